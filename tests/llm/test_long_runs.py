"""Candidates of the secret scan in long runs, and its figures against plain Python."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from rotorlake.llm import secrets_scan as s

NONE = np.zeros(s.BINS, bool)


@pytest.mark.parametrize("text", [b"A1b" * 700_000, b"token=" * 100_000, b"x " * 10 + b"ab.c" * 500_000, b'token="' * 5_000, b"password: " + b"." * 1_000_000, b"token" + b" " * 1_000_000 + b"= v1", b"://" * 300_000, b"://a:" * 200_000, b'secret="' + b"\\a" * 500_000])
def test_time_is_linear(text):
    at = time.perf_counter()
    found = sorted(s.spans(text))
    by_end = {}
    for a, z in found:
        by_end.setdefault(z, []).append(a)
    for z, starts in by_end.items():
        s.figures(np.frombuffer(text, np.uint8)[starts[0] : z], [a - starts[0] for a in starts], NONE)
    assert time.perf_counter() - at < 3


def plain(data, usual):
    n = len(data)
    kind = [0 if 48 <= b < 58 else 1 if 65 <= b < 91 else 2 if 97 <= b < 123 else 3 for b in data]
    moves = Counter(zip(kind, kind[1:]))
    bins, ok = s.pieces(np.frombuffer(data, np.uint8))
    longest = max((len(m) for m in re.findall(rb"[A-Za-z\x80-\xff]+", data)), default=0)
    return [n, *(kind.count(k) / n for k in range(4)), *(moves[a, b] / max(1, n - 1) for a in range(4) for b in range(4)), -sum(c / n * math.log2(c / n) for c in Counter(data).values()), sum(b in b"0123456789abcdefABCDEF" for b in data) / n, longest / n, float((usual[bins] * ok).sum()) / max(1, n - 3)]


def test_figures_of_nested_values_against_plain_python():
    rng = random.Random(6)
    usual = np.random.default_rng(1).random(s.BINS) < 0.5
    for _ in range(200):
        data = bytes(rng.choice(b"abcDEF019_-=\xc3\xb6 ") for _ in range(rng.randint(1, 60)))
        starts = sorted({0, *(rng.randrange(len(data)) for _ in range(rng.randint(0, 4)))})
        got = s.figures(np.frombuffer(data, np.uint8), starts, usual)
        for row, a in zip(got, starts, strict=True):
            assert np.allclose(row, plain(data[a:], usual))


def test_foreign_words_say_nothing(spark, make):
    rng = random.Random(7)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    syllables = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiouäöüéáíóú") for _ in range(rng.randint(2, 4)))
    rows, secret = [], {}
    for i in range(120):
        value, before = hexed(), " ".join(syllables() for _ in range(8))
        name = rng.choice(["token = ", "password: ", "api_key=", "secret = "]) if i % 2 else rng.choice(["commit ", "sha1 ", "checksum: ", "digest "])
        rows.append((i, f"{before} {name}{value} {syllables()} {syllables()}", rng.choice(["de", "fr", "es"]), rng.choice(["web", "forum", None])))
        secret[i] = bool(i % 2)
    got = {r.doc_id: r.is_secret for r in s.scan(make(rows)).where("length = 40").collect()}
    assert sum(got[i] == secret[i] for i in secret) >= 118 and all(got[i] for i in secret if secret[i])
