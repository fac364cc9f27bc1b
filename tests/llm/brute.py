"""Plain Python versions of what the operators compute."""

import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACED.findall(text or "")


def alnum(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def quality(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(rows):
    """(doc_id, class_id, n_links) of rows (doc_id, text), all pairs compared through an inverted index."""
    sets = [shingles(t) for _, t in rows]
    root, links, index = list(range(len(rows))), Counter(), defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j in {j for x in s for j in index[x]}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, least[find(i)], links[i]) for i, (k, _) in enumerate(rows) if k is not None)


def contaminated(docs, items, least=13, share=0.8):
    """(doc_id, item_id) with a stretch of enough matching words on some diagonal, all diagonals tried."""
    out = set()
    its = [(i, alnum(t)) for i, t in items if alnum(t)]
    index = defaultdict(list)
    for i, w in its:
        for p, x in enumerate(w):
            index[x].append((i, p))
    words_of = dict(its)
    for d, t in docs:
        if d is None:
            continue
        w = alnum(t)
        diagonals = Counter((i, q - p) for q, x in enumerate(w) for i, p in index.get(x, ()))
        for (i, g), n in diagonals.items():
            item = words_of[i]
            need = least if len(item) >= least else max(1, -(-len(item) * 9 // 10))
            if n < need:
                continue
            # every stretch that begins and ends at a match
            at = [p for p in range(max(0, -g), min(len(item), len(w) - g)) if w[p + g] == item[p]]
            if any(k + 1 >= need and k + 1 >= share * (z - p + 1) - 1e-9 for a, p in enumerate(at) for k, z in enumerate(at[a:])):
                out.add((d, i))
    return out
