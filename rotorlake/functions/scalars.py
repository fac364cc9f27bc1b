"""Column expressions for tags, paths, levels, PCM, labels and display text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"^[A-Za-z0-9._-]+$"
SHORT_S, CLIPPED_PEAK, LIVE_CLIP = 3.0, 0.999, 0.98
SUMMARY_CHARS = 60


def nonempty(c: Column, fallback: Column) -> Column:
    """The trimmed text, or the fallback if nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t).otherwise(fallback)


def sanitize(c: Column, default: str, most: int | None = None) -> Column:
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]", "")
    kept = F.substring(kept, 1, most) if most else kept
    return F.when(kept != "", kept).otherwise(default)


def member_keys(name: Column) -> dict[str, Column]:
    """machine_id, condition and filename of an archive member; all null if it is not a clip."""
    parts = F.split(name, "/")
    machine_id, condition, filename = (F.try_element_at(parts, F.lit(k)) for k in (-3, -2, -1))
    ok = (F.size(parts) >= 4) & machine_id.startswith("id_") & condition.isin("normal", "abnormal") & F.lower(filename).endswith(".wav")
    return {"machine_id": F.when(ok, machine_id), "condition": F.when(ok, condition), "filename": F.when(ok, filename)}


def id_token(token: Column) -> dict[str, Column]:
    """machine and id of ``machine:id``; null unless there is exactly one colon with text on both sides."""
    parts = F.split(token, ":")
    ok = (F.size(parts) == 2) & (F.length(parts[0]) > 0) & (F.length(F.try_element_at(parts, F.lit(2))) > 0)
    return {"machine": F.when(ok, parts[0]), "machine_id": F.when(ok, F.try_element_at(parts, F.lit(2)))}


def condition_label(condition: Column, suspected_fault: Column) -> Column:
    return nonempty(condition, nonempty(suspected_fault, F.lit("unknown")))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once; what a lambda takes from outside as an expression is worked out again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def power(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def unit(x: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    return bound(F.sqrt(dot(x, x)), lambda n: F.transform(x, lambda v: F.when(n == 0, F.lit(0.0)).otherwise(v / n)))


def cosine_distance(x: Column, y: Column) -> Column:
    """1 - cosine of unit vectors, within 0..2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(x, y)))


def pcm16(x: Column) -> Column:
    """Samples in -1..1 as 16-bit integers, rounding half up and clamping."""
    return F.transform(x, lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(v * 32768 + 0.5))).cast("long"))


def pcm16_asymmetric(x: Column) -> Column:
    """Samples clamped to -1..0.999969, then scaled by 32768 below zero and 32767 above, cut towards zero."""
    clamped = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(0.999969), v))
    return F.transform(x, lambda v: (clamped(v) * F.when(v < 0, 32768).otherwise(32767)).cast("long"))


def mono(x: Column, channels: int) -> Column:
    """Mean over the channels of interleaved samples; a partial last frame is dropped."""
    n = F.floor(F.size(x) / channels).cast("int")
    frames = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # sums start at -0.0, which leaves the sign of every first sample as it is
    return F.transform(frames, lambda i: F.aggregate(F.slice(x, i * channels + 1, channels), F.lit(-0.0), lambda a, v: a + v) / channels)


def resample(x: Column, src: int, dst: int) -> Column:
    """Linear interpolation from one rate to another; the right neighbour stops at the last sample."""
    n = F.floor(F.size(x) * (dst / src) + 0.5).cast("int")
    at = lambda i: F.least(F.lit(1.0) * i * src / dst, F.size(x) - F.lit(1.0))

    def value(i: Column) -> Column:
        left = F.floor(at(i)).cast("int")
        a, b = F.get(x, left), F.get(x, F.least(left + 1, F.size(x) - 1))
        return a + (b - a) * (at(i) - left)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<double>"))


def peak_label(hz: Column, rpm: Column) -> Column:
    """What a peak of the envelope spectrum suggests, first match first."""
    shaft = rpm / 60
    return F.when(F.abs(hz - 120) <= 3, "line hum").when(rpm.isNotNull() & (F.abs(hz - shaft) <= F.greatest(F.lit(3.0), 0.05 * shaft)), "1x rotation").otherwise("impulse train")


def band_phrase(lo: Column, hi: Column, delta: Column) -> Column:
    centre = (lo + hi) / 2
    name = F.when(centre < 500, "low").when(centre <= 2000, "mid").otherwise("high")
    return F.concat(name, F.lit("-band energy "), F.when(delta >= 0, "up").otherwise("down"))


def clamp_text(c: Column, most: int = SUMMARY_CHARS) -> Column:
    cut = F.substring(c, 1, most)
    return F.when(F.length(c) > most, F.rtrim(cut, F.lit(", "))).otherwise(c)


def summary(label: Column, hz: Column, phrase: Column) -> Column:
    """One line from the strongest peak (null: none) and the strongest band."""
    with_peak = F.concat(label, F.lit(" ~"), F.floor(hz + 0.5).cast("long").cast("string"), F.lit(" Hz, "), phrase)
    return clamp_text(F.when(label.isNotNull(), with_peak).otherwise(F.concat(phrase, F.lit(" vs baseline"))))


def wire_state(state: Column) -> Column:
    """The state to show for one that came over the wire: what is unknown or missing is shown as listening."""
    return F.when(state.isin("CAPTURING_BASELINE", "SUSPECT", "ALERT"), state).otherwise("LISTENING")


def card_lines(state: Column, percentile: Column, evidence: Column, remaining: Column) -> dict[str, Column]:
    """Two lines of at most 60 characters for every state of a session; unknown and null states show nothing.

    Evidence is cut so that the hint behind it stays whole; without evidence the hint stands alone.  A percentile or
    a remaining time that is null or not finite is left out.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rank = F.when(finite(percentile), F.concat(F.lit(" P"), F.floor(percentile + 0.5).cast("long").cast("string"))).otherwise("")
    left = F.when(finite(remaining), F.concat(F.lit(" "), F.ceil(F.greatest(F.lit(0.0), remaining)).cast("long").cast("string"), F.lit(" s"))).otherwise("")
    hint = " | tap to log"
    told = F.trim(F.coalesce(evidence, F.lit("")))
    because = F.when(told == "", hint[3:]).otherwise(F.concat(F.rtrim(F.substring(told, 1, SUMMARY_CHARS - len(hint))), F.lit(hint)))
    first = (
        F.when(state == "LISTENING", "Listening")
        .when(state == "CAPTURING_BASELINE", F.concat(F.lit("Learning baseline"), left))
        .when(state == "SUSPECT", F.concat(F.lit("Suspect"), rank))
        .when(state == "ALERT", F.concat(F.lit("ALERT"), rank))
        .when(state == "LOGGED", "Logged")
        .when(state == "OFFLINE", "Engine offline")
        .otherwise("")
    )
    second = F.when(state.isin("SUSPECT", "ALERT"), because).when(state == "CAPTURING_BASELINE", "keep the machine running normally").when(state == "OFFLINE", "check the connection").otherwise("")
    return {"line1": F.substring(first, 1, SUMMARY_CHARS), "line2": F.substring(second, 1, SUMMARY_CHARS)}


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; the bare file name for paths outside it."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(F.element_at(F.split(path, "/"), -1))
