"""Queries over whole sessions: baseline to scores, degraded rerun, timed cards, frames cut from chunks, card states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import baseline, degraded as deg, events, metrics, scoring, sequence, session
from .queries_eval import AUC, split_of
from .queries_stream import CHUNKS, chunks_of
from .views import SCORES, SPLIT, clips, degraded, frames, sql

Q: dict = {}
O: dict = {}

BASELINE_WINDOWS = 28


def query(oracle: str):
    def add(f):
        Q[f.__name__] = f
        O[f.__name__] = oracle
        return f

    return add


def windows_of(spark, d) -> DataFrame:
    """stream_id, seq, t, values of windows of three frames, one frame apart."""
    return sequence.sliding_windows(frames(spark, d)).select("stream_id", F.col("window_no").alias("seq"), F.col("t_end").alias("t"), "values")


SESSION = """win AS (SELECT stream_id, (seq - 2)::BIGINT AS seq, [a, b, c] AS v FROM (
    SELECT stream_id, seq, lag(raw, 2) OVER w AS a, lag(raw, 1) OVER w AS b, raw AS c FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY seq)) WHERE seq >= 2),
uw AS (SELECT stream_id, seq, list_transform(v, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END) AS u FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM win)),
big AS (SELECT stream_id FROM win WHERE seq < 28 GROUP BY stream_id HAVING count(*) >= 10),
sp AS (SELECT q.stream_id, q.seq, greatest(0, least(2, 1 - list_dot_product(q.u, t.u))) AS d, row_number() OVER (PARTITION BY q.stream_id, q.seq ORDER BY greatest(0, least(2, 1 - list_dot_product(q.u, t.u)))) AS rn
  FROM uw q JOIN uw t ON q.stream_id = t.stream_id AND t.seq < 28 AND t.seq % 5 <> 4 AND (q.seq >= 28 OR q.seq % 5 = 4) WHERE q.stream_id IN (SELECT stream_id FROM big)),
sc AS (SELECT stream_id, seq, round(sum(d) / 2, 9) AS raw FROM sp WHERE rn <= 2 GROUP BY ALL)"""


@query(sql("""SELECT l.stream_id, l.seq, any_value(l.raw) AS raw, 100.0::DOUBLE * count(*) FILTER (c.raw <= l.raw) / count(*) AS percentile
  FROM sc l JOIN sc c ON l.stream_id = c.stream_id AND c.seq < 28 WHERE l.seq >= 28 GROUP BY l.stream_id, l.seq""", SESSION))
def session_scores(spark, d):
    w = windows_of(spark, d)
    fitted = session.fit(w.where(F.col("seq") < BASELINE_WINDOWS))
    raw = session.raw_scores(w.where(F.col("seq") >= BASELINE_WINDOWS), fitted).withColumn("raw", F.round("raw", 9))
    calib = fitted.select("stream_id", F.transform("calib", lambda x: F.round(x, 9)).alias("calib"))
    return baseline.calib_percentile(raw, calib).select("stream_id", "seq", "raw", "percentile")


def _named(text: str, suffix: str) -> str:
    """The scores and AUC of another split, under names of their own."""
    for name in ("split", "unit", "pairs", "scores", "auc"):
        text = text.replace(f"{name} AS (", f"{name}{suffix} AS (").replace(f"FROM {name})", f"FROM {name}{suffix})").replace(f"FROM {name} ", f"FROM {name}{suffix} ").replace(f"JOIN {name} ", f"JOIN {name}{suffix} ")
    return text


RERUN = """split_d AS (SELECT s.vec_id, s.machine, s.machine_id, s.label, s.path, coalesce(g.v, s.v) AS v, s.split FROM split s LEFT JOIN degraded g ON s.path = g.path AND s.split <> 'train')"""


@query(sql("""SELECT condition, machine, round(avg(auc), 6) AS knn_auc, any_value(n_replaced) AS n_replaced, any_value(n_test) AS n_test FROM (
    SELECT 'clean' AS condition, machine, auc, 0::BIGINT AS n_replaced FROM auc
    UNION ALL SELECT 'reversed', machine, auc, (SELECT count(*) FROM split s JOIN degraded g ON s.path = g.path WHERE s.split <> 'train') FROM auc_d),
  (SELECT count(*) AS n_test FROM split WHERE split <> 'train') GROUP BY condition, machine""", SPLIT, SCORES, AUC, RERUN, _named(SCORES, "_d"), _named(AUC, "_d")))
def degraded_rerun(spark, d):
    """Test clips scored again from their degraded capture, by the baselines of the clean one; a stale result is replaced."""
    split = split_of(spark, d)
    swapped = deg.substitute(split, degraded(spark, d))

    def results(rows: DataFrame, condition: str) -> DataFrame:
        auc = metrics.auc(scoring.knn_scores_blocked(rows).withColumn("score", F.round("score", 9))).withColumn("auc", F.round("auc", 9)).groupBy("machine").agg(F.round(F.avg("auc"), 6).alias("knn_auc"))
        return auc.select(F.lit(condition).alias("condition"), "machine", "knn_auc")

    counts = deg.coverage(swapped)
    clean = results(split, "clean").crossJoin(counts.select(F.lit(0).cast("long").alias("n_replaced"), "n_test"))
    stale = clean.select(F.lit("reversed").alias("condition"), "machine", F.lit(0.0).alias("knn_auc"), "n_replaced", "n_test")
    new = results(swapped.drop("replaced"), "reversed").crossJoin(counts)
    return deg.upsert(clean.unionByName(stale), new)


@query(sql("SELECT vec_id, CASE WHEN starts_with(p, '0dB/fan/') THEN substr(p, 9) ELSE split_part(p, '/', -1) END AS key FROM (SELECT vec_id, path AS p FROM clips)"))
def relative_paths(spark, d):
    return clips(spark, d).select("vec_id", S.relative_path(F.col("path"), "0dB/fan").alias("key"))


CARDS = """cards AS MATERIALIZED (SELECT stream_id, seq, seq * 0.7::DOUBLE AS t, kind AS line, lead(seq * 0.7::DOUBLE) OVER (PARTITION BY stream_id ORDER BY seq) AS next_t FROM frames),
throttle AS (
  SELECT stream_id, seq, t, line AS shown, t AS shown_at, line AS pushed, NULL::VARCHAR AS flushed, NULL::DOUBLE AS flushed_at FROM cards WHERE seq = 0
  UNION ALL
  SELECT stream_id, seq, t, CASE WHEN flush THEN waiting ELSE shown1 END, CASE WHEN flush THEN at1 + 2 ELSE at1 END, pushed, CASE WHEN flush THEN waiting END, CASE WHEN flush THEN at1 + 2 END
  FROM (SELECT *, waiting IS NOT NULL AND (next_t IS NULL OR next_t > at1 + 2) AS flush FROM (
    SELECT c.stream_id, c.seq, c.t, c.next_t,
      CASE WHEN c.line <> h.shown AND c.t - h.shown_at >= 2 THEN c.line END AS pushed,
      CASE WHEN c.line <> h.shown AND c.t - h.shown_at >= 2 THEN c.line ELSE h.shown END AS shown1,
      CASE WHEN c.line <> h.shown AND c.t - h.shown_at >= 2 THEN c.t ELSE h.shown_at END AS at1,
      CASE WHEN c.line <> h.shown AND c.t - h.shown_at < 2 THEN c.line END AS waiting
    FROM throttle h JOIN cards c ON c.stream_id = h.stream_id AND c.seq = h.seq + 1)))"""


@query(sql("SELECT stream_id, t, pushed AS line FROM throttle WHERE pushed IS NOT NULL UNION ALL SELECT stream_id, flushed_at, flushed FROM throttle WHERE flushed IS NOT NULL", CARDS, recursive=True))
def timed_cards(spark, d):
    return sequence.timed_cards(frames(spark, d).select("stream_id", "seq", (F.col("seq") * F.lit(0.7)).alias("t"), F.col("kind").alias("line")))


@query(sql("""SELECT stream_id, frame_no, seq, greatest(a, frame_no * 32000) - a AS from_byte, least(z, (frame_no + 1) * 32000) - a AS to_byte FROM (
    SELECT *, unnest(range(a // 32000, (z - 1) // 32000 + 1)) AS frame_no FROM (
      SELECT stream_id, seq, a, least(a + n_bytes, even) AS z, even FROM (
        SELECT *, (sum(n_bytes) OVER (PARTITION BY stream_id ORDER BY seq) - n_bytes)::BIGINT AS a, (sum(n_bytes) OVER (PARTITION BY stream_id))::BIGINT // 2 * 2 AS even FROM chunks)) WHERE z > a)
  WHERE (frame_no + 1) * 32000 <= even OR even - frame_no * 32000 >= 16000""", CHUNKS))
def frame_pieces(spark, d):
    return events.frame_pieces(chunks_of(spark, d))


STATES = ["LISTENING", "CAPTURING_BASELINE", "SUSPECT", "ALERT", "LOGGED", "OFFLINE", "SOMETHING"]


@query(sql("""SELECT event_id, CASE k WHEN 0 THEN 'Listening' WHEN 1 THEN 'Learning baseline' || CASE WHEN rest IS NOT NULL THEN ' ' || ceil(greatest(0, rest))::BIGINT || ' s' ELSE '' END WHEN 2 THEN 'Suspect' || coalesce(' P' || floor(pc + 0.5)::BIGINT, '')
    WHEN 3 THEN 'ALERT' || coalesce(' P' || floor(pc + 0.5)::BIGINT, '') WHEN 4 THEN 'Logged' WHEN 5 THEN 'Engine offline' ELSE '' END AS line1,
  CASE k WHEN 1 THEN 'keep the machine running normally' WHEN 5 THEN 'check the connection' WHEN 2 THEN hint WHEN 3 THEN hint ELSE '' END AS line2
  FROM (SELECT *, CASE WHEN told = '' THEN 'tap to log' ELSE rtrim(substr(told, 1, 47)) || ' | tap to log' END AS hint FROM (
    SELECT event_id, event_id % 7 AS k, CASE WHEN event_id % 5 <> 0 THEN least(100, raw / 2) END AS pc, CASE WHEN event_id % 3 <> 0 THEN raw / 10 - 1 END AS rest,
      CASE WHEN event_id % 4 = 0 THEN '' ELSE rtrim(repeat(kind || ' ', (event_id % 9)::INT)) END AS told FROM frames))"""))
def card_states(spark, d):
    e = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, STATES)), (e % 7 + 1).cast("int"))
    percentile = F.when(e % 5 != 0, F.least(F.lit(100.0), F.col("raw") / 2)).otherwise(F.when(e % 2 == 0, F.lit(float("nan"))))
    evidence = F.when(e % 4 != 0, F.repeat(F.concat("kind", F.lit(" ")), (e % 9).cast("int")))
    rows = frames(spark, d).select("event_id", state.alias("s"), percentile.alias("p"), evidence.alias("e"), F.when(e % 3 != 0, F.col("raw") / 10 - 1).alias("r"))
    return rows.select("event_id", *[c.alias(n) for n, c in S.card_lines(F.col("s"), F.col("p"), F.col("e"), F.col("r")).items()])


@query(sql("SELECT event_id, CASE WHEN kind IN ('click', 'view') THEN 'LISTENING' WHEN event_id % 4 = 0 THEN 'SUSPECT' WHEN event_id % 4 = 1 THEN 'ALERT' WHEN event_id % 4 = 2 THEN 'CAPTURING_BASELINE' ELSE 'LISTENING' END AS shown FROM frames"))
def wire_states(spark, d):
    """States as they come over the wire, some unknown or missing, and what is shown for them."""
    known = F.element_at(F.array(*map(F.lit, ["SUSPECT", "ALERT", "CAPTURING_BASELINE", "LOGGED"])), (F.col("event_id") % 4 + 1).cast("int"))
    state = F.when(F.col("kind") == "click", "???").when(F.col("kind") == "view", F.lit(None)).otherwise(known)
    return frames(spark, d).select("event_id", S.wire_state(state).alias("shown"))
