"""Queries over frames, taps, captures and sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import baseline, events, ingest, scan, sequence
from .views import clips, frames, read, sidecars, sql

Q: dict = {}
O: dict = {}

ENTER, LEAVE, N, COOLDOWN = 30.0, 10.0, 2, 5.0
TAP_SECONDS = 5 * 86_400


def query(oracle: str | None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            O[f.__name__] = oracle
        return f

    return add


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Frames with a percentile made from their value."""
    return frames(spark, d).withColumn("percentile", F.least(F.lit(100.0), F.col("raw") / 2))


RANKED = "ranked AS MATERIALIZED (SELECT *, least(100.0::DOUBLE, raw / 2) AS percentile FROM frames)"
POLICY = """fold AS (
  SELECT stream_id, seq, t, CASE WHEN percentile >= 30 THEN 'SUSPECT' ELSE 'LISTENING' END AS state, CASE WHEN percentile >= 30 THEN 1 ELSE 0 END AS streak, 0.0::DOUBLE AS cd FROM ranked WHERE seq = 0
  UNION ALL
  SELECT r.stream_id, r.seq, r.t,
    CASE WHEN f.state = 'ALERT' THEN CASE WHEN r.percentile >= 10 THEN 'ALERT' ELSE 'LISTENING' END WHEN r.percentile < 30 THEN 'LISTENING'
         WHEN f.state = 'SUSPECT' AND f.streak + 1 >= 2 AND r.t >= f.cd THEN 'ALERT' ELSE 'SUSPECT' END,
    CASE WHEN f.state = 'ALERT' THEN CASE WHEN r.percentile >= 10 THEN f.streak ELSE 0 END WHEN r.percentile < 30 THEN 0 ELSE f.streak + 1 END,
    CASE WHEN f.state = 'ALERT' AND r.percentile < 10 THEN r.t + 5 ELSE f.cd END
  FROM fold f JOIN ranked r ON r.stream_id = f.stream_id AND r.seq = f.seq + 1)"""


def states_of(spark, d) -> DataFrame:
    return sequence.alert_states(ranked(spark, d), n=N, enter=ENTER, leave=LEAVE, cooldown=COOLDOWN)


@query(sql("SELECT stream_id, seq, t, state FROM fold", RANKED, POLICY, recursive=True))
def alert_states(spark, d):
    return states_of(spark, d)


@query(sql("SELECT stream_id, seq, t, state FROM fold", RANKED, POLICY, recursive=True))
def alerts_in_slices(spark, d):
    return scan.fold_in_slices(ranked(spark, d), "stream_id", ["seq", "t"], scan.Alerts(n=N, enter=ENTER, leave=LEAVE, cooldown=COOLDOWN))


@query(sql("SELECT stream_id, seq, t, state FROM (SELECT *, lag(state) OVER (PARTITION BY stream_id ORDER BY seq) AS p FROM fold) WHERE p IS DISTINCT FROM state", RANKED, POLICY, recursive=True))
def state_changes(spark, d):
    return sequence.state_changes(states_of(spark, d)).drop("previous")


@query(sql("SELECT stream_id, seq, t, state FROM fold WHERE state IN ('SUSPECT', 'ALERT')", RANKED, POLICY, recursive=True))
def gated_evidence(spark, d):
    from ..operators.evidence import gated

    return gated(states_of(spark, d))


@query(sql("SELECT stream_id, seq, round(ema, 6) AS ema FROM e", "fr AS MATERIALIZED (SELECT stream_id, seq, raw FROM frames)",
           "e AS (SELECT stream_id, seq, raw AS ema FROM fr WHERE seq = 0 UNION ALL SELECT f.stream_id, f.seq, 0.3::DOUBLE * f.raw + 0.7::DOUBLE * e.ema FROM e JOIN fr f ON f.stream_id = e.stream_id AND f.seq = e.seq + 1)", recursive=True))
def ema_scores(spark, d):
    return sequence.ema_scores(frames(spark, d)).withColumn("ema", F.round("ema", 6))


@query(sql("SELECT stream_id, seq, round(ema, 6) AS ema FROM e", "fr AS MATERIALIZED (SELECT stream_id, seq, raw FROM frames)",
           "e AS (SELECT stream_id, seq, raw AS ema FROM fr WHERE seq = 0 UNION ALL SELECT f.stream_id, f.seq, 0.3::DOUBLE * f.raw + 0.7::DOUBLE * e.ema FROM e JOIN fr f ON f.stream_id = e.stream_id AND f.seq = e.seq + 1)", recursive=True))
def ema_in_slices(spark, d):
    return scan.fold_in_slices(frames(spark, d), "stream_id", ["seq"], scan.Smooth()).withColumn("ema", F.round("ema", 6))


@query(sql("SELECT stream_id, seq, (sum((percentile >= 30)::INT) OVER (PARTITION BY stream_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS streak FROM (SELECT *, sum((percentile < 30)::INT) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM ranked)", RANKED))
def hot_streaks(spark, d):
    return sequence.hot_streaks(ranked(spark, d), ENTER)


@query(sql("SELECT stream_id, seq, (sum((percentile >= 30)::INT) OVER (PARTITION BY stream_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS streak FROM (SELECT *, sum((percentile < 30)::INT) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM ranked)", RANKED))
def streaks_in_slices(spark, d):
    return scan.fold_in_slices(ranked(spark, d), "stream_id", ["seq"], scan.Streak(ENTER))


@query(sql("SELECT stream_id, seq, t, line FROM k WHERE shown",
           "cards AS MATERIALIZED (SELECT stream_id, seq, seq * 0.7::DOUBLE AS t, kind AS line FROM frames)",
           """k AS (SELECT stream_id, seq, t, line, true AS shown, t AS at, line AS card FROM cards WHERE seq = 0
           UNION ALL SELECT c.stream_id, c.seq, c.t, c.line, c.line <> k.card AND c.t - k.at >= 2, CASE WHEN c.line <> k.card AND c.t - k.at >= 2 THEN c.t ELSE k.at END, CASE WHEN c.line <> k.card AND c.t - k.at >= 2 THEN c.line ELSE k.card END
           FROM k JOIN cards c ON c.stream_id = k.stream_id AND c.seq = k.seq + 1)""", recursive=True))
def card_throttle(spark, d):
    return sequence.throttled_cards(frames(spark, d).select("stream_id", "seq", (F.col("seq") * F.lit(0.7)).alias("t"), F.col("kind").alias("line")))


@query(sql("SELECT stream_id, (seq - 2)::BIGINT AS window_no, t AS t_end, vals AS \"values\" FROM (SELECT stream_id, seq, t, list(raw) OVER (PARTITION BY stream_id ORDER BY seq ROWS 2 PRECEDING) AS vals FROM frames) WHERE seq >= 2"))
def sliding_windows(spark, d):
    return sequence.sliding_windows(frames(spark, d))


HELD = "held AS (SELECT *, CASE WHEN seq % 5 = 4 THEN 'calib' ELSE 'train' END AS part FROM frames WHERE seq < 28)"


def held_of(spark, d) -> DataFrame:
    return baseline.calib_holdout(frames(spark, d).where("seq < 28"))


@query(sql("SELECT stream_id, seq, part, seq AS i FROM held", HELD))
def calib_holdout(spark, d):
    return held_of(spark, d).select("stream_id", "seq", "part", "i")


@query(sql("SELECT f.stream_id, f.seq, 100.0::DOUBLE * count(*) FILTER (c.raw <= f.raw) / count(*) AS percentile FROM frames f JOIN held c ON f.stream_id = c.stream_id AND c.part = 'calib' WHERE f.seq >= 28 GROUP BY f.stream_id, f.seq", HELD))
def calib_percentile(spark, d):
    return baseline.calib_percentile(frames(spark, d).where("seq >= 28"), baseline.calibration(held_of(spark, d))).select("stream_id", "seq", "percentile")


@query(sql("SELECT f.stream_id, f.seq, 100.0::DOUBLE * count(*) FILTER (c.raw <= f.raw) / count(*) AS percentile FROM frames f JOIN held c ON f.stream_id = c.stream_id AND c.part = 'calib' WHERE f.seq >= 28 GROUP BY f.stream_id, f.seq", HELD))
def calib_percentile_by_rank(spark, d):
    return baseline.percentile_by_rank(frames(spark, d).where("seq >= 28"), held_of(spark, d).where("part = 'calib'"), "stream_id", "raw").select("stream_id", "seq", "percentile")


@query(sql("SELECT stream_id, max(t) AS t, arg_max(raw, seq) AS raw FROM frames GROUP BY stream_id"))
def latest_score(spark, d):
    return sequence.latest(frames(spark, d))


@query(sql("SELECT stream_id, arrival, reason FROM (SELECT *, CASE WHEN NOT percentile BETWEEN 0 AND 100 THEN 'range' WHEN t < max(t) OVER (PARTITION BY stream_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'late' END AS reason FROM (SELECT stream_id, seq AS arrival, CASE WHEN event_id % 13 = 0 THEN t - 3 ELSE t END AS t, raw / 4 AS percentile FROM frames)) WHERE reason IS NOT NULL"))
def late_rows(spark, d):
    rows = frames(spark, d).select("stream_id", F.col("seq").alias("arrival"), F.when(F.col("event_id") % 13 == 0, F.col("t") - 3).otherwise(F.col("t")).alias("t"), (F.col("raw") / 4).alias("percentile"))
    return sequence.late_rows(rows).select("stream_id", "arrival", "reason")


@query(sql(f"SELECT t.event_id AS tap_id, t.stream_id, count(*) AS frames, min(f.ts) AS first_ts, max(f.ts) AS last_ts, round(sum(f.raw), 6) AS total FROM frames t JOIN frames f ON t.stream_id = f.stream_id AND t.kind = 'purchase' AND f.ts BETWEEN t.ts - INTERVAL {TAP_SECONDS} SECONDS AND t.ts GROUP BY ALL"))
def tap_evidence(spark, d):
    f = frames(spark, d)
    return events.tap_evidence(f.where("kind = 'purchase'"), f, TAP_SECONDS)


@query(sql("SELECT stream_id, seq, round(list_sum(ring), 6) AS total, len(ring) AS n FROM (SELECT stream_id, seq, list(raw) OVER (PARTITION BY stream_id ORDER BY seq ROWS 9 PRECEDING) AS ring FROM frames)"))
def ring_buffer(spark, d):
    return events.last_frames(frames(spark, d)).select("stream_id", "seq", F.round(F.aggregate("ring", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("ring").cast("long").alias("n"))


@query(sql("SELECT stream_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum((p IS NULL OR ts > p + INTERVAL 43200 SECONDS)::INT) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS p FROM frames)) GROUP BY stream_id, s"))
def idle_sessions(spark, d):
    return events.idle_sessions(frames(spark, d), 43_200)


SPANS = "spans AS (SELECT stream_id, event_id * 100 AS start, event_id * 100 + (seq % 7) * 900 AS \"end\" FROM frames)"


@query(sql("SELECT stream_id, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM (SELECT *, sum((reach IS NULL OR start - reach > 2000)::INT) OVER (PARTITION BY stream_id ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, max(\"end\") OVER (PARTITION BY stream_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)) GROUP BY stream_id, run", SPANS))
def coalesce_spans(spark, d):
    spans = frames(spark, d).select("stream_id", (F.col("event_id") * 100).alias("start"), (F.col("event_id") * 100 + F.col("seq") % 7 * 900).alias("end"))
    return events.coalesce_spans(spans, 2000, ["stream_id"])


@query(sql("SELECT stream_id, event_id, local_header_offset AS start, coalesce(lead(local_header_offset) OVER (PARTITION BY stream_id ORDER BY local_header_offset), 10000000) AS \"end\" FROM (SELECT stream_id, event_id, event_id * 100 AS local_header_offset FROM frames)"))
def member_spans(spark, d):
    m = frames(spark, d).select("stream_id", "event_id", (F.col("event_id") * 100).alias("local_header_offset"), F.lit(10_000_000).cast("long").alias("total"))
    return events.member_spans(m, ["stream_id"], "total").select("stream_id", "event_id", "start", "end")


def chunks_of(spark, d) -> DataFrame:
    """Captures of chunks with a size and a time of arrival."""
    return frames(spark, d).select("stream_id", "seq", (F.col("event_id") % 50 * 641 + 1000).alias("n_bytes"), (F.col("seq") * F.lit(0.5) + F.col("event_id") % 3 * 0.125).alias("at"))


CHUNKS = "chunks AS MATERIALIZED (SELECT stream_id, seq, event_id % 50 * 641 + 1000 AS n_bytes, seq * 0.5::DOUBLE + event_id % 3 * 0.125::DOUBLE AS arrived FROM frames)"


@query(sql("SELECT stream_id, n_bytes, (e // 32000 + (e % 32000 >= 16000)::INT)::BIGINT AS n_frames, (e % 32000 >= 16000)::BIGINT AS padded FROM (SELECT stream_id, sum(n_bytes)::BIGINT AS n_bytes, (sum(n_bytes)::BIGINT // 2 * 2) AS e FROM chunks GROUP BY stream_id)", CHUNKS))
def exact_frames(spark, d):
    return events.exact_frames(chunks_of(spark, d))


@query(sql("""SELECT stream_id, round(est, 6) AS estimate, CASE WHEN abs(est - 16000) / 16000 > 0.2 THEN (SELECT arg_min(r, (abs(r - est), r)) FROM (VALUES (8000), (16000), (22050), (32000), (44100), (48000)) x(r))::BIGINT ELSE 16000 END AS rate
  FROM (SELECT stream_id, CASE WHEN max(arrived) - min(arrived) >= 3 THEN (sum(n_bytes) - arg_min(n_bytes, (arrived, seq))) / (max(arrived) - min(arrived)) / 2 END AS est FROM chunks GROUP BY stream_id)""", CHUNKS))
def rate_estimate(spark, d):
    return events.rate_estimate(chunks_of(spark, d), 16_000)


@query(sql("SELECT stream_id AS capture_id, max(tot)::BIGINT AS n_bytes, max(tot) / 32000.0::DOUBLE AS seconds, count(*) FILTER (ok) AS n_accepted, count(*) FILTER (NOT ok) AS n_refused FROM cf GROUP BY stream_id", CHUNKS,
           """cf AS (SELECT stream_id, seq, n_bytes % 2 = 0 AND n_bytes <= 400000 AS ok, CASE WHEN n_bytes % 2 = 0 AND n_bytes <= 400000 THEN n_bytes ELSE 0 END AS tot FROM chunks WHERE seq = 0
           UNION ALL SELECT c.stream_id, c.seq, c.n_bytes % 2 = 0 AND f.tot + c.n_bytes <= 400000 AND (f.tot + c.n_bytes) / 32000.0 <= 12, CASE WHEN c.n_bytes % 2 = 0 AND f.tot + c.n_bytes <= 400000 AND (f.tot + c.n_bytes) / 32000.0 <= 12 THEN f.tot + c.n_bytes ELSE f.tot END
           FROM cf f JOIN chunks c ON c.stream_id = f.stream_id AND c.seq = f.seq + 1)""", recursive=True))
def capture_totals(spark, d):
    return sequence.capture_totals(chunks_of(spark, d).withColumnRenamed("stream_id", "capture_id"), max_bytes=400_000, max_seconds=12.0)


@query(sql("SELECT stream_id, seq FROM frames WHERE (event_id % 40) / 10.0 <= 2.5"))
def fresh_frames(spark, d):
    return events.fresh_frames(frames(spark, d).withColumn("delay_s", F.col("event_id") % 40 / 10.0)).select("stream_id", "seq")


@query(sql("""SELECT stream_id, seq, CASE WHEN bytes IS NULL THEN 'not base64' WHEN octet_length(bytes) % 2 = 1 THEN 'odd' WHEN octet_length(bytes) > 16 THEN 'too long' ELSE 'ok' END AS verdict FROM (
    SELECT stream_id, seq, CASE WHEN event_id % 9 <> 0 THEN from_base64(to_base64(encode(kind || event_id))) END AS bytes FROM frames)"""))
def frame_validation(spark, d):
    text = F.when(F.col("event_id") % 9 == 0, F.lit("*not base64*")).otherwise(F.base64(F.encode(F.concat("kind", F.col("event_id").cast("string")), "UTF-8")))
    from ..sources.wire import judge

    return judge(frames(spark, d).withColumn("pcm_b64", text), 16).select("stream_id", "seq", "verdict")


@query("SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events WHERE event_id % 17 <> 0")
def sidecar_json_parse(spark, d):
    from ..sources.sidecars import parse

    raw = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return parse(read(spark, d, "events").select("event_id", raw.alias("json")), "k long").select("event_id", "k")


# field recordings

ROWS = """rw AS (SELECT doc_id, machine_type, CASE WHEN trim(coalesce(condition, '')) <> '' THEN trim(condition) WHEN trim(suspected_fault) <> '' THEN suspected_fault ELSE 'unknown' END AS condition, site_tag, contains_speech,
  CASE WHEN n_samples > 0 THEN n_samples / 16000.0::DOUBLE ELSE 0 END AS duration_s, peak_abs, clipped FROM sidecars),
fl AS (SELECT * REPLACE (clipped OR peak_abs >= 0.999 AS clipped), duration_s < 3 AS short, NOT contains_speech AS export_eligible FROM rw)"""


def flags_of(spark, d) -> DataFrame:
    return ingest.ingest_flags(ingest.ingest_rows(sidecars(spark, d)))


@query(sql("SELECT * FROM rw", ROWS))
def ingest_rows(spark, d):
    return ingest.ingest_rows(sidecars(spark, d))


@query(sql("SELECT * FROM fl", ROWS))
def ingest_flags(spark, d):
    return flags_of(spark, d)


@query(sql("SELECT doc_id, machine_type, site_tag FROM fl WHERE export_eligible", ROWS))
def export_eligible(spark, d):
    return flags_of(spark, d).where("export_eligible").select("doc_id", "machine_type", "site_tag")


@query(sql("SELECT CASE WHEN grouping(machine_type) = 0 THEN 'machine_type' WHEN grouping(condition) = 0 THEN 'condition' ELSE 'site_tag' END AS field, coalesce(machine_type, condition, site_tag) AS value, count(*) AS clips, round(sum(duration_s) / 60, 6) AS minutes FROM fl GROUP BY GROUPING SETS ((machine_type), (condition), (site_tag))", ROWS))
def ingest_summary(spark, d):
    return ingest.ingest_summary(flags_of(spark, d))


@query(sql("SELECT count(*) AS clips, round(sum(duration_s) / 60, 6) AS minutes, count(*) FILTER (contains_speech) AS speech, count(*) FILTER (short) AS short, count(*) FILTER (clipped) AS clipped FROM fl", ROWS))
def ingest_totals(spark, d):
    return ingest.ingest_totals(flags_of(spark, d))


@query(sql("SELECT r.doc_id, r.machine_type, r.site_tag, round(r.duration_s, 6) AS duration_s, r.clipped OR r.peak_abs >= 0.999 OR r.doc_id % 29 = 0 AS clipped, r.contains_speech AS public_dataset_default_excluded FROM rw r", ROWS))
def label_rows(spark, d):
    return ingest.label_rows(sidecars(spark, d).withColumn("client_clipped", F.when(F.col("doc_id") % 29 == 0, True)))


@query(sql("SELECT doc_id, CASE WHEN n = 0 THEN base ELSE base || '_' || n END AS stem FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id // 40, doc_id) - 1 AS n FROM (SELECT doc_id, site_tag || '_' || strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds(doc_id // 40), '%Y%m%d_%H%M%S') AS base FROM sidecars))"))
def unique_stems(spark, d):
    at = F.timestamp_seconds(F.lit(1767225600) + F.floor(F.col("doc_id") / 40))
    return events.unique_stems(sidecars(spark, d).select("doc_id", F.col("site_tag").alias("tag"), at.alias("created_at")))


RAW_TAG = "CASE doc_id % 4 WHEN 0 THEN ' ' || source || '/../x' WHEN 1 THEN '  ' WHEN 2 THEN source || '.wav' ELSE repeat(source || '-', 20) END"


@query(f"""SELECT doc_id, CASE WHEN t <> '' THEN t ELSE 'unlabeled' END AS site_tag, CASE WHEN t <> '' THEN substr(t, 1, 48) ELSE 'capture' END AS capture_tag, regexp_full_match(raw, '[A-Za-z0-9._-]+') AS valid
  FROM (SELECT doc_id, raw, regexp_replace(raw, '[^A-Za-z0-9._-]', '', 'g') AS t FROM (SELECT doc_id, {RAW_TAG} AS raw FROM documents))""")
def sanitize_tags(spark, d):
    m = F.col("doc_id") % 4
    raw = F.when(m == 0, F.concat(F.lit(" "), "source", F.lit("/../x"))).when(m == 1, "  ").when(m == 2, F.concat("source", F.lit(".wav"))).otherwise(F.repeat(F.concat("source", F.lit("-")), F.lit(20)))
    return read(spark, d, "documents").select("doc_id", raw.alias("raw")).select("doc_id", S.sanitize(F.col("raw"), "unlabeled").alias("site_tag"), S.sanitize(F.col("raw"), "capture", 48).alias("capture_tag"), F.col("raw").rlike(S.TAG).alias("valid"))


@query(sql("""SELECT vec_id, CASE WHEN ok THEN p[-3] END AS machine_id, CASE WHEN ok THEN p[-2] END AS condition, CASE WHEN ok THEN p[-1] END AS filename FROM (
    SELECT vec_id, p, len(p) >= 4 AND starts_with(coalesce(p[-3], ''), 'id_') AND p[-2] IN ('normal', 'abnormal') AND ends_with(lower(p[-1]), '.wav') AS ok FROM (
      SELECT vec_id, string_split(CASE vec_id % 4 WHEN 0 THEN path WHEN 1 THEN upper(path) WHEN 2 THEN replace(path, '0dB/', '') ELSE substr(path, 12) END, '/') AS p FROM clips))"""))
def path_keys(spark, d):
    m, p = F.col("vec_id") % 4, F.col("path")
    name = F.when(m == 0, p).when(m == 1, F.upper(p)).when(m == 2, F.replace(p, F.lit("0dB/"), F.lit(""))).otherwise(F.expr("substring(path, 12)"))
    return clips(spark, d).withColumn("name", name).select("vec_id", *[c.alias(k) for k, c in S.member_keys(F.col("name")).items()])


@query(sql("""SELECT vec_id, CASE WHEN ok THEN p[1] END AS machine, CASE WHEN ok THEN p[2] END AS machine_id, coalesce(ok, false) AND count(*) OVER (PARTITION BY token) > 1 AS duplicate FROM (
    SELECT vec_id, token, p, len(p) = 2 AND p[1] <> '' AND coalesce(p[2], '') <> '' AS ok FROM (SELECT vec_id, token, string_split(token, ':') AS p FROM (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN machine || ':' || machine_id WHEN 1 THEN machine || ':' ELSE machine || ':a:' || vec_id END AS token FROM clips)))"""))
def id_tokens(spark, d):
    from pyspark.sql import Window as W

    m = F.col("vec_id") % 3
    token = F.when(m == 0, F.concat_ws(":", "machine", "machine_id")).when(m == 1, F.concat("machine", F.lit(":"))).otherwise(F.concat("machine", F.lit(":a:"), F.col("vec_id").cast("string")))
    rows = clips(spark, d).select("vec_id", token.alias("token"))
    keys = S.id_token(F.col("token"))
    return rows.select("vec_id", keys["machine"].alias("machine"), keys["machine_id"].alias("machine_id"), (keys["machine"].isNotNull() & (F.count(F.lit(1)).over(W.partitionBy("token")) > 1)).alias("duplicate"))


@query(sql("SELECT site_tag AS tag, count(*) AS n FROM sidecars GROUP BY site_tag"))
def baseline_tags(spark, d):
    from ..sources.stores import tags

    s = sidecars(spark, d).withColumnRenamed("site_tag", "tag")
    return tags(s).join(s.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), "tag").orderBy("tag")


@query(sql("""SELECT stream_id, seq, CASE shown WHEN 'SUSPECT' THEN 'Suspect P' || p WHEN 'ALERT' THEN 'ALERT P' || p WHEN 'CAPTURING_BASELINE' THEN 'Learning baseline ' || greatest(0, ceil(30 - t))::BIGINT || ' s' ELSE 'Listening' END AS line1,
    CASE WHEN shown IN ('SUSPECT', 'ALERT') THEN CASE WHEN ev = '' THEN 'tap to log' ELSE rtrim(substr(ev, 1, 47)) || ' | tap to log' END WHEN shown = 'CAPTURING_BASELINE' THEN 'keep the machine running normally' ELSE '' END AS line2
  FROM (SELECT *, CASE seq % 5 WHEN 0 THEN 'SUSPECT' WHEN 1 THEN 'ALERT' WHEN 2 THEN 'CAPTURING_BASELINE' ELSE 'LISTENING' END AS shown, floor(percentile + 0.5)::BIGINT AS p, trim(repeat(kind || ' ', (seq % 9)::INT)) AS ev FROM ranked)""", RANKED))
def display_cards(spark, d):
    """States as they come over the wire, unknown and missing ones among them."""
    m = F.col("seq") % 5
    state = F.when(m == 0, "SUSPECT").when(m == 1, "ALERT").when(m == 2, "CAPTURING_BASELINE").when(m == 3, "REBOOTING")
    rows = ranked(spark, d).withColumns({"state": S.wire_state(state), "ev": F.repeat(F.concat("kind", F.lit(" ")), (F.col("seq") % 9).cast("int"))})
    lines = S.card_lines(F.col("state"), F.col("percentile"), F.col("ev"), 30 - F.col("t"))
    return rows.select("stream_id", "seq", *[c.alias(k) for k, c in lines.items()])
