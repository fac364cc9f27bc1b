"""Queries over clips: splits, scores, metrics, vectors, degraded capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import baseline, degraded as deg, evidence, metrics, scoring, splits
from ..operators.tables import written
from .views import SCORES, SPLIT, clips, degraded, sql

KEYS = ["machine", "machine_id"]
#: Published AUC of an autoencoder on the same machine types.
PUBLISHED = {"fan": 0.658, "pump": 0.729}

Q: dict = {}
O: dict = {}


def query(oracle: str | None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            O[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Columns rounded for comparing with SQL; operators give full precision."""
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def rounded_as_sql(x: Column, places: int) -> Column:
    """SQL's round of doubles: scaled, half away from zero, and what rounds to zero keeps its sign (``F.round`` drops it)."""
    y = x * 10.0**places
    even = F.rint(y)
    return F.when(F.abs(y - even) == 0.5, y + F.signum(y) * 0.5).otherwise(even) / 10.0**places


def split_of(spark: SparkSession, d: str) -> DataFrame:
    return splits.anomaly_split(clips(spark, d))


def rounded_mean(rows: DataFrame) -> DataFrame:
    return baseline.mean_vector(rows, KEYS).withColumn("mean", F.transform("mean", lambda x: rounded_as_sql(x, 6)))


def scores_of(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.knn_scores_blocked(split_of(spark, d)), score=9)


@query(sql("SELECT vec_id, machine, machine_id, split, (dense_rank() OVER (ORDER BY machine, machine_id) - 1)::BIGINT AS id_offset FROM split", SPLIT))
def anomaly_split(spark, d):
    s = split_of(spark, d)
    return s.join(splits.id_offsets(s), KEYS).select("vec_id", *KEYS, "split", "id_offset")


@query(sql("""SELECT machine, machine_id, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test_normal') AS n_test_normal,
  count(*) FILTER (split = 'test_abnormal') AS n_test_abnormal, (SELECT median(n) FROM (SELECT count(*) FILTER (split = 'test_abnormal') AS n FROM split GROUP BY machine, machine_id)) AS median_abnormal
  FROM split GROUP BY ROLLUP (machine, machine_id)""", SPLIT))
def split_counts(spark, d):
    return splits.split_counts(split_of(spark, d))


@query(sql("""SELECT 'overlap' AS "check", (SELECT count(*) FROM (SELECT path FROM planted WHERE split = 'train' INTERSECT SELECT path FROM planted WHERE split <> 'train')) AS n
  UNION ALL SELECT 'abnormal_train', count(*) FROM planted WHERE split = 'train' AND label = 'abnormal'
  UNION ALL SELECT 'missing', (SELECT count(*) FROM (SELECT path FROM planted WHERE label = 'normal' EXCEPT ALL SELECT path FROM planted WHERE split IN ('train', 'test_normal')))
  UNION ALL SELECT 'added', (SELECT count(*) FROM (SELECT path FROM planted WHERE split IN ('train', 'test_normal') EXCEPT ALL SELECT path FROM planted WHERE label = 'normal'))""", SPLIT,
  """planted AS (SELECT path, label, CASE WHEN vec_id % 44 = 8 THEN 'train' WHEN vec_id % 31 = 5 THEN 'test_abnormal' ELSE split END AS split FROM split UNION ALL SELECT path, label, 'train' FROM split WHERE vec_id % 37 = 3)"""))
def split_faults(spark, d):
    """The audit of a split with planted faults: abnormal train clips, clips on both sides, normals that went missing or were added."""
    side = F.when(F.col("vec_id") % 44 == 8, "train").when(F.col("vec_id") % 31 == 5, "test_abnormal").otherwise(F.col("split"))
    s = split_of(spark, d)
    return splits.audit(s.select("path", "label", side.alias("split")).union(s.where("vec_id % 37 = 3").select("path", "label", F.lit("train"))))


@query(sql("""SELECT 'overlap' AS "check", (SELECT count(*) FROM (SELECT path FROM split WHERE split = 'train' INTERSECT SELECT path FROM split WHERE split <> 'train')) AS n
  UNION ALL SELECT 'abnormal_train', count(*) FROM split WHERE split = 'train' AND label = 'abnormal'
  UNION ALL SELECT 'missing', (SELECT count(*) FROM (SELECT path FROM split WHERE label = 'normal' EXCEPT ALL SELECT path FROM split WHERE split IN ('train', 'test_normal')))
  UNION ALL SELECT 'added', (SELECT count(*) FROM (SELECT path FROM split WHERE split IN ('train', 'test_normal') EXCEPT ALL SELECT path FROM split WHERE label = 'normal'))""", SPLIT))
def split_audit(spark, d):
    return splits.audit(split_of(spark, d))


@query(sql("SELECT vec_id, machine, machine_id, y, score FROM scores", SPLIT, SCORES))
def knn_scores(spark, d):
    return rounded(scoring.knn_scores(split_of(spark, d)), score=9)


@query(sql("SELECT vec_id, machine, machine_id, y, score FROM scores", SPLIT, SCORES))
def knn_scores_blocked(spark, d):
    return rounded(scoring.knn_scores_blocked(split_of(spark, d), block=256), score=9)


@query(None)
def mahalanobis_scores(spark, d):
    return scoring.mahalanobis_scores(split_of(spark, d))


AUC = """auc AS (SELECT machine, machine_id, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 9)::DOUBLE AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY machine, machine_id ORDER BY score) + (count(*) OVER (PARTITION BY machine, machine_id, score) - 1) / 2.0 AS r FROM scores) GROUP BY machine, machine_id)"""
PAUC = """g AS (SELECT machine, machine_id, score, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY ALL),
c AS (SELECT machine, machine_id, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY machine, machine_id) AS np, sum(neg) OVER (PARTITION BY machine, machine_id) AS nn
      FROM g WINDOW w AS (PARTITION BY machine, machine_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT machine, machine_id, (fp - neg) / nn AS x0, fp / nn AS x1, (tp - pos) / np AS y0, tp / np AS y1 FROM c),
cut AS (SELECT machine, machine_id, x0, y0, least(x1, 0.1::DOUBLE) AS xe, CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (least(x1, 0.1::DOUBLE) - x0) / (x1 - x0) ELSE y1 END AS ye FROM s WHERE x0 < 0.1),
pauc AS (SELECT machine, machine_id, round(0.5 * (1 + (sum((xe - x0) * (y0 + ye) / 2) - 0.005) / 0.095), 9)::DOUBLE AS pauc FROM cut GROUP BY machine, machine_id)"""


@query(sql("SELECT * FROM auc", SPLIT, SCORES, AUC))
def auc_by_machine(spark, d):
    return rounded(metrics.auc(scores_of(spark, d)), auc=9)


@query(sql("SELECT * FROM pauc", SPLIT, SCORES, PAUC))
def pauc_by_machine(spark, d):
    return rounded(metrics.pauc(scores_of(spark, d)), pauc=9)


def averages_of(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.type_averages(rounded(metrics.metrics(scores_of(spark, d)), auc=9, pauc=9)), auc=6, pauc=6)


AVERAGES = "av AS (SELECT machine, count(*) AS n_ids, round(avg(auc), 6) AS auc, round(avg(pauc), 6) AS pauc FROM auc JOIN pauc USING (machine, machine_id) GROUP BY machine)"


@query(sql("SELECT * FROM av", SPLIT, SCORES, AUC, PAUC, AVERAGES))
def type_averages(spark, d):
    return averages_of(spark, d)


@query(sql("SELECT machine, auc, auc BETWEEN 0.55 AND 0.98 AS sane, round(auc - CASE machine WHEN 'fan' THEN 0.658::DOUBLE ELSE 0.729::DOUBLE END, 6) AS delta FROM av", SPLIT, SCORES, AUC, PAUC, AVERAGES))
def sanity_gate(spark, d):
    return rounded(metrics.sanity_gate(averages_of(spark, d), PUBLISHED), delta=6)


@query(sql("SELECT m AS metric, (SELECT count(*) FROM auc) AS compared, 0::BIGINT AS differing FROM (VALUES ('auc'), ('pauc')) AS x(m)", SPLIT, SCORES, AUC))
def determinism_check(spark, d):
    again = splits.anomaly_split(clips(spark, d).repartition(7, "v"))
    return metrics.determinism(metrics.metrics(scores_of(spark, d)), metrics.metrics(rounded(scoring.knn_scores_blocked(again), score=9)), KEYS, ["auc", "pauc"])


@query(sql("""SELECT 'auc' AS metric, count(*) AS compared, count(*) FILTER (round(a.auc, 3) IS DISTINCT FROM round(b.auc, 3)) AS differing
  FROM auc a FULL JOIN auc2 b ON a.machine = b.machine AND a.machine_id = b.machine_id""", SPLIT, SCORES, AUC, "fewer AS (SELECT * FROM scores WHERE machine_id < 'id_04' OR vec_id % 13 <> 0)", AUC.replace("auc AS (", "auc2 AS (", 1).replace("FROM scores", "FROM fewer")))
def determinism_faults(spark, d):
    """The comparison of two runs, of which the second lost some scores of some ids."""
    scores = written(scores_of(spark, d), "scores")
    runs = [rounded(metrics.auc(s), auc=9) for s in (scores, scores.where("machine_id < 'id_04' or vec_id % 13 <> 0"))]
    return metrics.determinism(*runs, KEYS, ["auc"])


@query(sql("SELECT vec_id, machine, machine_id, label FROM (SELECT *, row_number() OVER (PARTITION BY machine, machine_id, label ORDER BY path) AS n FROM clips) WHERE n <= 3"))
def select_clips(spark, d):
    return splits.first_by_name(clips(spark, d), 3).select("vec_id", *KEYS, "label")


@query(sql("SELECT vec_id, machine, machine_id, label FROM (SELECT *, row_number() OVER (PARTITION BY machine, machine_id, label ORDER BY path) AS n FROM clips) WHERE n <= CASE label WHEN 'normal' THEN 7 ELSE 3 END"))
def subset_quota(spark, d):
    return splits.subset_quota(clips(spark, d), 10).select("vec_id", *KEYS, "label")


@query(sql("SELECT vec_id, machine, machine_id, split FROM split WHERE machine_id IN ('id_00', 'id_03')", SPLIT))
def restricted_split(spark, d):
    s = split_of(spark, d)
    ids = s.where(F.col("machine_id").isin("id_00", "id_03")).select(*KEYS).distinct()
    return splits.restrict(s, ids).select("vec_id", *KEYS, "split")


@query(sql("SELECT machine, CASE WHEN machine_id IN ('id_08', 'id_09') THEN 'val' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT machine_id) AS ids FROM clips GROUP BY ALL"))
def id_disjoint_split(spark, d):
    return splits.id_disjoint(clips(spark, d), ["id_08", "id_09"]).groupBy("machine", "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("machine_id").alias("ids"))


@query(sql("""SELECT vec_id, part, round(list_sum(list_transform(v, lambda x: (x - m) / s)), 4) AS total, round((v[1] - m) / s, 5) AS first
  FROM (SELECT *, CASE WHEN machine_id IN ('id_08', 'id_09') THEN 'val' ELSE 'train' END AS part FROM clips),
       (SELECT avg(x) AS m, CASE WHEN stddev_samp(x) > 1e-6 THEN stddev_samp(x) ELSE 1 END AS s FROM (SELECT unnest(v) AS x FROM clips WHERE machine_id NOT IN ('id_08', 'id_09')))"""))
def train_standardize(spark, d):
    rows = splits.standardize(splits.id_disjoint(clips(spark, d), ["id_08", "id_09"]))
    return rows.select("vec_id", "part", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.col("v")[0], 5).alias("first"))


@query(sql("""SELECT part, count(*) AS n, avg((c = machine)::INT) AS accuracy FROM (
    SELECT path, part, machine, arg_min(c, (dd, c)) AS c FROM (
      SELECT p.path, p.part, p.machine, m.machine AS c, round(sum((p.x - m.m) ** 2), 9) AS dd FROM pl p JOIN ce m ON p.i = m.i GROUP BY ALL) GROUP BY ALL) GROUP BY part""",
    "pl AS (SELECT path, CASE WHEN machine_id IN ('id_08', 'id_09') THEN 'val' ELSE 'train' END AS part, machine, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM clips)",
    "ce AS (SELECT machine, i, avg(x) AS m FROM pl WHERE part = 'train' GROUP BY ALL)"))
def classifier_accuracy(spark, d):
    return splits.centroid_accuracy(splits.id_disjoint(clips(spark, d), ["id_08", "id_09"]))


@query(sql("SELECT machine_id, label AS condition, count(*) AS clips FROM clips GROUP BY CUBE (machine_id, label)"))
def clip_inventory(spark, d):
    return clips(spark, d).withColumnRenamed("label", "condition").cube("machine_id", "condition").agg(F.count(F.lit(1)).alias("clips"))


@query(sql("SELECT machine, machine_id, list(round(m, 6) ORDER BY i) AS mean FROM (SELECT machine, machine_id, i, avg(x) AS m FROM (SELECT machine, machine_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM clips WHERE label = 'normal') GROUP BY ALL) GROUP BY ALL"))
def mean_vector(spark, d):
    return rounded_mean(clips(spark, d).where("label = 'normal'"))


@query(sql("""SELECT machine, machine_id, n, round(CASE WHEN least(beta, delta) = 0 THEN 0 ELSE least(beta, delta) / delta END, 6) AS shrinkage FROM (
    SELECT machine, machine_id, n, (dd - 2 * mu * tr / n + p * mu * mu) / p AS delta, (q4 / n - dd) / (p * n) AS beta
    FROM (SELECT *, tr / n / p AS mu, ff / n / n AS dd FROM st))""", SPLIT,
    "pl AS (SELECT machine, machine_id, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM split WHERE split = 'train')",
    "ctr AS (SELECT machine, machine_id, vec_id, list(x - m ORDER BY i) AS c FROM (SELECT *, avg(x) OVER (PARTITION BY machine, machine_id, i) AS m FROM pl) GROUP BY ALL)",
    "gr AS (SELECT a.machine, a.machine_id, a.vec_id AS i, b.vec_id AS j, len(a.c) AS p, list_dot_product(a.c, b.c) AS g FROM ctr a JOIN ctr b ON a.machine = b.machine AND a.machine_id = b.machine_id)",
    "st AS (SELECT machine, machine_id, count(*) FILTER (i = j) AS n, max(p) AS p, sum(g) FILTER (i = j) AS tr, sum(g * g) FILTER (i = j) AS q4, sum(g * g) AS ff FROM gr GROUP BY ALL)"))
def lw_shrinkage(spark, d):
    return scoring.lw_shrinkage(split_of(spark, d).where("split = 'train'"))


@query(sql("""SELECT machine, machine_id, any_value(n) AS n, any_value(round(trace, 6)) AS trace, any_value(round(fourth, 6)) AS fourth, round(sum(s * s), 4) AS spread FROM (
  SELECT machine, machine_id, i, j, sum(y[i] * y[j]) AS s, count(*) AS n, sum(q) AS fourth, (SELECT sum(list_inner_product(z.y, z.y)) FROM c z WHERE z.machine = c.machine AND z.machine_id = c.machine_id) AS trace
  FROM c, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY machine, machine_id, i, j) GROUP BY machine, machine_id""", SPLIT,
  """t AS (SELECT machine, machine_id, vec_id, v FROM split WHERE split = 'train'),
m AS (SELECT machine, machine_id, list(x ORDER BY i) AS mean FROM (SELECT machine, machine_id, i, avg(v[i]) AS x FROM t, range(1, 65) AS r(i) GROUP BY machine, machine_id, i) GROUP BY machine, machine_id),
c AS (SELECT machine, machine_id, y, list_inner_product(y, y) ** 2 AS q FROM (SELECT machine, machine_id, list_transform(v, lambda x, i: x - mean[i]) AS y FROM t JOIN m USING (machine, machine_id)))"""))
def train_moments(spark, d):
    """Trace, sum of fourth powers and squared norm of the centred products of each id's train vectors."""
    return scoring.moment_figures(split_of(spark, d).where("split = 'train'"))


# levels, PCM, resampling over the vectors as short signals

@query(sql("SELECT vec_id, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS peak, round(sqrt(list_dot_product(v, v) / len(v)), 6) AS rms, list_max(list_transform(v, lambda x: abs(x))) >= 0.4 AS clipped FROM clips"))
def level_stats(spark, d):
    return clips(spark, d).select("vec_id", F.round(S.peak(F.col("v")), 6).alias("peak"), F.round(F.sqrt(S.power(F.col("v"))), 6).alias("rms"), (S.peak(F.col("v")) >= 0.4).alias("clipped"))


@query(sql("""SELECT vec_id, list_transform(v, lambda x: greatest(-32768, least(32767, floor(x * 4 * 32768 + 0.5)))::BIGINT) AS pcm,
  list_transform(v, lambda x: trunc(greatest(-1, least(0.999969, x * 4)) * CASE WHEN x < 0 THEN 32768 ELSE 32767 END)::BIGINT) AS pcm_asymmetric FROM clips"""))
def pcm_quantize(spark, d):
    loud = clips(spark, d).select("vec_id", F.transform("v", lambda x: x * 4).alias("v"))
    return loud.select("vec_id", S.pcm16(F.col("v")).alias("pcm"), S.pcm16_asymmetric(F.col("v")).alias("pcm_asymmetric"))


@query(sql("SELECT vec_id, list_transform(range(len(v) // 3), lambda i: round((v[i * 3 + 1] + v[i * 3 + 2] + v[i * 3 + 3]) / 3, 6)) AS mono FROM clips"))
def mono_mix(spark, d):
    return clips(spark, d).select("vec_id", F.transform(S.mono(F.col("v"), 3), lambda x: rounded_as_sql(x, 6)).alias("mono"))


@query(sql("""SELECT vec_id, list_transform(range(96), lambda i: round(v[floor(least(i * 2.0 / 3, 63))::INT + 1] +
    (v[least(floor(least(i * 2.0 / 3, 63))::INT + 1, 63) + 1] - v[floor(least(i * 2.0 / 3, 63))::INT + 1]) * (least(i * 2.0 / 3, 63) - floor(least(i * 2.0 / 3, 63))), 5)) AS resampled FROM clips"""))
def resample_linear(spark, d):
    # rint keeps the sign of values that round to zero, as the SQL does
    return clips(spark, d).select("vec_id", F.transform(S.resample(F.col("v"), 32000, 48000), lambda x: F.rint(x * 1e5) / 1e5).alias("resampled"))


@query(sql("SELECT vec_id, CASE WHEN len(v) <> 64 THEN 'shape' WHEN list_aggregate(list_transform(v, lambda x: isfinite(x)), 'bool_and') THEN 'ok' ELSE 'not finite' END AS verdict FROM (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN list_append(v, 1.0) WHEN vec_id % 7 = 0 THEN list_append(v[1:63], 'nan'::DOUBLE) ELSE v END AS v FROM clips)"))
def vector_validation(spark, d):
    v = F.when(F.col("vec_id") % 11 == 0, F.concat("v", F.array(F.lit(1.0)))).when(F.col("vec_id") % 7 == 0, F.concat(F.slice("v", 1, 63), F.array(F.lit(float("nan"))))).otherwise(F.col("v"))
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return clips(spark, d).withColumn("v", v).select("vec_id", F.when(F.size("v") != 64, "shape").when(finite, "ok").otherwise("not finite").alias("verdict"))


@query(sql("""SELECT path, snr_db, CASE WHEN max(abs_m) > 1 THEN round(max(sq) * (0.99 / max(abs_m)) ** 2, 6) ELSE round(max(sq), 6) END AS power FROM (
    SELECT path, snr_db, list_max(list_transform(m, lambda x: abs(x))) AS abs_m, list_dot_product(m, m) / len(m) AS sq FROM (
      SELECT path, snr_db, list_transform(range(len(v)), lambda i: v[i + 1] + r[i + 1] * sqrt((list_dot_product(v, v) / len(v)) / (10 ** (snr_db / 10) * (list_dot_product(r, r) / len(r))))) AS m
      FROM (SELECT path, v, list_reverse(v) AS r FROM clips), (SELECT unnest([0.0::DOUBLE, 5.0, 10.0]) AS snr_db))) GROUP BY path, snr_db"""))
def snr_mix(spark, d):
    rows = clips(spark, d).withColumn("snr_db", F.explode(F.array(F.lit(0.0), F.lit(5.0), F.lit(10.0))))
    return rows.select("path", "snr_db", F.round(S.power(deg.mix_at_snr(F.col("v"), F.reverse("v"), F.col("snr_db"))), 6).alias("power"))


@query(sql("SELECT path, snr_db, (('0x' || substr(md5(path || '|' || snr_db::INT), 1, 8))::BIGINT % 7) AS noise_no FROM clips, (SELECT unnest([0.0::DOUBLE, 5.0, 10.0]) AS snr_db)"))
def noise_assignment(spark, d):
    return deg.noise_assignment(clips(spark, d), [0, 5, 10], 7)


# degraded capture

@query(sql("SELECT vec_id, split, d.path IS NOT NULL AS replaced, round(coalesce(d.v, s.v)[1], 6) AS first FROM split s LEFT JOIN degraded d ON s.path = d.path AND s.split <> 'train'", SPLIT))
def substitution_join(spark, d):
    return deg.substitute(split_of(spark, d), degraded(spark, d)).select("vec_id", "split", "replaced", F.round(F.col("v")[0], 6).alias("first"))


@query(sql("SELECT machine, machine_id, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM split WHERE split <> 'train' AND path NOT IN (SELECT path FROM degraded) GROUP BY ALL", SPLIT))
def missing_coverage(spark, d):
    return deg.missing_coverage(split_of(spark, d), degraded(spark, d))


@query(sql("SELECT vec_id, kind FROM clips, (VALUES ('logmel'), ('embedding')) AS k(kind) WHERE kind = 'embedding' OR path NOT IN (SELECT path FROM degraded)"))
def missing_features(spark, d):
    wanted = clips(spark, d).select("vec_id", "path", F.explode(F.array(F.lit("logmel"), F.lit("embedding"))).alias("kind"))
    return deg.missing_features(wanted, degraded(spark, d).select("path", F.lit("logmel").alias("kind")), ["path", "kind"]).select("vec_id", "kind")


# results per condition: clean, and test clips mixed with one of seven other clips at 5 and at 0 dB
MIXED = """noise AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS noise_no, v AS nv FROM clips WHERE label = 'normal' QUALIFY noise_no < 7),
given AS (SELECT c.*, s.condition, nv, sqrt(list_inner_product(c.v, c.v) / (pow(10.0::DOUBLE, snr / 10.0::DOUBLE) * list_inner_product(nv, nv))) AS scale
  FROM split c, (VALUES ('noise_5', 5), ('noise_0', 0)) AS s(condition, snr), noise WHERE c.split <> 'train' AND ('0x' || substr(md5(c.path || '|' || snr), 1, 8))::BIGINT % 7 = noise_no),
mixed AS (SELECT * EXCLUDE (m), CASE WHEN top > 1 THEN list_transform(m, lambda x: x * 0.99::DOUBLE / top) ELSE m END AS mv
  FROM (SELECT *, list_max(list_transform(m, lambda x: abs(x))) AS top FROM (SELECT *, list_transform(v, lambda x, i: x + scale * nv[i]) AS m FROM given))),
cond AS (SELECT 'clean' AS condition, vec_id, machine, machine_id, split, v FROM split UNION ALL SELECT c.condition, vec_id, machine, machine_id, split, v FROM split, (VALUES ('noise_5'), ('noise_0')) AS c(condition) WHERE split = 'train'
  UNION ALL SELECT condition, vec_id, machine, machine_id, split, mv FROM mixed),
cu AS (SELECT condition, vec_id, machine, machine_id, split, list_transform(v, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END) AS u FROM (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM cond)),
near AS (SELECT q.condition, q.vec_id, q.machine, q.machine_id, q.split, greatest(0, least(2, 1 - list_inner_product(q.u, t.u))) AS d, row_number() OVER (PARTITION BY q.condition, q.vec_id ORDER BY greatest(0, least(2, 1 - list_inner_product(q.u, t.u))), t.vec_id) AS rn
  FROM cu q JOIN cu t ON q.condition = t.condition AND q.machine = t.machine AND q.machine_id = t.machine_id AND q.split <> 'train' AND t.split = 'train'),
middle AS (SELECT machine, machine_id, list_transform(m, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END) AS mu FROM (SELECT *, sqrt(list_inner_product(m, m)) AS n FROM (
  SELECT machine, machine_id, list(a ORDER BY i) AS m FROM (SELECT machine, machine_id, i, avg(x) AS a FROM (SELECT machine, machine_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM split WHERE split = 'train') GROUP BY ALL) GROUP BY ALL))),
cs AS (SELECT condition, 'knn' AS scorer, machine, machine_id, (split = 'test_abnormal')::INT AS y, round(avg(d), 9) AS score FROM near WHERE rn <= 2 GROUP BY condition, vec_id, machine, machine_id, split
  UNION ALL SELECT condition, 'mean', machine, machine_id, (split = 'test_abnormal')::INT, round(greatest(0, least(2, 1 - list_inner_product(u, mu))), 9) FROM cu JOIN middle USING (machine, machine_id) WHERE split <> 'train'),
cr AS (SELECT *, rank() OVER (PARTITION BY condition, scorer, machine, machine_id ORDER BY score) + (count(*) OVER (PARTITION BY condition, scorer, machine, machine_id, score) - 1) / 2.0 AS r FROM cs),
res AS (SELECT condition, machine, scorer, round(avg(a), 6) AS auc FROM (SELECT condition, scorer, machine, machine_id, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS a FROM cr GROUP BY ALL) GROUP BY condition, machine, scorer)"""


def noise_of(spark, d) -> DataFrame:
    """Seven clips that stand for noise recordings: noise_no, v."""
    first = clips(spark, d).where("label = 'normal'").orderBy("vec_id").limit(7)
    return first.select((F.row_number().over(W.orderBy("vec_id")) - 1).cast("long").alias("noise_no"), "v")


def captures_of(spark, d, split: DataFrame) -> dict[str, DataFrame]:
    test = split.where("split <> 'train'")
    return {f"noise_{snr}": deg.noisy(test, noise_of(spark, d), float(snr)) for snr in (5, 0)}


def results_of(spark, d) -> DataFrame:
    split = split_of(spark, d)
    scorers = {"knn": lambda s: rounded(scoring.knn_scores_blocked(s), score=9), "mean": lambda s: rounded(scoring.mean_scores(s), score=9)}
    return rounded(deg.rerun(split, captures_of(spark, d, split), scorers), auc=6).select("condition", "machine", "scorer", "auc")


@query(sql("SELECT condition, max(auc) FILTER (machine = 'fan' AND scorer = 'knn') AS fan_knn, max(auc) FILTER (machine = 'fan' AND scorer = 'mean') AS fan_mean, max(auc) FILTER (machine = 'pump' AND scorer = 'knn') AS pump_knn, max(auc) FILTER (machine = 'pump' AND scorer = 'mean') AS pump_mean FROM res GROUP BY condition", SPLIT, MIXED))
def condition_report(spark, d):
    return deg.condition_report(results_of(spark, d), ["fan_knn", "fan_mean", "pump_knn", "pump_mean"])


@query(sql("SELECT r.condition, r.machine, r.scorer, r.auc, round((r.auc - 0.5) / (c.auc - 0.5), 6) AS retained, CASE WHEN (r.auc - 0.5) / (c.auc - 0.5) >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM res r JOIN res c USING (machine, scorer) WHERE c.condition = 'clean' AND r.condition <> 'clean'", SPLIT, MIXED))
def condition_verdict(spark, d):
    return rounded(deg.condition_verdict(results_of(spark, d)), retained=6)


@query(sql("SELECT condition, machine, scorer, auc FROM res WHERE condition <> 'noise_5' UNION ALL SELECT 'noise_5', machine, scorer, auc FROM res WHERE condition = 'noise_0'", SPLIT, MIXED))
def condition_upsert(spark, d):
    """A second run at 0 dB filed under the name of the first one replaces its rows."""
    old = results_of(spark, d)
    return deg.upsert(old, old.where("condition = 'noise_0'").withColumn("condition", F.lit("noise_5")))


@query(None)
def condition_rerun(spark, d):
    """Neighbour and covariance scorers on the clean and both noisy captures, AUC, partial AUC and coverage."""
    split = split_of(spark, d)
    return deg.rerun(split, captures_of(spark, d, split), scoring.SCORERS)


PLAYLIST = """pl AS (SELECT machine, machine_id, vec_id, idx, n_samples, (100 + 50 + coalesce(sum(n_samples + 50) OVER (PARTITION BY machine, machine_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_sample
  FROM (SELECT *, (row_number() OVER (PARTITION BY machine, machine_id ORDER BY path))::BIGINT AS idx, 160 + vec_id % 5 AS n_samples FROM clips))"""


def playlist_of(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    rows = clips(spark, d).withColumn("idx", F.row_number().over(W.partitionBy(*KEYS).orderBy("path")).cast("long")).withColumn("n_samples", 160 + F.col("vec_id") % 5)
    return deg.playlist_offsets(rows, 100, 50, KEYS)


@query(sql("SELECT machine, machine_id, vec_id, idx, n_samples, start_sample FROM pl", PLAYLIST))
def playlist_offsets(spark, d):
    return playlist_of(spark, d).select(*KEYS, "vec_id", "idx", "n_samples", "start_sample")


@query(sql("""SELECT machine_id AS rec, idx, k AS block_no, start_sample + 37 AS nominal, greatest(start_sample + 37 - 20, k * 1000) - k * 1000 AS from_sample, least(start_sample + 37 + n_samples + 20, k * 1000 + 1000) - k * 1000 AS to_sample
  FROM pl, (SELECT unnest(range(200))::BIGINT AS k) WHERE start_sample + 37 - 20 < k * 1000 + 1000 AND start_sample + 37 + n_samples + 20 > k * 1000 AND k * 1000 < (SELECT max(start_sample + n_samples + 100) FROM pl p2 WHERE p2.machine_id = pl.machine_id)""", PLAYLIST))
def segment_plan(spark, d):
    entries = playlist_of(spark, d).select(F.col("machine_id").alias("rec"), "idx", "start_sample", "n_samples")
    length = entries.groupBy("rec").agg(F.max(F.col("start_sample") + F.col("n_samples") + 100).alias("total"))
    blocks = length.select("rec", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / 1000))).alias("block_no")).selectExpr("rec", "block_no", "block_no * 1000 as b_start", "block_no * 1000 + 1000 as b_end")
    return deg.segment_plan(entries, blocks, 37, 20, 1000)


@query(sql("""SELECT vec_id, band, n, round(g - median(g) OVER (PARTITION BY vec_id), 6) AS gain_db, round(max(g) OVER (PARTITION BY vec_id) - min(g) OVER (PARTITION BY vec_id), 6) AS flatness_db FROM (
    SELECT vec_id, band, count(*) AS n, avg(x) AS g FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) * 100.0::DOUBLE AS freq FROM clips) JOIN
      (SELECT k AS band, 100.0::DOUBLE * (64.0::DOUBLE ** (1 / 6.0::DOUBLE)) ** k AS lo, CASE WHEN k = 5 THEN 6400.0::DOUBLE ELSE 100.0::DOUBLE * (64.0::DOUBLE ** (1 / 6.0::DOUBLE)) ** (k + 1) END AS hi FROM (SELECT unnest(range(6))::BIGINT AS k)) b
      ON freq >= lo AND (freq < hi OR (band = 5 AND freq <= hi)) GROUP BY ALL)"""))
def band_gains(spark, d):
    bins = clips(spark, d).select("vec_id", F.posexplode("v").alias("i", "gain_db")).select("vec_id", ((F.col("i") + 1) * 100.0).alias("freq"), "gain_db")
    return deg.band_gains(bins, 6, 100.0, 6400.0)


# evidence over the vectors as 64-band spectra

MEANS = "mean AS (SELECT machine, machine_id, list(round(m, 6) ORDER BY i) AS mean FROM (SELECT machine, machine_id, i, avg(x) AS m FROM (SELECT machine, machine_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM clips WHERE label = 'normal') GROUP BY ALL) GROUP BY ALL)"
TOP = """top AS (SELECT vec_id, rn AS rank, band, band * 100.0::DOUBLE AS lo_hz, (band + 2) * 100.0::DOUBLE AS hi_hz, delta_db FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(delta_db) DESC, band) AS rn FROM (
      SELECT vec_id, unnest(range(64))::BIGINT AS band, unnest(list_transform(range(64), lambda i: round(v[i + 1] - mean[i + 1], 6))) AS delta_db FROM clips JOIN mean USING (machine, machine_id))) WHERE rn <= 3)"""
EDGES = [k * 100.0 for k in range(66)]


def bands_of(spark, d) -> DataFrame:
    c = clips(spark, d)
    return evidence.top_band_deltas(c, rounded_mean(c.where("label = 'normal'")), KEYS, EDGES)


def peaks_of(spark, d) -> DataFrame:
    return evidence.labelled_peaks(evidence.rank_peaks(evidence.local_peaks(clips(spark, d), 5.0)), F.lit(1800.0))


PEAKS = """pk AS (SELECT vec_id, i * 5.0::DOUBLE AS freq_hz, round(x - greatest(l, r), 6) AS prominence FROM (
    SELECT vec_id, i - 1 AS i, x, v[i - 1] AS l, v[i + 1] AS r FROM (SELECT vec_id, v, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM clips) WHERE i > 1 AND i < 64) WHERE x > l AND x > r),
rk AS (SELECT vec_id, freq_hz, prominence, row_number() OVER (PARTITION BY vec_id ORDER BY prominence DESC, freq_hz) AS rank,
    CASE WHEN abs(freq_hz - 120) <= 3 THEN 'line hum' WHEN abs(freq_hz - 30) <= 3 THEN '1x rotation' ELSE 'impulse train' END AS label
  FROM (SELECT *, max(prominence) OVER (PARTITION BY vec_id) AS most FROM pk WHERE freq_hz BETWEEN 5 AND 300) WHERE prominence >= 0.1 * most)"""


@query(sql("SELECT * FROM top", MEANS, TOP))
def top_band_deltas(spark, d):
    return bands_of(spark, d)


@query(sql("SELECT vec_id, freq_hz, prominence, rank FROM rk WHERE rank <= 3", PEAKS))
def peak_rank(spark, d):
    return peaks_of(spark, d).select("vec_id", "freq_hz", "prominence", "rank")


@query(sql("SELECT vec_id, freq_hz, label FROM rk WHERE rank <= 3", PEAKS))
def peak_labels(spark, d):
    return peaks_of(spark, d).select("vec_id", "freq_hz", "label")


@query(sql("""SELECT vec_id, CASE WHEN length(hud) > 60 THEN rtrim(substr(hud, 1, 60), ', ') ELSE hud END AS hud FROM (
    SELECT t.vec_id, CASE WHEN label IS NOT NULL THEN label || ' ~' || floor(freq_hz + 0.5)::BIGINT || ' Hz, ' || phrase ELSE phrase || ' vs baseline' END AS hud FROM (
      SELECT vec_id, CASE WHEN (lo_hz + hi_hz) / 2 < 500 THEN 'low' WHEN (lo_hz + hi_hz) / 2 <= 2000 THEN 'mid' ELSE 'high' END || '-band energy ' || CASE WHEN delta_db >= 0 THEN 'up' ELSE 'down' END AS phrase FROM top WHERE rank = 1) t
    LEFT JOIN (SELECT vec_id, freq_hz, label FROM rk WHERE rank = 1) p ON t.vec_id = p.vec_id)""", MEANS, TOP, PEAKS))
def evidence_hud(spark, d):
    return evidence.text(bands_of(spark, d), peaks_of(spark, d))


@query(sql("""SELECT vec_id, list(b_t ORDER BY rn) AS times FROM (
    SELECT q.vec_id, t.t AS b_t, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, least(2, 1 - list_dot_product(q.u, t.u))), 9), t.t) AS rn
    FROM uu q JOIN uu t ON q.machine = t.machine AND q.machine_id = t.machine_id AND q.split = 'test_abnormal' AND t.split = 'train') WHERE rn <= 3 GROUP BY vec_id""", SPLIT,
    "uu AS (SELECT vec_id, vec_id::DOUBLE AS t, machine, machine_id, split, list_transform(v, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END) AS u FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM split))"))
def nearest_baseline(spark, d):
    s = split_of(spark, d).withColumn("t", F.col("vec_id").cast("double"))
    return evidence.nearest_baseline(s.where("split = 'test_abnormal'"), s.where("split = 'train'"), KEYS)


@query(sql("SELECT vec_id, copy, part, round(list_sum(v), 5) AS total FROM (SELECT vec_id, 0 AS copy, split AS part, v FROM split UNION ALL SELECT vec_id, 1, split, list_transform(v, lambda x: x / 2) FROM split WHERE split = 'train')", SPLIT))
def augmented_train(spark, d):
    rows = split_of(spark, d).withColumnRenamed("split", "part")
    return baseline.augmented(rows, [lambda v: F.transform(v, lambda x: x / 2)]).select("vec_id", "copy", "part", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(sql("SELECT vec_id, k AS chunk_no, least(10, 64 - k * 10) AS n FROM clips, (SELECT unnest(range(7))::BIGINT AS k)"))
def chunk_counts(spark, d):
    from ..operators.events import chunk_counts as f

    return f(clips(spark, d), 10)
