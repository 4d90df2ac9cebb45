"""Queries over embeddings, windows and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.functions import vectors as VF
from palaver.operators import evaluation as E
from palaver.operators import vectors as V
from palaver.operators import windows as W
from palaver.plans import adapters as A
from palaver.plans.registry import query

#: Vectors to a recording, the same at every size.
PER_RECORDING = 64

VEC_SQL = f"""vec AS (SELECT vec_id // {PER_RECORDING} AS recording, vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nrm AS (SELECT recording, id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-9)) AS v FROM vec),
prs AS (SELECT a.recording, a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v) AS cos FROM nrm a JOIN nrm b ON a.recording = b.recording AND a.id < b.id)"""
CEN_SQL = VEC_SQL + """,
cmp AS (SELECT recording, label, i, avg(v[i]) AS m, count(*) AS n FROM nrm, range(1, 65) t(i) GROUP BY 1, 2, 3),
cen0 AS (SELECT recording, label, max(n) AS n, list(m ORDER BY i) AS v FROM cmp GROUP BY 1, 2),
cen AS (SELECT recording, label, n, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-9)) AS v FROM cen0),
sco AS (SELECT nrm.recording, id, cen.label, list_inner_product(nrm.v, cen.v) AS cos FROM nrm JOIN cen USING (recording))"""


def _vectors(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.col("vec_id") / PER_RECORDING).alias("recording"), F.col("vec_id").alias("id"), "label", VF.l2_normalize(F.col("embedding")).alias("vector"))


@query(f"WITH {VEC_SQL} SELECT recording, a, b, same, round(cos, 6) + 0.0 AS cos FROM prs")
def pair_similarity(spark, sf_dir):
    return V.pairs(_vectors(spark, sf_dir)).withColumn("cos", F.round("cos", 6) + F.lit(0.0))


@query(f"""WITH {VEC_SQL}, r AS (SELECT same, cos, row_number() OVER (PARTITION BY recording, same ORDER BY cos) - 1 AS r, count(*) OVER (PARTITION BY recording, same) AS n, recording FROM prs)
SELECT recording, same, max(n) AS n, round(max(cos) FILTER (r = (n - 1) * 1 // 2), 6) + 0.0 AS p50, round(max(cos) FILTER (r = (n - 1) * 9 // 10), 6) + 0.0 AS p90, round(max(cos) FILTER (r = (n - 1) * 99 // 100), 6) + 0.0 AS p99 FROM r GROUP BY 1, 2""")
def separability_percentiles(spark, sf_dir):
    out = E.index_pick(V.pairs(_vectors(spark, sf_dir)), ["recording", "same"], "cos", {"p50": (1, 2), "p90": (9, 10), "p99": (99, 100)}, minus=1)
    return out.withColumns({k: F.round(k, 6) + F.lit(0.0) for k in ("p50", "p90", "p99")})


@query(f"WITH {VEC_SQL} SELECT recording, same, count(*) AS n, round(avg(cos), 6) + 0.0 AS mean, round(min(cos), 6) + 0.0 AS low, round(max(cos), 6) + 0.0 AS high FROM prs GROUP BY 1, 2")
def pair_statistics(spark, sf_dir):
    p = V.pairs(_vectors(spark, sf_dir))
    return p.groupBy("recording", "same").agg(F.count(F.lit(1)).alias("n"), *((F.round(f("cos"), 6) + F.lit(0.0)).alias(k) for k, f in (("mean", F.avg), ("low", F.min), ("high", F.max))))


@query(f"""WITH {VEC_SQL}, g AS (SELECT k, k / 100 AS t FROM range(100) x(k)),
e AS (SELECT recording, k, (sum(CASE WHEN same AND floor(cos * 100) < k THEN 1 ELSE 0 END) / nullif(count(*) FILTER (same), 0) + sum(CASE WHEN NOT same AND floor(cos * 100) >= k THEN 1 ELSE 0 END) / nullif(count(*) FILTER (NOT same), 0)) / 2 AS error FROM prs, g GROUP BY 1, 2)
SELECT recording, k / 100 AS threshold, round(error, 9) AS error FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY error, k) AS r FROM e WHERE error IS NOT NULL) WHERE r = 1""")
def best_split(spark, sf_dir):
    return V.best_split(V.pairs(_vectors(spark, sf_dir))).withColumn("error", F.round("error", 9))


@query(f"WITH {CEN_SQL} SELECT recording, label, n, list_transform(v, lambda x: round(x, 6) + 0.0) AS vector FROM cen")
def label_centroids(spark, sf_dir):
    return V.means(_vectors(spark, sf_dir)).withColumn("vector", F.transform("vector", lambda x: F.round(x, 6) + F.lit(0.0)))


@query(f"WITH {CEN_SQL} SELECT nrm.recording, nrm.label, round(min(list_inner_product(nrm.v, cen.v)), 6) + 0.0 AS cohesion FROM nrm JOIN cen ON nrm.recording = cen.recording AND nrm.label = cen.label GROUP BY 1, 2")
def centroid_cohesion(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return V.cohesion(rows, V.means(rows)).withColumn("cohesion", F.round("cohesion", 6) + F.lit(0.0))


@query(f"""WITH {CEN_SQL}, p AS (SELECT x.recording, x.label AS a, y.label AS b, list_inner_product(x.v, y.v) AS cos FROM cen x JOIN cen y ON x.recording = y.recording AND x.label < y.label)
SELECT recording, a, b, round(cos, 6) + 0.0 AS cos, CAST(row_number() OVER (PARTITION BY recording ORDER BY cos DESC, a, b) AS INTEGER) AS rank FROM p""")
def crowding_pairs(spark, sf_dir):
    return V.crowding(V.means(_vectors(spark, sf_dir))).withColumn("cos", F.round("cos", 6) + F.lit(0.0))


@query(f"WITH {CEN_SQL} SELECT recording, id, label, round(cos, 6) + 0.0 AS cos FROM (SELECT *, row_number() OVER (PARTITION BY recording, id ORDER BY cos DESC, label DESC) AS k FROM sco) WHERE k = 1")
def nearest_centroid(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return V.nearest(V.scores(rows, V.means(rows))).withColumn("cos", F.round("cos", 6) + F.lit(0.0))


@query(f"""WITH {CEN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY recording, id ORDER BY cos DESC, label DESC) AS k FROM sco),
s AS (SELECT recording, id, count(*) AS n, max(cos) FILTER (k = 1) AS s1, max(label) FILTER (k = 1) AS label, max(cos) FILTER (k > 1) AS s2, avg(cos) FILTER (k > 1) AS m, stddev_samp(cos) FILTER (k > 1) AS sd FROM r GROUP BY 1, 2)
SELECT recording, id, CASE WHEN s1 >= 0.2 AND (s2 IS NULL OR s1 - s2 >= 0.05) AND (n < 4 OR (s1 - m) / greatest(coalesce(sd, 0), 1e-6) >= 2.0) THEN label END AS label, round(s1, 6) + 0.0 AS cos FROM s""")
def gated_assignment(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return V.gated(V.scores(rows, V.means(rows)), 0.2, 0.05).withColumn("cos", F.round("cos", 6) + F.lit(0.0))


@query(f"""WITH {CEN_SQL}, co AS (SELECT nrm.recording, nrm.label, min(list_inner_product(nrm.v, cen.v)) AS cohesion FROM nrm JOIN cen ON nrm.recording = cen.recording AND nrm.label = cen.label GROUP BY 1, 2),
ri AS (SELECT x.recording, x.label, max(list_inner_product(x.v, y.v)) AS rival FROM cen x LEFT JOIN cen y ON x.recording = y.recording AND y.label < x.label GROUP BY 1, 2)
SELECT recording, label, CASE WHEN rival IS NULL THEN true WHEN rival < 0.02 THEN true ELSE rival < 0.55 AND cohesion - rival >= 0.05 END AS mint FROM co JOIN ri USING (recording, label)""")
def mint_gate(spark, sf_dir):
    """Whether each label's mean could be added beside those of smaller labels."""
    rows = _vectors(spark, sf_dir)
    c = V.means(rows)
    older = c.select("recording", F.col("label").alias("l"), F.col("vector").alias("u"))
    rival = c.join(older, "recording").groupBy("recording", "label").agg(F.max(F.when(F.col("l") < F.col("label"), VF.cosine(F.col("vector"), F.col("u")))).alias("rival"))
    return V.cohesion(rows, c).join(rival, ["recording", "label"]).select("recording", "label", V.may_mint(F.col("cohesion"), F.col("rival"), 0.02, 0.1, lead=0.05).alias("mint"))


@query(f"""WITH {VEC_SQL}, d AS (SELECT list_inner_product(v, lag(v) OVER o) AS cos, lag(label) OVER o AS before, label AS after, id % 4 AS restarts FROM nrm WINDOW o AS (PARTITION BY recording ORDER BY id))
SELECT t AS threshold, count(*) FILTER (cos >= t AND restarts <= 2 AND before = after) AS correct, count(*) FILTER (cos >= t AND restarts <= 2 AND before <> after) AS crossings FROM d, (VALUES (-0.2::DOUBLE), (0.0::DOUBLE), (0.1::DOUBLE), (0.37::DOUBLE)) x(t) GROUP BY 1""")
def gap_tally(spark, sf_dir):
    order = Window.partitionBy("recording").orderBy("id")
    rows = _vectors(spark, sf_dir)
    d = rows.select(VF.cosine(F.col("vector"), F.lag("vector").over(order)).alias("cos"), F.lag("label").over(order).alias("before"), F.col("label").alias("after"), (F.col("id") % 4).alias("restarts"))
    return V.gap_tally(d, [-0.2, 0.0, 0.1, 0.37])


@query(f"""WITH {VEC_SQL}, p AS (SELECT recording, id AS frame, i - 1 AS d, v[i] AS x FROM vec, range(1, 65) t(i)), s AS (SELECT recording, d, avg(x) AS m, stddev_pop(x) AS s FROM p GROUP BY 1, 2)
SELECT recording, frame, CAST(d AS INTEGER) AS d, round((x - m) / greatest(s, 1e-5), 5) + 0.0 AS x FROM p JOIN s USING (recording, d)""")
def feature_normalise(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / PER_RECORDING).alias("recording"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("feats"))
    return V.normalise_features(rows, True).withColumn("x", F.round("x", 5) + F.lit(0.0))


@query("""WITH RECURSIVE f AS (SELECT n_nationkey AS label, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey // 2 END AS retired_into FROM nation),
w AS (SELECT label, label AS cur FROM f UNION ALL SELECT w.label, f.retired_into FROM w JOIN f ON f.label = w.cur WHERE f.retired_into IS NOT NULL AND f.retired_into <> w.cur)
SELECT w.label, w.cur AS "to" FROM w JOIN f ON f.label = w.cur WHERE f.retired_into IS NULL OR f.retired_into = w.cur""")
def recursive_forward(spark, sf_dir):
    key = F.col("n_nationkey")
    return V.resolve(A.table(spark, sf_dir, "nation").select(key.alias("label"), F.when(key % 3 != 0, F.floor(key / 2)).alias("retired_into")))


RUN_SQL = A.SEG_SQL + """,
vo AS (SELECT session_id AS stream_id, pos - 1 AS frame FROM seg WHERE value >= 20),
rn AS (SELECT *, sum(nw) OVER (PARTITION BY stream_id ORDER BY frame) AS run FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY stream_id ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS nw FROM vo)),
nu AS (SELECT stream_id, CAST(run AS BIGINT) AS run, frame, row_number() OVER (PARTITION BY stream_id, run ORDER BY frame) AS n FROM rn)"""


def _voiced(spark, sf_dir):
    return A.segments(spark, sf_dir).select(F.col("session_id").alias("stream_id"), (F.col("pos") - 1).alias("frame"), (F.col("value") >= 20).alias("voiced"))


@query(f"WITH {RUN_SQL} SELECT stream_id, run, count(*) AS n, min(frame) AS first, max(frame) AS last FROM nu GROUP BY 1, 2")
def vad_runs(spark, sf_dir):
    return W.voiced_runs(_voiced(spark, sf_dir), 3).groupBy("stream_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


@query(f"""WITH {RUN_SQL}, sz AS (SELECT stream_id, run, max(n) AS m FROM nu GROUP BY 1, 2), w AS (SELECT stream_id, run, k FROM sz, LATERAL (SELECT unnest(range(0, 1000)) AS k) x WHERE k * 5 + 11 <= m)
SELECT w.stream_id, w.run, w.k, min(frame) AS first, max(frame) AS last FROM w JOIN nu ON nu.stream_id = w.stream_id AND nu.run = w.run AND n > k * 5 AND n <= k * 5 + 11 GROUP BY 1, 2, 3""")
def frame_windows(spark, sf_dir):
    return W.windows(_voiced(spark, sf_dir), 11, 5, 3)


@query(f"""WITH {RUN_SQL} SELECT stream_id, run, (n - 1) // 5 AS k, min(frame) AS first, max(frame) AS last FROM nu GROUP BY 1, 2, 3 HAVING count(*) = 5""")
def hops(spark, sf_dir):
    return W.hops(_voiced(spark, sf_dir), 5, 3)


@query(f"""WITH RECURSIVE {A.SEG_SQL}, pr AS (SELECT session_id AS stream_id, pos - 1 AS frame, value / 100 AS prob FROM seg),
st AS (SELECT stream_id, frame, prob, prob >= 0.5 AS voiced, CASE WHEN prob >= 0.5 THEN 4 ELSE 0 END AS h FROM pr WHERE frame = 0
 UNION ALL SELECT p.stream_id, p.frame, p.prob, CASE WHEN s.voiced THEN NOT (p.prob < 0.35 AND s.h = 0) ELSE p.prob >= 0.5 END,
 CASE WHEN s.voiced THEN CASE WHEN p.prob >= 0.35 THEN 4 ELSE greatest(s.h - 1, 0) END ELSE CASE WHEN p.prob >= 0.5 THEN 4 ELSE 0 END END FROM st s JOIN pr p ON p.stream_id = s.stream_id AND p.frame = s.frame + 1)
SELECT stream_id, frame, voiced FROM st""")
def vad_hysteresis(spark, sf_dir):
    probs = A.segments(spark, sf_dir).select(F.col("session_id").alias("stream_id"), (F.col("pos") - 1).alias("frame"), (F.col("value") / 100).alias("prob"))
    return W.gate(probs).select("stream_id", "frame", "voiced")


@query(f"""WITH {A.SEG_SQL} SELECT session_id AS stream_id, (pos - 1) // 32 AS frame, count(*) AS n, round(sum(value), 4) AS sum, count(*) = 32 AS whole FROM seg GROUP BY 1, 2""")
def framing(spark, sf_dir):
    samples = A.segments(spark, sf_dir).select(F.col("session_id").alias("stream_id"), (F.col("pos") - 1).alias("pos"), F.col("value").alias("x"))
    return W.framed(samples, 32).withColumn("sum", F.round("sum", 4))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 400 THEN 0 ELSE 1 + (o_orderkey - 400) // 160 END AS n FROM orders")
def analysis_frames(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", W.analysis_frames(F.col("o_orderkey")).alias("n"))
