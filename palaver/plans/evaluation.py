"""Queries that score labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.operators import evaluation as O
from palaver.plans import adapters as A
from palaver.plans.registry import query

PER_CHUNK, LAG = 4, 2
CELL_SQL = A.FRAME_SQL + ", cells AS (SELECT recording, spk, label, count(*) AS n FROM single WHERE label IS NOT NULL GROUP BY 1, 2, 3)"
CHANGE_SQL = A.FRAME_SQL + """,
truth AS (SELECT recording, frame, spk FROM (SELECT *, lag(spk) OVER (PARTITION BY recording ORDER BY frame) AS b FROM single) WHERE b <> spk),
found AS (SELECT recording, frame, label FROM (SELECT *, lag(label) OVER (PARTITION BY recording ORDER BY frame) AS b FROM frames_c WHERE label IS NOT NULL) WHERE b <> label)"""
MAP_SQL = CELL_SQL + """,
sol AS (SELECT recording, label, spk FROM (SELECT *, row_number() OVER (PARTITION BY recording, label ORDER BY n DESC, spk DESC) AS k FROM cells) WHERE k = 1),
los AS (SELECT recording, spk, arg_min(label, f) AS label FROM (SELECT s.recording, s.label, s.spk, (SELECT min(x.frame) FROM single x WHERE x.recording = s.recording AND x.label = s.label) AS f FROM sol s) GROUP BY 1, 2)"""


@query(f"WITH {A.FRAME_SQL} SELECT recording, count(*) AS scored, count(*) FILTER (label IS NULL) AS missed, count(DISTINCT label) AS labels, count(*) FILTER (label IS NULL) / greatest(count(*), 1) AS miss FROM single GROUP BY 1")
def confusion_counts(spark, sf_dir):
    return O.counts(A.frames(spark, sf_dir))


@query(f"WITH {CELL_SQL} SELECT recording, spk, sum(n * 0.01::DOUBLE) FILTER (label = 1) AS label_1, sum(n * 0.01::DOUBLE) FILTER (label = 2) AS label_2, sum(n * 0.01::DOUBLE) FILTER (label = 3) AS label_3 FROM cells GROUP BY 1, 2")
def overlap_matrix(spark, sf_dir):
    cells = O.overlap(A.frames(spark, sf_dir)).withColumn("s", F.col("n") * O.FRAME_SECONDS)
    return cells.groupBy("recording", "spk").pivot("label", [1, 2, 3]).agg(F.sum("s")).withColumnsRenamed({str(i): f"label_{i}" for i in (1, 2, 3)})


@query(f"""WITH {CELL_SQL}, tot AS (SELECT recording, spk, count(*) AS a FROM single GROUP BY 1, 2), lab AS (SELECT recording, label, sum(n) AS a FROM cells GROUP BY 1, 2),
s AS (SELECT recording, CAST(sum(greatest(k - 1, 0)) AS BIGINT) AS splits FROM (SELECT c.recording, c.spk, count(*) FILTER (c.n >= a * 0.1::DOUBLE) AS k FROM cells c JOIN tot USING (recording, spk) GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT recording, CAST(sum(greatest(k - 1, 0)) AS BIGINT) AS merges FROM (SELECT c.recording, c.label, count(*) FILTER (c.n >= a * 0.1::DOUBLE) AS k FROM cells c JOIN lab USING (recording, label) GROUP BY 1, 2) GROUP BY 1)
SELECT recording, splits, merges FROM s JOIN m USING (recording)""")
def splits_merges(spark, sf_dir):
    return O.splits_merges(A.frames(spark, sf_dir))


@query(f"""WITH {A.FRAME_SQL}, t AS (SELECT s.recording, spk, least(frame * 3 // n, 2) AS third, label, count(*) AS c FROM single s JOIN (SELECT recording, count(*) AS n FROM frames_c GROUP BY 1) USING (recording) WHERE label IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT recording, spk, CAST(third AS INTEGER) AS third, label FROM (SELECT *, row_number() OVER (PARTITION BY recording, spk, third ORDER BY c DESC, label) AS k FROM t) WHERE k = 1""")
def thirds_dominant(spark, sf_dir):
    return O.thirds(A.frames(spark, sf_dir))


@query(f"WITH {A.FRAME_SQL} SELECT recording, spk, count(*) * 0.01::DOUBLE AS seconds, min(frame) AS first FROM single GROUP BY 1, 2")
def speaker_seconds(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    return O.single(frames).groupBy("recording", "spk").agg((F.count(F.lit(1)) * O.FRAME_SECONDS).alias("seconds"), F.min("frame").alias("first"))


@query(f"""WITH {CELL_SQL}, w AS (SELECT recording, spk, label, n FROM cells),
a AS (SELECT r.recording, coalesce(max(coalesce(x.n, 0) + coalesce(y.n, 0) + coalesce(z.n, 0)), 0) AS correct FROM (SELECT DISTINCT recording FROM cells) r
 CROSS JOIN (VALUES (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 3, 1), (3, 1, 2), (3, 2, 1)) p(a, b, c)
 LEFT JOIN w x ON x.recording = r.recording AND x.spk = 0 AND x.label = a LEFT JOIN w y ON y.recording = r.recording AND y.spk = 1 AND y.label = b LEFT JOIN w z ON z.recording = r.recording AND z.spk = 2 AND z.label = c GROUP BY 1)
SELECT recording, CAST(correct AS BIGINT) AS correct FROM a""")
def best_mapping(spark, sf_dir):
    return O.best_mapping(A.frames(spark, sf_dir))


@query(f"WITH {CHANGE_SQL} SELECT recording, frame, spk AS value, 'reference' AS kind FROM truth UNION ALL SELECT recording, frame, label, 'hypothesis' FROM found")
def turn_changes(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    truth = O.changes(frames.withColumn("spk", O.speaker()), "spk").withColumn("kind", F.lit("reference"))
    return truth.unionByName(O.changes(frames, "label").withColumn("kind", F.lit("hypothesis")))


@query(f"""WITH {A.FRAME_SQL}, i AS (SELECT recording, frame, label, frame - row_number() OVER (PARTITION BY recording, label ORDER BY frame) AS i FROM frames_c WHERE label IS NOT NULL)
SELECT recording, label, min(frame) AS first, max(frame) + 1 AS until FROM i GROUP BY recording, label, i""")
def run_length_segments(spark, sf_dir):
    return O.run_lengths(A.frames(spark, sf_dir))


NEAREST_SQL = CHANGE_SQL + """,
d AS (SELECT t.recording, t.frame, least(t.frame - b.frame, a.frame - t.frame) AS distance FROM truth t ASOF LEFT JOIN found b ON t.recording = b.recording AND t.frame > b.frame ASOF LEFT JOIN found a ON t.recording = a.recording AND t.frame <= a.frame)"""


@query(f"WITH {NEAREST_SQL} SELECT * FROM d")
def nearest_boundary(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    return O.nearest(O.changes(frames.withColumn("spk", O.speaker()), "spk"), O.changes(frames, "label"))


@query(f"""WITH {NEAREST_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY distance) - 1 AS r, count(*) OVER (PARTITION BY recording) AS n FROM d WHERE distance IS NOT NULL)
SELECT recording, max(n) AS n, max(distance) FILTER (r = n // 2) AS median, max(distance) FILTER (r = n * 9 // 10) AS p90, avg(CASE WHEN distance <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM r GROUP BY 1""")
def boundary_recall(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    return O.boundary_stats(O.changes(frames.withColumn("spk", O.speaker()), "spk"), O.changes(frames, "label"), 1)


@query(f"""WITH {A.FRAME_SQL}, w AS (SELECT recording, frame AS ord, frame AS lo, frame + 3 + frame % 9 AS hi, label FROM frames_c WHERE label IS NOT NULL),
v AS (SELECT w.recording, f.frame, w.label, row_number() OVER (PARTITION BY w.recording, f.frame ORDER BY ord) AS slot FROM w, LATERAL (SELECT unnest(range(lo, hi)) AS frame) f),
t AS (SELECT recording, frame, label, count(*) AS n, max(slot) AS s FROM v WHERE slot <= 8 GROUP BY 1, 2, 3)
SELECT recording, frame, label FROM (SELECT *, row_number() OVER (PARTITION BY recording, frame ORDER BY n DESC, s DESC) AS k FROM t) WHERE k = 1""")
def vote_paint_frames(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    return O.vote_frames(frames.select("recording", F.col("frame").alias("ord"), F.col("frame").alias("lo"), (F.col("frame") + 3 + F.col("frame") % 9).alias("hi"), "label"))


@query(f"""WITH {A.FRAME_SQL}, w AS (SELECT recording, spk, unnest(range(frame, frame + 3)) AS frame FROM single)
SELECT recording, frame, CAST(bit_or(1 << spk) AS INTEGER) AS mask FROM w GROUP BY 1, 2""")
def paint_words(spark, sf_dir):
    words = O.single(A.frames(spark, sf_dir)).select("recording", "spk", F.col("frame").alias("lo"), (F.col("frame") + 2).alias("hi"))
    return O.paint_words(words)


@query(f"WITH {A.FRAME_SQL} SELECT f.recording, f.frame, c.label FROM frames_c f LEFT JOIN frames_c c ON c.recording = f.recording AND c.frame = f.frame // {PER_CHUNK}")
def paint_chunks(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    return O.paint_chunks(frames.select("recording", F.col("frame").alias("chunk"), "label"), PER_CHUNK, frames)


@query(f"WITH {MAP_SQL} SELECT * FROM sol")
def speaker_of_label(spark, sf_dir):
    return O.speaker_of_label(A.frames(spark, sf_dir))


@query(f"""WITH {MAP_SQL}, fh AS (SELECT recording, spk, min(frame) AS first FROM single GROUP BY 1, 2),
h AS (SELECT fh.recording, fh.spk, fh.first, min(f.frame) AS at_f FROM fh JOIN los USING (recording, spk) JOIN frames_c f ON f.recording = fh.recording AND f.label = los.label AND f.frame >= fh.first GROUP BY 1, 2, 3),
e AS (SELECT *, CAST(ceil(at_f / {PER_CHUNK}) * {PER_CHUNK} + {LAG * PER_CHUNK} AS BIGINT) AS hi FROM h)
SELECT e.recording, e.spk, count(s.frame) * 0.01::DOUBLE AS seconds FROM e LEFT JOIN single s ON s.recording = e.recording AND s.spk = e.spk AND s.frame >= e.first AND s.frame < e.hi GROUP BY 1, 2""")
def first_label_latency(spark, sf_dir):
    return O.first_label_latency(A.frames(spark, sf_dir), PER_CHUNK, LAG)


@query(f"""WITH {MAP_SQL}, tr AS (SELECT recording, frame, spk FROM (SELECT *, lag(spk) OVER (PARTITION BY recording ORDER BY frame) AS b FROM single) WHERE b <> spk),
tc AS (SELECT *, coalesce(lead(frame) OVER (PARTITION BY recording ORDER BY frame), 1000000000) AS until FROM tr),
h AS (SELECT tc.recording, tc.spk, tc.frame AS t, min(f.frame) AS f FROM tc JOIN los USING (recording, spk) JOIN frames_c f ON f.recording = tc.recording AND f.label = los.label AND f.frame >= tc.frame AND f.frame < tc.until GROUP BY 1, 2, 3),
e AS (SELECT *, CAST(ceil(f / {PER_CHUNK}) * {PER_CHUNK} + {LAG * PER_CHUNK} AS BIGINT) AS hi FROM h)
SELECT e.recording, e.spk, e.t AS "at", count(s.frame) * 0.01::DOUBLE AS seconds FROM e LEFT JOIN single s ON s.recording = e.recording AND s.spk = e.spk AND s.frame >= e.t AND s.frame < e.hi GROUP BY 1, 2, 3""")
def turn_switch_latency(spark, sf_dir):
    return O.turn_switch_latency(A.frames(spark, sf_dir), PER_CHUNK, LAG)


@query(f"WITH {A.FRAME_SQL} SELECT DISTINCT recording, frame // {PER_CHUNK} AS chunk FROM single")
def annotated_chunks(spark, sf_dir):
    return O.annotated(A.frames(spark, sf_dir), PER_CHUNK)


@query(f"""WITH {A.FRAME_SQL}, w AS (SELECT recording, frame AS id, frame AS lo, frame + 3 AS hi FROM frames_c WHERE frame % 2 = 0),
c AS (SELECT w.recording, id, s.spk, count(*) AS n FROM w JOIN frames_c f ON f.recording = w.recording AND f.frame >= lo AND f.frame < hi LEFT JOIN single s ON s.recording = f.recording AND s.frame = f.frame GROUP BY 1, 2, 3),
t AS (SELECT recording, id, sum(n) AS total, sum(n) FILTER (spk IS NOT NULL) AS clean FROM c GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY recording, id ORDER BY n DESC, spk DESC) AS k FROM c WHERE spk IS NOT NULL)
SELECT t.recording, t.id, CASE WHEN b.n >= 0.9::DOUBLE * clean AND b.n >= 0.5::DOUBLE * total THEN b.spk END AS spk FROM t LEFT JOIN b ON b.recording = t.recording AND b.id = t.id AND b.k = 1""")
def window_speaker(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    spans = frames.filter("frame % 2 = 0").select("recording", F.col("frame").alias("id"), F.col("frame").alias("lo"), (F.col("frame") + 3).alias("hi"))
    return O.pure_speaker(spans, frames)


@query(f"""WITH {A.FRAME_SQL}, r AS (SELECT recording, (row_number() OVER (ORDER BY recording) - 1) // 2 AS grp, (row_number() OVER (ORDER BY recording) - 1) % 2 AS o FROM (SELECT DISTINCT recording FROM frames_c)),
p AS (SELECT f.recording, grp, o, frame, mask FROM frames_c f JOIN r USING (recording)), m AS (SELECT recording, grp, o, max(frame) AS m FROM p GROUP BY 1, 2, 3),
s AS (SELECT recording, grp, o, s, row_number() OVER (PARTITION BY grp ORDER BY s, o) - 1 AS place FROM m, LATERAL (SELECT unnest(range(0, m // 50 + 1)) AS s) x),
g AS (SELECT recording, grp, o, s * 50 + i AS frame, place * 50 + i AS out_frame FROM s, range(50) t(i))
SELECT g.grp AS "group", out_frame, CAST(coalesce(p.mask << (g.o * 3)::INTEGER, 0) AS INTEGER) AS mask FROM g LEFT JOIN p ON p.recording = g.recording AND p.frame = g.frame""")
def splice_recordings(spark, sf_dir):
    """All recordings, three speakers each, interleaved two by two in slices of fifty frames: a mask has eight bits."""
    frames = A.frames(spark, sf_dir)
    nth = F.row_number().over(Window.orderBy("recording")) - 1  # a row a recording
    ord_ = frames.select("recording").distinct().select("recording", F.floor(nth / 2).alias("group"), (nth % 2).alias("ord"))
    return O.splice(frames.join(ord_, "recording").withColumn("speakers", F.lit(3)), 50)


@query(f"""WITH {A.FRAME_SQL}, c AS (SELECT DISTINCT recording, frame // {PER_CHUNK} AS chunk, (frame // {PER_CHUNK} + 1) * {PER_CHUNK} AS until FROM single),
w AS (SELECT recording, frame AS ord, frame AS lo, frame + 7 AS hi FROM frames_c WHERE frame % 3 = 0 AND label IS NOT NULL)
SELECT c.recording, c.chunk, min(w.ord) AS ord, min(w.hi) - any_value(c.until) AS lag FROM c LEFT JOIN w ON w.recording = c.recording AND w.hi >= c.until AND w.lo < c.until GROUP BY 1, 2""")
def window_lag(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    chunks = O.annotated(frames, PER_CHUNK).withColumn("until", (F.col("chunk") + 1) * PER_CHUNK)
    windows = frames.filter("frame % 3 = 0 AND label IS NOT NULL").select("recording", F.col("frame").alias("ord"), F.col("frame").alias("lo"), (F.col("frame") + 7).alias("hi"))
    return O.first_window(chunks, windows)
