"""The data model's tables, derived from the driver's tables: in Spark, and as SQL for the checks.

A session is one day of events, so that every window below has a session to partition by and no task
needs all rows. Positions count from 1, chunks from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPEAKER_OF = "CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 END"
#: Seconds of silence that break a line, in events' time.
GAP = 300.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str, interleaved: bool = False) -> DataFrame:
    """SEGMENT and user_id, value, event_type."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = events.withColumns({"session_id": F.date_format("ts", "yyyy-MM-dd"), "us": F.unix_micros(F.col("ts").cast("timestamp"))})
    by = Window.partitionBy("session_id")
    rows = rows.withColumns({"pos": F.row_number().over(by.orderBy("us", "event_id")).cast("bigint"), "at": (F.col("us") - F.min("us").over(by)) / F.lit(1e6)})
    source = F.col("user_id") % 3 if interleaved else F.floor((F.col("pos") - 1) / 20) % 3
    return rows.select(
        "session_id", "pos", "at", F.col("event_type").alias("text"), F.concat(F.lit("src"), source.cast("string")).alias("source"), F.expr(SPEAKER_OF).alias("speaker"),
        ((F.col("value") < 50) & F.expr(SPEAKER_OF).isNotNull()).alias("provisional"), F.col("pos").alias("seq"), "user_id", "value", "event_type",
    )


SEG_SQL = f"""
ev AS (SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS session_id, epoch_us(ts) AS us FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS pos, min(us) OVER (PARTITION BY session_id) AS us0 FROM ev),
seg AS (SELECT session_id, pos, (us - us0) / 1e6 AS at_s, event_type AS text, 'src' || CAST(((pos - 1) // 20) % 3 AS VARCHAR) AS source,
  'src' || CAST(user_id % 3 AS VARCHAR) AS user_source, {SPEAKER_OF} AS speaker, coalesce(value < 50 AND {SPEAKER_OF} IS NOT NULL, false) AS provisional, pos AS seq, user_id, value, event_type FROM numbered)
"""


def chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    return seg.select("session_id", (F.col("pos") - 1).alias("chunk"), "speaker", "provisional", (F.col("event_type") == "error").alias("boundary"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text per chunk: every third chunk has some."""
    seg = segments(spark, sf_dir)
    return seg.select("session_id", (F.col("pos") - 1).alias("chunk"), F.when(F.col("pos") % 3 == 0, F.col("text")).otherwise("").alias("text"))


def relabels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sign-up corrects the six chunks before it."""
    seg = segments(spark, sf_dir).filter("event_type = 'signup'")
    return seg.select("session_id", (F.col("pos") - 1).alias("arrival"), F.greatest(F.col("pos") - 7, F.lit(0)).alias("from_chunk"), (F.col("pos") - 2).alias("to_chunk"), (F.col("user_id") % 3 + 1).cast("int").alias("speaker"))


CHUNK_SQL = SEG_SQL + """,
labels_c AS (SELECT session_id, pos - 1 AS chunk, speaker, provisional, event_type = 'error' AS boundary FROM seg),
relabels_c AS (SELECT session_id, pos - 1 AS arrival, greatest(pos - 7, 0) AS from_chunk, pos - 2 AS to_chunk, CAST(user_id % 3 + 1 AS INTEGER) AS speaker FROM seg WHERE event_type = 'signup'),
commits_c AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS seq, text, coalesce(lag(pos - 1) OVER (PARTITION BY session_id ORDER BY pos) + 1, 0) AS from_chunk, pos - 1 AS to_chunk FROM seg WHERE pos % 3 = 0)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference speaker mask and hypothesis label per frame; a session is a recording.

    Speakers are the bits 0 to 2. An error frame has two speakers at once, a sign-up frame none.
    """
    seg = segments(spark, sf_dir)
    mask = F.when(F.col("event_type") == "error", F.lit(3)).otherwise(F.coalesce(F.call_function("shiftleft", F.lit(1), F.col("speaker") - 1), F.lit(0)))
    return seg.select(F.col("session_id").alias("recording"), (F.col("pos") - 1).alias("frame"), mask.cast("int").alias("mask"), F.nullif((F.col("user_id") % 4).cast("int"), F.lit(0)).alias("label"))


FRAME_SQL = SEG_SQL + """,
frames_c AS (SELECT session_id AS recording, pos - 1 AS frame, CASE WHEN event_type = 'error' THEN 3 ELSE coalesce(CASE speaker WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 END, 0) END AS mask,
  CAST(nullif(user_id % 4, 0) AS INTEGER) AS label FROM seg),
single AS (SELECT recording, frame, CASE mask WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 END AS spk, label FROM frames_c WHERE mask IN (1, 2, 4))
"""
