"""Frames, voice gate and windows over voiced frames.

``frames``: stream_id, frame (from 0), voiced. Windows restart after a gap of more than ``gap`` frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME, WINDOW_FRAMES, HOP_FRAMES, MAX_GAP = 512, 47, 23, 15
ENTER, LEAVE, HANGOVER = 0.5, 0.35, 4


def voiced_runs(frames: DataFrame, gap: int = MAX_GAP) -> DataFrame:
    """Voiced frames with the run they belong to and their number in it, from 1."""
    order = Window.partitionBy("stream_id").orderBy("frame")
    voiced = frames.filter("voiced").withColumn("_new", F.coalesce(F.col("frame") - F.lag("frame").over(order) > gap, F.lit(True)).cast("int"))
    runs = voiced.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.drop("_new").withColumn("n", F.row_number().over(Window.partitionBy("stream_id", "run").orderBy("frame")))


def windows(frames: DataFrame, width: int = WINDOW_FRAMES, hop: int = HOP_FRAMES, gap: int = MAX_GAP) -> DataFrame:
    """Sliding windows of ``width`` voiced frames every ``hop``: first and last frame, and the run."""
    runs = voiced_runs(frames, gap)
    # frame n lies in the windows k with k * hop < n <= k * hop + width
    low = F.greatest(F.ceil((F.col("n") - width) / hop), F.lit(0))
    spread = runs.withColumn("k", F.explode(F.sequence(low, F.floor((F.col("n") - 1) / hop))))
    full = spread.groupBy("stream_id", "run", "k").agg(F.count(F.lit(1)).alias("c"), F.min("frame").alias("first"), F.max("frame").alias("last")).filter(F.col("c") == width)
    return full.select("stream_id", "run", "k", "first", "last")


def timed_windows(frames: DataFrame, window_s: float, hop_s: float, gap_s: float = 0.5, frame_s: float = FRAME / 16_000) -> DataFrame:
    """:func:`windows` of so many seconds, with the times ``t0`` and ``t1`` from the first frame's start to the last one's end."""
    made = windows(frames, round(window_s / frame_s), max(1, round(hop_s / frame_s)), int(gap_s / frame_s))
    return made.withColumns({"t0": F.col("first") * frame_s, "t1": (F.col("last") + 1) * frame_s})


def voiced_share(frames: DataFrame) -> DataFrame:
    """Frames of each stream, the share of voiced ones, and how long they last in seconds."""
    out = frames.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("voiced").cast("double")).alias("share"))
    return out.withColumn("seconds", F.col("n") * FRAME / 16_000)


def real_time_factor(seconds: Column, elapsed: Column) -> Column:
    """How many times faster than it lasts audio was worked on; null for no time at all."""
    return seconds / F.nullif(elapsed, F.lit(0.0))


def hops(frames: DataFrame, hop: int = HOP_FRAMES, gap: int = MAX_GAP) -> DataFrame:
    """Consecutive pieces of ``hop`` voiced frames; an incomplete one is dropped."""
    runs = voiced_runs(frames, gap).withColumn("k", F.floor((F.col("n") - 1) / hop))
    full = runs.groupBy("stream_id", "run", "k").agg(F.count(F.lit(1)).alias("c"), F.min("frame").alias("first"), F.max("frame").alias("last")).filter(F.col("c") == hop)
    return full.select("stream_id", "run", "k", "first", "last")


def gate(probs: DataFrame, enter: float = ENTER, leave: float = LEAVE, hangover: int = HANGOVER) -> DataFrame:
    """Voiced or not by hysteresis over ``prob``: on from ``enter``, off after more than ``hangover``
    frames in a row below ``leave``.

    A frame of ``enter`` or more switches on, the frame after ``hangover`` low ones off; in between the
    last such event holds, so the state is a running window and needs no fold.
    """
    order = Window.partitionBy("stream_id").orderBy("frame")
    low = F.col("prob") < leave
    streak = probs.withColumn("_g", F.sum((~low).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = streak.withColumn("_low", F.when(F.col("prob") < leave, F.row_number().over(Window.partitionBy("stream_id", "_g").orderBy("frame")) - F.when(F.col("_g") > 0, 1).otherwise(0)).otherwise(0))
    event = F.when(F.col("prob") >= enter, True).when(F.col("_low") > hangover, False)
    state = F.last(event, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return streak.withColumn("voiced", F.coalesce(state, F.lit(False))).drop("_g", "_low")


def framed(samples: DataFrame, size: int = FRAME) -> DataFrame:
    """Samples (stream_id, pos from 0, x) in whole frames of ``size``, with what is left over as carry."""
    by = Window.partitionBy("stream_id")
    rows = samples.withColumns({"frame": F.floor(F.col("pos") / size), "_n": F.count(F.lit(1)).over(by)})
    return rows.groupBy("stream_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum")).withColumn("whole", F.col("n") == size)


def analysis_frames(n: Column, length: int = 400, shift: int = 160) -> Column:
    """How many overlapping analysis frames fit into n samples."""
    return F.when(n < length, F.lit(0)).otherwise(F.floor((n - length) / shift) + 1).cast("bigint")


def analysis_spans(n: Column, length: int = 400, shift: int = 160) -> Column:
    """The overlapping analysis frames of n samples as (frame, lo, hi exclusive); what is left over is dropped."""
    k = analysis_frames(n, length, shift)
    return F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.struct(i.alias("frame"), (i * shift).alias("lo"), (i * shift + length).alias("hi")))).otherwise(F.expr("CAST(array() AS array<struct<frame: bigint, lo: bigint, hi: bigint>>)"))
