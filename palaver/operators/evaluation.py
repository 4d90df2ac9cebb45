"""Evaluation of labels against annotated speech.

Tables: ``frames`` (recording, frame, mask, label): a bit per speaker in the reference mask, and the
hypothesis label. Only frames with exactly one speaker are scored. A recording is the unit of every
window and group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME_SECONDS, SIGNIFICANT, VOTE_SLOTS = 0.01, 0.10, 8


def speaker(mask: Column | str = "mask") -> Column:
    """The only speaker of a mask, from 0; null for none or several."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.when(F.bit_count(m) == 1, F.bit_count(m - 1))


def single(frames: DataFrame) -> DataFrame:
    return frames.withColumn("spk", speaker()).filter("spk IS NOT NULL")


def overlap(frames: DataFrame) -> DataFrame:
    """Frames per recording, speaker and label."""
    return single(frames).filter("label IS NOT NULL").groupBy("recording", "spk", "label").agg(F.count(F.lit(1)).alias("n"))


def counts(frames: DataFrame) -> DataFrame:
    """Per recording: scored and missed frames, miss rate, and number of labels."""
    out = single(frames).groupBy("recording").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("label").isNull()).alias("missed"), F.count_distinct("label").alias("labels"))
    return out.withColumn("miss", F.col("missed") / F.greatest("scored", F.lit(1)))


def splits_merges(frames: DataFrame, share: float = SIGNIFICANT) -> DataFrame:
    """Per recording: speakers over several labels, and labels over several speakers, counting only
    shares of at least ``share``. A speaker's share is of all its frames, missed ones included."""
    cells = overlap(frames)
    by_spk = single(frames).groupBy("recording", "spk").agg(F.count(F.lit(1)).alias("all"))
    own = cells.join(by_spk, ["recording", "spk"]).groupBy("recording", "spk").agg(F.count_if(F.col("n") >= F.col("all") * share).alias("k"))
    split = own.groupBy("recording").agg(F.sum(F.greatest(F.col("k") - 1, F.lit(0))).alias("splits"))
    by_label = cells.withColumn("all", F.sum("n").over(Window.partitionBy("recording", "label")))
    shared = by_label.groupBy("recording", "label").agg(F.count_if(F.col("n") >= F.col("all") * share).alias("k"))
    merge = shared.groupBy("recording").agg(F.sum(F.greatest(F.col("k") - 1, F.lit(0))).alias("merges"))
    return split.join(merge, "recording", "full").select("recording", F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("merges", F.lit(0)).alias("merges"))


def thirds(frames: DataFrame) -> DataFrame:
    """The most frequent label per recording, speaker and third; ties go to the lowest label."""
    n = F.count(F.lit(1)).over(Window.partitionBy("recording"))
    cells = frames.withColumn("_n", n).withColumn("third", F.least(F.floor(F.col("frame") * 3 / F.col("_n")), F.lit(2)).cast("int"))
    cells = single(cells).filter("label IS NOT NULL").groupBy("recording", "spk", "third", "label").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("recording", "spk", "third").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select("recording", "spk", "third", (-F.col("b.l")).alias("label"))


def best_mapping(frames: DataFrame) -> DataFrame:
    """Per recording the most frames that a one-to-one mapping of labels to speakers gets right.

    Exact, over all subsets of speakers (at most eight); a group is one recording's small matrix.
    """

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        spks = sorted(cells["spk"].unique())
        place = {s: i for i, s in enumerate(spks)}
        best = {0: 0}
        for _, rows in cells.groupby("label"):
            found = dict(best)
            for used, total in best.items():
                for s, n in zip(rows["spk"], rows["n"], strict=True):
                    bit = 1 << place[s]
                    if not used & bit:
                        found[used | bit] = max(found.get(used | bit, 0), total + int(n))
            best = found
        return pd.DataFrame({"recording": [cells["recording"].iloc[0]], "correct": [max(best.values())]})

    return overlap(frames).groupBy("recording").applyInPandas(solve, "recording string, correct bigint")


def score(frames: DataFrame) -> DataFrame:
    """Miss, confusion, splits and merges per recording."""
    out = counts(frames).join(best_mapping(frames), "recording", "left").join(splits_merges(frames), "recording", "left").fillna(0, ["correct", "splits", "merges"])
    return out.withColumn("confusion", (F.col("scored") - F.col("missed") - F.col("correct")) / F.greatest("scored", F.lit(1)))


def changes(rows: DataFrame, value: str) -> DataFrame:
    """Frames at which a non-null value differs from the last non-null one."""
    known = rows.filter(F.col(value).isNotNull()).withColumn("_before", F.lag(value).over(Window.partitionBy("recording").orderBy("frame")))
    return known.filter(F.col("_before") != F.col(value)).select("recording", "frame", F.col(value).alias("value"))


def run_lengths(frames: DataFrame) -> DataFrame:
    """Maximal runs of consecutive frames with one label."""
    known = frames.filter("label IS NOT NULL")
    island = F.col("frame") - F.row_number().over(Window.partitionBy("recording", "label").orderBy("frame"))
    return known.withColumn("_i", island).groupBy("recording", "label", "_i").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("until")).drop("_i")


def nearest(points: DataFrame, others: DataFrame) -> DataFrame:
    """Per point (recording, frame) the distance to the nearest other on either side; null without any.

    A union and two running windows: no range join, and no pairs.
    """
    both = points.select("recording", "frame", F.lit(1).alias("_p")).unionByName(others.select("recording", "frame", F.lit(0).alias("_p")))
    other = F.when(F.col("_p") == 0, F.col("frame"))
    by = Window.partitionBy("recording")
    # an other at the same frame counts as one after
    before = F.last(other, ignorenulls=True).over(by.orderBy("frame", F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(other, ignorenulls=True).over(by.orderBy(F.desc("frame"), "_p").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumns({"_x": before, "_y": after}).filter("_p = 1").select("recording", "frame", F.least(F.col("frame") - F.col("_x"), F.col("_y") - F.col("frame")).alias("distance"))


def index_pick(rows: DataFrame, by: list[str], value: str, picks: dict[str, tuple[int, int]], minus: int = 0) -> DataFrame:
    """Order statistics by floor index: name to (a, b) picks element ``(n - minus) * a // b``."""
    order = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = rows.filter(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(order) - 1, "_n": n})
    chosen = [F.max(F.when(F.col("_r") == F.floor((F.col("_n") - minus) * a / b), F.col(value))).alias(k) for k, (a, b) in picks.items()]
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *chosen)


def boundary_stats(points: DataFrame, others: DataFrame, near: float) -> DataFrame:
    """Median, ninth decile and share within ``near`` of distances to the nearest other."""
    d = nearest(points, others).filter("distance IS NOT NULL")
    share = d.groupBy("recording").agg(F.avg((F.col("distance") <= near).cast("double")).alias("share"))
    return index_pick(d, ["recording"], "distance", {"median": (1, 2), "p90": (9, 10)}).join(share, "recording")


def vote_frames(windows: DataFrame, slots: int = VOTE_SLOTS) -> DataFrame:
    """Frames under labelled windows (recording, ord, lo, hi exclusive, label): at most ``slots`` votes in
    order of arrival; most votes win, then the label voted last."""
    votes = windows.filter("label IS NOT NULL AND lo < hi").withColumn("frame", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    slot = F.row_number().over(Window.partitionBy("recording", "frame").orderBy("ord"))
    kept = votes.withColumn("slot", slot).filter(F.col("slot") <= slots)
    tally = kept.groupBy("recording", "frame", "label").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("s"))
    return tally.groupBy("recording", "frame").agg(F.max(F.struct("n", "s", "label")).alias("b")).select("recording", "frame", F.col("b.label").alias("label"))


def paint_words(words: DataFrame, unit: str = "frame") -> DataFrame:
    """Masks per frame from words (recording, spk, lo, hi): both ends inclusive, speakers' bits joined."""
    spread = words.withColumn(unit, F.explode(F.sequence("lo", "hi")))
    return spread.groupBy("recording", unit).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("spk"))).alias("mask"))


def paint_chunks(labels: DataFrame, per_chunk: int, frames: DataFrame) -> DataFrame:
    """Chunk labels (recording, chunk, label) on the frames of a recording that they cover."""
    return frames.select("recording", "frame").withColumn("chunk", F.floor(F.col("frame") / per_chunk)).join(labels, ["recording", "chunk"], "left").select("recording", "frame", "label")


def speaker_of_label(frames: DataFrame) -> DataFrame:
    """Per label the speaker with most of its frames; ties go to the highest speaker."""
    return overlap(frames).groupBy("recording", "label").agg(F.max(F.struct("n", "spk")).alias("b")).select("recording", "label", F.col("b.spk").alias("spk"))


def label_of_speaker(frames: DataFrame) -> DataFrame:
    """Per speaker the label mapped to it that is heard first."""
    seen = single(frames).filter("label IS NOT NULL").groupBy("recording", "label").agg(F.min("frame").alias("f"))
    return speaker_of_label(frames).join(seen, ["recording", "label"]).groupBy("recording", "spk").agg(F.min(F.struct("f", "label")).alias("b")).select("recording", "spk", F.col("b.label").alias("label"))


def first_heard(frames: DataFrame) -> DataFrame:
    return single(frames).groupBy("recording", "spk").agg(F.min("frame").alias("first"))


def emitted_at(frame: Column, per_chunk: int, lag: int) -> Column:
    """The frame at which a label for ``frame`` is out: the end of its chunk and ``lag`` chunks."""
    return (F.ceil(frame / per_chunk) * per_chunk + lag * per_chunk).cast("bigint")


def own_speech(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """Seconds that ``spk`` speaks alone in spans (recording, spk, lo, hi exclusive), by running counts.

    Running counts per speaker, looked up at both ends by a union and a window.
    """
    alone = single(frames).select("recording", "spk", "frame").withColumn("c", F.row_number().over(Window.partitionBy("recording", "spk").orderBy("frame")))
    ends = spans.select("recording", "spk", "lo", "hi", F.explode(F.array("lo", "hi")).alias("frame")).distinct()
    both = alone.select("recording", "spk", "frame", "c", F.lit(1).alias("k"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"))
    both = both.unionByName(ends.select("recording", "spk", "frame", F.lit(None).cast("int").alias("c"), F.lit(0).alias("k"), "lo", "hi"))
    upto = F.coalesce(F.last("c", ignorenulls=True).over(Window.partitionBy("recording", "spk").orderBy("frame", "k")), F.lit(0))
    at = both.withColumn("u", upto).filter("k = 0")
    sums = at.groupBy("recording", "spk", "lo", "hi").agg((F.max("u") - F.min("u")).alias("n"))
    return sums.select("recording", "spk", "lo", "hi", F.when(F.col("hi") > F.col("lo"), F.col("n") * FRAME_SECONDS).otherwise(0.0).alias("seconds"))


def first_label_latency(frames: DataFrame, per_chunk: int, lag: int) -> DataFrame:
    """Per speaker the own speech until its label is first out."""
    starts = first_heard(frames).join(label_of_speaker(frames), ["recording", "spk"])
    hit = frames.select("recording", "frame", "label").join(starts, ["recording", "label"]).filter("frame >= first").groupBy("recording", "spk", "first").agg(F.min("frame").alias("at"))
    spans = hit.select("recording", "spk", F.col("first").alias("lo"), emitted_at(F.col("at"), per_chunk, lag).alias("hi"))
    return own_speech(spans, frames).select("recording", "spk", "seconds")


def turn_switch_latency(frames: DataFrame, per_chunk: int, lag: int) -> DataFrame:
    """Per turn change, followed by the speaker's label before the next one, the own speech until it is out."""
    turns = changes(frames.withColumn("spk", speaker()), "spk").select("recording", F.col("frame").alias("at"), F.col("value").alias("spk"))
    until = F.lead("at").over(Window.partitionBy("recording").orderBy("at"))
    turns = turns.withColumn("until", F.coalesce(until, F.lit(1 << 60))).join(label_of_speaker(frames), ["recording", "spk"])
    # frames carry the turn they lie in, so the range join is one on equality
    marks = frames.select("recording", "frame", "label").join(turns.select("recording", F.col("at").alias("frame"), F.col("at").alias("t")), ["recording", "frame"], "left")
    inside = marks.withColumn("t", F.last("t", ignorenulls=True).over(Window.partitionBy("recording").orderBy("frame"))).filter("t IS NOT NULL")
    hit = inside.join(turns.withColumnRenamed("at", "t"), ["recording", "t", "label"]).filter("frame < until").groupBy("recording", "spk", "t").agg(F.min("frame").alias("f"))
    spans = hit.select("recording", "spk", F.col("t").alias("lo"), emitted_at(F.col("f"), per_chunk, lag).alias("hi"))
    return own_speech(spans, frames).select("recording", "spk", F.col("lo").alias("at"), "seconds")


def annotated(frames: DataFrame, per_chunk: int) -> DataFrame:
    """Chunks with at least one frame of a single speaker."""
    return single(frames).select("recording", F.floor(F.col("frame") / per_chunk).alias("chunk")).distinct()


def pure_speaker(spans: DataFrame, frames: DataFrame, clean_share: float = 0.9, total_share: float = 0.5) -> DataFrame:
    """The speaker of spans (recording, id, lo, hi exclusive): with at least 90% of the frames of single
    speakers and half of all; null otherwise. Ties go to the highest speaker."""
    covered = spans.filter("lo < hi").withColumn("frame", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))).join(frames.select("recording", "frame", speaker().alias("spk")), ["recording", "frame"])
    by = covered.groupBy("recording", "id", "spk").agg(F.count(F.lit(1)).alias("n"))
    sums = by.groupBy("recording", "id").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("spk").isNotNull(), F.col("n"))).alias("clean"), F.max(F.when(F.col("spk").isNotNull(), F.struct("n", "spk"))).alias("b"))
    pure = (F.col("b.n") >= F.col("clean") * clean_share) & (F.col("b.n") >= F.col("total") * total_share)
    return spans.select("recording", "id").join(sums, ["recording", "id"], "left").select("recording", "id", F.when(pure, F.col("b.spk")).alias("spk"))


def splice(parts: DataFrame, slice_frames: int) -> DataFrame:
    """Recordings (group, ord, frame, mask, speakers) of a group interleaved in slices: bits of later
    recordings are moved up, and a recording's last slice is filled with silence. Adds ``out_frame``. A mask
    has room for a few recordings, so many are spliced in groups, each a recording of its own."""
    sizes = parts.groupBy("group", "recording", "ord").agg(F.max("speakers").alias("k"), F.max("frame").alias("m"))
    every = Window.partitionBy("group").orderBy("ord")
    shift = F.coalesce(F.sum("k").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    shifted = sizes.withColumn("shift", shift)
    slices = shifted.withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("m") / slice_frames))))
    place = slices.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("s", "ord")) - 1)
    grid = place.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(slice_frames - 1))))
    grid = grid.select("group", "recording", "shift", (F.col("s") * slice_frames + F.col("i")).alias("frame"), (F.col("place") * slice_frames + F.col("i")).cast("bigint").alias("out_frame"))
    out = grid.join(parts.select("group", "recording", "frame", "mask"), ["group", "recording", "frame"], "left")
    return out.select("group", "out_frame", F.coalesce(F.call_function("shiftleft", F.col("mask"), F.col("shift")), F.lit(0)).alias("mask"))


def first_window(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """Per chunk (recording, chunk, until) the first window (ord, lo, hi) that ends at or after it and
    began before its end, and how long after the chunk it ends; null without one.

    Windows slide, so the first one to end late enough decides: a union and a running window.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    points = chunks.select("recording", F.col("until").alias("at"), F.lit(0).alias("k"), "chunk", none("struct<ord:bigint,lo:bigint,hi:bigint>", "w"))
    ends = windows.select("recording", F.col("hi").cast("bigint").alias("at"), F.lit(1).alias("k"), none("bigint", "chunk"), F.struct(F.col("ord").cast("bigint").alias("ord"), F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi")).alias("w"))
    # from the end backwards, the last window seen is the first one that ends at or after this point
    order = Window.partitionBy("recording").orderBy(F.desc("at"), F.desc("k"), F.desc("w.ord")).rowsBetween(Window.unboundedPreceding, 0)
    seen = points.unionByName(ends).withColumn("f", F.last("w", ignorenulls=True).over(order)).filter("k = 0")
    fits = F.col("f.lo") < F.col("at")
    return seen.select("recording", "chunk", F.when(fits, F.col("f.ord")).alias("ord"), F.when(fits, F.col("f.hi") - F.col("at")).alias("lag"))
