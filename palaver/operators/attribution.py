"""Attribution of committed text to speakers: spans, votes, release, late corrections.

Everything is keyed by session and ordered by chunk. Range joins have bounded ranges, so they are
exploded into chunks or buckets and become equality joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAG_CHUNKS, RELABEL_WINDOW = 2, 30.0
CHUNK_SECONDS = 0.56


def commits(texts: DataFrame) -> DataFrame:
    """Commits of texts per chunk: seq from 1, and the chunks since the commit before."""
    order = Window.partitionBy("session_id").orderBy("chunk")
    said = texts.filter("text <> ''")
    return said.select("session_id", F.row_number().over(order).cast("bigint").alias("seq"), "text", F.coalesce(F.lag("chunk").over(order) + 1, F.lit(0)).cast("bigint").alias("from_chunk"), F.col("chunk").alias("to_chunk"))


def release_chunk(commits_: DataFrame, labels: DataFrame, lag: int = LAG_CHUNKS) -> DataFrame:
    """Adds ``released_at``: the chunk after whose labels a commit has its lag, or the last one of a
    session that ends before; ``forced`` tells which. Commits leave in order."""
    ends = labels.groupBy("session_id").agg(F.max("chunk").alias("_last"))
    out = commits_.join(ends, "session_id")
    ripe = F.col("to_chunk") + lag
    return out.withColumns({"released_at": F.least(ripe, "_last"), "forced": ripe > F.col("_last")}).drop("_last")


def majority(commits_: DataFrame, labels: DataFrame, lag: int = LAG_CHUNKS) -> DataFrame:
    """Commits with speaker and provisional by the votes of their last chunk and the ``lag`` after it.

    Votes stop before the first boundary after the first of these chunks. Most votes win, then the
    earliest vote; a label is provisional where all votes for it are. Without votes it is null.
    """
    wanted = commits_.select("session_id", "seq", F.col("to_chunk").alias("_at"), F.explode(F.sequence(F.col("to_chunk"), F.col("to_chunk") + lag)).alias("chunk"))
    votes = wanted.join(labels, ["session_id", "chunk"])
    order = Window.partitionBy("session_id", "seq").orderBy("chunk")
    cut = F.max((F.col("boundary") & (F.col("chunk") > F.col("_at"))).cast("int")).over(order)
    counted = votes.withColumn("_cut", cut).filter("_cut = 0 AND speaker IS NOT NULL")
    tally = counted.groupBy("session_id", "seq", "speaker").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("first"), F.every("provisional").alias("provisional"))
    best = tally.groupBy("session_id", "seq").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "speaker", "provisional")).alias("__b"))
    out = commits_.join(best, ["session_id", "seq"], "left")
    return out.withColumns({"speaker": F.col("__b.speaker"), "provisional": F.coalesce("__b.provisional", F.lit(False))}).drop("__b")


def window_chunks(seconds: float, chunk_seconds: float = CHUNK_SECONDS) -> int:
    return 0 if seconds <= 0 else -int(-seconds // chunk_seconds)


def reach(emitted: DataFrame, relabels: DataFrame, window: int, lag: int = LAG_CHUNKS, bucket: int = 32) -> DataFrame:
    """Pairs of commit and correction: spans overlap, the commit was out before the correction came and
    not older than ``window`` chunks (0: no pairs)."""
    if window == 0:
        window = -1
    r = relabels.select("session_id", "arrival", F.col("from_chunk").alias("r_from"), F.col("to_chunk").alias("r_to"), F.col("speaker").alias("r_speaker")).filter("r_from <= r_to")
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("r_from") / bucket), F.floor(F.col("r_to") / bucket))))
    e = emitted.select("session_id", "seq", "from_chunk", "to_chunk", "speaker", "provisional").withColumn("_b", F.explode(F.sequence(F.floor(F.col("from_chunk") / bucket), F.floor(F.col("to_chunk") / bucket))))
    overlap = (F.col("from_chunk") <= F.col("r_to")) & (F.col("to_chunk") >= F.col("r_from"))
    first = F.col("_b") == F.greatest(F.floor(F.col("r_from") / bucket), F.floor(F.col("from_chunk") / bucket))  # a pair meets in one bucket only
    timely = (F.col("to_chunk") + lag < F.col("arrival")) & (F.col("to_chunk") >= F.col("arrival") + 1 - window)
    return e.join(r, ["session_id", "_b"]).filter(overlap & first & timely).drop("_b")


def relabel(emitted: DataFrame, relabels: DataFrame, window: int, lag: int = LAG_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """Commits after corrections, and per correction the commits it changed.

    A correction changes commits without a speaker, and provisional ones of another speaker; the first
    that does settles a commit.
    """
    pairs = reach(emitted, relabels, window, lag).filter("speaker IS NULL OR (provisional AND speaker <> r_speaker)")
    first = pairs.groupBy("session_id", "seq").agg(F.min(F.struct("arrival", "r_from", "r_to", "r_speaker")).alias("__c"))
    out = emitted.join(first, ["session_id", "seq"], "left")
    out = out.withColumns({"speaker": F.coalesce("__c.r_speaker", "speaker"), "provisional": F.col("provisional") & F.col("__c").isNull()}).drop("__c")
    return out, first.select("session_id", "seq", "__c.*")


def messages(changed: DataFrame) -> DataFrame:
    """Correction messages: unbroken runs of seq that one correction changed."""
    of = ["session_id", "arrival", "r_from", "r_to", "r_speaker"]
    island = F.col("seq") - F.row_number().over(Window.partitionBy(*of).orderBy("seq"))
    runs = changed.withColumn("_i", island).groupBy(*of, "_i").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"))
    return runs.select("session_id", "arrival", "from_seq", "to_seq", F.col("r_speaker").alias("speaker"))


def labelled(text: Column) -> Column:
    return F.trim(text) != ""
