"""Transcripts: turns, lines, rendering, merging of sources, corrections by the reader.

All windows partition by session and order by position, so a session is the largest unit that one task
holds. Speakers are numbered within a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T

PLAIN, TIMESTAMPED, LABELLED = "plain", "timestamped", "labelled"
NEW_LINE_AFTER = 1.5


def with_turns(segments: DataFrame) -> DataFrame:
    """Adds ``turn`` (from 1) and ``turn_speaker``, the speaker of the turn's first segment.

    A turn starts with the session, where the source changes, and where a speaker is named who is not
    the last one named in this run of one source. Unnamed segments join the open turn.
    """
    order = Window.partitionBy("session_id").orderBy("pos")
    before = F.lag("source").over(order)
    first = F.row_number().over(order) == 1
    rows = segments.withColumn("__switch", first | ~F.col("source").eqNullSafe(before))
    rows = rows.withColumn("__run", F.sum(F.col("__switch").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("session_id", "__run").orderBy("pos")
    last = F.last("speaker", ignorenulls=True).over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("__switch") | (F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(last))
    rows = rows.withColumn("__opens", opens)
    rows = rows.withColumn("turn", F.sum(F.col("__opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_turn = Window.partitionBy("session_id", "turn").orderBy("pos")
    return rows.withColumn("turn_speaker", F.first("speaker").over(in_turn)).drop("__switch", "__run", "__opens")


def joined(value: Column, order: Column | str = "pos", separator: str = "") -> Column:
    """Aggregate: texts joined in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o") if isinstance(order, str) else order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(items, lambda x: x["v"]), separator)


def turns(segments: DataFrame) -> DataFrame:
    """One row per turn: speaker, source, first position, number of segments, text."""
    return with_turns(segments).groupBy("session_id", "turn").agg(
        F.first("turn_speaker").alias("speaker"), F.first("source").alias("source"), F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_segments"), joined(F.col("text")).alias("text"),
    )


def lines(segments: DataFrame, gap: float = NEW_LINE_AFTER) -> DataFrame:
    """Adds ``line`` within ``turn``: a silence of ``gap`` seconds or more breaks. A turn has one source,
    so the source never breaks a line inside it."""
    in_turn = Window.partitionBy("session_id", "turn").orderBy("pos")
    rows = with_turns(segments)
    breaks = F.coalesce(F.col("at") - F.lag("at").over(in_turn) >= gap, F.lit(True))
    return rows.withColumn("__b", breaks.cast("int")).withColumn("line", F.sum("__b").over(in_turn.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def render(segments: DataFrame, layout: str = PLAIN, gap: float = NEW_LINE_AFTER) -> DataFrame:
    """One row per session with its ``body``.

    Plain: a line per turn, with the speaker where there is one. Stamped, where no segment of the
    session has a speaker: a line per segment that is not blank. Stamped otherwise: blank segments go
    first, then lines within turns; only the first piece of a line is trimmed, at both ends if alone.
    """
    if layout == PLAIN:
        rows = turns(segments).select("session_id", "turn", F.concat(T.speaker_prefix(F.col("speaker")), "text").alias("l"))
        return rows.groupBy("session_id").agg(T.trim(joined(F.col("l"), "turn", "\n")).alias("body"))
    source = F.when(F.col("source").isNotNull(), F.concat(F.lit("["), "source", F.lit("] "))).otherwise("") if layout == LABELLED else F.lit("")
    named = F.max(F.col("speaker").isNotNull()).over(Window.partitionBy("session_id"))
    full = segments.withColumn("_named", named).filter(~T.is_blank(F.col("text")))
    flat = full.filter(~F.col("_named")).select("session_id", F.col("pos").alias("o"), F.concat(T.stamp(F.col("at")), F.lit(" "), source, T.trim(F.col("text"))).alias("l"))
    pieces = lines(full.filter("_named"), gap)
    in_line = Window.partitionBy("session_id", "turn", "line").orderBy("pos")
    alone = F.count(F.lit(1)).over(Window.partitionBy("session_id", "turn", "line")) == 1
    piece = F.when(F.row_number().over(in_line) > 1, F.col("text")).when(alone, T.trim(F.col("text"))).otherwise(T.ltrim(F.col("text")))
    made = pieces.withColumns({"piece": piece, "s": source}).groupBy("session_id", "turn", "line").agg(
        F.min("pos").alias("o"), F.min(F.struct("pos", "at", "s", "turn_speaker")).alias("f"), joined(F.col("piece")).alias("t"),
    )
    labelled = made.select("session_id", "o", F.concat(T.stamp(F.col("f.at")), F.lit(" "), F.col("f.s"), T.speaker_prefix(F.col("f.turn_speaker")), "t").alias("l"))
    return flat.unionByName(labelled).groupBy("session_id").agg(joined(F.col("l"), "o", "\n").alias("body"))


def merge_sources(parts: list[DataFrame]) -> DataFrame:
    """Segments of several recordings of one session in order of arrival; ties by recording, then position."""
    tagged = None
    for i, p in enumerate(parts):
        one = p.withColumn("part", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    order = Window.partitionBy("session_id").orderBy("at", "part", "pos")
    return tagged.withColumn("merged_pos", F.row_number().over(order).cast("bigint"))


def by_source(segments: DataFrame, path: Column, layout: str = PLAIN) -> DataFrame:
    """One row per session and source with text: ord of first appearance, path of its file and body."""
    name = F.coalesce("source", F.lit("transcript"))
    rows = segments.withColumn("_name", name).withColumn("_session", F.col("session_id"))
    keyed = rows.withColumn("session_id", F.to_json(F.struct("_session", "_name")))
    bodies = render(keyed, layout)
    firsts = keyed.groupBy("session_id", "_session", "_name").agg(F.min("pos").alias("first_pos"))
    out = firsts.join(bodies, "session_id").filter(~T.is_blank(F.col("body")))
    ord_ = F.row_number().over(Window.partitionBy("_session").orderBy("first_pos"))
    return out.select(F.col("_session").alias("session_id"), ord_.cast("bigint").alias("ord"), F.col("_name").alias("source"), T.path_for_source(path, F.col("_name")).alias("path"), "body")


def relabel(segments: DataFrame, corrections: DataFrame, bucket: int = 64) -> DataFrame:
    """Segments after corrections (session_id, arrival, from_seq, to_seq, speaker), in order of arrival.

    A correction reaches segments of its range that are unnamed or provisional and bear another name; it
    settles them, so the first one that applies is the only one. The range join goes over buckets of seq.
    """
    open_ = F.col("speaker").isNull() | F.col("provisional")
    spread = corrections.select("session_id", F.col("arrival").alias("_arrival"), F.col("from_seq").alias("_from"), F.col("to_seq").alias("_to"), F.col("speaker").alias("_new"))
    spread = spread.filter("_from <= _to").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / bucket), F.floor(F.col("_to") / bucket))))
    reach = segments.filter(open_ & F.col("seq").isNotNull()).select("session_id", "pos", "seq", "speaker").withColumn("_bucket", F.floor(F.col("seq") / bucket))
    hit = reach.join(spread, ["session_id", "_bucket"]).filter(F.col("seq").between(F.col("_from"), F.col("_to")) & ~F.col("speaker").eqNullSafe(F.col("_new")))
    first = hit.groupBy("session_id", "pos").agg(F.min(F.struct("_arrival", "_from", "_to", "_new")).alias("__c"))
    out = segments.join(first, ["session_id", "pos"], "left")
    return out.withColumns({"speaker": F.coalesce("__c._new", "speaker"), "provisional": F.col("provisional") & F.col("__c").isNull()}).drop("__c")


def merge_states(states: DataFrame) -> DataFrame:
    """Snapshots of a session's recordings (ord, recording, error, transcript, changes) folded into one.

    ``ord`` may be a struct, and has to be one where a single value leaves snapshots of a session equal.
    """
    error = F.min(F.when(F.col("error").isNotNull(), F.struct("ord", F.col("error").alias("v"))))["v"]
    texts = F.array_sort(F.collect_list(F.when(F.col("transcript") != "", F.struct("ord", F.col("transcript").alias("v")))))
    return states.groupBy("session_id").agg(F.bool_or("recording").alias("recording"), error.alias("error"), F.sum("changes").alias("changes"), F.array_join(F.transform(texts, lambda x: x["v"]), "\n").alias("transcript"))
