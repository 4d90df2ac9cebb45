"""Wire messages: decoding with rejects, encoding, and their fold into a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver import schemas

SERVER_TYPES = ("session.ready", "transcript.commit", "transcript.provisional", "transcript.revise", "transcript.relabel", "error", "session.closed")
CLIENT_TYPES = ("session.start", "session.flush", "session.stop")


def decode(frames: DataFrame, json: str = "json", schema: str = schemas.SERVER_MESSAGE, types: tuple[str, ...] = SERVER_TYPES) -> tuple[DataFrame, DataFrame]:
    """Messages, and the rows that are none: not JSON, or of an unknown type. Unknown fields are ignored;
    a field with the name of one of the frames' other columns comes out as ``message_`` and its name."""
    parsed = frames.withColumn("__m", F.from_json(json, schema, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.col("__m.type").isin(*types), F.lit(False))
    rest = [c for c in frames.columns if c != json]
    fields = parsed.schema["__m"].dataType.names
    out = parsed.filter(good).select(*rest, *(F.col(f"__m.{c}").alias(f"message_{c}" if c in rest else c) for c in fields))
    if "speaker_provisional" in out.columns:
        out = out.withColumn("speaker_provisional", F.coalesce("speaker_provisional", F.lit(False)))
    return out, parsed.filter(~good).drop("__m")


def encode(message: DataFrame, columns: list[str]) -> Column:
    """JSON without fields that are null, or flags that are false."""
    flags = {f.name for f in message.schema if f.dataType.simpleString() == "boolean" and f.name != "retryable"}
    return F.to_json(F.struct(*(F.when(F.col(c), F.lit(True)).alias(c) if c in flags else F.col(c) for c in columns)))


def transcript(messages: DataFrame) -> DataFrame:
    """Per session the texts of commits and provisional texts in order of ``seq``, then a server's error."""
    text = F.array_sort(F.collect_list(F.when(F.col("type").isin("transcript.commit", "transcript.provisional"), F.struct("seq", "text"))))
    error = F.max(F.when(F.col("type") == "error", F.concat(F.lit("\n["), "message", F.lit("]"))))
    joined = messages.groupBy("session_id").agg(F.array_join(F.transform(text, lambda x: x["text"]), "").alias("t"), error.alias("e"))
    return joined.select("session_id", F.trim(F.concat("t", F.coalesce("e", F.lit("")))).alias("text"))


def first_error(messages: DataFrame) -> DataFrame:
    """The first error of a session; later success does not clear it."""
    return messages.filter("type = 'error'").groupBy("session_id").agg(F.min_by("message", "seq").alias("error"))


def snapshot(text: Column, revision: Column, since: Column) -> Column:
    """The text, or null for a viewer that has this revision already; revision 0 is never had."""
    return F.when((revision == since) & (revision != 0), F.lit(None).cast("string")).otherwise(text)


def dropped(queues: DataFrame) -> DataFrame:
    """Running total of samples dropped per source."""
    order = Window.partitionBy("session_id", "source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return queues.withColumn("dropped_total", F.sum("dropped").over(order))
