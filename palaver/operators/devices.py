"""Capture devices and ports from an audio server's JSON dump.

A dump is a table with one JSON object per row: ``dump`` (which one), ``pos`` and ``json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T

KINDS = {"Microphone": 0, "Monitor": 1, "Application": 2}


def _prop(name: str) -> Column:
    return F.get_json_object("json", f"$.info.props['{name}']")


def sources(dump: DataFrame) -> DataFrame:
    """Nodes that can be captured: target, name, kind, detail, stable_name, sink_description."""
    rows = dump.select("dump", "pos", F.get_json_object("json", "$.id").try_cast("bigint").alias("target"), *(_prop(p).alias(p.replace(".", "_")) for p in ("media.class", "node.name", "node.description", "application.name", "media.name")))
    cls = F.col("media_class")
    source, sink, app = cls.isin("Audio/Source", "Audio/Source/Virtual"), cls == "Audio/Sink", cls == "Stream/Output/Audio"
    described = F.coalesce("node_description", "node_name", F.lit("unknown"))
    kind = F.when(source & F.coalesce(F.col("node_name").endswith(".monitor"), F.lit(False)), "Monitor").when(source, "Microphone").when(sink, "Monitor").when(app, "Application")
    name = F.when(source, described).when(sink, F.concat(F.lit("Everything playing on "), described)).when(app, F.coalesce("application_name", "node_name", F.lit("unknown application")))
    out = rows.withColumns({"kind": kind, "name": name}).filter("kind IS NOT NULL AND target IS NOT NULL")
    return out.select("dump", "pos", "target", "name", "kind", F.when(app, F.col("media_name")).alias("detail"), F.when(~app, F.col("node_name")).alias("stable_name"), F.when(sink, described).alias("sink_description"))


def ports(dump: DataFrame) -> DataFrame:
    """Ports with a node and a direction."""
    rows = dump.filter(F.get_json_object("json", "$.type") == "PipeWire:Interface:Port")
    out = rows.select("dump", F.get_json_object("json", "$.id").try_cast("bigint").alias("id"), _prop("node.id").try_cast("bigint").alias("node_id"), _prop("port.direction").alias("direction"), F.coalesce(_prop("port.name"), F.lit("")).alias("name"))
    return out.filter("node_id IS NOT NULL AND direction IS NOT NULL")


def capture_node(dump: DataFrame, name: str) -> DataFrame:
    """Per dump the first capture stream of exactly this name."""
    hit = dump.filter((_prop("media.class") == "Stream/Input/Audio") & (_prop("node.name") == name))
    first = hit.groupBy("dump").agg(F.min_by("json", "pos").alias("json"))
    return first.select("dump", F.get_json_object("json", "$.id").cast("bigint").alias("node_id"))


def disambiguate(devices: DataFrame) -> DataFrame:
    """A microphone named as some output of its dump is marked as the input."""
    outputs = devices.filter("kind = 'Monitor' AND sink_description IS NOT NULL").select("dump", F.col("sink_description").alias("name"), F.lit("Microphone").alias("kind"), F.lit(True).alias("_same")).distinct()
    out = devices.join(outputs, ["dump", "name", "kind"], "left")
    return out.withColumn("name", F.when(F.col("_same"), F.concat("name", F.lit(" (input)"))).otherwise(F.col("name"))).drop("_same")


def mark_default(devices: DataFrame, default: Column) -> DataFrame:
    marked = (F.col("kind") == "Monitor") & F.col("stable_name").eqNullSafe(default) & default.isNotNull()
    return devices.withColumn("name", F.when(marked, F.concat("name", F.lit(" (default output)"))).otherwise(F.col("name")))


def kind_order(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for name, place in KINDS.items():
        out = F.when(kind == name, place).otherwise(out)
    return out


def ranked(devices: DataFrame) -> DataFrame:
    """Adds ``rank`` by kind, then name without regard to case; ties as they came."""
    order = Window.partitionBy("dump").orderBy(kind_order(F.col("kind")), F.lower("name"), "pos")
    return devices.withColumn("rank", F.row_number().over(order))


def display() -> Column:
    detail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" — "), T.truncate(F.col("detail"), 48)))
    return F.concat("name", F.coalesce(detail, F.lit("")))


def short_label() -> Column:
    bare = F.regexp_replace("name", r"( \(input\))+$", "")
    return F.when(F.col("kind") == "Monitor", "System audio").when(F.col("kind") == "Application", F.col("name")).otherwise(T.truncate(bare, 24))


def stable_key() -> Column:
    app = F.concat(F.lit("app:"), "name", F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(":"), "detail")).otherwise(""))
    return F.coalesce("stable_name", app)


def choose(devices: DataFrame, remembered: Column) -> DataFrame:
    """Per dump the remembered device, else a microphone with noise suppression, else any microphone, else the first."""
    mic = F.col("kind") == "Microphone"
    rank = F.when(stable_key().eqNullSafe(remembered), 0).when(mic & stable_key().contains("rnnoise"), 1).when(mic, 2).otherwise(3)
    best = devices.withColumn("_k", rank).groupBy("dump").agg(F.min_by(F.struct("target", "name", "kind", F.col("_k").alias("priority")), F.struct("_k", "pos")).alias("b"))
    return best.select("dump", "b.*")


def resolve(selection: DataFrame, devices: DataFrame) -> DataFrame:
    """Remembered keys (dump, key) to their first device; null where it is gone."""
    keyed = devices.withColumn("key", stable_key()).groupBy("dump", "key").agg(F.min_by("target", "pos").alias("target"))
    return selection.join(keyed, ["dump", "key"], "left")


def numbered(rows: DataFrame, group: str, base: str, order: str) -> DataFrame:
    """Names told apart: the second of a base is "base 2", and so on in order.

    A name that is taken by a base of its own, like a literal "X 2" before the second X, is skipped: of
    each base the numbers that others bear are looked up, and what is not a duplicate costs nothing.
    """
    n = F.row_number().over(Window.partitionBy(group, base).orderBy(order))
    number = F.expr(f"try_cast(regexp_extract(`{base}`, ' ([1-9][0-9]*)$', 1) AS bigint)")
    bearing = rows.select(F.col(group).alias("__g"), F.regexp_replace(base, " [1-9][0-9]*$", "").alias("__of"), number.alias("__k")).filter("__k >= 2")
    taken = bearing.groupBy("__g", "__of").agg(F.array_sort(F.collect_set("__k")).alias("__taken"))
    out = rows.withColumn("__n", n.cast("bigint")).join(taken, F.col(group).eqNullSafe(F.col("__g")) & (F.col(base) == F.col("__of")), "left")
    free = F.aggregate(F.coalesce("__taken", F.expr("CAST(array() AS array<bigint>)")), F.col("__n"), lambda at, k: F.when(k <= at, at + 1).otherwise(at))
    name = F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(" "), free.cast("string")))
    return out.withColumn("label", name).drop("__n", "__taken", "__g", "__of")


def links(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Output ports (dump, id, name) on input ports in turn, both by name."""
    place = lambda d: F.row_number().over(Window.partitionBy("dump").orderBy("name", "id")) - 1
    n = inputs.groupBy("dump").agg(F.count(F.lit(1)).alias("_n"))
    outs = outputs.withColumn("_i", place(outputs)).join(n, "dump").withColumn("_i", F.pmod("_i", "_n").cast("int"))
    ins = inputs.withColumn("_i", place(inputs).cast("int")).select("dump", "_i", F.col("id").alias("input_id"))
    return outs.join(ins, ["dump", "_i"]).select("dump", F.col("id").alias("output_id"), "input_id")


def starved(seconds_since_data: Column, error: Column, limit: float = 5.0) -> Column:
    return error.isNotNull() | F.coalesce(seconds_since_data >= limit, F.lit(True))


def candidate_models(names: DataFrame, others: DataFrame, known: Column) -> DataFrame:
    """Model files (name) that are not listed in ``others``, told apart by whether their family is known."""
    return names.filter(F.col("name").endswith(".onnx")).join(others.select("name").distinct(), "name", "left_anti").withColumn("known", known)


def pick_model(candidates: DataFrame, usual: str) -> DataFrame:
    """One row: the model to use (``name``), which is the usual one or the only one of a known family, or
    why there is none (``fault``)."""
    sums = candidates.agg(F.max(F.when(F.col("name") == usual, F.col("name"))).alias("u"), F.count_if("known").alias("n"), F.max(F.when(F.col("known"), F.col("name"))).alias("k"))
    fault = F.when(F.col("u").isNotNull() | (F.col("n") == 1), F.lit(None)).when(F.col("n") == 0, "no model of a known family").otherwise("several models")
    return sums.select(F.coalesce("u", F.when(F.col("n") == 1, F.col("k"))).alias("name"), fault.alias("fault"))
