"""Writers: transcripts as text files, messages as JSON lines, sweeps as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import messages, transcript


def write_text(rendered: DataFrame, path: str) -> None:
    """Bodies (session_id, body) in a folder per session, each with one line break at its end; blank ones
    are not written."""
    full = rendered.filter(~T.is_blank(F.col("body")))
    full.select("session_id", T.trim(F.col("body")).alias("value")).write.mode("overwrite").partitionBy("session_id").text(path)


def write_per_source(segments: DataFrame, path: str, layout: str = transcript.PLAIN) -> None:
    """A folder per session and source, named as the source's file; sources without text are left out."""
    parts = transcript.by_source(segments, F.lit("transcript.txt"), layout)
    parts.select("session_id", F.col("path").alias("file"), F.col("body").alias("value")).write.mode("overwrite").partitionBy("session_id", "file").text(path)


def write_messages(rows: DataFrame, columns: list[str], path: str) -> None:
    rows.select(messages.encode(rows, columns).alias("value")).write.mode("overwrite").text(path)


#: Columns of a sweep's table, in order: settings, scores against the reference, and what the clusterer holds.
SWEEP = "model meeting window t_assign t_retire min_pool alpha margin mint_ceiling ref hyp splits merges miss% conf% minted active crowd".split()


def sweep_table(rows: DataFrame) -> DataFrame:
    """The columns of ``SWEEP`` from rows with settings and counts, ``miss`` and ``confusion`` as shares: those as
    percent with a digit, and ``crowd`` with three (NaN without a pair)."""
    share = lambda c: F.format_string("%.1f", 100 * F.col(c).cast("double"))
    crowd = F.when(F.isnan("crowd") | F.col("crowd").isNull(), "NaN").otherwise(F.format_string("%.3f", F.col("crowd").cast("double")))
    return rows.withColumns({"miss%": share("miss"), "conf%": share("confusion"), "crowd": crowd}).select(*(F.col(f"`{c}`") for c in SWEEP))


def write_sweep(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


FILES = "session_id string, path string"


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _put(uri: str, text: str, append: bool = False) -> None:
    """One file, whole or not at all: written beside its place and moved there."""
    place, path = _place(uri)
    place.create_dir(path.rpartition("/")[0], recursive=True)
    if append and place.get_file_info(path).is_file:
        with place.open_input_stream(path) as f:
            old = f.read().decode()
        text = old + ("" if not old or old.endswith("\n") else "\n") + text
    with place.open_output_stream(f"{path}.part") as f:
        f.write(text.encode())
    place.move(f"{path}.part", path)


def _saved(rows: DataFrame) -> DataFrame:
    """Writes (session_id, path, body), a file a row, where the rows are; returns session_id and path."""

    def run(batches):
        for batch in batches:
            for _, path, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _put(path, f"{body}\n")
            yield batch.select([0, 1])

    return rows.select("session_id", "path", "body").mapInArrow(run, FILES)


def save(rendered: DataFrame, folder: str, stamp: str | None = None) -> list:
    """A file a session from (session_id, body): ``<session>.txt``, or in a folder a session under the stamped
    name if there is a ``stamp``. Bodies are trimmed and end in a line break. A blank one is an error, before
    anything is written."""
    blank = rendered.filter(T.is_blank(F.col("body"))).select("session_id").limit(1).collect()
    if blank:
        raise ValueError(f"nothing to save of {blank[0][0]}")
    name = F.concat(F.lit(f"{folder}/"), "session_id", F.lit(f"/{stamp}.txt" if stamp else ".txt"))
    return _saved(rendered.select("session_id", name.alias("path"), T.trim(F.col("body")).alias("body"))).collect()


def save_per_source(segments: DataFrame, folder: str, layout: str = transcript.PLAIN) -> list:
    """A file a session and source; sources without text are left out, and none at all is an error."""
    parts = transcript.by_source(segments, F.lit("transcript.txt"), layout).filter(~T.is_blank(F.col("body")))
    made = _saved(parts.select("session_id", F.concat(F.lit(f"{folder}/"), "session_id", F.lit("/"), "path").alias("path"), T.trim(F.col("body")).alias("body"))).collect()
    if not made:
        raise ValueError("no source has text")
    return made


def append(batch: DataFrame, folder: str) -> list:
    """Appends a batch of lines (session_id, pos, line), in order, to a file a session. A file that does not end
    in a line break gets one first. Corrections never rewrite. One live batch is written from the driver, so
    that a task that is run again can't append twice."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    rows = batch.groupBy("session_id").agg(F.array_join(lines, "\n").alias("body")).withColumn("path", F.concat(F.lit(f"{folder}/"), "session_id", F.lit(".txt")))
    made = []
    for r in rows.toLocalIterator():
        _put(r["path"], f"{r['body']}\n", append=True)
        made.append((r["session_id"], r["path"]))
    return made


def append_lines(batch: DataFrame, path: str) -> None:
    """Appends a batch of lines (session_id, at, line) in order within a session; corrections never rewrite."""
    batch.repartition("session_id").sortWithinPartitions("session_id", "pos").select("session_id", F.col("line").alias("value")).write.mode("append").partitionBy("session_id").text(path)
