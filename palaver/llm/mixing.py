"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should have. The whole
part is given to all of them; the fractions are rounded by the pivotal method: two fractions meet,
and mass, here words, moves at random from one to the other until one of them is 0 or 1; the other
goes on. The expected copies of every document stay what they were, and the words of both together
are kept, so that of a source only the words of the last open document are off its target. In a leaf
the documents come in order of falling size, and each meets all smaller ones, which have one fraction
in common and so are one unit: what a large document takes or leaves is spread over many small ones,
and the one left open is the smallest, unless a single document outweighs all others. There is one
draw and no choice among draws, which would favour some documents.

The leaves of the reduction tree are blocks of about ``LEAF`` documents of one source, by a hash of
the id. Each leaf leaves at most one open fraction. Open fractions of neighbouring leaves meet
``FAN`` at a time, level by level, until each source has one, which is rounded alone. Leaves and
levels depend on the data only and all randomness on ids, so reruns agree however the table is
partitioned.

Defined results: a null text has size 0; documents of size 0 take nothing; a null source is a source
of its own and sorts last; a null id counts as an id; rows that repeat stay rows of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm import common

WEIGHTS = (5, 2, 1)
MOST = 3
LEAF, FAN = 2048, 32
SEED = 20_011


def words(text: Column) -> Column:
    """Number of words, null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that joins, null included."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def row_key(row_id: Column, source: Column, text: Column) -> Column:
    """A number for a row by its id, source and text; rows alike in these share it."""
    return F.xxhash64(row_id, source_key(source.cast("string")), text)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source (key ``k``): source_size, docs and target, from rows with source and size.

    With every target the smaller of ``most`` sizes and one level times the weight, the targets add
    up to all sizes: what a capped source can't take goes to the others by weight. Sources are taken
    up in the order in which they reach their cap, and the level follows from the sums so far.
    """
    total = sizes.groupBy("k", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = total.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "k")
    everything = Window.partitionBy(F.lit(0))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    stepped = ranked.withColumn("level", level)
    # the first source whose cap is not reached at its level sets the level of all
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    final = F.first(fits, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return stepped.select("k", "source_size", "docs", F.least(F.col("cap"), F.coalesce(final, F.lit(math.inf)) * F.col("w")).alias("target"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions in their order, with uniform numbers ``u``, and keeps the sum of fraction times
    size. The rounded ones, and the place of the one left open (-1 if none)."""
    p = p.tolist()
    first = -1
    for i, (s, chance) in enumerate(zip(size.tolist(), u.tolist(), strict=True)):
        if s <= 0 or p[i] <= 1e-12 or p[i] >= 1 - 1e-12:
            p[i] = float(round(p[i])) if s > 0 else 0.0
            continue
        if first < 0:
            first = i
            continue
        a, b, t = p[first], p[i], float(size[first])
        fill, drain = (1 - a) * t, a * t  # of the open one
        most, least = min(fill, b * s), min(drain, (1 - b) * s)
        if chance * (most + least) < least:
            a, b = (1.0, b - fill / s) if fill <= b * s else (a + b * s / t, 0.0)
        else:
            a, b = (0.0, b + drain / s) if drain <= (1 - b) * s else (a - (1 - b) * s / t, 1.0)
        a, b = (float(round(x)) if x <= 1e-12 or x >= 1 - 1e-12 else x for x in (a, b))
        p[first], p[i] = a, b
        first = first if 0 < a < 1 else i if 0 < b < 1 else -1
    return np.array(p), first


def pivot_together(fraction: float, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """As :func:`pivot` for documents with one fraction, by falling size: each meets all after it as one unit."""
    sizes = size.tolist()
    p = [0.0] * len(sizes)
    n = sum(s > 0 for s in sizes)  # those without words come last and take nothing
    rest, share = float(sum(sizes[:n])), float(fraction)
    for i in range(n):
        t = sizes[i]
        rest -= t
        if share <= 1e-12 or share >= 1 - 1e-12 or not rest:
            if share <= 1e-12 or share >= 1 - 1e-12:
                p[i:n] = [float(round(share))] * (n - i)
                return np.array(p), -1
            p[i] = share
            return np.array(p), i
        fill, drain = (1 - share) * t, share * t
        most, least = min(fill, share * rest), min(drain, (1 - share) * rest)
        moved = most if u[i] * (most + least) < least else -least
        p[i] = share + moved / t
        share -= moved / rest
        if 1e-12 < p[i] < 1 - 1e-12:  # the others are all taken or all left
            p[i + 1 : n] = [float(round(share))] * (n - i - 1)
            return np.array(p), i
        p[i] = float(round(p[i]))
    return np.array(p), -1


ROW = "doc_id {id}, k string, size long, source_size long, target double, base int, p double, key long, bucket long, open boolean"


def _round_group(leaf: bool, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key", "p"], ascending=False, kind="stable", ignore_index=True)
        keys, size, fraction = rows["key"].to_numpy(np.int64).view(np.uint64), rows["size"].to_numpy(np.int64), rows["p"].to_numpy(np.float64)
        with np.errstate(over="ignore"):
            u = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(keys), dtype=np.uint64) + np.uint64(SEED)) / 2.0**64
            alone = _mixed(keys ^ np.uint64(SEED * 2_654_435_761)) / 2.0**64
        p, at = pivot_together(fraction[0], size, u) if leaf else pivot(fraction, size, u)
        if last and at >= 0:
            p[at], at = float(alone[at] < p[at]), -1
        rows["p"] = p
        rows["open"] = np.arange(len(rows)) == at
        return rows

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per row: doc_id, k (key of the source), size, source_size, target, copies, key (:func:`row_key`), taken."""
    source = docs[source_col].cast("string")
    sizes = docs.select(
        docs[id_col].alias("doc_id"), source.alias("source"), source_key(source).alias("k"), words(docs[text_col]).alias("size"),
        row_key(docs[id_col], docs[source_col], docs[text_col]).alias("key"),
    )
    sizes = common.materialize(sizes, "sizes")
    id_kind = sizes.schema["doc_id"].dataType.simpleString()
    goal = common.materialize(targets(sizes, weights, most), "targets")
    ratio = F.least(F.lit(float(most)), F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    rows = sizes.join(goal, "k").withColumns({"ratio": ratio, "blocks": F.ceil(F.col("docs") / LEAF)})
    rows = rows.select(
        "doc_id", "k", "size", "source_size", "target", F.floor("ratio").cast("int").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("p"), "key",
        F.pmod(F.xxhash64(F.col("key"), F.lit(SEED)), F.col("blocks")).alias("bucket"), F.lit(True).alias("open"),
    )
    schema = ROW.format(id=id_kind)
    leaves = goal.agg(F.max(F.ceil(F.col("docs") / LEAF))).first()[0] or 1
    levels = max(1, math.ceil(math.log(leaves, FAN) - 1e-9))
    out = None
    steps = [step := common.materialize(rows.groupBy("k", "bucket").applyInPandas(_round_group(True, False), schema), "leaves")]
    for n in range(levels):
        done = step.filter(~F.col("open"))
        out = out.unionByName(done) if out is not None else done
        upper = step.filter("open").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        steps.append(step := common.materialize(upper.groupBy("k", "bucket").applyInPandas(_round_group(False, n == levels - 1), schema), f"level{n}"))
    out = out.unionByName(step)
    common.drop(sizes, goal)
    copies = (F.col("base") + F.round("p").cast("int")).alias("copies")
    out = out.select("doc_id", "k", "size", "source_size", "target", copies, "key").withColumn("taken", F.col("copies") * F.col("size"))
    return common.holding(out, *steps)


def op10_mix(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
