"""Approximate nearest neighbours by collision counting.

Largest inner product becomes smallest distance once each vector gets one more component that brings
it to the block's largest norm M and the query is scaled to M. ``LINES`` random lines are drawn, at right
angles to each other as far as the dimensions go, which makes collisions tell more than those of
independent lines; a block of vectors is indexed by its sorted projections on each line alone. For a
query each line has a window centred on the query's own projection; a vector inside it collides. Windows
are widened in step with a radius R (virtual rehashing: the arrays stay as they are), each step counting
only what changes, or what is left outside where that is less. Vectors with at least ``threshold``
collisions are verified by their exact inner products, until R reaches the distance of the k-th best one.
A vector nearer than R collides on a line with probability P(|N(0,1)| < ``WIDTH``) or more, and the
threshold lies ``SIGMAS`` standard deviations of independent lines below that mean.

The index is a table of blocks of at most about ``BLOCK`` vectors whose norms differ by a factor of at
most ``NORMS``, each with its sorted projections; it is built once. Blocks are searched in passes, those
with the largest norms first, and each pass takes ``WIDER`` times as many vectors as all before it. The k-th best score so far
bounds what a later block must beat: a block whose largest norm can't reach it is left out, and in others
the windows open at once to the distance that it stands for. A task takes one block and up to ``TURNS``
batches of queries.

Defined results: vectors that are null, zero, of another size than most, or hold null or non-finite
components take no part; a query's own row (same id) is no candidate; rows that repeat an id with a
different vector are candidates of their own; ties go to the smaller id; fewer candidates than k give
fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm import common

K, BLOCK, BATCH, TURNS, LINES, WIDTH, SIGMAS, GROWTH, SEED = 20, 8192, 2048, 8, 64, 1.5, 0.5, 1.35, 7
#: Norms within a block differ by this factor at most; each pass takes so many times the vectors before it.
NORMS, WIDER = 1.1, 7


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def threshold(lines: int = LINES, width: float = WIDTH, sigmas: float = SIGMAS) -> int:
    p = math.erf(width / math.sqrt(2))
    return max(1, math.floor(lines * p - sigmas * math.sqrt(lines * p * (1 - p))))


def directions(dim: int, lines: int = LINES) -> np.ndarray:
    """Lines at right angles, of the length that independent ones have on average; where there are more lines
    than dimensions, several such sets."""
    rng, out, size = np.random.default_rng(SEED), [], dim + 1
    for _ in range(-(-lines // size)):
        out.append(np.linalg.qr(rng.standard_normal((size, size)))[0] * math.sqrt(size))
    return np.concatenate(out)[:lines]


class Block:
    """Sorted projections of some vectors: ``values`` (a row a line) and ``order``, the places of their vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, lines: int = LINES, made: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.vectors, self.top = ids, vectors, top
        self.lines = directions(vectors.shape[1], lines)
        if made is None:
            rest = np.sqrt(np.maximum(top * top - (vectors * vectors).sum(1), 0))
            values = self.lines @ np.column_stack([vectors, rest]).T
            order = np.argsort(values, 1, kind="stable")
            made = np.take_along_axis(values, order, 1), order
        self.values, self.order = made[0].astype(np.float64), made[1].astype(np.int64)
        # all lines in one sorted array, a step apart, so that one search serves all
        self.step = 4.0 * float(np.abs(self.values).max(initial=0.0)) + 16.0 * top + 1.0
        self.flat = (self.values + self.step * np.arange(lines)[:, None]).ravel()
        self.verified = 0

    def _edges(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        n, at = len(self.ids), np.arange(len(centre))
        half = min(half, self.step / 4)
        centre = np.clip(centre, -self.step / 4, self.step / 4) + self.step * at
        low = np.searchsorted(self.flat, centre - half, "left") - n * at
        high = np.searchsorted(self.flat, centre + half, "right") - n * at
        return low, high

    def search(self, query_id: int, query: np.ndarray, k: int = K, width: float = WIDTH, least: int | None = None, bound: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the block and their inner products, best first, of ``bound`` or more; the second also tells ties."""
        n, norm, lines = len(self.ids), math.sqrt(query @ query), len(self.lines)
        none = np.zeros(0, np.int64), np.zeros(0)
        if norm * self.top < bound:
            return none
        least = threshold(lines, width) if least is None else least
        centre = self.lines[:, :-1] @ (query * (self.top / norm))
        distance = lambda score: math.sqrt(max(0.0, 2 * self.top * self.top - 2 * score * (self.top / norm)))
        lows = highs = self._edges(centre, 0.0)[0]
        counts = np.zeros(n, np.int64)
        seen = self.ids == query_id
        (rows, scores), end = none, 2.0 * self.top
        far = end if bound == -math.inf else min(end, distance(bound))
        radius = 0.5 * self.top if bound == -math.inf else far
        while True:
            low, high = self._edges(centre, width * radius)
            low, high = np.minimum(low, lows), np.maximum(high, highs)
            if (low + n - high).sum() < ((lows - low) + (high - highs)).sum():  # fewer are left outside than come in
                parts = [x for o, a, b in zip(self.order, low, high, strict=True) for x in (o[:a], o[b:])]
                counts = lines - np.bincount(np.concatenate(parts), minlength=n)
            else:
                parts = [x for o, a, b, c, d in zip(self.order, low, lows, highs, high, strict=True) for x in (o[a:b], o[c:d])]
                counts = counts + np.bincount(np.concatenate(parts), minlength=n)
            lows, highs = low, high
            new = np.flatnonzero((counts >= least) & ~seen)
            if len(new):
                seen[new] = True
                self.verified += len(new)
                rows = np.concatenate([rows, new])
                scores = np.concatenate([scores, self.vectors[new] @ query])
                if len(rows) > 4 * k:  # keep more than k, with all that tie with the k-th
                    keep = scores >= np.partition(scores, -k)[-k]
                    rows, scores = rows[keep], scores[keep]
            kth = far
            if len(rows) >= k:
                kth = min(far, distance(np.partition(scores, -k)[-k]))
            if radius >= kth:
                break
            radius = min(radius * GROWTH, max(kth, radius * 1.001), end)
        if bound == -math.inf and len(rows) < k:  # fewer than k collide often enough at the widest window: all the others are verified
            more = np.flatnonzero(~seen)
            self.verified += len(more)
            rows, scores = np.concatenate([rows, more]), np.concatenate([scores, self.vectors[more] @ query])
        fits = scores >= bound
        rows, scores = rows[fits], scores[fits]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]


def _norm(v: str = "v") -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def told(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part, as vec_id and v."""
    return df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())


def index(points: DataFrame, dim: int, lines: int = LINES) -> DataFrame:
    """Blocks of rows (vec_id, v) of one size: block (0 has the largest norms), pass, n, top, ids, vectors, values, order."""
    rows = points.withColumn("class", F.floor(F.log(_norm()) / math.log(NORMS)).cast("long"))
    counts = rows.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = rows.join(F.broadcast(counts), "class")  # one row for each factor NORMS of the norms: doubles allow some 15,000
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.lit(SEED)), F.col("blocks")))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        vectors = np.stack(part["v"].to_numpy()).astype(np.float64)
        top = float(np.sqrt((vectors * vectors).sum(1)).max())
        made = Block(part["vec_id"].to_numpy(np.int64), vectors, top, lines)
        order = made.order.astype(np.uint16 if len(vectors) <= 1 << 16 else np.uint32)
        return pd.DataFrame({"n": [len(vectors)], "top": [top], "part": [part["part"].iloc[0]], "ids": [made.ids.tobytes()], "vectors": [vectors.tobytes()], "values": [made.values.astype(np.float32).tobytes()], "order": [order.tobytes()]})

    packed = common.materialize(rows.groupBy("class", "part").applyInPandas(pack, "n long, top double, part long, ids binary, vectors binary, values binary, order binary"), "packed")
    falling = Window.orderBy(F.desc("top"), "part")  # a row a block
    before = F.sum("n").over(falling) - F.col("n")
    number = F.when(before < BLOCK, 0).otherwise(1 + F.floor(F.log(before / BLOCK) / math.log(1 + WIDER))).cast("int")
    nth = packed.select("top", "part", (F.row_number().over(falling) - 1).alias("block"), number.alias("pass"))
    return packed.join(nth, ["top", "part"])


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, lines: int = LINES) -> DataFrame:
    """The k nearest rows of ``df`` to each row of ``queries`` (the same columns): query_id, rank, vec_id, score."""
    return passes(df, queries, id_col, vector_col, k, lines)[0]


def passes(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, lines: int) -> tuple[DataFrame, float]:
    """As :func:`search`, and the share of (query, candidate) pairs that were verified by their inner product."""
    points, asked = told(df, id_col, vector_col), told(queries, id_col, vector_col)
    sizes = points.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (0, 0)
    blocks = common.materialize(index(points.filter(F.size("v") == dim), dim, lines), "blocks")
    asked = asked.filter(F.size("v") == dim)
    n_queries = asked.count()
    in_pass = {r["pass"]: r["count"] for r in blocks.groupBy("pass").count().collect()}  # some ten rows at most
    n_batches = max(1, -(-n_queries // BATCH))
    n_turns = -(-n_batches // TURNS)
    asked = common.materialize(asked.withColumn("batch", F.pmod(F.xxhash64("vec_id", "v", F.lit(SEED + 1)), F.lit(n_batches)).cast("int")), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = "query_id long, vec_id long, score double"
    best = df.sparkSession.createDataFrame([], f"{result}, rank int")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        vectors = np.stack(part["v"].to_numpy()).astype(np.float64)
        bounds = part["bound"].to_numpy(np.float64)
        reach = float((bounds / np.sqrt((vectors * vectors).sum(1))).min())
        return pd.DataFrame({"batch": [int(part["batch"].iloc[0])], "reach": [reach], "query_ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "query_vectors": [vectors.tobytes()], "bounds": [bounds.tobytes()]})

    def run(groups):
        key, block = None, None
        for group in groups:
            for number, top, ids, vectors, values, places, query_ids, query_vectors, bounds in zip(*(group.column(i).to_pylist() for i in range(9)), strict=True):
                if key != number:
                    found_ids = np.frombuffer(ids, np.int64)
                    size = len(found_ids)
                    kind = np.uint16 if len(places) == 2 * size * lines else np.uint32
                    made = np.frombuffer(values, np.float32).reshape(lines, size), np.frombuffer(places, kind).reshape(lines, size)
                    key, block = number, Block(found_ids, np.frombuffer(vectors, np.float64).reshape(-1, dim), top, lines, made)
                block.verified = 0
                out = ([], [], [])
                for query_id, query, bound in zip(np.frombuffer(query_ids, np.int64), np.frombuffer(query_vectors, np.float64).reshape(-1, dim), np.frombuffer(bounds, np.float64), strict=True):
                    rows, scores = block.search(query_id, query, k, bound=bound)
                    out[0].append(np.full(len(rows), query_id))
                    out[1].append(block.ids[rows])
                    out[2].append(scores)
                told = [np.concatenate(x) for x in out]
                # the last row tells how many were verified
                yield pa.RecordBatch.from_arrays([pa.array(np.append(told[0], 0), pa.int64()), pa.array(np.append(told[1], block.verified), pa.int64()), pa.array([*told[2], None], pa.float64())], ["query_id", "vec_id", "score"])

    verified = 0
    for number, take in sorted(in_pass.items()):
        bounds = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("b"))
        bounded = asked.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("b", F.lit(-math.inf)))
        batches = common.materialize(bounded.groupBy("batch").applyInPandas(pack, "batch int, reach double, query_ids binary, query_vectors binary, bounds binary"), "batches")
        some = blocks.filter(F.col("pass") == number)
        turn = F.floor(F.col("batch") / TURNS).alias("turn")
        wanted = batches.select("*", turn).join(F.broadcast(some.select("block", "top").withColumnRenamed("top", "t")) if take <= 100_000 else some.select("block", F.col("top").alias("t")), F.col("t") >= F.col("reach")).drop("t")
        copies = some.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(n_turns - 1))))
        n_tasks = take * n_turns
        met = copies.repartition(n_tasks, "block", "turn").join(wanted.repartition(n_tasks, "block", "turn"), ["block", "turn"])
        found = common.materialize(met.select("block", "top", "ids", "vectors", "values", "order", "query_ids", "query_vectors", "bounds").transform(common.in_batches).mapInArrow(run, result), f"found{number}")
        verified += found.filter("score IS NULL").agg(F.sum("vec_id")).first()[0] or 0
        old = best
        both = old.select("query_id", "vec_id", "score").unionByName(found.filter("score IS NOT NULL"))
        best = common.materialize(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), f"best{number}")
        common.drop(old, batches, found)
    common.drop(blocks, asked)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), verified / max(1, n_queries * n)


def op9_ann(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
