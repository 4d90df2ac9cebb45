"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are boosted on labelled documents; every path from a root to a node becomes a rule, a
conjunction of bounds on statistics. A logistic model with a lasso penalty gives weights to the rules
and drops most of them. What is left is compiled into one Spark column over the statistics.

Statistics depend on the text alone. The model is fitted on at most ``SAMPLE`` labelled documents,
those with the smallest hash of their id.

Defined results: a null text counts as empty, and an empty text has all statistics 0; ids and other
columns are never read by the score, and columns of any name are handed on; without labels of both kinds every score is the share of label 1
(1 without labels); repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm import common

SAMPLE, TREES, DEPTH, BINS, LASSO, SEED, CUT = 12_000, 40, 3, 32, 0.0015, 5, 0.3
STATISTICS = (
    "words", "word_length", "upper", "digits", "symbols", "marks", "bars", "spaces", "other",
    "unlettered_words", "short_words", "distinct_words", "repeated_words", "distinct_pairs", "top_word", "distinct_lines", "line_words", "loud_words",
)

UPPER, LOWER, DIGIT, SPACE, STOP, MARK, BAR, SYMBOL, HIGH = range(9)
KIND = np.full(256, SYMBOL, np.uint8)
for _chars, _kind in ((range(65, 91), UPPER), (range(97, 123), LOWER), (range(48, 58), DIGIT), (b" \t\n\r\v\f", SPACE), (b".,;:'\"()-", STOP), (b"!?", MARK), (b"|", BAR), (range(128, 256), HIGH)):
    KIND[list(_chars)] = _kind
#: Bytes that are neither letters nor digits nor part of a longer character.
_UNLETTERED = bytes(i for i in range(128) if KIND[i] not in (UPPER, LOWER, DIGIT))
_LOUD = re.compile(rb"[a-z]")


def statistics(data: bytes) -> tuple[float, ...]:
    words = data.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, size = len(words), len(data)
    kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=9) / size
    letters = kinds[UPPER] + kinds[LOWER] + kinds[HIGH]
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    distinct = len(counts)
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0  # noqa: B905
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    bare = sum(c for w, c in counts.items() if not w.strip(_UNLETTERED))
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    loud = sum(c for w, c in counts.items() if len(w) > 3 and not _LOUD.search(w))
    return (
        float(np.log1p(n)), size / n, kinds[UPPER] / letters if letters else 0.0, kinds[DIGIT], kinds[SYMBOL], kinds[MARK], kinds[BAR], kinds[SPACE], kinds[HIGH],
        bare / n, short / n, distinct / n, same, pairs, counts.most_common(1)[0][1] / n, len(set(lines)) / len(lines) if lines else 1.0, n / max(1, len(lines)), loud / n,
    )


def _by_place(df: DataFrame, text_col: str) -> DataFrame:
    """The columns by place (``common.by_place``), and the statistics of the text as ``q_`` and their names."""
    plain = common.by_place(df)
    at = df.columns.index(text_col)
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema)), *(f"q_{s} double" for s in STATISTICS)])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                rows = np.array([statistics(x or b"") for x in part.column(at).cast(pa.binary()).to_pylist()], dtype=np.float64).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(rows[:, i]) for i in range(rows.shape[1]))], [*part.schema.names, *("q_" + s for s in STATISTICS)])

    return plain.transform(common.in_batches).mapInArrow(common.lean(run), schema)


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """All columns, and the statistics of the text as ``prefix`` and their names."""
    return _by_place(df, text_col).toDF(*df.columns, *(prefix + s for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, at_most, bound): value <= bound if at_most, else value > bound."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, at_most, bound in self.parts:
            out &= (x[:, i] <= bound) if at_most else (x[:, i] > bound)
        return out

    def column(self, prefix: str = "q_") -> Column:
        out = None
        for i, at_most, bound in self.parts:
            c = F.col(prefix + STATISTICS[i])
            part = c <= F.lit(float(bound)) if at_most else c > F.lit(float(bound))
            out = part if out is None else out & part
        return out


@dataclass
class Model:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "q_") -> Column:
        """The score as a Spark column over the statistics."""
        z = F.lit(float(self.bias))
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(prefix), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _paths(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, step: np.ndarray, columns: np.ndarray) -> None:
    """Grows a tree of least squares on (gradient, hessian), notes the path to each node, adds leaf values to ``step``."""
    g, h = gradient[rows], hessian[rows]
    if path:
        out.append(Rule(path))
    best = (1e-3, None, None)
    if depth and len(rows) >= 40:
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for j in columns:
            if not len(edges[j]):
                continue
            gs = np.cumsum(np.bincount(binned[rows, j], g, len(edges[j]) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, j], h, len(edges[j]) + 1))[:-1]
            n = np.cumsum(np.bincount(binned[rows, j], minlength=len(edges[j]) + 1))[:-1]
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
            gain[(n < 10) | (len(rows) - n < 10)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[1] is None:
        step[rows] = g.sum() / (h.sum() + 1.0)
        return
    _, j, k = best
    left = binned[rows, j] <= k
    for side, at_most in ((rows[left], True), (rows[~left], False)):
        _paths(binned, edges, gradient, hessian, side, depth - 1, (*path, (int(j), at_most, float(edges[j][k]))), out, step, columns)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Model:
    y = np.asarray(y, np.float64)
    share = y.mean() if len(y) else 1.0
    if share in (0.0, 1.0):
        return Model([], np.zeros(0), 30.0 if share else -30.0)
    rng = np.random.default_rng(SEED)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    z, rules = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(len(y), max(1, len(y) * 2 // 3), replace=False))
        columns = np.sort(rng.choice(x.shape[1], -(-x.shape[1] * 2 // 3), replace=False))
        step = np.zeros(len(y))
        _paths(binned, edges, y - p, p * (1 - p), rows, depth, (), rules, step, columns)
        z += 0.3 * step
    rules = list(dict.fromkeys(rules))
    # one rule for each set of documents that rules pick out
    held, kept = [], []
    seen: set[bytes] = set()
    for r in rules:
        h = r.holds(x)
        if 0 < h.sum() < len(h) and (key := np.packbits(h).tobytes()) not in seen:
            seen.add(key)
            held.append(h)
            kept.append(r)
    a = np.column_stack(held).astype(np.float64)
    scale = a.std(0)
    a = (a - a.mean(0)) / scale
    mean = np.column_stack(held).mean(0)
    weights, bias = np.zeros(a.shape[1]), np.log(share / (1 - share))
    ahead, t = weights.copy(), 1.0
    rate = 4.0 * len(y) / np.linalg.norm(a.T @ a, 2)
    for _ in range(400):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(bias + a @ ahead))) - y
        bias -= 2.0 * r.mean()
        new = ahead - rate * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * lasso, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - weights)
        weights, t = new, t2
    use = np.flatnonzero(np.abs(weights) > 1e-6)
    own = weights[use] / scale[use]
    return Model([kept[i] for i in use], own, float(bias - (own * mean[use]).sum()))


def sample(labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, by the smallest hash of the id. Where an
    id has several labels the larger one counts."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold != 0))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_rows(stats: DataFrame, picked: DataFrame, most: int = SAMPLE) -> Model:
    """Fits on rows (doc_id and statistics) that ``picked`` (doc_id, y) labels. Of rows that repeat an id
    those with the smallest statistics count, so that reruns agree."""
    q = [f"q_{s}" for s in STATISTICS]
    rows = stats.select("doc_id", *q).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.array(*q)).alias("x"))
    rows = rows.orderBy("doc_id").limit(most).toPandas()
    return fit(np.array(rows["x"].tolist(), np.float64).reshape(-1, len(q)), rows["y"].to_numpy())


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fits on the sampled documents; the sample is bounded, so it is broadcast and fitted on the driver."""
    picked = sample(labels, "quality", most)
    asked = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    return fit_rows(with_statistics(asked), picked, most)


def keep_good(spark, docs: DataFrame, sf_dir: str, cut: float = CUT) -> DataFrame:
    """The documents that the classifier does not reject."""
    model = train(docs, common.table(spark, sf_dir, "labels"))
    names = docs.columns
    return _by_place(docs, "text").filter(model.column() >= cut).select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    stats = common.materialize(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    model = fit_rows(stats, sample(common.table(spark, sf_dir, "labels"), "quality"))
    score = model.column()
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return stats.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))
