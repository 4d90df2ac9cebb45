"""Toxicity as ordered grades: cumulative-link regression on sparse words.

The chance that a document's grade is at most k is ``logistic(threshold[k] - weights . words)``: one
weight per word serves all thresholds, which are kept in order. The expected severity is the sum over
k of the chance that the grade is above k. Grades are 0 clean, 1 toxic, 2 severe. **Labels know only
toxic or not**: which toxic training documents count as severe is derived, not labelled. The documents
are dealt into two halves by a hash of their text; one is severe where its features tell more than those of
the median toxic one, by what the *other* half says of these features, so no document grades itself.
Grades 1 and 2 thus order documents by how much of toxic language they hold; only 0 against the rest
is held against labels.

Features are words, their first ``STEMS`` letters, and those with the word's length, so that inflected
forms of an insult count together. Those in at least ``LEAST`` training documents, more than ``PURE`` of
them toxic, are ranked by how much they tell, and the first ``TERMS`` are used. A document's value for a
feature is the number of its distinct words that have it. Weights are never negative: a long harmless
text does not make up for insults in it. The model is fitted on at most ``SAMPLE`` labelled documents,
those with the smallest hash of their id; executors count features and the driver gets the chosen ones,
never texts.

Defined results: a null or empty text has no words and gets the severity of the thresholds alone;
without labels of both kinds every severity is 0, and without any telling feature that of the labels'
shares; texts that repeat count once in training; repeated rows score alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import common, quality

SAMPLE, TERMS, LEAST, PURE, LASSO, STEPS, CUT = 8_000, 2_000, 6, 0.5, 1e-3, 800, 0.25
STEMS = (4, 5, 6, 7)
#: Words remembered in each Python worker before the table is emptied.
CACHE_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    n = len(word)
    return [word, *(f"{word[:k]}*" for k in STEMS if n > k), *(f"{word[:k]}~{n}" for k in STEMS[:3] if n > k)]


@dataclass
class Model:
    terms: dict[str, float]
    thresholds: np.ndarray

    def weight(self, word: str) -> float:
        return sum(self.terms.get(f, 0.0) for f in features(word))

    def grades(self, z: float) -> tuple[float, list[float]]:
        """Expected grade, and the chance of each grade."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds - z, -60, 60)))
        return float(above.sum()), (-np.diff(np.concatenate([[1.0], above, [0.0]]))).tolist()

    def severity(self, text: str | None, known: dict[str, float] | None = None) -> tuple[float, list[float]]:
        """``known``: weights of words met so far."""
        known = {} if known is None else known
        z = 0.0
        for w in sorted(words(text)):  # one order of sums everywhere
            x = known.get(w)
            if x is None:
                x = known[w] = self.weight(w)
            if x:
                z += x
        return self.grades(z)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, n_columns: int, lasso: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights, none below 0, and ordered thresholds for sparse features given as (row, column, value).

    Accelerated proximal gradient on features of equal spread, with a lasso penalty.
    """
    n, top = len(y), int(y.max())
    share = np.clip([(y > k).mean() for k in range(top)], 1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    mean = np.bincount(columns, values, n_columns) / n
    spread = np.sqrt(np.maximum(np.bincount(columns, values * values, n_columns) / n - mean * mean, 1e-12))
    values = values / spread[columns]
    apply = lambda w: np.bincount(rows, values * w[columns], n)
    back = lambda r: np.bincount(columns, values * r[rows], n_columns) / n
    v, curve = np.ones(n_columns), 1.0
    for _ in range(12):  # the largest curvature, by powers
        v = back(apply(v))
        curve = np.linalg.norm(v)
        v /= curve or 1.0
    rate = 1.0 / (0.5 * curve + 0.5)
    w, ahead, cuts_ahead, t = np.zeros(n_columns), np.zeros(n_columns), cuts.copy(), 1.0
    edge = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for _ in range(steps):
        z = apply(ahead)
        low = np.where(y < top, edge(np.append(cuts_ahead, 0.0)[y] - z), 1.0)
        high = np.where(y > 0, edge(np.append(0.0, cuts_ahead)[y] - z), 0.0)
        p = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p  # of the negative log likelihood
        g_w = back(d_low - d_high)
        g_c = np.array([(d_high[y == k + 1].sum() - d_low[y == k].sum()) / n for k in range(top)])
        new = np.maximum(ahead - rate * (g_w + lasso), 0)
        new_cuts = np.maximum.accumulate(cuts_ahead - rate * g_c + np.arange(top) * 1e-9)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        cuts_ahead = np.maximum.accumulate(new_cuts + (t - 1) / t2 * (new_cuts - cuts))
        w, cuts, t = new, new_cuts, t2
    return w / spread, cuts


def values(text: str | None) -> Counter[str]:
    """How many of a text's distinct words have each feature."""
    return Counter(f for w in words(text) for f in features(w))


@dataclass
class Counts:
    """Of training documents: how many there are in each half, toxic ones and all, and how many have each feature."""

    n: np.ndarray  # [half, all or toxic]
    names: list[str]
    seen: np.ndarray  # [feature, half, all or toxic]

    def telling(self, half: int | None = None) -> np.ndarray:
        """How much a feature's shares of toxic and clean documents differ, in standard deviations."""
        n, seen = (self.n.sum(0), self.seen.sum(1)) if half is None else (self.n[half], self.seen[:, half])
        (all_, toxic), (total, marked) = n, seen.T
        if not 0 < toxic < all_:
            return np.zeros(len(self.names))
        share = np.maximum(total, 0.5) / (all_ + 1)
        return (marked / toxic - (total - marked) / (all_ - toxic)) / np.sqrt(share * (1 - share) * (1 / toxic + 1 / (all_ - toxic)))


def chosen(counts: Counts, terms: int = TERMS) -> np.ndarray:
    """Places of the features to use, by name."""
    total, marked = counts.seen.sum(1).T
    names = np.array(counts.names, object)
    ranked = np.lexsort((names, -counts.telling()))[:terms]
    ranked = ranked[marked[ranked] > PURE * total[ranked]]
    return ranked[np.argsort(names[ranked])]


def fit_counts(counts: Counts, found: list[tuple[int, int, list[int], list[int]]]) -> Model:
    """Fits on documents (half, toxic, places of features in ``counts``, values)."""
    n, n1 = (int(x) for x in counts.n.sum(0))
    if not 0 < n1 < n:
        return Model({}, np.array([60.0, 60.0]))
    if not len(counts.names):  # too little to tell anything by
        return Model({}, np.array([np.log((n - n1) / n1), 60.0]))
    rows = np.repeat(np.arange(n), [len(f[2]) for f in found])
    columns = np.array([c for f in found for c in f[2]], np.int64)
    x = np.array([v for f in found for v in f[3]], np.float64)
    half, toxic = (np.array([f[i] for f in found]) for i in (0, 1))
    other = np.stack([counts.telling(1), counts.telling(0)])
    strong = np.bincount(rows, x * other[half[rows], columns], n)
    grade = toxic + (toxic & (strong > np.median(strong[toxic == 1])))
    w, cuts = fit_ordinal(rows, columns, x, grade, len(counts.names))
    return Model({f: float(v) for f, v in zip(counts.names, w, strict=True) if v > 1e-9}, cuts)


def _of_terms(text: str | None, at: dict[str, int]) -> tuple[list[int], list[int]]:
    got = sorted((at[f], c) for f, c in values(text).items() if f in at)
    return [a for a, _ in got], [c for _, c in got]


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Fits on texts at hand; those at odd places are one half."""
    toxic = np.asarray(toxic, int)
    n = np.array([[len(toxic[h::2]), toxic[h::2].sum()] for h in (0, 1)])
    seen: dict[str, np.ndarray] = {}
    for i, t in enumerate(texts):
        for f in values(t):
            seen.setdefault(f, np.zeros((2, 2), np.int64))[i % 2] += (1, toxic[i])
    names = sorted(f for f, c in seen.items() if c[:, 0].sum() >= LEAST)
    counts = Counts(n, names, np.array([seen[f] for f in names], np.int64).reshape(-1, 2, 2))
    use = chosen(counts)
    counts = Counts(n, [names[i] for i in use], counts.seen[use])
    at = {f: i for i, f in enumerate(counts.names)}
    return fit_counts(counts, [(i % 2, int(toxic[i]), *_of_terms(t, at)) for i, t in enumerate(texts)])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fits on the sampled documents: features are counted where the texts are, and the driver gets at most
    ``TERMS`` of them and what each of at most ``most`` documents has of those."""
    picked = F.broadcast(quality.sample(labels, "toxic", most))
    # texts that repeat would count as evidence many times; those that labels disagree on are toxic
    told = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").join(picked, "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("y").alias("y"))
    told = common.materialize(told.orderBy("h").limit(most), "labelled")
    n = np.zeros((2, 2), np.int64)
    for r in told.groupBy(F.pmod("h", F.lit(2)).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect():  # two rows
        n[r["half"]] = r["n"], r["y"]

    def count(batches):
        seen: dict[str, list[int]] = {}  # of a bounded sample
        for batch in batches:
            for h, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for f in values(text):
                    c = seen.setdefault(f, [0, 0, 0, 0])
                    c[2 * (h % 2)] += 1
                    c[2 * (h % 2) + 1] += y
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(4))], ["f", "n0", "y0", "n1", "y1"])

    seen = told.select("h", "text", "y").transform(common.in_batches).mapInArrow(count, "f string, n0 long, y0 long, n1 long, y1 long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n0", "y0", "n1", "y1")))
    # the others are not among the first TERMS that are pure enough, or are too rare
    share = (F.col("n0") + F.col("n1")) / float(n[:, 0].sum() + 1)
    clean, toxic = float(max(1, n[:, 0].sum() - n[:, 1].sum())), float(max(1, n[:, 1].sum()))
    telling = ((F.col("y0") + F.col("y1")) / toxic - (F.col("n0") + F.col("n1") - F.col("y0") - F.col("y1")) / clean) / F.sqrt(share * (1 - share))
    best = seen.filter(F.col("n0") + F.col("n1") >= LEAST).orderBy(telling.desc(), "f").limit(TERMS).toPandas().sort_values("f")
    counts = Counts(n, best["f"].tolist(), best[["n0", "y0", "n1", "y1"]].to_numpy(np.int64).reshape(-1, 2, 2))
    use = chosen(counts)
    counts = Counts(n, [counts.names[i] for i in use], counts.seen[use])
    at = {f: i for i, f in enumerate(counts.names)}

    def pick(batches):
        for batch in batches:
            got = [_of_terms(t, at) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1))], ["h", "y", "at", "x"])

    rows = told.select("h", "text", "y").transform(common.in_batches).mapInArrow(pick, "h long, y int, at array<int>, x array<int>").toPandas().sort_values("h")
    model = fit_counts(counts, [(h % 2, y, list(a), list(x)) for h, y, a, x in rows.itertuples(index=False)])
    common.drop(told)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Per row: expected_severity, the chance of being toxic at all, toxic (that chance >= ``cut``), grade (the likeliest
    above 0 if toxic, else 0)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS words

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                if len(known) > CACHE_WORDS:
                    known.clear()
                made = [shipped.value.severity(t, known) for t in part.column(1).to_pylist()]
                chance = [1 - p[0] for _, p in made]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s for s, _ in made], pa.float64()), pa.array(chance, pa.float64()), pa.array([1 + int(np.argmax(p[1:])) if c >= cut else 0 for (_, p), c in zip(made, chance, strict=True)], pa.int32()), pa.array([int(c >= cut) for c in chance], pa.int32())],
                    ["id", "expected_severity", "score", "grade", "toxic"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).transform(common.in_batches).mapInArrow(run, f"id {kind}, expected_severity double, score double, grade int, toxic int").withColumnRenamed("id", id_col)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
