"""Online clustering of speakers: a fold over one stream's embeddings, in order.

Centroids move with every embedding they admit, so the order counts and a stream is one group. The
same step runs in batch (a group per stream) and in a stateful stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a sweep's grid at most, about 100 bytes each.
MOST_CONFIGS = 100_000


@dataclass(frozen=True)
class Tuning:
    t_assign: float = 0.45
    margin: float = 0.10
    short_factor: float = 2.0
    cohort: int = 4
    t_z: float = 2.0
    alpha: float = 0.05
    t_retire: float = 0.80
    min_pool: int = 4
    mint_lead: float = 0.20
    mint_ceiling: float = 0.55
    most_pools: int = 8
    pool_age: int = 64


def unit(v) -> np.ndarray:
    v = np.asarray(v, np.float64)
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def stands_out(scores: np.ndarray, t: Tuning, margin: float) -> int | None:
    """The place of the score that reaches the threshold, leads the second and, in a cohort, is an outlier."""
    if not len(scores) or np.isnan(scores).any():
        return None
    best = len(scores) - 1 - int(np.argmax(scores[::-1]))
    top, rest = scores[best], np.delete(scores, best)
    if not np.isfinite(top) or top < t.t_assign:
        return None
    if len(rest) and not top - rest.max() >= margin:
        return None
    if margin > 0 and len(scores) >= t.cohort:
        spread = max(float(rest.std(ddof=1)) if len(rest) > 1 else 0.0, 1e-6)
        if not (top - rest.mean()) / spread >= t.t_z:
            return None
    return best


@dataclass
class Clusterer:
    tuning: Tuning = field(default_factory=Tuning)
    labels: list[int] = field(default_factory=list)
    vectors: list[np.ndarray] = field(default_factory=list)
    into: list[int | None] = field(default_factory=list)
    pools: list[tuple[list[np.ndarray], int]] = field(default_factory=list)
    seen: int = 0

    def live(self) -> list[int]:
        return [i for i, x in enumerate(self.into) if x is None]

    def scores(self, v: np.ndarray, live: list[int]) -> np.ndarray:
        return np.array([v @ self.vectors[i] for i in live])

    def resolve(self, label: int) -> int:
        while (to := self.into[self.labels.index(label)]) is not None:
            label = to
        return label

    def admits(self, v: np.ndarray, margin: float) -> int | None:
        live = self.live()
        at = stands_out(self.scores(v, live), self.tuning, margin)
        return None if at is None else live[at]

    def nearest(self, v: np.ndarray) -> tuple[int, float] | None:
        live = self.live()
        if not live:
            return None
        s = self.scores(v, live)
        at = len(s) - 1 - int(np.argmax(s[::-1]))
        return live[at], float(s[at])

    def observe(self, embedding) -> tuple[int | None, str]:
        """Label and certainty (settled, guessed, unknown) of one window."""
        t, v = self.tuning, unit(embedding)
        self.seen += 1
        self.pools = [p for p in self.pools if p[1] >= max(0, self.seen - t.pool_age)]
        at = self.admits(v, t.margin)
        if at is not None:
            self.vectors[at] = unit((1 - t.alpha) * self.vectors[at] + t.alpha * v)
            label = self.labels[at]
            self._retire()
            return self.resolve(label), "settled"
        near = self.nearest(v)
        guess = self.resolve(self.labels[near[0]]) if near and np.isfinite(near[1]) and near[1] >= t.t_assign else None
        minted = self._file(v)
        if minted is not None:
            return minted, "settled"
        return (guess, "guessed") if guess is not None else (None, "unknown")

    def observe_short(self, embedding) -> int | None:
        """The label of a short piece, at a wider margin; changes nothing."""
        at = self.admits(unit(embedding), self.tuning.short_factor * self.tuning.margin)
        return None if at is None else self.resolve(self.labels[at])

    def _retire(self) -> None:
        """Of live centroids that have come together the younger one forwards to the older."""
        while True:
            live = self.live()
            pair = next(((a, b) for n, a in enumerate(live) for b in live[n + 1 :] if self.vectors[a] @ self.vectors[b] >= self.tuning.t_retire), None)
            if pair is None:
                return
            self.into[pair[1]] = self.labels[pair[0]]

    def _file(self, v: np.ndarray) -> int | None:
        """Into the pool whose members all agree best, or a new one; a full pool may become a centroid."""
        t = self.tuning
        worst = [min(float(v @ m) for m in members) for members, _ in self.pools]
        fit = [i for i, w in enumerate(worst) if w >= t.t_assign]
        if fit:
            at = max(fit, key=lambda i: (worst[i], i))
        else:
            if len(self.pools) >= t.most_pools:
                self.pools.pop(min(range(len(self.pools)), key=lambda i: self.pools[i][1]))
            self.pools.append(([], self.seen))
            at = len(self.pools) - 1
        members = [*self.pools[at][0], v]
        self.pools[at] = (members, self.seen)
        if len(members) < t.min_pool:
            return None
        self.pools.pop(at)
        mean = unit(np.sum(members, 0))
        near = self.nearest(mean)
        if not self._may_mint(min(float(mean @ m) for m in members), near[1] if near else None):
            return None
        self.labels.append(len(self.labels) + 1)
        self.vectors.append(mean)
        self.into.append(None)
        return self.labels[-1]

    def _may_mint(self, cohesion: float, rival: float | None) -> bool:
        t = self.tuning
        if rival is None:
            return True
        if np.isnan(rival):
            return False
        if rival < t.t_assign:
            return True
        return t.margin > 0 and rival < min(t.mint_ceiling, t.t_retire) and cohesion - rival >= t.mint_lead

    def crowding(self) -> list[tuple[int, int, float]]:
        live = self.live()
        rows = [(self.labels[a], self.labels[b], float(self.vectors[a] @ self.vectors[b])) for n, a in enumerate(live) for b in live[n + 1 :]]
        return sorted(rows, key=lambda r: -r[2])


LABELS = "stream_id {0}, ord bigint, label int, certainty string"


def cluster(embeddings: DataFrame, tuning: Tuning = Tuning()) -> DataFrame:  # noqa: B008
    """Labels of embeddings (stream_id, ord, vector), one fold per stream."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state = Clusterer(tuning)
        rows = rows.sort_values("ord", kind="stable")
        made = [state.observe(v) for v in rows["vector"]]
        return pd.DataFrame({"stream_id": rows["stream_id"].to_numpy(), "ord": rows["ord"].to_numpy(), "label": pd.array([m[0] for m in made], "Int32"), "certainty": [m[1] for m in made]})

    return embeddings.select("stream_id", "ord", "vector").groupBy("stream_id").applyInPandas(fold, LABELS.format(embeddings.schema["stream_id"].dataType.simpleString()))


def sweep(embeddings: DataFrame, grid: DataFrame) -> DataFrame:
    """A fold per stream and row of the grid (config, t_assign, margin, min_pool, alpha): how many labels
    were minted, are active, and windows by certainty."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        state = Clusterer(Tuning(t_assign=float(first["t_assign"]), margin=float(first["margin"]), min_pool=int(first["min_pool"]), alpha=float(first["alpha"])))
        made = [state.observe(v)[1] for v in rows.sort_values("ord", kind="stable")["vector"]]
        crowd = state.crowding()
        return pd.DataFrame({"config": [first["config"]], "stream_id": [first["stream_id"]], "minted": [len(state.labels)], "active": [len(state.live())], "settled": [made.count("settled")], "guessed": [made.count("guessed")], "crowd": [crowd[0][2] if crowd else np.nan]})

    kind = embeddings.schema["stream_id"].dataType.simpleString()
    # the streams are the distributed side; a grid is written by hand, which is checked before each copy of it is sent
    rows = grid.count()
    if rows > MOST_CONFIGS:
        raise ValueError(f"a grid of {rows} rows; {MOST_CONFIGS} at most, so sweep it in parts")
    both = embeddings.select("stream_id", "ord", "vector").join(F.broadcast(grid))
    return both.groupBy("config", "stream_id").applyInPandas(fold, f"config bigint, stream_id {kind}, minted int, active int, settled int, guessed int, crowd double")
