"""Who speaks in each chunk of audio: voice gate, pieces of voiced audio, embeddings, labels over time.

The voice model and the embedder are functions that the caller passes in; without a voice model the
energy of a frame stands in. One stream is one fold, in the order of its chunks.

Three things are remembered about the past. The *label* in force, which a short piece may guess only
while there is none. The *seam*: the earliest chunk that a later, surer label may still correct. And
whether a *gap* of silence lies between the last short piece and the next, because the voice may have
changed behind it: the first piece after the gap settles that, or too many silences do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from palaver.operators.clusterer import Clusterer, Tuning, unit
from palaver.operators.windows import ENTER, FRAME, HANGOVER, HOP_FRAMES, LEAVE, MAX_GAP, WINDOW_FRAMES
from palaver.streaming.folds import Attribution

REFRACTORY_FRAMES, T_CHANGE, T_GAP_CHANGE, MOST_SILENCES, MOST_FAILURES = 24, 0.30, 0.37, 2, 3
HOP, WINDOW = "hop", "window"


def energy(frame: np.ndarray) -> float:
    """A stand-in for a voice model: loud frames are voice."""
    return float(min(1.0, 20 * np.sqrt(np.mean(frame**2)))) if len(frame) else 0.0


@dataclass
class Gate:
    """Hysteresis over the probability of voice."""

    on: bool = False
    left: int = 0

    def step(self, p: float) -> bool:
        if p >= (LEAVE if self.on else ENTER):
            self.on, self.left = True, HANGOVER
        elif self.on and self.left:
            self.left -= 1
        else:
            self.on = False
        return self.on


@dataclass
class Pieces:
    """Voiced frames gathered into hops and sliding windows; a long gap starts both anew."""

    window: list = field(default_factory=list)
    hop: list = field(default_factory=list)
    last: int | None = None
    since: int = 0  # voiced frames since the last start or boundary
    restarted: bool = False

    def add(self, index: int, frame: np.ndarray) -> list[tuple[str, np.ndarray]]:
        if self.last is not None and index - self.last > MAX_GAP:
            self.window, self.hop, self.since, self.restarted = [], [], 0, True
        self.last = index
        self.window.append(frame)
        self.hop.append(frame)
        self.since += 1
        out = []
        if len(self.hop) >= HOP_FRAMES:
            out.append((HOP, np.concatenate(self.hop)))
            self.hop = []
        if len(self.window) >= WINDOW_FRAMES:
            out.append((WINDOW, np.concatenate(self.window[:WINDOW_FRAMES])))
            self.window = self.window[HOP_FRAMES:]
        return out

    def cut(self) -> bool:
        """A boundary, unless one was too short ago: of the window only the last hop stays."""
        if self.since < REFRACTORY_FRAMES:
            return False
        self.window, self.since = self.window[-HOP_FRAMES:], 0
        return True


class OutOfService(RuntimeError):
    pass


def self_check(embed: Callable[[np.ndarray], np.ndarray], voice: Callable[[np.ndarray], float], speech: np.ndarray, dim: int | None = None) -> int:
    """Checks models before they are used, on silence and on ``speech`` of a second or more; the size of embeddings.

    No frame of a second of silence may be voiced, a third of the frames of speech must be, and
    embeddings of both lengths must be of one size, finite and not nought once they are scaled.
    """

    def voiced(samples: np.ndarray) -> list[bool]:
        gate = Gate()
        return [gate.step(voice(f)) for f in samples[: len(samples) // FRAME * FRAME].reshape(-1, FRAME)]

    if any(voiced(np.zeros(16_000))):
        raise ValueError("the voice model hears speech in silence")
    heard = voiced(np.asarray(speech, float))
    if 3 * sum(heard) < len(heard):
        raise ValueError(f"the voice model hears speech in {sum(heard)} of {len(heard)} frames of speech only")
    made = embed_batch(embed, [np.resize(speech, WINDOW_FRAMES * FRAME)]) + embed_batch(embed, [np.resize(speech, HOP_FRAMES * FRAME)])
    sizes = {len(v) for v in made} | ({dim} if dim else set())
    if len(sizes) > 1:
        raise ValueError(f"embeddings of sizes {sorted(sizes)}")
    if any(abs(float(np.linalg.norm(v)) - 1) >= 1e-3 for v in made):
        raise ValueError("an embedding without length")
    return len(made[0])


def embed_batch(embed: Callable[[np.ndarray], np.ndarray], pieces: list[np.ndarray]) -> list[np.ndarray]:
    """Unit embeddings of pieces of one length; an error if lengths differ or a number is not finite."""
    if len({len(p) for p in pieces}) > 1:
        raise ValueError("pieces of unequal length")
    made = [unit(embed(p)) for p in pieces]
    if not all(np.isfinite(v).all() for v in made):
        raise ValueError("an embedding that is not finite")
    return made


@dataclass
class Diarizer:
    embed: Callable[[np.ndarray], np.ndarray]
    voice: Callable[[np.ndarray], float] = energy
    tuning: Tuning = field(default_factory=Tuning)
    t_change: float = T_CHANGE
    t_gap: float = T_GAP_CHANGE
    clusterer: Clusterer = None
    gate: Gate = field(default_factory=Gate)
    pieces: Pieces = field(default_factory=Pieces)
    carry: np.ndarray = field(default_factory=lambda: np.zeros(0))
    frames: int = 0
    chunk: int = -1
    label: int | None = None
    guessed_since: int | None = None  # of the label in force, if it is a guess
    before: np.ndarray | None = None  # the last hop's embedding
    gap: tuple[str, int | None] = ("closed", None)
    silences: int = 0
    seam: int | None = None
    failures: int = 0

    def __post_init__(self):
        self.clusterer = self.clusterer or Clusterer(self.tuning)

    def push(self, samples: np.ndarray) -> dict:
        """Speaker, provisional, boundary and relabels of the next chunk."""
        self.chunk += 1
        if self.failures >= MOST_FAILURES:
            raise OutOfService(f"{MOST_FAILURES} embeddings failed in a row")
        if -(-len(samples) // FRAME) >= HOP_FRAMES:
            raise ValueError("a chunk has to be shorter than a hop")
        audio = np.concatenate([self.carry, samples])
        n = len(audio) // FRAME
        whole, self.carry = audio[: n * FRAME].reshape(n, FRAME), audio[n * FRAME :]
        voiced = [self.gate.step(self.voice(f)) for f in whole]
        self.pieces.restarted = False
        made = [p for i, (f, v) in enumerate(zip(whole, voiced, strict=True)) if v for p in self.pieces.add(self.frames + i, f)]
        self.frames += n
        out = {"speaker": None, "provisional": False, "boundary": False, "relabels": []}
        try:
            self._hear(made, out)
        finally:  # the silence counts even where an embedding failed
            if self.pieces.restarted:
                self.gap = ("pending", self.chunk)
                self.silences += 1
                if self.silences > MOST_SILENCES:
                    self._assume_change()
        if any(voiced):
            out["speaker"], out["provisional"] = self.label, self.guessed_since is not None
        if (out["speaker"] is None or out["provisional"]) and self.seam is None:
            self.seam = self.chunk
        return out

    def _hear(self, made: list, out: dict) -> None:
        cut = False
        for kind, audio in made:
            if kind == WINDOW and cut:  # it reaches back over the boundary
                continue
            try:
                (v,) = embed_batch(self.embed, [audio])
            except Exception:
                self.failures += 1
                raise
            self.failures = 0
            if kind == HOP:
                cut = self._hop(v, out) or cut
            else:
                self._window(v, out)

    def _later_seam(self, chunk: int) -> None:
        if self.seam is not None:
            self.seam = max(self.seam, chunk)

    def _assume_change(self) -> None:
        if self.gap[0] == "pending":
            self._later_seam(self.gap[1])
            self.gap = ("assumed", None)

    def _hop(self, v: np.ndarray, out: dict) -> bool:
        across, self.gap, self.silences = self.gap[0] != "closed", ("closed", None), 0
        near = None if self.before is None else float(self.before @ v)
        first, self.before = self.before is None, v
        changed = False
        if across:
            same = self.t_change > 0 and near is not None and near >= self.t_gap
            if not same:
                self._later_seam(self.chunk)
        else:
            changed = self.t_change > 0 and near is not None and near < self.t_change and self.pieces.cut()
            if changed:
                out["boundary"], self.label, self.guessed_since = True, None, None
            if changed or first:
                self.seam = self.chunk
        if self.label is None and (short := self.clusterer.observe_short(v)) is not None:
            self.label, self.guessed_since = short, self.chunk
        return changed

    def _window(self, v: np.ndarray, out: dict) -> None:
        known = len(self.clusterer.labels)
        label, certainty = self.clusterer.observe(v)
        since = None
        if certainty == "settled":
            if len(self.clusterer.labels) > known:
                self._assume_change()
                since = self.chunk if self.seam is None else self.seam
            elif self.guessed_since is not None and self.label != label:
                self._assume_change()
                since = max(self.guessed_since, self.guessed_since if self.seam is None else self.seam)
        if since is not None:
            out["relabels"].append((since, self.chunk, label))
        held = self.guessed_since if self.guessed_since is not None and self.label == label else self.chunk
        self.label, self.guessed_since = label, held if certainty == "guessed" else None
        if certainty == "settled":
            self.seam = None
        elif self.seam is None:
            self.seam = self.chunk


LABELS = "chunk bigint, speaker int, provisional boolean, boundary boolean, relabels array<struct<from_chunk: bigint, to_chunk: bigint, speaker: int>>, corrected int"


def attribute(chunks: DataFrame, embed: Callable, voice: Callable = energy, tuning: Tuning = Tuning(), most_strikes: int = 5, window: int = 54) -> DataFrame:  # noqa: B008
    """Labels of audio chunks (stream_id, chunk, samples), as heard live and as corrected in the end.

    A chunk whose audio cannot be labelled has none; after ``most_strikes`` of these in a row the
    labeller of the stream is dropped.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", kind="stable")
        own, session, strikes, made = Diarizer(embed, voice, tuning), Attribution(lag=0, window=window), 0, []
        corrected: list[int | None] = []
        for samples in rows["samples"]:
            heard = {"speaker": None, "provisional": False, "boundary": False, "relabels": []}
            if strikes < most_strikes:
                try:
                    heard, strikes = own.push(np.asarray(samples, np.float64)), 0
                except Exception:  # noqa: BLE001  a chunk without a label, and a strike
                    strikes += 1
            for m in session.step(heard | {"text": "x"}):
                if m["kind"] == "commit":
                    corrected.append(m["speaker"])
                else:
                    corrected[m["from_seq"] - 1 : m["to_seq"]] = [m["speaker"]] * (m["to_seq"] - m["from_seq"] + 1)
            made.append(heard)
        relabels = [[{"from_chunk": a, "to_chunk": b, "speaker": s} for a, b, s in m["relabels"]] for m in made]
        return pd.DataFrame(
            {
                "stream_id": rows["stream_id"].to_numpy(), "chunk": rows["chunk"].to_numpy(), "speaker": pd.array([m["speaker"] for m in made], "Int32"), "provisional": [m["provisional"] for m in made],
                "boundary": [m["boundary"] for m in made], "relabels": relabels, "corrected": pd.array(corrected, "Int32"),
            }
        )

    return chunks.select("stream_id", "chunk", "samples").groupBy("stream_id").applyInPandas(fold, f"stream_id string, {LABELS}")
