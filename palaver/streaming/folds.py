"""Order-dependent state of one session, as folds that batch and stream share.

A fold has ``step(row) -> list of output rows`` and turns itself to and from JSON, so a stateful
stream can keep it between batches. :func:`in_batch` runs it per session over a table, and
:func:`in_stream` in a stream; both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass
class Attribution:
    """Commits wait for ``lag`` chunks of labels, get the majority's, and are corrected within ``window`` chunks.

    A row has text, speaker, provisional, boundary, relabels (from_chunk, to_chunk, speaker) and last.
    """

    lag: int = 2
    window: int = 54
    chunks: int = 0
    text_since: int = 0
    seq: int = 0
    labels: list = field(default_factory=list)  # chunk, speaker, provisional, boundary
    held: list = field(default_factory=list)  # text, from, to
    emitted: list = field(default_factory=list)  # seq, from, to, speaker, provisional

    SCHEMA = "kind string, seq bigint, text string, from_chunk bigint, to_chunk bigint, speaker int, provisional boolean, from_seq bigint, to_seq bigint, arrival bigint"

    def step(self, row: dict) -> list[dict]:
        self.labels.append([self.chunks, row["speaker"], bool(row["provisional"]), bool(row["boundary"])])
        self.chunks += 1
        out = [m for r in row["relabels"] for m in self._relabel(*r)] if self.window else []
        if row["text"]:
            self.held.append([row["text"], self.text_since, self.chunks - 1])
            self.text_since = self.chunks
        while self.held and (row.get("last") or self.chunks > self.held[0][2] + self.lag):
            out.append(self._release(*self.held.pop(0)))
        spent = self.held[0][2] if self.held else self.chunks - 1
        self.labels = [x for x in self.labels if x[0] >= spent]
        return out

    def _release(self, text: str, first: int, last: int) -> dict:
        votes: dict[int, list] = {}
        for chunk, speaker, provisional, boundary in self.labels:
            if not last <= chunk <= last + self.lag:
                continue
            if boundary and chunk > last:
                break
            if speaker is not None:
                v = votes.setdefault(speaker, [0, -chunk, True])
                v[0] += 1
                v[2] = v[2] and provisional
        speaker = max(votes, key=lambda k: votes[k][:2], default=None)
        provisional = votes[speaker][2] if votes else False
        self.seq += 1
        if self.window:
            self.emitted.append([self.seq, first, last, speaker, provisional])
        return {"kind": "commit", "seq": self.seq, "text": text, "from_chunk": first, "to_chunk": last, "speaker": speaker, "provisional": provisional}

    def _relabel(self, first: int, last: int, speaker: int) -> list[dict]:
        self.emitted = [e for e in self.emitted if e[2] >= self.chunks - self.window]
        changed = []
        for e in self.emitted:
            if e[1] <= last and e[2] >= first and (e[3] is None or (e[4] and e[3] != speaker)):
                e[3], e[4] = speaker, False
                if changed and changed[-1][1] + 1 == e[0]:
                    changed[-1][1] = e[0]
                else:
                    changed.append([e[0], e[0]])
        return [{"kind": "relabel", "from_seq": a, "to_seq": b, "speaker": speaker, "arrival": self.chunks - 1} for a, b in changed]


@dataclass
class Lines:
    """Which turn and line of the transcript a segment goes on, as segments arrive.

    A row has source, speaker, at and text. Blank segments are not written.
    """

    gap: float = 1.5
    turn: int = 0
    line: int = 0
    source: str | None = None
    speaker: int | None = None
    turn_speaker: int | None = None
    at: float | None = None

    SCHEMA = "pos bigint, turn bigint, line bigint, turn_speaker int, opens boolean"

    def step(self, row: dict) -> list[dict]:
        if not (row["text"] or "").strip():
            return []
        switch = self.turn == 0 or row["source"] != self.source
        if switch:
            self.speaker = None
        new_turn = switch or (row["speaker"] is not None and row["speaker"] != self.speaker)
        opens = new_turn or row["at"] - self.at >= self.gap
        if new_turn:
            self.turn, self.line, self.turn_speaker = self.turn + 1, 0, row["speaker"]
        self.line += opens
        self.source, self.at = row["source"], row["at"]
        if row["speaker"] is not None:
            self.speaker = row["speaker"]
        return [{"pos": row["pos"], "turn": self.turn, "line": self.line, "turn_speaker": self.turn_speaker, "opens": opens}]


@dataclass
class Transcript:
    """The reader's transcript: commits append, a revision takes characters back, corrections settle names.

    A row has type, seq, text, speaker, speaker_provisional, retract_n, from_seq, to_seq.
    """

    text: str = ""
    segments: list = field(default_factory=list)  # seq, text, speaker, provisional

    SCHEMA = "seq bigint, text string, speaker int, provisional boolean, length bigint"

    def step(self, row: dict) -> list[dict]:
        kind = row["type"]
        if kind in ("transcript.commit", "transcript.provisional"):
            self._add(row["seq"], row["text"] or "", row["speaker"], bool(row["speaker_provisional"]))
        elif kind == "transcript.revise":
            n = min(int(row["retract_n"] or 0), len(self.text))
            self.text = self.text[: len(self.text) - n]
            gone = 0
            while self.segments and gone < n:  # whole segments go until enough characters are gone
                gone += len(self.segments.pop()[1])
            if row["text"]:
                self._add(None, row["text"], None, False)
        elif kind == "transcript.relabel":
            for s in self.segments:
                if s[0] is not None and row["from_seq"] <= s[0] <= row["to_seq"] and (s[2] is None or s[3]) and s[2] != row["speaker"]:
                    s[2], s[3] = row["speaker"], False
        return []

    def _add(self, seq, text, speaker, provisional) -> None:
        self.text += text
        self.segments.append([seq, text, speaker, provisional])


@dataclass
class Rate:
    """Lets a row through if ``every`` seconds have gone by since the last one that was let through. A row has pos and at."""

    every: float = 5.0
    last: float | None = None

    SCHEMA = "pos bigint, allowed boolean"

    def step(self, row: dict) -> list[dict]:
        allowed = self.last is None or row["at"] - self.last >= self.every
        if allowed:
            self.last = row["at"]
        return [{"pos": row["pos"], "allowed": allowed}]


@dataclass
class Strikes:
    """Drops a labeller after ``most`` errors in a row; no label is no error, and success starts anew."""

    most: int = 5
    run: int = 0
    dropped: bool = False

    SCHEMA = "pos bigint, dropped boolean"

    def step(self, row: dict) -> list[dict]:
        if not self.dropped:
            self.run = self.run + 1 if row["failed"] else 0
            self.dropped = self.run >= self.most
        return [{"pos": row["pos"], "dropped": self.dropped}]


def _plain(value):
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return [_plain(v) for v in value]
    if value is None or (isinstance(value, float) and value != value) or value is pd.NA or value is pd.NaT:
        return None
    return value.item() if hasattr(value, "item") else value


def _rows(frame: pd.DataFrame) -> Iterable[dict]:
    for r in frame.to_dict("records"):
        yield {k: _plain(v) for k, v in r.items()}


def _whole(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]


def _run(fold, frame: pd.DataFrame, adapt, order: list[str], key: str, session: str, columns: list[str], whole: list[str]) -> pd.DataFrame:
    out = []
    frame = frame.astype(dict.fromkeys(whole, "Int64"))  # with nulls they come as floats
    for row in _rows(frame.sort_values(order, kind="stable")):
        out += [{key: session} | m for m in fold.step(adapt(fold, row) if adapt else row)]
    made = pd.DataFrame(out, columns=[key, *columns]).astype(object)
    return made.where(made.notna(), None)


def _columns(fold) -> list[str]:
    return [x.split(" ")[0] for x in fold.SCHEMA.split(", ")]


def in_batch(rows: DataFrame, fold, order: list[str], adapt=None, key: str = "session_id") -> DataFrame:
    """Runs a fresh copy of ``fold`` over each session; ``adapt(fold, row)`` makes the fold's row."""
    start, kind, columns, whole = json.dumps(asdict(fold)), type(fold), _columns(fold), _whole(rows)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _run(kind(**json.loads(start)), frame, adapt, order, key, frame[key].iloc[0], columns, whole)

    return rows.groupBy(key).applyInPandas(run, f"{key} string, {fold.SCHEMA}")


def in_stream(rows: DataFrame, fold, order: list[str], adapt=None, key: str = "session_id") -> DataFrame:
    """The same in a stream: state per session is kept between batches, rows of a batch are put in order. A
    row whose column ``last`` is true ends its session and frees the state."""
    start, kind, columns, whole = json.dumps(asdict(fold)), type(fold), _columns(fold), _whole(rows)

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("fold", "json string")

        def handleInputRows(self, key_, batches, timers):
            state = kind(**json.loads(self.state.get()[0] if self.state.exists() else start))
            frame = pd.concat(list(batches), ignore_index=True)
            out = _run(state, frame, adapt, order, key, key_[0], columns, whole)
            if "last" in frame and frame["last"].fillna(False).any():  # nothing comes after a session's end
                self.state.clear()
            else:
                self.state.update((json.dumps(asdict(state)),))
            yield out

        def close(self) -> None:
            pass

    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Processor(), outputStructType=f"{key} string, {fold.SCHEMA}", outputMode="Append", timeMode="None")
