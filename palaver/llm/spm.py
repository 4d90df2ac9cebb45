"""SentencePiece encoding with byte spans, and decoding.

A text is normalised by the rules compiled into the model file: at each position the longest prefix
found in the compiled character map (a double-array trie followed by a pool of replacement strings)
is replaced, any other character stands for itself. The normaliser records for every byte of its
output the source byte it came from, so that each piece can be projected to a span of original bytes.

The segmentation itself is left to the sentencepiece library, on a copy of the model whose own
normaliser is switched off. Where no piece of the vocabulary has a word-start mark after another
character, merges cannot cross from one word to the next; then words are encoded one by one and
remembered in a bounded table, which gives the same ids as encoding whole texts.

Defined results: a null or empty text has no ids and decodes to the empty text. Rows are
independent, so repeated rows give repeated results and an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from palaver.llm import common

MARK = "▁"
#: Words remembered in each Python worker before the table is emptied.
CACHE_WORDS = 250_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(blob):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = blob[at : at + 8], at + 8
        elif kind == 2:
            size, at = varint(at)
            value, at = blob[at : at + size], at + size
        elif kind == 5:
            value, at = blob[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


class CharsMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, found = self.units, None
        node = 0
        unit = units[node]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1] : end]


class Normalizer:
    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True, suffix: bool = False):
        self.map = CharsMap(charsmap) if charsmap else None
        self.dummy, self.squeeze, self.escape, self.suffix = dummy_prefix, squeeze, escape, suffix

    @property
    def plain(self) -> bool:
        """Only spaces change: the result can be had without walking the text."""
        return self.map is None and not self.squeeze and self.escape and not self.suffix

    def text(self, text: str) -> str:
        if self.plain:
            return (MARK * self.dummy + text.replace(" ", MARK)) if text else ""
        return self.aligned(text)[0].decode()

    def aligned(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the offset of its source byte."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            steps = np.where(raw == 32, 3, 1)
            source = np.repeat(np.arange(len(raw)), steps)
            lead = np.zeros(3 * self.dummy, np.int64)
            return self.text(text).encode(), np.concatenate([lead, source, [len(raw)]])
        return self._walk(data)

    def _walk(self, data: bytes) -> tuple[bytes, np.ndarray]:
        mark = MARK.encode() if self.escape else b" "
        pieces: list[tuple[bytes, int, int]] = []  # replacement, from, to
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit is None:
                size = 1
                while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                    size += 1
                hit = size, data[at : at + size]
            pieces.append((hit[1], at, at + hit[0]))
            at += hit[0]
        if self.squeeze:
            while pieces and not pieces[0][0].strip(b" "):
                pieces.pop(0)
        out, source, last_space = bytearray(), [], self.squeeze
        if not pieces:
            return b"", np.array([len(data)])
        begin = pieces[0][1]
        if self.dummy and not self.suffix:
            out += mark
            source += [begin] * len(mark)
        for value, start, _ in pieces:
            for i in range(len(value)):
                char = value[i : i + 1]
                if char == b" ":
                    if self.squeeze and last_space:
                        continue
                    out += mark
                    source += [start] * len(mark)
                else:
                    out += char
                    source.append(start)
                last_space = char == b" "
        end = pieces[-1][2]
        if self.squeeze:
            while out.endswith(mark) and len(out) >= len(mark) and source:
                cut = len(out) - len(mark)
                end = source[cut]
                del out[cut:], source[cut:]
        if self.dummy and self.suffix:
            out += mark
            source += [end] * len(mark)
        return bytes(out), np.array([*source, end])


class Codec:
    """The encoder and decoder of one model file."""

    def __init__(self, blob: bytes):
        import sentencepiece

        spec: dict[int, object] = {}
        trainer: dict[int, object] = {}
        pieces = []
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode(), piece.get(3, NORMAL)))
            elif number == 2:
                trainer |= dict(_fields(value))
            elif number == 3:
                spec |= dict(_fields(value))
        self.normalizer = Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(trainer.get(24, 0)))
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=blob)
        # A later field of the same number overrides: an identity map, no prefix, nothing squeezed or escaped.
        off = b"\x0a\x08identity" + b"\x12\x00" + b"\x18\x00\x20\x00\x28\x00"
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=blob + b"\x1a" + bytes([len(off)]) + off)
        self.size = np.array([1 if kind == BYTE else len(piece.encode()) for piece, kind in pieces])
        self.byte_fallback = bool(trainer.get(35, 0))
        bpe = trainer.get(3, 1) == 2
        self.by_word = bpe and self.byte_fallback and not self.normalizer.suffix and not any(kind == USER or MARK in piece.lstrip(MARK) for piece, kind in pieces)
        self.ids: dict[str, tuple[int, ...]] = {}
        self.said: dict[str, str] = {}

    def _chunks(self, norm: str) -> list[str]:
        """Runs that no merge leaves: marks, then what is not a mark."""
        if norm.startswith(MARK) and MARK + MARK not in norm and not norm.endswith(MARK):
            return [MARK + x for x in norm.split(MARK)[1:]]
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", norm)

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each text its ids, and the same as decimals joined by commas."""
        norms = [self.normalizer.text(t) for t in texts]
        if not self.by_word:
            return [(x, ",".join(map(str, x))) for x in (self.segmenter.encode(t, add_bos=False, add_eos=False) for t in norms)]
        chunks = [self._chunks(n) for n in norms]
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.said = {}, {}
        missing = list(set().union(*chunks) - self.ids.keys())
        for key, ids in zip(missing, self.segmenter.encode(missing, num_threads=1, add_bos=False, add_eos=False) if missing else [], strict=True):
            self.ids[key] = tuple(ids)
            self.said[key] = ",".join(map(str, ids))
        return [(list(chain.from_iterable(map(self.ids.__getitem__, c))), ",".join(map(self.said.__getitem__, c))) for c in chunks]

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte (exclusive) in the text of each piece. Pieces tile the bytes that the
        normaliser kept; one inside a replaced run starts where that run starts."""
        if not self.byte_fallback:
            raise ValueError("unknown pieces have no fixed size without byte fallback")
        ends = np.cumsum(self.size[ids]) if ids else np.zeros(0, np.int64)
        _, source = self.normalizer.aligned(text)
        at = source[np.concatenate([[0], ends]).astype(np.int64)]
        return at[:-1], at[1:]

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids) if ids else ""


SCHEMA = "n_tokens long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def _model(spark, path: str | None):
    """The model file as a broadcast: its size is that of a vocabulary, whatever the data."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_codecs: dict[int, Codec] = {}
common.KEPT["spm"] = _codecs


def _codec(blob: bytes) -> Codec:
    """One codec for each model and Python worker."""
    key = hash(blob)
    if key not in _codecs:
        _codecs[key] = Codec(blob)
    return _codecs[key]


def _slices(batches, text: int, most: int = 4_000_000):
    """Rows of Arrow batches in slices of bounded text, so that long texts don't pile up."""
    for batch in batches:
        first = size = 0
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            size += n
            if size > most:
                yield batch.slice(first, i + 1 - first)
                first, size = i + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Per row the id, the number of pieces, their ids, original byte spans and the decoded text."""
    model = _model(df.sparkSession, model_path)

    def run(batches):
        codec = _codec(model.value)
        for part in _slices(batches, 1):
            texts = [t or "" for t in part.column(1).to_pylist()]
            made = [x for x, _ in codec.encode(texts)]
            spans = [codec.spans(t, x) for t, x in zip(texts, made, strict=True)]
            kinds = pa.list_(pa.int32())
            columns = [pa.array([len(x) for x in made], pa.int64()), pa.array(made, kinds), *(pa.array([s[i].astype(np.int32) for s in spans], kinds) for i in (0, 1)), pa.array([codec.decode(x) for x in made], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_tokens", "ids", "begins", "ends", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).transform(common.in_batches).mapInArrow(common.lean(run, "spm"), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """As :func:`encode`, but with digests in place of ids and decoded text, and the bytes that spans cover."""
    model = _model(df.sparkSession, model_path)

    def run(batches):
        codec = _codec(model.value)
        for part in _slices(batches, 1):
            texts = [t or "" for t in part.column(1).to_pylist()]
            n, said, back, covered = [], [], [], []
            for text, (ids, joined) in zip(texts, codec.encode(texts), strict=True):
                begins, ends = codec.spans(text, ids)
                n.append(len(ids))
                said.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                covered.append(int((ends - begins).sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string()), pa.array(covered, pa.int64())], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).transform(common.in_batches).mapInArrow(common.lean(run, "spm"), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long").withColumnRenamed("id", id_col)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
