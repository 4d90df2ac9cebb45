"""Media columns: ISO media files as binary values, and what their boxes say.

:func:`write` stores bytes losslessly as 8-bit mono sound: a sample is one frame of ``FRAME`` bytes,
``CHUNK`` samples make a chunk, and the first sample of each chunk is listed as a sync sample.
:func:`probe` walks the nested boxes of any such file, decodes the sample tables of its tracks and
gives codec, duration and the byte ranges of sync samples; it touches no payload. Samples of movie
fragments follow those of the tables. :func:`payload` reads the bytes of all samples by these ranges.

Defined results: a null value probes as a null codec with ``error`` "empty"; a file that is cut off
or contradicts itself (a count that its bytes can't hold, a sample beyond the end) gives its ``error`` and no
ranges; files are handled row by row, equal ones alike.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palaver.llm import common

FRAME, RATE, CHUNK = 192, 8000, 16
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Malformed(ValueError):
    pass


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of the frame size."""
    return data + b" " * (-len(data) % FRAME if data else FRAME)


def file_of(data: bytes) -> bytes:
    """An ISO media file that holds ``data``, whose size is a positive multiple of ``FRAME``."""
    samples = len(data) // FRAME
    if samples * FRAME != len(data) or not samples:
        raise ValueError("whole frames are stored")
    chunks = -(-samples // CHUNK)
    length, rest = samples * FRAME, samples % CHUNK
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ", b"isom")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    runs = [(1, CHUNK)] if samples >= CHUNK else []
    if rest:
        runs.append((chunks, rest))

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)
        wide = offsets[-1] > 0xFFFFFFFF
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, samples, FRAME)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, n, 1) for c, n in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, samples)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">i8" if wide else ">u4").tobytes()),
            _full(b"stss", struct.pack(">I", chunks), (1 + np.arange(chunks) * CHUNK).astype(">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length, 0x55C4, 0)), _full(b"hdlr", b"mhlrsoun", bytes(12), b"\0"), minf)
        tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8))
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, length), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    size = len(moov(0))
    head = 8 if length + 8 <= 0xFFFFFFFF else 16
    mdat = struct.pack(">I4s", length + 8, b"mdat") if head == 8 else struct.pack(">I4sQ", 1, b"mdat", length + 16)
    return b"".join((ftyp, moov(len(ftyp) + size + head), mdat, data))


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first byte of the body and end of each box between ``start`` and ``end``."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            if not any(data[start:end]):
                return
            raise Malformed(f"a box cut off at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - body < 8:
                raise Malformed(f"a box cut off at {start}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise Malformed(f"box {kind!r} at {start} has a size of {size}")
        yield kind, body, start + size
        start += size


def _tree(data: memoryview, start: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[bytes, int, int, list]]:
    if depth > 16:
        raise Malformed("boxes nested too deep")
    return [(k, a, b, _tree(data, a, b, depth + 1) if k in NESTED else []) for k, a, b in boxes(data, start, end)]


def _find(tree: list, *path: bytes) -> Iterator[tuple[bytes, int, int, list]]:
    for node in tree:
        if node[0] == path[0]:
            if len(path) == 1:
                yield node
            else:
                yield from _find(node[3], *path[1:])


def _one(tree: list, *path: bytes) -> tuple[int, int] | None:
    node = next(_find(tree, *path), None)
    return node and (node[1], node[2])


def _array(data: memoryview, span: tuple[int, int], skip: int, kind: str, columns: int = 1) -> np.ndarray:
    """The counted table of a full box, after ``skip`` further bytes."""
    at = span[0] + 4 + skip
    if at + 4 > span[1]:
        raise Malformed("a table cut off")
    (n,) = struct.unpack_from(">I", data, at)
    size = n * columns * np.dtype(kind).itemsize
    if at + 4 + size > span[1]:
        raise Malformed("a table cut off")
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _fields(data: memoryview, span: tuple[int, int], skip: int, kind: str) -> tuple:
    """Fields of a box, ``skip`` bytes into its body."""
    if span[0] + skip + struct.calcsize(kind) > span[1]:
        raise Malformed("a box too small for its fields")
    return struct.unpack_from(kind, data, span[0] + skip)


#: Marks of a fragment's track header and run, and of a sample that depends on others.
BASE, DESCRIPTION, DURATION, SIZE, FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
RUN_OFFSET, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
DEPENDS = 0x10000


def _optional(data: memoryview, span: tuple[int, int], skip: int, marks: int, kinds: dict[int, str]) -> tuple[dict[int, int], int]:
    """Fields that are there where their mark is set, in order, and how far they go."""
    out = {}
    for mark, kind in kinds.items():
        if marks & mark:
            (out[mark],) = _fields(data, span, skip, kind)
            skip += struct.calcsize(kind)
    return out, skip


def fragments(data: memoryview, tree: list, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, sizes, durations and sync marks of a track's samples in movie fragments."""
    given = {}
    for _, a, b, _ in _find(tree, b"moov", b"mvex", b"trex"):
        trex = _fields(data, (a, b), 4, ">IIIII")
        given[trex[0]] = dict(zip((DURATION, SIZE, FLAGS), trex[2:], strict=True))
    offsets, sizes, lengths, sync = [], [], [], []
    for kind, body, _, nodes in tree:
        if kind != b"moof":
            continue
        end = moof = body - 8
        for _, _, _, traf in _find(nodes, b"traf"):
            tfhd = _one(traf, b"tfhd")
            if tfhd is None:
                raise Malformed("a fragment without a track header")
            marks, of = _fields(data, tfhd, 0, ">II")
            own, _ = _optional(data, tfhd, 8, marks, {BASE: ">Q", DESCRIPTION: ">I", DURATION: ">I", SIZE: ">I", FLAGS: ">I"})
            use = given.get(of, {}) | own
            base = own.get(BASE, moof if marks & 0x20000 or end == moof else end)
            end = base
            for _, a, b, _ in _find(traf, b"trun"):
                marks, n = _fields(data, (a, b), 0, ">II")
                run, at = _optional(data, (a, b), 8, marks, {RUN_OFFSET: ">i", RUN_FIRST: ">I"})
                columns = [m for m in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if marks & m]
                if a + at + 4 * n * len(columns) > b or (not columns and n > len(data)):
                    raise Malformed("a run cut off")
                table = np.frombuffer(data, ">u4", n * len(columns), a + at).astype(np.int64).reshape(n, len(columns)) if columns else np.zeros((n, 0), np.int64)
                column = lambda m, default: table[:, columns.index(m)] if m in columns else np.full(n, use.get(default, 0), np.int64)  # noqa: E731, B023
                size, flags = column(RUN_SIZE, SIZE), column(RUN_FLAGS, FLAGS).copy()
                if RUN_FIRST in run and n:
                    flags[0] = run[RUN_FIRST]
                start = base + run[RUN_OFFSET] if RUN_OFFSET in run else end
                ends = start + np.cumsum(size)
                end = int(ends[-1]) if n else start
                if of == number:
                    for whole, part in zip((offsets, sizes, lengths, sync), (ends - size, size, column(RUN_DURATION, DURATION), flags & DEPENDS == 0), strict=True):
                        whole.append(part)
    if not offsets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in (offsets, sizes, lengths, sync))


def track(data: memoryview, trak: list, tree: list) -> dict:
    """Codec, timing and the place of every sample of one track."""
    need = {k: _one(trak, b"mdia", b"minf", b"stbl", k) for k in (b"stsd", b"stts", b"stsc", b"stsz")}
    mdhd = _one(trak, b"mdia", b"mdhd")
    if mdhd is None or None in need.values():
        raise Malformed("a sample table is missing")
    version = _fields(data, mdhd, 0, ">B")[0]
    scale, duration = _fields(data, mdhd, 20 if version else 12, ">IQ" if version else ">II")
    codec = _fields(data, need[b"stsd"], 12, "4s")[0].decode("latin-1")
    fixed, count = _fields(data, need[b"stsz"], 4, ">II")
    if fixed * count > len(data):
        raise Malformed("more samples than the file holds")
    sizes = np.full(count, fixed, np.int64) if fixed else _array(data, need[b"stsz"], 4, ">u4")[:, 0]
    times = _array(data, need[b"stts"], 0, ">u4", 2)
    if times[:, 0].sum() != len(sizes):
        raise Malformed("times and sizes differ in number")
    deltas = np.repeat(times[:, 1], times[:, 0])
    stco, co64 = (_one(trak, b"mdia", b"minf", b"stbl", k) for k in (b"stco", b"co64"))
    if stco is None and co64 is None:
        raise Malformed("no chunk offsets")
    chunks = _array(data, stco, 0, ">u4")[:, 0] if stco else _array(data, co64, 0, ">u8")[:, 0]
    runs = _array(data, need[b"stsc"], 0, ">u4", 3)
    first = runs[:, 0] - 1
    if len(sizes) and (not len(first) or first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= len(chunks)):
        raise Malformed("chunks out of order")
    per = np.repeat(runs[:, 1], np.diff(np.append(first, len(chunks))))
    if per.sum() != len(sizes):
        raise Malformed("chunks and sizes differ in number")
    chunk = np.repeat(np.arange(len(chunks)), per)
    before = np.cumsum(sizes) - sizes
    start_of_chunk = before[np.minimum(np.cumsum(per) - per, max(len(sizes) - 1, 0))] if len(sizes) else before
    offsets = chunks[chunk] + before - start_of_chunk[chunk]
    stss = _one(trak, b"mdia", b"minf", b"stbl", b"stss")
    sync = _array(data, stss, 0, ">u4")[:, 0] - 1 if stss else np.arange(len(sizes))
    if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
        raise Malformed("a sync sample that isn't there")
    tkhd = _one(trak, b"tkhd")
    number = _fields(data, tkhd, 20 if _fields(data, tkhd, 0, ">B")[0] else 12, ">I")[0] if tkhd else 0
    more = fragments(data, tree, number)
    if len(more[0]):
        sync = np.append(sync, len(sizes) + np.flatnonzero(more[3]))
        offsets, sizes, deltas = (np.append(x, y) for x, y in zip((offsets, sizes, deltas), more[:3], strict=True))
        duration = max(duration, int(deltas.sum()))
    if len(sizes) and (int(offsets.min()) < 0 or int((offsets + sizes).max()) > len(data)):
        raise Malformed("a sample lies beyond the end")
    return {"codec": codec, "timescale": scale, "duration": duration, "offsets": offsets, "sizes": sizes, "starts": np.cumsum(deltas) - deltas, "sync": sync}


def tracks(media: bytes) -> list[dict]:
    data = memoryview(media)
    try:
        tree = _tree(data)
        return [track(data, node[3], tree) for node in _find(tree, b"moov", b"trak")]
    except struct.error as e:
        raise Malformed(str(e)) from e


def ranges(t: dict) -> list[tuple[int, int]]:
    """Byte ranges of all samples, those that touch joined."""
    offsets, ends = t["offsets"], t["offsets"] + t["sizes"]
    if not len(offsets):
        return []
    new = np.flatnonzero(np.append(True, offsets[1:] != ends[:-1]))
    return list(zip(offsets[new].tolist(), ends[np.append(new[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def payload(media: bytes) -> bytes:
    return b"".join(media[a:b] for t in tracks(media) for a, b in ranges(t))


def write(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """The id, the size of the data and the media file that holds it, padded. Null data count as empty."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                data = [x or b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([file_of(pad(x)) for x in data], pa.binary())], ["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[data_col].cast("binary").alias("data")).transform(common.in_batches).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


KEYFRAMES = "array<struct<offset: bigint, length: bigint, seconds: double>>"
_KEYS = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("seconds", pa.float64())]))


def keyframes(t: dict) -> list[dict]:
    scale = t["timescale"] or 1
    return [{"offset": int(t["offsets"][i]), "length": int(t["sizes"][i]), "seconds": int(t["starts"][i]) / scale} for i in t["sync"]]


def probe(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """A row per track: its number from 1, codec, duration in seconds, number of samples, and the sync
    samples as (offset, length, seconds). A file in error has one row without a track. No payload is read."""

    def told(media: bytes | None) -> list[tuple]:
        if not media:
            return [(None, None, None, None, None, "empty")]
        try:
            found = tracks(media)
        except Malformed as e:
            return [(None, None, None, None, None, str(e))]
        if not found:
            return [(None, None, None, None, None, "no track")]
        return [(i, t["codec"], t["duration"] / (t["timescale"] or 1), len(t["sizes"]), keyframes(t), None) for i, t in enumerate(found, 1)]

    kinds = (pa.int32(), pa.string(), pa.float64(), pa.int64(), _KEYS, pa.string())

    def run(batches):
        for batch in batches:
            rows = [(i, *r) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in told(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds, 1))], ["id", "track", "codec", "duration", "n_samples", "keyframes", "error"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, track int, codec string, duration double, n_samples long, keyframes {KEYFRAMES}, error string"
    return df.select(df[id_col].alias("id"), df[media_col].alias("media")).transform(common.in_batches).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """What the stored files hold, read by their sample tables: digests, a summary of boxes as ``feature``,
    and codec, duration in seconds and the byte ranges of sync samples."""

    def told(n: int, media: bytes) -> tuple:
        (t,) = tracks(media)
        data = b"".join(media[a:b] for a, b in ranges(t))
        keys = np.stack([t["offsets"][t["sync"]], t["sizes"][t["sync"]]])
        feature = f"{t['codec'].strip()};{t['duration']}/{t['timescale']};samples={len(t['sizes'])};keyframes={keys.shape[1]}@{zlib.crc32(keys.tobytes()):08x}"
        return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, t["codec"].strip(), t["duration"] / t["timescale"], keyframes(t)

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframes"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), _KEYS]

    def run(batches):
        for batch in batches:
            rows = [told(n, x) for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, keyframes {KEYFRAMES}"
    return df.select(df[id_col].alias("id"), df["n_bytes"], df[media_col].alias("media")).transform(common.in_batches).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return digests(write(docs, "doc_id", "text"), "doc_id")
