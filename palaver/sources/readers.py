"""Readers: recordings, annotations, caches, message frames."""

from __future__ import annotations

import uuid
import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver import schemas
from palaver.functions import signal as S
from palaver.functions import text as T

RATE, CHUNK = 16_000, 8960


def wav_samples(data: bytes) -> np.ndarray:
    """Samples of a 16 kHz mono WAV file of 16-bit or float samples."""
    if data[20:22] == b"\x03\x00":  # float samples, which the wave module refuses
        channels, rate = int.from_bytes(data[22:24], "little"), int.from_bytes(data[24:28], "little")
        at = data.index(b"data") + 8
        samples = np.frombuffer(data[at : at + int.from_bytes(data[at - 4 : at], "little") // 4 * 4], "<f4")
    else:
        with wave.open(io.BytesIO(data)) as w:
            channels, rate, width = w.getnchannels(), w.getframerate(), w.getsampwidth()
            if width != 2:
                raise ValueError(f"{8 * width}-bit samples")
            samples = np.frombuffer(w.readframes(w.getnframes()), "<i2") / np.float32(32768)
    if (channels, rate) != (1, RATE):
        raise ValueError(f"{channels} channels at {rate} Hz; one at {RATE} is read")
    return samples.astype(np.float32)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: stream_id (its stem), samples, error."""

    def run(parts):
        for rows in parts:
            out = []
            for data in rows["content"]:
                try:
                    out.append((wav_samples(bytes(data)).tolist(), None))
                except Exception as e:  # noqa: BLE001  a file that can't be read is a row with its error
                    out.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame({"path": rows["path"], "samples": [o[0] for o in out], "error": [o[1] for o in out]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, samples array<float>, error string").select(T.stem(F.col("path")).alias("stream_id"), "samples", "error")


def audio_chunks(streams: DataFrame, size: int = CHUNK) -> DataFrame:
    """AUDIO_CHUNK rows of streams (stream_id, samples); the last one is filled with silence."""
    pieces = F.posexplode(S.chunks(S.pad(F.transform("samples", lambda x: x.cast("double")), size), size))
    return streams.select("stream_id", pieces.alias("chunk", "samples")).select("stream_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("samples").cast("array<float>").alias("samples"))


def read_pcm(spark: SparkSession, path: str) -> DataFrame:
    """Raw 16-bit files: stream_id and samples. An odd last byte is dropped."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(T.stem(F.col("path")).alias("stream_id"), S.pcm_to_samples("content").alias("samples"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """REFERENCE_WORD rows of annotation files ``<meeting>.<letter>.words.xml``, one word element a line.

    Punctuation, words without times and words of no length are left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f")).filter(F.col("value").contains("<w "))
    rows = lines.select(
        F.substring_index("f", ".", 1).alias("meeting"), F.substring_index(F.substring_index("f", ".", 2), ".", -1).alias("speaker"),
        T.xml_attr(F.col("value"), "starttime").alias("start"), T.xml_attr(F.col("value"), "endtime").alias("end"), F.col("value").contains('punc="true"').alias("punc"),
    )
    return rows.filter(~F.col("punc") & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") > F.col("start")))


def word_frames(words: DataFrame, per_second: int = 100) -> DataFrame:
    """Words on the grid of frames: recording, spk (from 0, by letter), lo and hi, both inclusive."""
    micros = lambda c: F.floor(F.round(F.col(c) * 1_000_000).cast("bigint") / F.lit(1_000_000 // per_second))
    spk = F.dense_rank().over(Window.partitionBy("meeting").orderBy("speaker")) - 1
    return words.select(F.col("meeting").alias("recording"), spk.alias("spk"), micros("start").alias("lo"), micros("end").alias("hi"))


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Server messages of files with one JSON object a line, and the lines that are none."""
    from palaver.operators import messages

    lines = spark.read.text(path).select(F.col("value").alias("json"))
    return messages.decode(lines)


def cached(build, spark: SparkSession, path: str, version: str) -> DataFrame:
    """A table kept under a path that names its parameters and version; built beside its place and moved
    there where it isn't there yet, so that no half of one is ever read."""
    where = f"{path.rstrip('/')}/{version}"
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = of(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not place.exists(of(f"{where}/_SUCCESS")):
        part = f"{where}.{uuid.uuid4().hex}"
        build().write.parquet(part)
        place.delete(of(where), True)
        if not place.rename(of(part), of(where)):
            raise OSError(f"{where} could not be put in place")
    return spark.read.parquet(where)


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDING).parquet(path)


#: Fixed value: the first bytes of a file of embeddings.
MAGIC = b"DZEM"


def pack_embeddings(times: list[tuple[float, float]], vectors: list[list[float]]) -> bytes:
    """The file of embeddings: magic, width, number, then the times and the vectors as 32-bit floats."""
    width = len(vectors[0]) if vectors else 0
    if len(times) != len(vectors) or any(len(v) != width for v in vectors):
        raise ValueError("times and vectors that don't belong together")
    return MAGIC + np.array([width, len(vectors)], "<u4").tobytes() + np.array(times, "<f4").tobytes() + np.array(vectors, "<f4").tobytes()


def unpack_embeddings(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (n by 2) and vectors of such a file; an error if it is none or has another length than it says."""
    if len(data) < 12 or data[:4] != MAGIC:
        raise ValueError("not a file of embeddings")
    width, n = (int(x) for x in np.frombuffer(data, "<u4", 2, 4))
    if len(data) != 12 + 4 * n * (2 + width):
        raise ValueError("a file of embeddings cut off")
    floats = np.frombuffer(data, "<f4", n * (2 + width), 12)
    return floats[: 2 * n].reshape(n, 2), floats[2 * n :].reshape(n, width)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """A row per embedding of such files: stream_id (the file's stem), ord, t0, t1, vector, error. A file that
    can't be read is one row with its error."""

    def run(parts):
        for rows in parts:
            for name, data in zip(rows["path"], rows["content"], strict=True):
                try:
                    times, vectors = unpack_embeddings(bytes(data))
                    yield pd.DataFrame({"path": name, "ord": np.arange(len(times)), "t0": times[:, 0], "t1": times[:, 1], "vector": list(vectors), "error": None})
                except ValueError as e:
                    yield pd.DataFrame({"path": [name], "ord": pd.array([None], "Int64"), "t0": [None], "t1": [None], "vector": [None], "error": [str(e)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, ord bigint, t0 float, t1 float, vector array<float>, error string").select(T.stem(F.col("path")).alias("stream_id"), "ord", "t0", "t1", "vector", "error")


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """FRAME rows (stream_id, frame, voiced) of files with a byte a frame, nought for silence."""
    files = spark.read.format("binaryFile").load(path).select(T.stem(F.col("path")).alias("stream_id"), F.hex("content").alias("h"))
    flags = F.transform(F.sequence(F.lit(0), (F.length("h") / 2).cast("int") - 1), lambda i: F.substring(F.col("h"), i * 2 + 1, F.lit(2)) != "00")
    return files.filter(F.length("h") > 0).select("stream_id", F.posexplode(flags).alias("frame", "voiced")).withColumn("frame", F.col("frame").cast("bigint"))


def at_frames(frames: DataFrame, flags: DataFrame) -> DataFrame:
    """Frames (stream_id, frame) with their flags by position; the shorter side ends both."""
    return frames.join(flags.select("stream_id", "frame", "voiced"), ["stream_id", "frame"])
