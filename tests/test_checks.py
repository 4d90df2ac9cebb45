import os
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import checks, devices, windows
from palaver.operators import vectors as V
from palaver.functions import text as T
from palaver.plans.catalog import ORACLES, QUERIES
from palaver.sources import readers, writers
from palaver.streaming import diarizer, folds, run


def test_out_of_range(spark):
    rows = [(0, 2, 0.0, 0.0, 0.0, 0), (16, 16, 0.5, 1.0, 1.0, 600), (17, 1, 0.51, -0.1, float("nan"), 601), (None, 2, None, 0.5, 0.5, -1)]
    df = spark.createDataFrame(rows, "lag_chunks int, min_pool int, margin double, mint_ceiling double, change_threshold double, relabel_window int")
    assert [r[0] for r in df.select(checks.out_of_range()).collect()] == [[], [], list(checks.RANGES), ["lag_chunks", "margin", "relabel_window"]]


def test_addresses_and_capacity(spark):
    said = {None: "empty", " ": "empty", "http://a": "no scheme", "host:1": "no scheme", "ws://": "no host", "wss:///x": "no host", " ws://h:1/x ": None}
    df = spark.createDataFrame([(k,) for k in said], "u string")
    assert {r[0]: r[1] for r in df.select("u", checks.address_fault(F.col("u"))).collect()} == said
    free = spark.createDataFrame([(11,), (10,), (None,)], "free int")
    assert [r[0] for r in free.select(checks.can_load(F.col("free"), F.lit(6), F.lit(4))).collect()] == [True, False, False]


def test_spans(spark):
    got = spark.createDataFrame([(399,), (400,), (720,), (None,)], "n long").select(windows.analysis_spans(F.col("n"))).collect()
    assert [[tuple(x) for x in r[0]] if r[0] is not None else None for r in got] == [[], [(0, 0, 400)], [(0, 0, 400), (1, 160, 560), (2, 320, 720)], []]


def test_resolve_any_length(spark):
    chain = [(i, i + 1 if i < 700 else None) for i in range(701)] + [(900, 900), (901, 5000)]
    got = {r["label"]: r["to"] for r in V.resolve(spark.createDataFrame(chain, "label long, retired_into long")).collect()}
    assert got == {i: 700 for i in range(701)} | {900: 900, 901: 5000}
    with pytest.raises(ValueError):
        V.resolve(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "label long, retired_into long"))


def test_pick_model(spark):
    names = lambda *x: devices.pick_model(spark.createDataFrame([(n, k) for n, k in x], "name string, known boolean"), "usual.onnx").first()
    assert tuple(names(("usual.onnx", False), ("a.onnx", True), ("b.onnx", True))) == ("usual.onnx", None)
    assert tuple(names(("a.onnx", True), ("x.onnx", False))) == ("a.onnx", None)
    assert names(("x.onnx", False))["fault"] == "no model of a known family" and names(("a", True), ("b", True))["fault"] == "several models"


def test_rate():
    rate = folds.Rate(5.0)
    assert [rate.step({"pos": i, "at": t})[0]["allowed"] for i, t in enumerate((0.0, 4.9, 5.0, 9.0, 10.0))] == [True, False, True, False, True]


def test_self_check():
    rng = np.random.default_rng(0)
    speech = rng.standard_normal(16_000) * 0.3
    embed = lambda x: np.array([x.mean(), x.std(), len(x) / 1e5])
    assert diarizer.self_check(embed, diarizer.energy, speech, 3) == 3
    for bad in ((embed, lambda f: 1.0, speech), (embed, lambda f: 0.0, speech), (lambda x: np.zeros(3), diarizer.energy, speech), (lambda x: np.ones(len(x)), diarizer.energy, speech), (lambda x: np.array([np.nan]), diarizer.energy, speech)):
        with pytest.raises(ValueError):
            diarizer.self_check(*bad)
    with pytest.raises(ValueError):
        diarizer.embed_batch(embed, [speech, speech[:10]])


def test_saving(spark, tmp_path):
    texts = spark.createDataFrame([("a", "  one\ntwo \n"), ("b", "three")], "session_id string, body string")
    made = writers.save(texts, f"{tmp_path}/plain")
    assert sorted(os.listdir(tmp_path / "plain")) == ["a.txt", "b.txt"] and len(made) == 2
    assert (tmp_path / "plain/a.txt").read_text() == "one\ntwo\n"
    writers.save(texts, f"{tmp_path}/stamped", "2024-01-02-030405")
    assert (tmp_path / "stamped/b/2024-01-02-030405.txt").read_text() == "three\n"
    with pytest.raises(ValueError):
        writers.save(texts.union(spark.createDataFrame([("c", " \n")], texts.schema)), f"{tmp_path}/none")
    assert not os.path.exists(tmp_path / "none")


def test_saving_sources(spark, tmp_path):
    schema = "session_id string, pos long, at double, text string, source string, speaker int, provisional boolean, seq long"
    rows = [("s", 1, 0.0, "hello", "Mic 1", None, False, 1), ("s", 2, 1.0, "there", "Line", None, False, 2), ("s", 3, 2.0, " ", "Mute", None, False, 3)]
    df = spark.createDataFrame(rows, schema)
    made = {r["path"].rpartition("/")[2] for r in writers.save_per_source(df, str(tmp_path))}
    assert made == set(os.listdir(tmp_path / "s")) == {"transcript-mic-1.txt", "transcript-line.txt"}
    with pytest.raises(ValueError):
        writers.save_per_source(df.filter("pos = 3"), str(tmp_path))


def test_appending(spark, tmp_path):
    (tmp_path / "s.txt").write_text("cut off")
    for first in (1, 3):
        writers.append(spark.createDataFrame([("s", first + 1, f"line {first + 1}"), ("s", first, f"line {first}")], "session_id string, pos long, line string"), str(tmp_path))
    assert (tmp_path / "s.txt").read_text() == "cut off\nline 1\nline 2\nline 3\nline 4\n"


def test_sweep_table(spark):
    row = dict.fromkeys(("model", "meeting"), "m") | dict.fromkeys("window t_assign t_retire min_pool alpha margin mint_ceiling ref hyp splits merges minted active".split(), 1) | {"miss": 0.12345, "confusion": 1.0, "crowd": float("nan")}
    out = writers.sweep_table(spark.createDataFrame([row]))
    assert out.columns == writers.SWEEP and len(out.columns) == 18
    r = out.first()
    assert (r["miss%"], r["conf%"], r["crowd"]) == ("12.3", "100.0", "NaN")


def test_end_of_a_stream(spark, small):
    """A session's last row releases what is held; the same rows as a fold over the table."""
    events = spark.read.parquet(f"{small}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    last = run.with_last(events, events, ["us", "event_id"]).groupBy("session_id").agg(F.count_if("last").alias("n"), F.max(F.struct("us", "event_id")).alias("m"), F.max(F.when(F.col("last"), F.struct("us", "event_id"))).alias("l"))
    assert last.filter("n <> 1 OR m <> l").count() == 0


def test_embedding_files(spark, tmp_path):
    times, vectors = [(0.0, 1.5), (0.75, 2.25)], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    data = readers.pack_embeddings(times, vectors)
    assert data[:12] == b"DZEM" + struct.pack("<II", 3, 2) and len(data) == 12 + 4 * 2 * 5
    (tmp_path / "good.emb").write_bytes(data)
    (tmp_path / "short.emb").write_bytes(data[:-1])
    (tmp_path / "none.emb").write_bytes(b"RIFF" + bytes(20))
    rows = readers.read_embeddings(spark, str(tmp_path)).collect()
    assert sorted((r["ord"], r["t0"], r["t1"], tuple(r["vector"])) for r in rows if r["error"] is None) == [(0, 0.0, 1.5, (1, 2, 3)), (1, 0.75, 2.25, (4, 5, 6))]
    assert {r["stream_id"] for r in rows if r["error"]} == {"short", "none"}
    with pytest.raises(ValueError):
        readers.pack_embeddings(times, [[1.0], [1.0, 2.0]])


def test_flags_and_cache(spark, tmp_path):
    (tmp_path / "m.vad").write_bytes(b"\0\1\1\0\7")
    flags = readers.read_flags(spark, f"{tmp_path}/m.vad")
    assert [(r["frame"], r["voiced"]) for r in flags.orderBy("frame").collect()] == [(0, False), (1, True), (2, True), (3, False), (4, True)]
    frames = spark.range(9).select(F.lit("m").alias("stream_id"), F.col("id").alias("frame"))
    assert readers.at_frames(frames, flags).count() == 5
    made = []
    build = lambda: made.append(1) or spark.range(3).toDF("x")
    for _ in range(2):
        assert readers.cached(build, spark, f"{tmp_path}/kept", "v1").count() == 3
    assert made == [1] and os.listdir(tmp_path / "kept") == ["v1"]


def test_paths(spark):
    df = spark.createDataFrame([("ES2002a.Mix-Headset.wav", "/m/eres2net.onnx")], "wav string, model string")
    r = df.select(T.resolved(F.col("wav"), "/p/audio"), T.resolved(F.col("model"), "/p"), T.cache_path(F.col("wav"), F.col("model"), 1.5, 0.75, "/p", 2), T.path_key(F.col("wav"))).first()
    assert r[0] == "/p/audio/ES2002a.Mix-Headset.wav" and r[1] == "/m/eres2net.onnx" and r[2] == f"/p/cache/ES2002a.Mix-Headset-{r[3]}.eres2net.w1500h750.v2.emb"


@pytest.fixture(scope="module")
def backwards(tmp_path_factory):
    """A table of embeddings whose rows lie in descending order, and DuckDB's rows for a query over it."""
    path = tmp_path_factory.mktemp("embeddings")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT i AS vec_id, [cos(i * i)::FLOAT, sin(i * i)::FLOAT] AS embedding, CAST(i * 7 % 5 AS INTEGER) AS label FROM range(400) t(i) ORDER BY i DESC) TO '{path}/embeddings.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    return str(path), c


def agrees(spark, backwards, name):
    path, c = backwards
    want = c.execute(f"SELECT * FROM ({ORACLES[name]}) ORDER BY ALL")
    columns = [d[0] for d in want.description]
    return sorted(tuple(r) for r in QUERIES[name](spark, path).select(columns).collect()) == want.fetchall()


def test_gap_decisions_in_any_order(spark, backwards):
    """Hops that share a chunk go by their ids, however the rows arrive."""
    assert agrees(spark, backwards, "gap_decisions")


def test_gap_bridged_in_any_order(spark, backwards):
    assert agrees(spark, backwards, "gap_bridged")


def test_worst_crossings_in_any_order(spark, backwards):
    assert agrees(spark, backwards, "worst_crossings")


def test_equal_crossings_go_by_their_hops(spark):
    rows = [("r", 0.5, 1, 2, 6, 6), ("r", 0.5, 2, 1, 3, 6), ("r", 0.5, 1, 2, 1, 3), ("r", 0.4, 1, 1, 0, 1)]
    for order in (1, -1):
        made = spark.createDataFrame(rows[::order], "recording string, cos double, before int, after int, before_chunk long, after_chunk long").coalesce(1)
        assert [(r["before_chunk"], r["after_chunk"]) for r in V.worst_crossings(made).orderBy("rank").collect()] == [(1, 3), (3, 6), (6, 6)]
