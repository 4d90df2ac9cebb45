import numpy as np

from palaver.operators import attribution as O
from palaver.operators import clusterer as C
from palaver.operators import windows as W
from palaver.streaming import folds, run


def chunk(speaker=None, text="", provisional=False, boundary=False, relabels=(), last=False):
    return {"speaker": speaker, "text": text, "provisional": provisional, "boundary": boundary, "relabels": list(relabels), "last": last}


def play(fold, *rows):
    return [m for r in rows for m in fold.step(r)]


def test_votes():
    commits = lambda *rows: [(m["speaker"], m["provisional"]) for m in play(folds.Attribution(), *rows) if m["kind"] == "commit"]
    assert commits(chunk(1, "a"), chunk(2), chunk(2)) == [(2, False)]
    assert commits(chunk(1, "a"), chunk(2), chunk(None)) == [(1, False)]
    assert commits(chunk(1, "a"), chunk(2, boundary=True), chunk(2)) == [(1, False)]
    assert commits(chunk(1, "a", True), chunk(1, "", True), chunk(None)) == [(1, True)]
    assert commits(chunk(1, "a"), chunk(2)) == []
    assert commits(chunk(1, "a"), chunk(2, last=True)) == [(1, False)]


def test_corrections():
    relabels = lambda fold, *rows: [(m["from_seq"], m["to_seq"], m["speaker"]) for m in play(fold, *rows) if m["kind"] == "relabel"]
    none = folds.Attribution(lag=0)
    assert relabels(none, chunk(), chunk(None, "a"), chunk(None, "b"), chunk(relabels=[(0, 2, 1)])) == [(1, 2, 1)]
    guesses = folds.Attribution(lag=0)
    assert relabels(guesses, chunk(2, "a", True), chunk(2, "b", True), chunk(relabels=[(0, 2, 1)])) == [(1, 2, 1)]
    agree = folds.Attribution(lag=0)
    assert relabels(agree, chunk(1, "a", True), chunk(relabels=[(0, 2, 1)])) == []
    around = folds.Attribution(lag=0)
    assert relabels(around, chunk(None, "a"), chunk(2, "b"), chunk(None, "c"), chunk(relabels=[(0, 3, 1)])) == [(1, 1, 1), (3, 3, 1)]
    late = folds.Attribution(lag=0, window=3)
    assert relabels(late, *(chunk(None, "x") for _ in range(4)), chunk(relabels=[(0, 4, 1)])) == [(3, 4, 1)]
    off = folds.Attribution(lag=0, window=0)
    assert relabels(off, chunk(None, "x"), chunk(relabels=[(0, 4, 1)])) == []


def test_reader():
    t = folds.Transcript()
    row = lambda **k: {"type": None, "seq": None, "text": None, "speaker": None, "speaker_provisional": None, "retract_n": None, "from_seq": None, "to_seq": None} | k
    play(t, row(type="transcript.commit", seq=1, text="hello ", speaker=2), row(type="transcript.commit", seq=2, text="wörld"), row(type="transcript.commit", seq=3, text="!", speaker=3, speaker_provisional=True))
    play(t, row(type="transcript.relabel", from_seq=1, to_seq=3, speaker=1))
    assert [s[2] for s in t.segments] == [2, 1, 1]
    play(t, row(type="transcript.revise", retract_n=3, text="ks"))
    assert t.text == "hello wörks" and [s[0] for s in t.segments] == [1, None]


def test_strikes():
    s = folds.Strikes(most=2)
    assert [r["dropped"] for r in play(s, *({"pos": i, "failed": f} for i, f in enumerate((True, False, True, True, False))))] == [False, False, False, True, True]


def test_gate(spark):
    voiced = lambda *p: [r["voiced"] for r in W.gate(spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(p)], "stream_id string, frame bigint, prob double")).orderBy("frame").collect()]
    assert voiced(0.4) == [False]
    assert voiced(0.9, 0.4) == [True, True]
    assert voiced(0.9, 0, 0, 0, 0, 0, 0.4) == [True] * 5 + [False, False]
    assert voiced(0.0, 0.0, 0.9, 0.0) == [False, False, True, True]


def test_windows(spark):
    def made(n, skip=0):
        rows = [("s", i + (skip if i >= 30 else 0), True) for i in range(n)]
        return spark.createDataFrame(rows, "stream_id string, frame bigint, voiced boolean")

    assert W.windows(made(46)).count() == 0 and W.windows(made(47)).count() == 1 and W.windows(made(70)).count() == 2
    assert W.hops(made(22)).count() == 0 and W.hops(made(23)).count() == 1
    assert W.windows(made(60, 15)).count() == 0 and W.windows(made(60, 14)).count() == 1


def voices(n, each, noise, seed=1):
    rng = np.random.default_rng(seed)
    basis = np.eye(max(64, n))[:n]
    order = [i for i in range(n) for _ in range(each)]
    return order, [basis[i] + noise * rng.standard_normal(basis.shape[1]) for i in order]


def test_clusterer():
    for n in (8, 12):
        _, v = voices(n, 8, 0.02)
        c = C.Clusterer()
        heard = [c.observe(x) for x in v]
        assert len(c.labels) == n and heard[-1] == (n, "settled")
    _, v = voices(1, 60, 0.05)
    c = C.Clusterer()
    for x in v:
        c.observe(x)
    assert len(c.labels) == 1 and c.observe_short(v[0]) == 1
    assert c.observe(np.full(64, np.nan))[1] == "unknown"


def test_stands_out():
    t = C.Tuning()
    out = lambda *s: C.stands_out(np.array(s, float), t, t.margin)
    assert out() is None and out(0.5) == 0 and out(0.4) is None
    assert out(0.6, 0.55) is None and out(0.6, 0.6) is None and out(0.8, 0.6) == 0
    assert out(0.9, 0.1, 0.1, 0.1) == 0 and out(0.6, 0.45, 0.3, 0.0) is None
    assert out(float("nan"), 0.9) is None


def test_batch_is_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    at = np.cumsum(rng.random(90) * 2)
    maybe = lambda share, made: None if rng.random() < share else made()
    rows = [(f"s{i % 3}", i, maybe(0.2, lambda: f"m{rng.integers(2)}"), maybe(0.4, lambda: int(rng.integers(1, 4))), float(at[i]), " " if rng.random() < 0.1 else " x") for i in range(90)]
    schema = "session_id string, pos bigint, source string, speaker int, at double, text string"
    for i in range(3):  # each file a batch of its own
        spark.createDataFrame(rows[i * 30 : i * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    fold = folds.Lines(1.5)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, run.drain(folds.in_stream(stream, fold, ["pos"]), "lines").select("session_id", "pos", "turn", "line", "turn_speaker").collect()), key=repr)
    batch = folds.in_batch(spark.read.parquet(str(tmp_path / "in")), fold, ["pos"])
    assert got == sorted(map(tuple, batch.select("session_id", "pos", "turn", "line", "turn_speaker").collect()), key=repr) and len(got) > 60
    # and the same as the windows over a table
    from palaver.operators import transcript

    table = spark.read.parquet(str(tmp_path / "in")).filter("trim(text) <> ''")
    want = transcript.lines(table).select("session_id", "pos", "turn", "line", "turn_speaker")
    assert got == sorted(map(tuple, want.collect()), key=repr)


def test_expiry(spark):
    assert O.window_chunks(30.0) == 54 and O.window_chunks(0) == 0
    emitted = spark.createDataFrame([("s", i + 1, i, i, None, False) for i in range(6)], "session_id string, seq bigint, from_chunk bigint, to_chunk bigint, speaker int, provisional boolean")
    r = spark.createDataFrame([("s", 5, 0, 5, 1)], "session_id string, arrival bigint, from_chunk bigint, to_chunk bigint, speaker int")
    assert sorted(x["seq"] for x in O.reach(emitted, r, 3, 0).collect()) == [4, 5]
    assert O.reach(emitted, r, 0, 0).count() == 0
