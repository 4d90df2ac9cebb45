import duckdb
from pyspark.sql import functions as F

from palaver import schemas
from palaver.functions import text as T
from palaver.operators import transcript as O
from palaver.plans.catalog import ORACLES, QUERIES


def segs(spark, *rows):
    """(at, text, source, speaker[, provisional])"""
    return spark.createDataFrame([("s", i, float(r[0]), r[1], r[2], r[3], bool(r[4]) if len(r) > 4 else False, i + 1) for i, r in enumerate(rows)], schemas.SEGMENT)


def body(spark, layout, *rows, **k):
    found = O.render(segs(spark, *rows), layout, **k).collect()
    return found[0]["body"] if found else ""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_turns(spark):
    n = lambda *rows: [(r["speaker"], r["n_segments"]) for r in O.turns(segs(spark, *rows)).orderBy("turn").collect()]
    assert n((0, "a", None, 1), (1, "b", None, None), (2, "c", None, 2)) == [(1, 2), (2, 1)]
    assert n((0, "a", None, None), (1, "b", None, None)) == [(None, 2)]
    assert n((0, "a", "Mic", 1), (1, "b", "Sys", None), (2, "c", "Sys", 1)) == [(1, 1), (None, 1), (1, 1)]
    assert n((0, "a", "Mic", 1), (1, "b", "Sys", 1)) == [(1, 1), (1, 1)]


def test_render(spark):
    assert body(spark, O.PLAIN, (0, " a", None, 1), (1, " b ", None, 2)) == "Speaker 1:  a\nSpeaker 2:  b"
    assert body(spark, O.TIMESTAMPED, (0, " a ", None, None), (0.6, "b", None, None), (0.7, "  ", None, None)) == "[00:00] a\n[00:00] b"
    got = body(spark, O.TIMESTAMPED, (0, "w", None, None), (65, "x", None, 1), (130, "y", None, 1), (200, "z", None, None))
    assert got.split("\n") == ["[00:00] w", "[01:05] Speaker 1: x", "[02:10] Speaker 1: y", "[03:20] Speaker 1: z"]
    assert body(spark, O.LABELLED, (0, "hello", "System audio", 2)) == "[00:00] [System audio] Speaker 2: hello"
    assert body(spark, O.TIMESTAMPED, (0, " fox j", None, 1), (1, "umps over the", None, 1), (2, " lazy dog ", None, None)) == "[00:00] Speaker 1: fox jumps over the lazy dog "
    # a silence of exactly the gap breaks
    assert len(body(spark, O.TIMESTAMPED, (0, "a", None, 1), (1.5, "b", None, 1)).split("\n")) == 2
    assert body(spark, O.PLAIN) == ""


def test_blank_segments_do_not_make_turns(spark):
    assert body(spark, O.TIMESTAMPED, (0, "a", None, 1), (0.5, " ", None, 2), (0.6, "b", None, 1)) == "[00:00] Speaker 1: ab"


def test_text_functions(spark):
    t = lambda f, *a: one(spark, f(*(F.lit(x) for x in a)))
    assert [t(T.stamp, x) for x in (0.0, 65.0, 3661.0, -5.0, 360000.0)] == ["[00:00]", "[01:05]", "[01:01:01]", "[00:00]", "[100:00:00]"]
    assert t(T.slug, "Yeti (RNNoise)") == "yeti-rnnoise"
    assert t(T.slug, "Firefox — YouTube") == "firefox-youtube"
    assert t(T.slug, "x" * 200) == "x" * 40
    assert t(T.slug, "a" * 39 + " b") == "a" * 39 + "-"
    assert t(T.path_for_source, "/tmp/meeting.txt", "Yeti (RNNoise)") == "/tmp/meeting-yeti-rnnoise.txt"
    assert t(T.path_for_source, "notes", "mic") == "notes-mic.txt"
    now = "2026-08-27_09-00-00"
    assert t(T.restamped, "/m/2026-08-20_10-00-00.txt", now) == f"/m/{now}.txt"
    for same in ("/m/2026-08-27_10-00-00.txt", "notes.txt", "/", ""):
        assert t(T.restamped, same, now) == same
    assert one(spark, T.truncate(F.lit("abcdef"), 4)) == "abc…"
    assert t(T.retract, "hello", 3, "y") == "hey" and t(T.retract, "ab", 9, "c") == "c"
    assert one(spark, T.bars(F.array(*(F.lit(x) for x in (0.0, 0.5, 1.0, 2.0))))) == " ▄██"


def test_path_key(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for c in b:
            h = (h ^ c) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    for s in ("", "a", "/tmp/meeting.wav", "ünï" * 20):
        assert one(spark, T.path_key(F.lit(s))) == fnv(s.encode())


def test_relabel_by_reader(spark):
    rows = segs(spark, (0, "a", None, 2), (1, "b", None, None), (2, "c", None, 3, True))
    c = spark.createDataFrame([("s", 1, 1, 3, 1), ("s", 2, 1, 3, 2)], "session_id string, arrival bigint, from_seq bigint, to_seq bigint, speaker int")
    got = [(r["speaker"], r["provisional"]) for r in O.relabel(rows, c).orderBy("pos").collect()]
    assert got == [(2, False), (1, False), (1, False)]


def test_by_source_skips_the_silent(spark):
    rows = segs(spark, (0, "a", "Mic", 1), (1, " ", "Sys", None), (2, "b", None, None))
    got = [(r["ord"], r["source"], r["path"]) for r in O.by_source(rows, F.lit("/x/n.txt")).orderBy("ord").collect()]
    assert got == [(1, "Mic", "/x/n-mic.txt"), (2, "transcript", "/x/n-transcript.txt")]


def test_merge_states_at_one_time(spark, tmp_path):
    """Events of one microsecond go by their ids; a session without text has none."""
    c = duckdb.connect()
    c.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(i // 30 AS INTEGER)) AS ts, i AS user_id, CASE WHEN i >= 60 THEN 'view' ELSE ['view', 'signup', 'click', 'purchase', 'error'][i * 7 % 5 + 1] END AS event_type FROM range(70) t(i)")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = c.execute(f"SELECT session_id, recording, error, CAST(changes AS BIGINT), transcript FROM ({ORACLES['merge_states']}) ORDER BY 1").fetchall()
    got = QUERIES["merge_states"](spark, str(tmp_path)).select("session_id", "recording", "error", "changes", "transcript").orderBy("session_id").collect()
    assert [tuple(r) for r in got] == want and want[2][4] is None
