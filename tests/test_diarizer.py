import numpy as np
import pytest

from palaver.operators.windows import FRAME
from palaver.streaming import diarizer as D

CHUNK = 16 * FRAME


def voice(kind, n):
    """Chunks of a voice: its number is in the samples, silence is 0."""
    return [np.full(CHUNK, 0.2 + kind / 10 if kind else 0.0) for _ in range(n)]


def embed(audio):
    v = np.zeros(8)
    for kind in (1, 2, 3):
        v[kind] = np.sum(np.abs(audio - (0.2 + kind / 10)) < 0.01)
    return v


def play(chunks, **k):
    d = D.Diarizer(embed, **k)
    return d, [d.push(c) for c in chunks]


def test_one_voice_is_minted_and_corrected_back():
    d, out = play(voice(1, 14))
    assert d.clusterer.labels == [1] and out[-1]["speaker"] == 1 and not out[-1]["provisional"]
    first = [r for o in out for r in o["relabels"]]
    assert first and first[0][0] == 1 and first[0][2] == 1  # reaches back to the first hop
    assert all(o["speaker"] is None for o in out[:5])


def test_change_of_voice_is_a_boundary():
    _, out = play(voice(1, 16) + voice(2, 16))
    bounds = [i for i, o in enumerate(out) if o["boundary"]]
    assert bounds and 16 <= bounds[0] <= 19 and out[-1]["speaker"] == 2
    back = [r for o in out for r in o["relabels"] if r[2] == 2]
    assert back and back[0][0] >= bounds[0]  # no correction across the boundary
    _, off = play(voice(1, 16) + voice(2, 16), t_change=0.0)
    assert not any(o["boundary"] for o in off)


def test_silence_has_no_speaker_and_restarts_windows():
    _, out = play(voice(1, 14) + voice(0, 4) + voice(1, 4))
    assert out[16]["speaker"] is None and out[-1]["speaker"] == 1


def test_failures_latch():
    def broken(audio):
        raise ValueError("no")

    d = D.Diarizer(broken)
    kinds = []
    for c in voice(1, 12):
        try:
            d.push(c)
        except D.OutOfService:
            kinds.append("out")
        except ValueError:
            kinds.append("failed")
    assert kinds[:3] == ["failed"] * 3 and kinds[-1] == "out"
    with pytest.raises(ValueError, match="shorter than a hop"):
        D.Diarizer(embed).push(np.zeros(FRAME * 23))


def test_refractory():
    p = D.Pieces()
    for i in range(23):
        p.add(i, np.zeros(FRAME))
    assert not p.cut()
    p.add(23, np.zeros(FRAME))
    assert p.cut() and len(p.window) == 23 and not p.cut()


def test_streams_apart(spark):
    rows = [(s, i, c.tolist()) for s, chunks in (("a", voice(1, 12) + voice(2, 12)), ("b", voice(3, 10))) for i, c in enumerate(chunks)]
    df = spark.createDataFrame(rows, "stream_id string, chunk bigint, samples array<double>")
    got = {(r["stream_id"], r["chunk"]): r for r in D.attribute(df, embed).collect()}
    assert len(got) == 34 and got["b", 9]["speaker"] == 1 and got["a", 23]["speaker"] == 2
    assert got["a", 1]["speaker"] is None and got["a", 1]["corrected"] == 1  # corrected in the end
