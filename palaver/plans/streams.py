"""Queries that run as streams over the events' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.plans import adapters as A
from palaver.plans.attribution import LAG, VOTE_SQL, WINDOW
from palaver.plans.registry import query
from palaver.plans.transcript import TURN_SQL
from palaver.streaming import folds, run

SPEAKERS = {"click": 1, "purchase": 2, "view": 3}
ORDER = ["us", "event_id"]


def _events(spark, sf_dir):
    # a pattern, so that a table in one file is a stream as well
    return run.with_last(_told(run.read_events(spark, f"{sf_dir}/events.parquet*")), _told(A.table(spark, sf_dir, "events")), ORDER)


def _told(rows):
    return rows.select(F.date_format("ts", "yyyy-MM-dd").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "user_id", "event_type", "value")


def chunk_of(fold: folds.Attribution, e: dict) -> dict:
    """An event as a chunk: the adapters' rules, with the position from the state."""
    pos, speaker = fold.chunks + 1, SPEAKERS.get(e["event_type"])
    relabels = [(max(pos - 7, 0), pos - 2, e["user_id"] % 3 + 1)] if e["event_type"] == "signup" and pos - 2 >= max(pos - 7, 0) else []
    return {"text": e["event_type"] if pos % 3 == 0 else "", "speaker": speaker, "provisional": speaker is not None and e["value"] < 50, "boundary": e["event_type"] == "error", "relabels": relabels, "last": e["last"]}


def segment_of(fold: folds.Lines, e: dict) -> dict:
    return {"pos": e["event_id"], "source": None, "speaker": SPEAKERS.get(e["event_type"]), "at": e["us"] / 1e6, "text": e["event_type"]}


def _attributed(spark, sf_dir):
    return run.drain(folds.in_stream(_events(spark, sf_dir), folds.Attribution(LAG, WINDOW), ORDER, chunk_of), "commits")


@query(f"WITH {VOTE_SQL} SELECT session_id, seq, text, from_chunk, to_chunk, speaker, provisional FROM em")
def stream_commits(spark, sf_dir):
    """Commits as they are released; a session's end releases those still held."""
    return _attributed(spark, sf_dir).filter("kind = 'commit'").select("session_id", "seq", "text", "from_chunk", "to_chunk", "speaker", "provisional")


@query(f"""WITH {VOTE_SQL}, isl AS (SELECT *, seq - row_number() OVER (PARTITION BY session_id, arrival, r_from, r_to, r_speaker ORDER BY seq) AS i FROM ch)
SELECT session_id, arrival, min(seq) AS from_seq, max(seq) AS to_seq, r_speaker AS speaker FROM isl GROUP BY session_id, arrival, r_from, r_to, r_speaker, i""")
def stream_relabel(spark, sf_dir):
    return _attributed(spark, sf_dir).filter("kind = 'relabel'").select("session_id", "arrival", "from_seq", "to_seq", "speaker")


ONE_SOURCE_SQL = A.SEG_SQL.replace("'src' || CAST(((pos - 1) // 20) % 3 AS VARCHAR) AS source", "CAST(NULL AS VARCHAR) AS source")


@query(f"WITH {ONE_SOURCE_SQL}{TURN_SQL} SELECT session_id, CAST(turn AS BIGINT) AS turn, CAST(line AS BIGINT) AS line, turn_speaker, count(*) AS n FROM ln GROUP BY ALL")
def stream_turns(spark, sf_dir):
    """Segments per turn and line of sessions with one source, as they arrive."""
    made = run.drain(folds.in_stream(_events(spark, sf_dir), folds.Lines(A.GAP), ORDER, segment_of), "turns")
    return made.groupBy("session_id", "turn", "line", "turn_speaker").agg(F.count(F.lit(1)).alias("n"))
