"""Queries over commits, votes and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import attribution as O
from palaver.plans import adapters as A
from palaver.plans.registry import query

LAG, WINDOW = 2, 54

VOTE_SQL = A.CHUNK_SQL + f""",
v0 AS (SELECT c.session_id, c.seq, c.to_chunk, l.chunk, l.speaker, l.provisional, min(CASE WHEN l.boundary AND l.chunk > c.to_chunk THEN l.chunk END) OVER (PARTITION BY c.session_id, c.seq) AS cut
  FROM commits_c c JOIN labels_c l ON c.session_id = l.session_id AND l.chunk BETWEEN c.to_chunk AND c.to_chunk + {LAG}),
v1 AS (SELECT session_id, seq, speaker, count(*) AS n, min(chunk) AS f, bool_and(provisional) AS p FROM v0 WHERE speaker IS NOT NULL AND (cut IS NULL OR chunk < cut) GROUP BY 1, 2, 3),
v2 AS (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY n DESC, f) AS k FROM v1),
em AS (SELECT c.*, v.speaker, coalesce(v.p, false) AS provisional FROM commits_c c LEFT JOIN v2 v ON c.session_id = v.session_id AND c.seq = v.seq AND v.k = 1),
pr AS (SELECT e.session_id, e.seq, r.arrival, r.from_chunk AS r_from, r.to_chunk AS r_to, r.speaker AS r_speaker, row_number() OVER (PARTITION BY e.session_id, e.seq ORDER BY r.arrival, r.from_chunk, r.to_chunk, r.speaker) AS k
  FROM em e JOIN relabels_c r ON e.session_id = r.session_id AND e.from_chunk <= r.to_chunk AND e.to_chunk >= r.from_chunk AND r.from_chunk <= r.to_chunk AND e.to_chunk + {LAG} < r.arrival AND e.to_chunk >= r.arrival + 1 - {WINDOW}
  WHERE e.speaker IS NULL OR (e.provisional AND e.speaker <> r.speaker)),
ch AS (SELECT * FROM pr WHERE k = 1)
"""


def _emitted(spark, sf_dir):
    return O.majority(O.commits(A.texts(spark, sf_dir)), A.chunk_labels(spark, sf_dir), LAG)


@query(f"WITH {A.CHUNK_SQL} SELECT * FROM commits_c")
def commit_spans(spark, sf_dir):
    return O.commits(A.texts(spark, sf_dir))


@query(f"""WITH {A.CHUNK_SQL}, last AS (SELECT session_id, max(chunk) AS m FROM labels_c GROUP BY 1)
SELECT c.session_id, c.seq, c.to_chunk, least(c.to_chunk + {LAG}, m) AS released_at, c.to_chunk + {LAG} > m AS forced FROM commits_c c JOIN last ON c.session_id = last.session_id""")
def lag_release(spark, sf_dir):
    return O.release_chunk(O.commits(A.texts(spark, sf_dir)), A.chunk_labels(spark, sf_dir), LAG).select("session_id", "seq", "to_chunk", "released_at", "forced")


@query(f"WITH {VOTE_SQL} SELECT session_id, seq, speaker, provisional FROM em")
def commit_majority_vote(spark, sf_dir):
    return _emitted(spark, sf_dir).select("session_id", "seq", "speaker", "provisional")


@query(f"WITH {VOTE_SQL} SELECT em.session_id, em.seq, coalesce(ch.r_speaker, em.speaker) AS speaker, em.provisional AND ch.seq IS NULL AS provisional FROM em LEFT JOIN ch ON em.session_id = ch.session_id AND em.seq = ch.seq")
def relabel_server_overlap(spark, sf_dir):
    out, _ = O.relabel(_emitted(spark, sf_dir), A.relabels(spark, sf_dir), WINDOW, LAG)
    return out.select("session_id", "seq", "speaker", "provisional")


@query(f"""WITH {VOTE_SQL}, isl AS (SELECT *, seq - row_number() OVER (PARTITION BY session_id, arrival, r_from, r_to, r_speaker ORDER BY seq) AS i FROM ch)
SELECT session_id, arrival, min(seq) AS from_seq, max(seq) AS to_seq, r_speaker AS speaker FROM isl GROUP BY session_id, arrival, r_from, r_to, r_speaker, i""")
def relabel_messages(spark, sf_dir):
    _, changed = O.relabel(_emitted(spark, sf_dir), A.relabels(spark, sf_dir), WINDOW, LAG)
    return O.messages(changed)


@query(f"""WITH {VOTE_SQL} SELECT r.session_id, r.arrival, count(e.seq) FILTER (e.to_chunk >= r.arrival + 1 - 6) AS in_window, count(e.seq) FILTER (e.to_chunk < r.arrival + 1 - 6) AS expired
FROM relabels_c r LEFT JOIN em e ON e.session_id = r.session_id AND e.from_chunk <= r.to_chunk AND e.to_chunk >= r.from_chunk AND e.to_chunk + {LAG} < r.arrival GROUP BY 1, 2""")
def relabel_window_expiry(spark, sf_dir):
    """With a window of six chunks: commits that a correction still reaches, and those that it comes too late for."""
    emitted, relabels = _emitted(spark, sf_dir), A.relabels(spark, sf_dir)
    all_ = O.reach(emitted, relabels, 1 << 40, LAG).withColumn("late", F.col("to_chunk") < F.col("arrival") + 1 - 6)
    n = all_.groupBy("session_id", "arrival").agg(F.count_if(~F.col("late")).alias("in_window"), F.count_if("late").alias("expired"))
    return relabels.select("session_id", "arrival").join(n, ["session_id", "arrival"], "left").fillna(0, ["in_window", "expired"])
