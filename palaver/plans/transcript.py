"""Queries over transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import transcript as O
from palaver.plans import adapters as A
from palaver.plans.registry import query

TURN_SQL = """,
sw AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR source IS DISTINCT FROM lag(source) OVER o THEN 1 ELSE 0 END AS switch FROM seg WINDOW o AS (PARTITION BY session_id ORDER BY pos)),
rn AS (SELECT *, sum(switch) OVER (PARTITION BY session_id ORDER BY pos) AS run FROM sw),
ls AS (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY session_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_speaker FROM rn),
tn AS (SELECT *, sum(CASE WHEN switch = 1 OR (speaker IS NOT NULL AND speaker IS DISTINCT FROM last_speaker) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS turn FROM ls),
tu AS (SELECT session_id, CAST(turn AS BIGINT) AS turn, arg_min(speaker, pos) FILTER (pos = p0) AS speaker, min(source) AS source, min(pos) AS first_pos, count(*) AS n_segments, string_agg(text, '' ORDER BY pos) AS text
  FROM (SELECT *, min(pos) OVER (PARTITION BY session_id, turn) AS p0 FROM tn) GROUP BY session_id, turn),
tw AS (SELECT tn.*, tu.speaker AS turn_speaker FROM tn JOIN tu ON tn.session_id = tu.session_id AND tn.turn = tu.turn),
ln AS (SELECT *, sum(brk) OVER (PARTITION BY session_id, turn ORDER BY pos) AS line FROM (SELECT *, CASE WHEN at_s - lag(at_s) OVER (PARTITION BY session_id, turn ORDER BY pos) < 300 THEN 0 ELSE 1 END AS brk FROM tw))
"""
STAMP_SQL = "CASE WHEN {0} >= 3600 THEN printf('[%02d:%02d:%02d]', CAST(floor({0}) AS BIGINT) // 3600, CAST(floor({0}) AS BIGINT) % 3600 // 60, CAST(floor({0}) AS BIGINT) % 60) ELSE printf('[%02d:%02d]', CAST(floor(greatest({0}, 0)) AS BIGINT) // 60, CAST(floor(greatest({0}, 0)) AS BIGINT) % 60) END"
PREFIX_SQL = "coalesce('Speaker ' || CAST({0} AS VARCHAR) || ': ', '')"
SLUG_SQL = "substr(regexp_replace(lower(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g'), 1, 40)"


@query(f"WITH {A.SEG_SQL}{TURN_SQL} SELECT * FROM tu")
def turns_by_speaker(spark, sf_dir):
    return O.turns(A.segments(spark, sf_dir))


@query(f"""WITH {A.SEG_SQL}{TURN_SQL} SELECT session_id, CAST(turn AS BIGINT) AS turn, CAST(line AS BIGINT) AS line, min(at_s) AS "at", count(*) AS n_segments, string_agg(text, '' ORDER BY pos) AS text FROM ln GROUP BY session_id, turn, line""")
def lines_by_silence(spark, sf_dir):
    rows = O.lines(A.segments(spark, sf_dir), A.GAP)
    return rows.groupBy("session_id", "turn", "line").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n_segments"), O.joined(F.col("text")).alias("text"))


@query(f"WITH {A.SEG_SQL}{TURN_SQL} SELECT session_id, trim(string_agg({PREFIX_SQL.format('speaker')} || text, chr(10) ORDER BY turn)) AS body FROM tu GROUP BY session_id")
def render_plain(spark, sf_dir):
    return O.render(A.segments(spark, sf_dir), O.PLAIN)


def _stamped_sql(source: str) -> str:
    return f"""WITH {A.SEG_SQL}{TURN_SQL},
li AS (SELECT session_id, turn, line, min(pos) AS o, arg_min(at_s, pos) AS at_s, arg_min(source, pos) AS source, any_value(turn_speaker) AS sp, string_agg(text, '' ORDER BY pos) AS t FROM ln GROUP BY session_id, turn, line)
SELECT session_id, string_agg({STAMP_SQL.format('at_s')} || ' ' || {source} || {PREFIX_SQL.format('sp')} || t, chr(10) ORDER BY o) AS body FROM li GROUP BY session_id"""


@query(_stamped_sql("''"))
def render_timestamped(spark, sf_dir):
    return O.render(A.segments(spark, sf_dir), O.TIMESTAMPED, A.GAP)


@query(_stamped_sql("'[' || source || '] '"))
def render_labelled(spark, sf_dir):
    return O.render(A.segments(spark, sf_dir), O.LABELLED, A.GAP)


@query(f"""WITH {A.SEG_SQL.replace("'src' || CAST(((pos - 1) // 20) % 3 AS VARCHAR) AS source", "NULL AS source")}
SELECT session_id, string_agg({STAMP_SQL.format('at_s')} || ' ' || text, chr(10) ORDER BY pos) AS body FROM seg WHERE speaker IS NULL GROUP BY session_id""")
def render_unlabelled(spark, sf_dir):
    return O.render(A.segments(spark, sf_dir).filter("speaker IS NULL"), O.TIMESTAMPED, A.GAP)


@query(f"""WITH {A.SEG_SQL} SELECT session_id, user_source AS source, pos, at_s AS "at", text, row_number() OVER (PARTITION BY session_id ORDER BY at_s, user_source, pos) AS merged_pos FROM seg""")
def merge_sources(spark, sf_dir):
    seg = A.segments(spark, sf_dir, interleaved=True)
    return O.merge_sources([seg.filter(F.col("source") == f"src{i}") for i in range(3)]).select("session_id", "source", "pos", "at", "text", "merged_pos")


@query(f"""WITH {A.SEG_SQL.replace("'src' || CAST(((pos - 1) // 20) % 3 AS VARCHAR) AS source", "'src' || CAST(user_id % 3 AS VARCHAR) AS source")},
by_src AS (SELECT session_id AS sid, session_id || '/' || source AS session_id, * EXCLUDE (session_id) FROM seg)
{TURN_SQL.replace("FROM seg", "FROM by_src")},
bodies AS (SELECT session_id, source, min(first_pos) AS f, trim(string_agg({PREFIX_SQL.format('speaker')} || text, chr(10) ORDER BY turn)) AS body FROM tu GROUP BY session_id, source)
SELECT split_part(session_id, '/', 1) AS session_id, row_number() OVER (PARTITION BY split_part(session_id, '/', 1) ORDER BY f) AS ord, source, '/tmp/meeting-' || source || '.txt' AS path, body FROM bodies""")
def split_by_source(spark, sf_dir):
    return O.by_source(A.segments(spark, sf_dir, interleaved=True), F.lit("/tmp/meeting.txt"))


@query("""SELECT conv_id, turn, length(text) AS n FROM conversations WHERE regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''""")
def segment_blank_filter(spark, sf_dir):
    rows = A.table(spark, sf_dir, "conversations")
    return rows.filter(~T.is_blank(F.col("text"))).select("conv_id", "turn", F.char_length("text").cast("bigint").alias("n"))


@query(f"SELECT DISTINCT p_name, {SLUG_SQL.format('p_name')} AS slug, '/a/notes-' || {SLUG_SQL.format('p_name')} || '.txt' AS path FROM part")
def slug_text(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_name", T.slug(F.col("p_name")).alias("slug"), T.path_for_source(F.lit("/a/notes"), F.col("p_name")).alias("path")).distinct()


@query(f"SELECT event_id, {STAMP_SQL.format('value * 20')} AS stamp FROM events")
def stamp_seconds(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", T.stamp(F.col("value") * 20).alias("stamp"))


@query("""SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y-%m-%d') <> '1995-03-15' THEN '/m/1995-03-15_10-00-00.txt' ELSE '/m/' || strftime(o_orderdate, '%Y-%m-%d') || '_09-30-00.txt' END AS path, '/m/notes.txt' AS other FROM orders""")
def restamp_names(spark, sf_dir):
    now, old = F.lit("1995-03-15_10-00-00"), F.concat(F.lit("/m/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_09-30-00.txt"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", T.restamped(old, now).alias("path"), T.restamped(F.lit("/m/notes.txt"), now).alias("other"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN left(p_name, 11) || '…' ELSE p_name END AS label FROM part""")
def truncate_label(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", T.truncate(F.col("p_name"), 12).alias("label"))


@query(f"""WITH {A.SEG_SQL},
c AS (SELECT session_id, pos AS arrival, greatest(pos - 6, 1) AS f, pos - 1 AS t, CAST(user_id % 3 + 1 AS INTEGER) AS new FROM seg WHERE event_type = 'signup'),
hit AS (SELECT s.session_id, s.pos, arg_min(c.new, c.arrival) AS new FROM seg s JOIN c ON s.session_id = c.session_id AND s.seq BETWEEN c.f AND c.t AND (s.speaker IS NULL OR s.provisional) AND s.speaker IS DISTINCT FROM c.new GROUP BY 1, 2)
SELECT s.session_id, s.pos, coalesce(h.new, s.speaker) AS speaker, s.provisional AND h.new IS NULL AS provisional FROM seg s LEFT JOIN hit h ON s.session_id = h.session_id AND s.pos = h.pos""")
def relabel_client(spark, sf_dir):
    seg = A.segments(spark, sf_dir)
    corrections = seg.filter("event_type = 'signup'").select("session_id", F.col("pos").alias("arrival"), F.greatest(F.col("pos") - 6, F.lit(1)).alias("from_seq"), (F.col("pos") - 1).alias("to_seq"), (F.col("user_id") % 3 + 1).cast("int").alias("speaker"))
    return O.relabel(seg, corrections).select("session_id", "pos", "speaker", "provisional")


@query("""SELECT doc_id, substr(text, 41) AS rest, left(text, greatest(length(text) - 10, 0)) || ' end' AS revised FROM documents""")
def text_delta(spark, sf_dir):
    """What a reader that has taken 40 characters of each document is given next, and a retracted text."""
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.delta(F.col("text"), F.lit(40)).alias("rest"), T.retract(F.col("text"), F.lit(10), F.lit(" end")).alias("revised"))


@query("""SELECT session_id, bool_or(event_type = 'click') AS recording, arg_min(event_type, us) FILTER (event_type = 'error') AS error, sum(user_id) AS changes,
string_agg(event_type, chr(10) ORDER BY us) FILTER (event_type <> 'view') AS transcript
FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS session_id, epoch_us(ts) AS us FROM events) GROUP BY session_id""")
def merge_states(spark, sf_dir):
    events = A.table(spark, sf_dir, "events")
    states = events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id").alias("ord"), (F.col("event_type") == "click").alias("recording"),
        F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("transcript"), F.col("user_id").alias("changes"),
    )
    return O.merge_states(states).withColumn("transcript", F.nullif("transcript", F.lit("")))  # SQL joins no text to null
