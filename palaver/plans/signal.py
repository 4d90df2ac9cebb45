"""Queries over audio, devices and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import signal as S
from palaver.functions import text as T
from palaver.operators import clusterer as C
from palaver.operators import devices as D
from palaver.operators import messages as M
from palaver.operators import mixer as X
from palaver.plans import adapters as A
from palaver.plans.registry import query
from palaver.plans.vectors import _vectors

SAMPLE = "greatest(least((value - 250) / 250, 1), -1)"
SAMPLE_SQL = A.SEG_SQL + f", smp AS (SELECT session_id, pos - 1 AS i, user_source AS source, {SAMPLE} AS x FROM seg), cnt AS (SELECT session_id, count(*) AS n FROM smp GROUP BY 1)"


def _samples(spark, sf_dir, *keys: str):
    """An array of samples per session (and further keys), in order."""
    seg = A.segments(spark, sf_dir, interleaved=True)
    items = F.array_sort(F.collect_list(F.struct("pos", F.expr(SAMPLE).alias("x"))))
    return seg.groupBy("session_id", *keys).agg(F.transform(items, lambda v: v["x"]).alias("samples"))


def _rows(frame, digits: int = 6):
    return frame.select("session_id", F.posexplode("out").alias("i", "x")).withColumn("x", F.round("x", digits) + F.lit(0.0))


@query(f"WITH {SAMPLE_SQL} SELECT session_id, CAST(i // 2 AS INTEGER) AS i, round((sum(x)) / 2, 6) + 0.0 AS x FROM smp GROUP BY 1, 2 HAVING count(*) = 2")
def downmix_mean(spark, sf_dir):
    return _rows(_samples(spark, sf_dir).select("session_id", S.downmix(F.col("samples"), 2).alias("out")))


@query(f"WITH {SAMPLE_SQL} SELECT session_id, CAST(i // 3 AS INTEGER) AS i, round(sum(x) / 3, 6) + 0.0 AS x FROM smp GROUP BY 1, 2 HAVING count(*) = 3")
def box_resample(spark, sf_dir):
    return _rows(_samples(spark, sf_dir).select("session_id", S.resample(F.col("samples"), 48_000).alias("out")))


@query(f"""WITH {SAMPLE_SQL}, o AS (SELECT session_id, k, k * 2.75625::DOUBLE AS place FROM cnt, LATERAL (SELECT unnest(range(0, CAST(floor(n / 2.75625::DOUBLE) AS BIGINT))) AS k) t)
SELECT o.session_id, CAST(k AS INTEGER) AS i, round(a.x + (coalesce(b.x, a.x) - a.x) * (place - floor(place)), 9) + 0.0 AS x FROM o JOIN smp a ON a.session_id = o.session_id AND a.i = CAST(floor(place) AS BIGINT) LEFT JOIN smp b ON b.session_id = o.session_id AND b.i = CAST(floor(place) AS BIGINT) + 1""")
def linear_resample(spark, sf_dir):
    return _rows(_samples(spark, sf_dir).select("session_id", S.resample(F.col("samples"), 44_100).alias("out")), 9)


@query(f"""WITH {SAMPLE_SQL}, r AS (SELECT session_id, source, sqrt(avg(x * x)) AS r FROM smp GROUP BY 1, 2)
SELECT session_id, source, round(r, 6) AS rms, round(CASE WHEN r <= 1e-9 THEN 0.0 ELSE least(greatest((20 * log10(r) + 60) / 60, 0.0), 1.0) END, 6) AS level FROM r""")
def rms_by_source(spark, sf_dir):
    r = _samples(spark, sf_dir, "source").withColumn("r", S.rms(F.col("samples")))
    return r.select("session_id", "source", F.round("r", 6).alias("rms"), F.round(S.display(F.col("r")), 6).alias("level"))


@query(f"""WITH {SAMPLE_SQL}, s AS (SELECT session_id, source, x, row_number() OVER (PARTITION BY session_id, source ORDER BY i) - 1 AS k FROM smp),
l AS (SELECT session_id, min(n) AS n, count(*) AS live FROM (SELECT session_id, source, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT s.session_id, CAST(k AS INTEGER) AS i, round(sum(x) / max(live), 6) + 0.0 AS x FROM s JOIN l ON s.session_id = l.session_id WHERE k < n GROUP BY 1, 2""")
def mix_live(spark, sf_dir):
    return _rows(X.mix_streams(_samples(spark, sf_dir, "source")).withColumnRenamed("samples", "out"))


@query(f"""WITH {SAMPLE_SQL}, p AS (SELECT session_id, source, i, i // 16 AS tick, x FROM smp), q AS (SELECT *, row_number() OVER (PARTITION BY session_id, tick, source ORDER BY i) - 1 AS k FROM p),
lv AS (SELECT session_id, count(DISTINCT source) AS live, max(tick) AS m FROM p GROUP BY 1), s AS (SELECT session_id, tick, k, sum(x) AS x FROM q WHERE k < 8 GROUP BY 1, 2, 3),
g AS (SELECT session_id, live, tick, k FROM lv, LATERAL (SELECT unnest(range(0, m + 1)) AS tick) a, range(8) b(k))
SELECT g.session_id, g.tick, CAST(g.k AS INTEGER) AS i, round(coalesce(s.x, 0) / live, 6) + 0.0 AS x FROM g LEFT JOIN s ON s.session_id = g.session_id AND s.tick = g.tick AND s.k = g.k""")
def mix_clock(spark, sf_dir):
    seg = A.segments(spark, sf_dir, interleaved=True)
    pieces = seg.select("session_id", "source", (F.col("pos") - 1).alias("at_ms"), F.array(F.expr(SAMPLE)).alias("samples"))
    return X.mix_clock(pieces, 16, 8).select("session_id", "tick", F.posexplode("samples").alias("i", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(f"SELECT event_id, CAST(trunc({SAMPLE} * 32767) AS SMALLINT) AS s16, trunc({SAMPLE} * 32767) / 32768 AS back FROM events")
def pcm_roundtrip(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select("event_id", S.encode_s16(F.expr(SAMPLE)).alias("s16"))
    return rows.withColumn("back", S.decode_s16(F.col("s16")))


@query(f"""WITH {SAMPLE_SQL} SELECT session_id, CAST(i AS INTEGER) AS i, round(trunc(x * 32767) / 32768, 6) + 0.0 AS x FROM smp""")
def pcm_bytes(spark, sf_dir):
    """Samples to bytes and back, in Arrow batches."""
    made = _samples(spark, sf_dir).select("session_id", S.samples_to_pcm("samples").alias("pcm"))
    return _rows(made.select("session_id", F.transform(S.pcm_to_samples("pcm"), lambda x: x.cast("double")).alias("out")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN value / 500 WHEN 1 THEN floor(value) / 32768 ELSE (event_id % 256 - 128) / 128 END AS x FROM events")
def device_formats(spark, sf_dir):
    i = F.col("event_id") % 3
    fmt = F.when(i == 0, "F32").when(i == 1, "I16").otherwise("U8")
    raw = F.when(i == 0, F.col("value") / 500).when(i == 1, F.floor("value").cast("double")).otherwise((F.col("event_id") % 256).cast("double"))
    return A.table(spark, sf_dir, "events").select("event_id", S.decode(fmt, raw).alias("x"))


@query(f"""WITH {SAMPLE_SQL} SELECT session_id, n + (64 - n % 64) % 64 AS padded, (n + 63) // 64 AS chunks, least(n, 100) AS kept, greatest(n - 100, 0) AS dropped FROM cnt""")
def chunk_padding(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    kept = F.size(S.keep_newest(F.col("samples"), 100)).cast("bigint")
    return rows.select("session_id", F.size(S.pad(F.col("samples"), 64)).cast("bigint").alias("padded"), F.size(S.chunks(F.col("samples"), 64)).cast("bigint").alias("chunks"), kept.alias("kept"), (F.size("samples") - kept).alias("dropped"))


@query()
def spectrum_bands(spark, sf_dir):
    """Levels per band of each session's samples, repeated to fill the transform, and their bars."""
    rows = _samples(spark, sf_dir).select("session_id", F.flatten(F.array_repeat("samples", 32)).alias("samples"))
    return rows.select("session_id", S.spectrum("samples").alias("bands")).withColumn("bars", T.bars(F.col("bands")))


@query()
def fbank(spark, sf_dir):
    rows = _samples(spark, sf_dir).select("session_id", F.flatten(F.array_repeat("samples", 16)).alias("samples"))
    return rows.select("session_id", F.posexplode(S.fbank("samples")).alias("frame", "feats"))


NODES_SQL = """
n AS (SELECT s_nationkey AS dump, s_suppkey AS pos, s_suppkey AS target, s_suppkey % 6 AS c, s_name, 'Card ' || CAST(s_suppkey % 4 AS VARCHAR) AS card FROM supplier),
dev AS (SELECT dump, pos, target, CASE WHEN c = 0 THEN card WHEN c = 1 THEN card WHEN c = 2 THEN 'Everything playing on ' || card WHEN c = 3 THEN s_name END AS name,
  CASE WHEN c = 0 THEN 'Microphone' WHEN c = 1 THEN 'Monitor' WHEN c = 2 THEN 'Monitor' WHEN c = 3 THEN 'Application' END AS kind, CASE WHEN c = 3 THEN 'song ' || CAST(pos % 3 AS VARCHAR) END AS detail,
  CASE WHEN c = 0 THEN 'in' || CAST(pos AS VARCHAR) || CASE WHEN pos % 12 = 0 THEN '.rnnoise' ELSE '' END WHEN c = 1 THEN 'out' || CAST(pos AS VARCHAR) || '.monitor' WHEN c = 2 THEN 'out' || CAST(pos AS VARCHAR) END AS stable_name,
  CASE WHEN c = 2 THEN card END AS sink_description FROM n WHERE c <= 3),
dis AS (SELECT d.* EXCLUDE (name), CASE WHEN kind = 'Microphone' AND EXISTS (SELECT 1 FROM dev o WHERE o.dump = d.dump AND o.kind = 'Monitor' AND o.sink_description = d.name) THEN name || ' (input)' ELSE name END AS name FROM dev d)"""
SHORT_SQL = "CASE kind WHEN 'Monitor' THEN 'System audio' WHEN 'Application' THEN name ELSE replace(name, ' (input)', '') END"


def _dump(spark, sf_dir):
    """A JSON dump per nation, an object per supplier."""
    pos, c = F.col("s_suppkey"), F.col("s_suppkey") % 6
    card = F.concat(F.lit("Card "), (pos % 4).cast("string"))
    media = F.when(c == 0, "Audio/Source").when(c == 1, "Audio/Source/Virtual").when(c == 2, "Audio/Sink").when(c == 3, "Stream/Output/Audio").otherwise("Midi/Bridge")
    name = F.when(c == 0, F.concat(F.lit("in"), pos.cast("string"), F.when(pos % 12 == 0, ".rnnoise").otherwise(""))).when(c == 1, F.concat(F.lit("out"), pos.cast("string"), F.lit(".monitor"))).when(c == 2, F.concat(F.lit("out"), pos.cast("string")))
    props = F.struct(media.alias("media.class"), name.alias("node.name"), F.when(c < 3, card).alias("node.description"), F.when(c == 3, F.col("s_name")).alias("application.name"), F.concat(F.lit("song "), (pos % 3).cast("string")).alias("media.name"))
    obj = F.struct(pos.alias("id"), F.lit("PipeWire:Interface:Node").alias("type"), F.struct(props.alias("props")).alias("info"))
    return A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dump"), pos.alias("pos"), F.to_json(obj).alias("json"))


def _devices(spark, sf_dir):
    return D.disambiguate(D.sources(_dump(spark, sf_dir)))


@query(f"WITH {NODES_SQL} SELECT dump, pos, target, name, kind, detail, stable_name, sink_description FROM dev")
def source_parse_json(spark, sf_dir):
    return D.sources(_dump(spark, sf_dir))


@query(f"WITH {NODES_SQL} SELECT dump, target, name, CAST(row_number() OVER (PARTITION BY dump ORDER BY CASE kind WHEN 'Microphone' THEN 0 WHEN 'Monitor' THEN 1 ELSE 2 END, lower(name), pos) AS INTEGER) AS rank FROM dis")
def card_input_semi(spark, sf_dir):
    return D.ranked(_devices(spark, sf_dir)).select("dump", "target", "name", "rank")


@query(f"WITH {NODES_SQL} SELECT dump, target, CASE WHEN kind = 'Monitor' AND stable_name = 'out' || CAST(dump * 6 + 2 AS VARCHAR) THEN name || ' (default output)' ELSE name END AS name FROM dis")
def default_source(spark, sf_dir):
    default = F.concat(F.lit("out"), (F.col("dump") * 6 + 2).cast("string"))
    return D.mark_default(_devices(spark, sf_dir), default).select("dump", "target", "name")


@query(f"""WITH {NODES_SQL}, k AS (SELECT *, CASE WHEN stable_name = 'out' || CAST(dump AS VARCHAR) THEN 0 WHEN kind = 'Microphone' AND stable_name LIKE '%rnnoise%' THEN 1 WHEN kind = 'Microphone' THEN 2 ELSE 3 END AS priority FROM dis)
SELECT dump, target, name, kind, priority FROM (SELECT *, row_number() OVER (PARTITION BY dump ORDER BY priority, pos) AS r FROM k) WHERE r = 1""")
def priority_pick(spark, sf_dir):
    return D.choose(_devices(spark, sf_dir), F.concat(F.lit("out"), F.col("dump").cast("string")))


@query(f"""WITH {NODES_SQL}, l AS (SELECT dump, target, pos, {SHORT_SQL} AS base FROM dis), r AS (SELECT *, row_number() OVER (PARTITION BY dump, base ORDER BY pos) AS n FROM l)
SELECT dump, target, CASE WHEN n = 1 THEN base ELSE base || ' ' || CAST(n AS VARCHAR) END AS label FROM r""")
def duplicate_names(spark, sf_dir):
    rows = _devices(spark, sf_dir).withColumn("base", D.short_label())
    return D.numbered(rows, "dump", "base", "pos").select("dump", "target", "label")


@query(f"""WITH {NODES_SQL} SELECT dump, target, name || CASE WHEN detail IS NOT NULL THEN ' — ' || detail ELSE '' END AS display, coalesce(stable_name, 'app:' || name || ':' || detail) AS key FROM dis""")
def device_labels(spark, sf_dir):
    return _devices(spark, sf_dir).select("dump", "target", D.display().alias("display"), D.stable_key().alias("key"))


@query(f"""WITH {NODES_SQL}, sel AS (SELECT n_nationkey AS dump, 'in' || CAST(n_nationkey AS VARCHAR) AS key FROM nation)
SELECT sel.dump, sel.key, min(dis.target) AS target FROM sel LEFT JOIN dis ON dis.dump = sel.dump AND coalesce(stable_name, 'app:' || name || ':' || detail) = sel.key GROUP BY 1, 2""")
def remembered_devices(spark, sf_dir):
    """Remembered keys stay in the result where their device is gone."""
    selection = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dump"), F.concat(F.lit("in"), F.col("n_nationkey").cast("string")).alias("key"))
    return D.resolve(selection, _devices(spark, sf_dir))


@query("""WITH o AS (SELECT p_size AS dump, p_partkey AS id, row_number() OVER (PARTITION BY p_size ORDER BY p_name, p_partkey) - 1 AS i FROM part),
s AS (SELECT s_nationkey AS dump, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT CAST(o.dump AS INTEGER) AS dump, o.id AS output_id, s.id AS input_id FROM o JOIN s ON s.dump = o.dump AND s.i = o.i % s.n""")
def round_robin_link(spark, sf_dir):
    """Ports per node from a dump: a part is an output, a supplier an input."""

    def port(table, node, key, name, direction):
        props = F.struct(F.col(node).alias("node.id"), F.lit(direction).alias("port.direction"), F.col(name).alias("port.name"))
        obj = F.struct(F.col(key).alias("id"), F.lit("PipeWire:Interface:Port").alias("type"), F.struct(props.alias("props")).alias("info"))
        return A.table(spark, sf_dir, table).select(F.col(node).cast("int").alias("dump"), F.col(key).alias("pos"), F.to_json(obj).alias("json"))

    ports = D.ports(port("part", "p_size", "p_partkey", "p_name", "out").unionByName(port("supplier", "s_nationkey", "s_suppkey", "s_name", "in")))
    return D.links(ports.filter("direction = 'out'"), ports.filter("direction = 'in'"))


TYPES_SQL = "CASE event_type WHEN 'click' THEN 'transcript.commit' WHEN 'view' THEN 'transcript.provisional' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'transcript.relabel' ELSE 'metrics.tick' END"


def _frames(spark, sf_dir):
    """JSON frames of a server, one per event; purchases are of a type that no reader knows."""
    seg = A.segments(spark, sf_dir)
    is_text = F.col("event_type").isin("click", "view")
    body = F.struct(
        F.expr(TYPES_SQL).alias("type"), "session_id", F.col("pos").alias("seq"), F.when(is_text, F.concat("event_type", F.lit(" "))).alias("text"), F.when(is_text, F.col("speaker")).alias("speaker"), F.when(F.col("provisional") & is_text, True).alias("speaker_provisional"),
        F.when(F.col("event_type") == "error", F.lit("lost")).alias("message"), F.lit("x").alias("unknown_field"),
    )
    return seg.select(F.col("session_id").alias("at_session"), F.col("pos").alias("at_pos"), F.to_json(body).alias("json"))


MSG_SQL = A.SEG_SQL + f""", msg AS (SELECT session_id, pos AS seq, {TYPES_SQL} AS type, CASE WHEN event_type IN ('click', 'view') THEN event_type || ' ' END AS text, CASE WHEN event_type IN ('click', 'view') THEN speaker END AS speaker, provisional AND event_type IN ('click', 'view') AS speaker_provisional,
 CASE WHEN event_type = 'error' THEN 'lost' END AS message FROM seg)"""


@query(f"WITH {MSG_SQL} SELECT session_id, seq, type, text, speaker, speaker_provisional, message FROM msg WHERE type <> 'metrics.tick'")
def message_decode(spark, sf_dir):
    good, _ = M.decode(_frames(spark, sf_dir))
    return good.select("session_id", "seq", "type", "text", "speaker", "speaker_provisional", "message")


@query(f"WITH {MSG_SQL} SELECT session_id AS at_session, count(*) AS n FROM msg WHERE type = 'metrics.tick' GROUP BY 1")
def message_rejects(spark, sf_dir):
    _, bad = M.decode(_frames(spark, sf_dir))
    return bad.groupBy("at_session").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MSG_SQL} SELECT session_id, seq, '{{"type":"' || type || '","seq":' || CAST(seq AS VARCHAR) || coalesce(',"speaker":' || CAST(speaker AS VARCHAR), '') || CASE WHEN speaker_provisional THEN ',"speaker_provisional":true' ELSE '' END || '}}' AS json FROM msg WHERE type <> 'metrics.tick'""")
def message_encode(spark, sf_dir):
    good, _ = M.decode(_frames(spark, sf_dir))
    return good.select("session_id", "seq", M.encode(good, ["type", "seq", "speaker", "speaker_provisional"]).alias("json"))


@query(f"""WITH {MSG_SQL} SELECT session_id, trim(coalesce(string_agg(text, '' ORDER BY seq) FILTER (type IN ('transcript.commit', 'transcript.provisional')), '') || coalesce(max(CASE WHEN type = 'error' THEN chr(10) || '[lost]' END), '')) AS text FROM msg WHERE type <> 'metrics.tick' GROUP BY 1""")
def message_transcript(spark, sf_dir):
    good, _ = M.decode(_frames(spark, sf_dir))
    return M.transcript(good)


@query(f"WITH {A.SEG_SQL} SELECT session_id, source, pos, CAST(sum(user_id % 5) OVER (PARTITION BY session_id, source ORDER BY pos) AS BIGINT) AS dropped_total, CASE WHEN pos = user_id AND pos <> 0 THEN NULL ELSE text END AS text FROM seg")
def source_health(spark, sf_dir):
    """Dropped samples so far per source, and the text for a viewer that has the revision of its user's id."""
    rows = M.dropped(A.segments(spark, sf_dir).withColumn("dropped", F.col("user_id") % 5))
    return rows.select("session_id", "source", "pos", "dropped_total", M.snapshot(F.col("text"), F.col("pos"), F.col("user_id")).alias("text"))


@query()
def cluster_online(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.col("recording").alias("stream_id"), F.col("id").alias("ord"), "vector")
    return C.cluster(rows, C.Tuning(t_assign=0.2, margin=0.02, min_pool=2, mint_lead=0.0))


@query()
def cluster_sweep(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.col("recording").alias("stream_id"), F.col("id").alias("ord"), "vector")
    grid = spark.sql("SELECT row_number() OVER (ORDER BY t_assign, margin, min_pool) AS config, t_assign, margin, min_pool, 0.05D AS alpha FROM VALUES (0.15D), (0.25D) a(t_assign), VALUES (0.0D), (0.05D) b(margin), VALUES (2), (3) c(min_pool)").withColumn("config", F.col("config").cast("bigint"))
    return C.sweep(rows, grid)


@query("""SELECT page_id, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(url, ''), lambda x: unicode(x)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS key,
 split_part(url, '/', -1) AS base, split_part(split_part(url, '/', -1), '.', 1) AS meeting FROM pages""")
def path_keys(spark, sf_dir):
    """The 64-bit key of each page's address, and names taken from it."""
    return A.table(spark, sf_dir, "pages").select("page_id", T.path_key(F.col("url")).alias("key"), T.basename(F.col("url")).alias("base"), T.meeting_of(F.col("url")).alias("meeting"))


@query(f"""WITH {A.SEG_SQL} SELECT session_id, source, count(*) AS n, min(pos) AS first_pos FROM seg GROUP BY 1, 2""")
def sources_seen(spark, sf_dir):
    return A.segments(spark, sf_dir).groupBy("session_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))



@query("""WITH n AS (SELECT DISTINCT source || '-' || lang || CASE WHEN doc_id % 4 = 0 THEN '.onnx' ELSE '.bin' END AS name FROM documents)
SELECT name, name LIKE 'src1%' AS known FROM n WHERE name LIKE '%.onnx' AND name NOT IN (SELECT 'src' || CAST(n_nationkey AS VARCHAR) || '-en.onnx' FROM nation WHERE n_nationkey < 3)""")
def candidate_models(spark, sf_dir):
    """Model files but those of a list, told apart by whether their family is known."""
    docs = A.table(spark, sf_dir, "documents")
    names = docs.select(F.concat("source", F.lit("-"), "lang", F.when(F.col("doc_id") % 4 == 0, ".onnx").otherwise(".bin")).alias("name")).distinct()
    others = A.table(spark, sf_dir, "nation").filter("n_nationkey < 3").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string"), F.lit("-en.onnx")).alias("name"))
    return D.candidate_models(names, others, F.col("name").startswith("src1"))


@query("SELECT event_id, event_type = 'error' OR value >= 100 AS starved FROM events")
def starved_sources(spark, sf_dir):
    """A source with an error, or silent for five seconds, with the value as twentieths of a second."""
    error = F.when(F.col("event_type") == "error", F.lit("lost"))
    return A.table(spark, sf_dir, "events").select("event_id", D.starved(F.col("value") / 20, error).alias("starved"))
