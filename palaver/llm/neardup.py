"""Near duplicates by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is the ``SKETCH`` smallest
of them. Documents with equal sets form a class, and only one representative of each goes on.

*Inverted lists.* In each sketch the values are ordered by how many sketches retain them, rarest
first. Two sketches that have ``o`` values in common share one among the first ``size - o + 1`` of
each, so only those go into the lists, and values of passages that many documents share come last and
stay out, unless a document consists of little else. Sketches that hold whole sets need exactly the
overlap that the threshold asks for; of others so many values are asked for (:func:`shared_values`) that
pairs at the threshold miss them with a chance below ``SHARED``.

*Stars, then the rest.* In each list the ``LEADERS`` smallest ids are leaders and meet all others. The
links found label the documents by component. Documents of lists with several labels are listed again,
now by their full sets: by rarity among themselves, and only as many values as a link at the threshold
must share one of, which leaves out most that have no partner. In these lists the documents whose label
is not the list's most frequent one, the strays, meet a few of the latter in turns, while that halves their
number; what is left meets all those with another label, so that no link between parts that are not yet
known to belong together is left out (:func:`across`). Pairs within a part are never made.

*Filter and check*, in both steps. A pair's union sketch, the smallest values of both sketches together, estimates the
overlap; pairs below what the threshold makes likely go (pairs at the threshold with a chance below
``LIKELY``). The others are checked on their full sets. Components come from the links by rounds of large and small stars.

Defined results: null and empty texts have no shingles, link to nothing and are classes of their own;
rows with a null id link to nothing and have a null component; rows that repeat an id and a text are one
class, and of rows that repeat an id with other texts each links by its own; an empty table gives an empty result. Two shingles count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm import common

SHINGLE, SKETCH, LEADERS = 3, 64, 8
#: Chances that a pair at the threshold is missed by the lists and by the union sketches.
SHARED, LIKELY = 1e-8, 2e-7
#: Link when PARTS * intersection >= LEAST * union, unless the caller asks for another similarity.
PARTS, LEAST = 100, 85
#: Documents of a list's main label and of one class of sizes that strays meet in a turn.
FEW = 16
#: Sizes up to the first are classes of their own, larger ones grow by the second.
EXACT, STEP = 64, 1.02
#: Ids sent to all executors at most (about 100 bytes each with what goes with them).
BROADCAST_IDS = 200_000


def shingles(data: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (signed 64 bits) of a text's word shingles."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64).view(np.int64)
    own: dict[bytes, int] = {}
    for w in set(words):
        own[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    count = len(h) - n + 1
    mixed = np.zeros(count, np.uint64)
    for i in range(n):  # position matters
        x = (mixed ^ h[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = x ^ (x >> np.uint64(29))
    x = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((x ^ (x >> np.uint64(32))).view(np.int64))


def sketches(df: DataFrame, shingle: int = SHINGLE, size: int = SKETCH) -> DataFrame:
    """Per row (doc, row, data): doc, row, n (size of the set), digest of the set (null if empty) and sketch."""

    def run(batches):
        kept = pa.list_(pa.int64())
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                sets = [shingles(x or b"", shingle) for x in part.column(2).to_pylist()]
                digests = [_digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([s[:size] for s in sets], kept)], ["doc", "row", "n", "digest", "sketch"])

    return df.transform(common.in_batches).mapInArrow(common.lean(run), "doc long, row long, n long, digest binary, sketch array<bigint>")


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def full_sets(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, data, digest) to (id, items): the sets as arrays, one for each id, of the text with that digest."""

    def run(batches):
        kept = pa.list_(pa.int64())
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = [(id_, s) for id_, data, digest in zip(*(c.to_pylist() for c in part.columns), strict=True) if _digest(s := shingles(data or b"", shingle)) == digest]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kept)], ["id", "items"])

    return df.select("id", "data", "digest").transform(common.in_batches).mapInArrow(common.lean(run), "id long, items array<bigint>").dropDuplicates(["id"])


def shared_values(size: int, chance: float, least: int = LEAST, parts: int = PARTS) -> int:
    """The most values of a union sketch that both documents of a pair at the threshold have, but for this chance."""
    below, share = 0.0, least / parts
    for k in range(size):
        below += math.comb(size, k) * share**k * (1 - share) ** (size - k)
        if below > chance:
            return k
    return size


def prefix_length(n: Column, size: int, shared: int, least: int = LEAST, parts: int = PARTS) -> Column:
    """How many of a sketch's values go into the lists."""
    exact = n - F.ceil(n * least / parts) + 1
    kept = F.least(n, F.lit(size))
    cut = kept - F.floor(kept * shared / size) + 1
    return F.when(n <= int(size * least / parts), exact).otherwise(cut).cast("int")


def _two(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_by_sketch(size: int, least: int = LEAST, parts: int = PARTS) -> Column:
    """Whether a pair (n_a, s_a, n_b, s_b) may be linked: exact where both sketches hold whole sets."""
    enough = shared_values(size, LIKELY, least, parts)
    fits = F.least("n_a", "n_b") * parts >= F.greatest("n_a", "n_b") * least
    inter = F.array_intersect("s_a", "s_b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, size)
    exact = F.size(inter) * parts >= (F.size("s_a") + F.size("s_b") - F.size(inter)) * least
    likely = (F.size(inter) >= enough) & (F.size(F.array_intersect(inter, union)) >= enough)
    return fits & F.when(F.greatest("n_a", "n_b") <= size, exact).otherwise(likely)


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int, name: str) -> DataFrame:
    """(id, items) for some ``nodes`` (id, doc, digest). A list of up to ``BROADCAST_IDS`` of them goes to the
    scan; beyond that the texts are shuffled. Where a document id has several texts, the digest tells which."""
    nodes = common.materialize(nodes, f"{name}-nodes")
    few = nodes.count() <= BROADCAST_IDS
    picked = docs.join(F.broadcast(nodes) if few else nodes, "doc").select("id", "data", "digest")
    out = common.materialize(full_sets(picked, shingle), f"{name}-sets")
    common.drop(nodes)
    return out


def linked(pairs: DataFrame, sets: DataFrame, least: int = LEAST, parts: int = PARTS) -> DataFrame:
    """The pairs (a, b) that their full sets link."""
    items = lambda x: sets.select(F.col("id").alias(x), F.col("items").alias(f"i_{x}"))
    both = pairs.join(items("a"), "a").join(items("b"), "b")
    inter = F.size(F.array_intersect("i_a", "i_b"))
    return both.filter(inter * parts >= (F.size("i_a") + F.size("i_b") - inter) * least).select("a", "b")


def lists_of(entries: DataFrame, kept: Column, most: Column) -> DataFrame:
    """Inverted lists (value, id, n, place) of entries (id, n, value): of the ``kept`` values of a document
    the ``most`` rarest, without those that no other document has; ``place`` counts these as well."""
    often = common.materialize(entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "often")  # as a table, so that a join on it can split a hot value
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "value"))
    alone = kept - F.count(F.lit(1)).over(Window.partitionBy("id"))  # values of one document come first
    return entries.join(often, "value").withColumns({"place": place + alone, "most": most}).filter("place <= most").select("value", "id", "n", "place")


def size_class(n: Column) -> Column:
    """Sizes in classes: each of the small ones alone, then in steps of ``STEP``."""
    return F.when(n <= EXACT, n).otherwise(EXACT + F.floor(F.log(n / EXACT) / math.log(STEP))).cast("int")


def split_lists(marked: DataFrame) -> DataFrame:
    """Of lists of full sets (value, id, n, place, label) those with several labels, with the most frequent
    one (``main``), the class of a document's size, and all its values in the lists by rarity (``ranked``)."""
    mains = marked.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.max(F.struct("c", (-F.col("label")).alias("m"))).alias("top"), F.count(F.lit(1)).alias("k"))
    mains = common.materialize(mains.filter("k > 1").select("value", (-F.col("top.m")).alias("main")), "mains")
    ranks = marked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("ranked"))
    out = common.materialize(marked.join(mains, "value").join(ranks, "id").withColumn("class", size_class(F.col("n"))), "split")
    common.drop(mains)
    return out


def _strays(split: DataFrame, least: int, parts: int) -> DataFrame:
    """Documents without a list's main label, once for each class of sizes that a partner may be of.

    What comes before the first list that both are in is not shared, so the places there bound the
    intersection: with at most r, sizes n and m are linked only if r * (parts + least) >= least * (n + m).
    """
    out = split.filter("label <> main").select("value", *(F.col(c).alias(f"{c}_p") for c in ("id", "n", "place", "label", "ranked")))
    most = F.col("n_p") - F.col("place_p") + 1
    low, high = F.ceil(F.col("n_p") * least / parts), F.floor(most * (parts + least) / least) - F.col("n_p")
    out = out.withColumn("low", low).withColumn("high", high).filter("low <= high")
    return out.withColumn("class", F.explode(F.sequence(size_class(F.col("low")), size_class(F.col("high")))))


def _fits(least: int, parts: int) -> Column:
    most = F.least(F.col("n") - F.col("place"), F.col("n_p") - F.col("place_p")) + 1
    return (most * parts >= (F.col("n") + F.col("n_p") - most) * least) & (F.col("label") != F.col("label_p"))


def towards(split: DataFrame, turn: int, least: int = LEAST, parts: int = PARTS) -> DataFrame:
    """Pairs (a, b) of strays with a few documents of their lists' main label, others at each turn."""
    nth = F.row_number().over(Window.partitionBy("value", "class").orderBy("place", F.xxhash64("id", F.lit(turn)), "id"))
    some = split.filter("label = main").select("value", "class", "id", "n", "place", "label").withColumn("nth", nth).filter(F.col("nth") <= FEW)
    some = common.materialize(some, "some")
    pairs = common.materialize(_strays(split, least, parts).drop("ranked_p").join(some, ["value", "class"]).filter(_fits(least, parts)).select(*_two("id_p", "id")).distinct(), "towards")
    common.drop(some)
    return pairs


def across(split: DataFrame, least: int = LEAST, parts: int = PARTS) -> DataFrame:
    """All pairs (a, b) of documents with different labels that may be linked, each from the first list, by
    rarity, that both are in. A list is dealt by classes of size, and a stray document meets only those that
    its place allows: documents of one size that share a passage too small to link them never meet."""
    once = (F.col("label") == F.col("main")) | (F.col("id_p") < F.col("id"))  # two strays meet both ways
    first = F.get(F.array_intersect("ranked", "ranked_p"), F.lit(0)) == F.col("value")
    pairs = split.join(_strays(split, least, parts), ["value", "class"]).filter(_fits(least, parts) & once & first)
    return common.materialize(pairs.select(*_two("id_p", "id")), "rest")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): alternating large and small stars, until nothing moves."""
    edges = common.materialize(links.filter("a <> b").select(*_two("a", "b")).distinct().select(F.col("b").alias("x"), F.col("a").alias("y")), "edges")  # y < x
    before, n = None, 0
    while True:
        old = edges
        # large star: larger neighbours go to the smallest of neighbours and self
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = common.materialize(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "low")  # as a table, so that the join can split a large star
        large = low
        edges = both.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: smaller neighbours and self go to the smallest neighbour
        low = edges.groupBy("x").agg(F.min("y").alias("m"))
        edges = edges.join(low, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct(F.col("x"), F.col("m").alias("y")))).alias("e")).select("e.*").filter("x <> y").distinct()
        edges = common.materialize(edges, f"stars{n}")
        common.drop(old, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("x", "y").cast("long")), F.count_distinct("x")).first()
        if now == before and now[0] == now[2]:  # one edge to each document, and the same as before
            return common.holding(edges.select(F.col("x").alias("id"), F.col("y").alias("component")), edges)
        before, n = now, n + 1


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, size: int = SKETCH, least: int = LEAST, parts: int = PARTS, row_col: str | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links), kept. If ``row_col``
    names a column of longs, that is handed on, and ``group`` tells the component where ids repeat (null for empty sets).

    Links are pairs of sets of ``shingle`` words with a similarity of ``least / parts`` or more.
    """
    shared = shared_values(size, SHARED, least, parts)
    row = F.lit(0).cast("long") if row_col is None else df[row_col].cast("long")
    docs = df.select(df[id_col].cast("long").alias("doc"), df[text_col].cast("binary").alias("data"))
    own = common.materialize(sketches(df.select(df[id_col].cast("long").alias("doc"), row.alias("row"), df[text_col].cast("binary").alias("data")), shingle, size), "sketches")
    members = common.materialize(own.select("doc", "row", "n", "digest"), "members")
    classes = own.filter(F.col("digest").isNotNull() & F.col("doc").isNotNull()).groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows"), F.first(F.struct("n", "sketch")).alias("s"))
    # the number of a class is given once, as it is written
    reps = common.materialize(classes.select(F.monotonically_increasing_id().alias("id"), F.col("first").alias("doc"), "digest", "rows", "s.n", "s.sketch"), "representatives")
    common.drop(own)

    entries = reps.select("id", "n", F.explode("sketch").alias("value"))
    lists = common.materialize(lists_of(entries, F.least("n", F.lit(size)), prefix_length(F.col("n"), size, shared, least, parts)), "lists")

    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    known = (F.greatest("n_a", "n_b") <= size).alias("known")
    nodes = reps.select("id", "doc", "digest")

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that their union sketches let through."""
        return common.materialize(pairs.join(side("a"), "a").join(side("b"), "b").filter(near_by_sketch(size, least, parts)).select("a", "b", known), name)

    first_ids = F.row_number().over(Window.partitionBy("value").orderBy("id"))
    leaders = common.materialize(lists.withColumn("r", first_ids).filter(F.col("r") <= LEADERS).select("value", F.col("id").alias("a"), F.col("n").alias("n_a")), "leaders")
    fits = (F.col("a") < F.col("id")) & (F.least("n", "n_a") * parts >= F.greatest("n", "n_a") * least)
    stars = likely(lists.join(leaders, "value").filter(fits).select("a", F.col("id").alias("b")).distinct(), "likely")
    check = stars.filter("NOT known").select("a", "b")
    asked = check.select(F.col("a").alias("id")).union(check.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(docs, nodes.join(asked, "id", "left_semi"), shingle, "stars")
    first = common.materialize(linked(check, sets, least, parts).union(stars.filter("known").select("a", "b")), "star-links")
    common.drop(sets, stars, leaders)

    label = components(first)
    common.drop(first)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(label.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))

    marked = common.materialize(labelled(lists).select("value", "id", "label"), "marked")
    several = marked.groupBy("value").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("value")
    asked = marked.join(several, "value").select("id").distinct()
    open_ = sets_of(docs, nodes.join(asked, "id", "left_semi"), shingle, "open")
    common.drop(lists, marked)
    entries = open_.select("id", F.size("items").cast("long").alias("n"), F.explode("items").alias("value"))
    exact = (F.col("n") - F.ceil(F.col("n") * least / parts) + 1).cast("int")
    full = common.materialize(lists_of(entries, F.col("n"), exact), "full-lists")
    before, turn = None, 0
    while True:
        split = split_lists(labelled(full))
        strays = split.filter("label <> main").agg(F.count_distinct("id")).first()[0]
        last = before is not None and 2 * strays > before  # the turns no longer help
        pairs = across(split, least, parts) if last or not strays else towards(split, turn, least, parts)
        rest = likely(pairs, "likely-rest")
        links = common.materialize(linked(rest.filter("NOT known").select("a", "b"), open_, least, parts).union(rest.filter("known").select("a", "b")), "rest-links")
        old, label = label, components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))
        common.drop(split, pairs, rest, links, old)
        if last or not strays:
            break
        before, turn = strays, turn + 1
    groups = label
    common.drop(open_, full)
    # the smallest id of each component's classes; only those, and classes of several rows, have to be told
    roots = groups.select("component").distinct().select(F.col("component").alias("id"), "component")
    grouped = common.materialize(nodes.join(groups.unionByName(roots), "id").select("component", "digest", "doc"), "grouped")
    lowest = grouped.groupBy("component").agg(F.min("doc").alias("low"), F.min("digest").alias("group"))
    told = grouped.join(lowest, "component").select("digest", "low", "group").union(reps.filter("rows > 1").select("digest", "doc", "digest"))
    lows = common.materialize(told.groupBy("digest").agg(F.min("low").alias("low"), F.min("group").alias("group")), "lows")
    common.drop(groups, reps, grouped)
    out = members.join(lows, "digest", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("low", "doc"))
    kept = F.coalesce(F.col("doc") == component, F.lit(True))
    out = out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), *([F.col("row").alias(row_col), F.coalesce("group", "digest").alias("group")] if row_col else []))
    return common.holding(out, members, lows)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
