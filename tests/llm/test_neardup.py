import random

import pytest

from palaver.llm import neardup


def sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([b" ".join(w)] if w else [])


def brute(rows):
    own = {i: sets(t) for i, t in rows}
    up = {i: i for i in own}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x = len(own[a] & own[b])
            if own[a] and own[b] and 100 * x >= 85 * len(own[a] | own[b]):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(own[i]), top(i)) for i in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice((4, 12, 60, 150, 400)))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):  # copies of copies, some beyond the threshold
            base = list(base)
            for _ in range(max(1, len(base) // 60)):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
        texts.append(f"{rng.choice(shared)} {word()} {rng.choice(shared)}")
    texts += ["", None, " \n", "one", "ONE", "one two", texts[0].upper(), "x " * 30, "é É"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    want = brute(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert len({c for _, c in want.values()}) < len(rows) - 40


def test_edges(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (3, "")], schema)
    got = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, None, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0), (3, 3, 0)], key=str)


@pytest.mark.parametrize("n", [1, 7, 54, 55, 64, 500])
def test_prefix(spark, n):
    from pyspark.sql import functions as F

    kept = spark.range(1).select(neardup.prefix_length(F.lit(n).cast("long"), 64, 36).alias("p")).first()["p"]
    assert kept >= n - -(-85 * n // 100) + 1 if n <= 54 else kept >= min(n, 64) - 36 + 1


def jaccard(a, b, n):
    x, y = ({tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def groups_at(texts, n, least):
    """Kept ids by plain Python: the smallest id of each group of links."""
    up = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if jaccard(texts[a], texts[b], n) >= least:
                x, y = sorted((up[a], up[b]))
                up = [x if u == y else u for u in up]
    return {i for i, u in enumerate(up) if u == i}


def test_pipeline_threshold(spark):
    import corpus_pipeline

    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    texts = []
    for n in (40, 70, 120, 1000):
        base = words(n)
        texts += [base, f"{base} {words(n // 5)}", f"{words(n)} {words(n)}"]  # about 0.83
        base = words(n)
        texts += [base, f"{words(n // 5)} {base}", f"{base} {words(n // 3)}"]  # 0.83 and 0.75
        base = words(n)
        texts += [base, " ".join(base.split()[: n - n // 6])]
    assert 0.8 < jaccard(texts[-8], texts[-7], 5) < 0.85 and 0.8 < jaccard(texts[-8], texts[-7], 3) < 0.85
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == groups_at(texts, 5, 0.8)
    strict = {r["doc_id"] for r in neardup.near_duplicates(docs).collect() if r["kept"]}
    assert strict == groups_at(texts, 3, 0.85) and len(got) < len(strict)


def test_bounds_of_the_contract():
    assert (neardup.shared_values(64, neardup.SHARED), neardup.shared_values(64, neardup.LIKELY)) == (36, 38)
    assert (neardup.shared_values(64, neardup.SHARED, 80), neardup.shared_values(64, neardup.LIKELY, 80)) == (31, 33)


def test_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(7, a, 0), (7, b, 1), (3, a + " more", 2), (9, b, 3), (2, b + " else", 4), (7, c, 5), (7, a, 6), (5, c.upper(), 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = {r["row"]: (r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, row_col="row").collect()}
    assert got == {0: (7, 3, False), 1: (7, 2, False), 2: (3, 3, True), 3: (9, 2, False), 4: (2, 2, True), 5: (7, 5, False), 6: (7, 3, False), 7: (5, 5, True)}


def test_templates_never_meet(spark):
    """Documents of one template and three words of their own: none is linked, and no pair is made."""
    from pyspark.sql import functions as F

    shared = " ".join(f"t{i}" for i in range(30))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared), *(F.concat(F.lit(f" {x}"), "id") for x in "abc")).alias("text"))
    assert neardup.near_duplicates(df).filter("NOT kept").count() == 0
    sets = neardup.full_sets(df.select("doc_id", F.col("text").cast("binary").alias("data")).join(neardup.sketches(df.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("row"), F.col("text").cast("binary").alias("data"))).select(F.col("doc").alias("doc_id"), "digest"), "doc_id").withColumnRenamed("doc_id", "id"))
    lists = neardup.lists_of(sets.select("id", F.size("items").cast("long").alias("n"), F.explode("items").alias("value")), F.col("n"), (F.col("n") - F.ceil(F.col("n") * 0.85) + 1).cast("int"))
    split = neardup.split_lists(lists.withColumn("label", F.col("id")))
    made = neardup.across(split).union(neardup.towards(split, 0))
    assert lists.groupBy("value").count().agg(F.max("count")).first()[0] == 3000 and made.count() == 0
