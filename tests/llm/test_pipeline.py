"""Each stage of the pipeline against plain Python, on rows with nulls, repeats, ties and clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from palaver.llm import mixing, pii, quality

EXTRA = "key copy copies n c i r row sum size k stays pii said pairs q_words component_id kept n_shingles c0 c1 low digest".split()


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} or {tuple(t.lower().split())} for t in (a, b))
    return len(x & y) / len(x | y)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = []
    for n in (30, 60, 90, 300):
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join(base + [word() for _ in range(n // 5)]), " ".join(base[: n - n // 6]), " ".join(base + [word() for _ in range(n // 2)])]
    texts += [None, "", " ", "Mrs Anna wrote to anna@example.org. " + " ".join(word() for _ in range(40)), texts[0], "x " * 3000]
    rows = [(i, t, "en" if i % 3 else None, ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (1, texts[4], "en", "a", 5), (None, texts[0], "de", "b", 1), (None, texts[0], "de", "b", 1), (7, texts[12] + " end", "en", "b", 3)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({c: F.lit(f"mine {c}") for c in EXTRA})


def rows_of(df):
    out = df.collect()
    assert all(r[c] == f"mine {c}" for r in out for c in EXTRA)
    return [tuple(r)[:5] for r in out]


def in_order(rows):
    return sorted(rows, key=repr)


def test_quality_stage(spark, docs, small):
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = [r for r in corpus() if model.score(np.array([quality.statistics((r[1] or "").encode())]))[0] >= quality.CUT]
    out = corpus_pipeline.STAGES[0][1](spark, docs, small)
    assert out.columns == docs.columns and in_order(rows_of(out)) == in_order(want)


def test_near_duplicates_stage(spark, docs, small):
    rows = corpus()
    up = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            (i, s, *_), (j, t, *_) = rows[a], rows[b]
            if i is not None and j is not None and (s or "").split() and (t or "").split() and jaccard(s, t) >= 0.8:
                x, y = sorted((up[a], up[b]))
                up = [x if u == y else u for u in up]
    groups = {}
    for at, u in enumerate(up):
        groups.setdefault(u, []).append(rows[at])
    out = corpus_pipeline.STAGES[1][1](spark, docs, small)
    got = rows_of(out)
    assert out.columns == docs.columns and len(got) == len(groups) < len(rows) - 5
    for g in groups.values():  # one row of each group, with its smallest id
        kept = [r for r in got if r in g]
        if any((r[1] or "").split() and r[0] is not None for r in g):
            assert len(kept) == 1 and kept[0][0] == min(r[0] for r in g)
    assert sum(r[0] is None for r in got) == 2


def test_pii_stage(spark, docs, small):
    out = corpus_pipeline.STAGES[2][1](spark, docs, small)
    makes = pii.Surrogates(pii.TEST_KEY)
    want = []
    for i, t, lang, source, n in corpus():
        new = t
        for kind, a, b in reversed(pii.find(t or "")):
            new = new[:a] + makes.of(kind, t[a:b]) + new[b:]
        want.append((i, new, lang, source, None if n is None or new is None else len(new)))
    assert out.columns == docs.columns and in_order(rows_of(out)) == in_order(want)
    assert sum(a != b for a, b in zip([r[1] for r in want], [r[1] for r in corpus()], strict=True)) == 1


def test_mix_stage(spark, docs, small):
    out = corpus_pipeline.STAGES[3][1](spark, docs, small)
    got = rows_of(out)
    copies = {}
    for r in mixing.mix(docs.select("doc_id", "source", "text")).collect():
        copies[r["doc_id"], r["k"], r["size"]] = copies.get((r["doc_id"], r["k"], r["size"]), 0) + r["copies"]
    back = {}
    for i, t, _, s, _ in got:
        at = (i, "n" if s is None else f"s{s}", len((t or "").split()))
        back[at] = back.get(at, 0) + 1
    assert out.columns == docs.columns and back == {k: v for k, v in copies.items() if v} and set(got) <= set(corpus())


def test_tokens_stage(spark, docs, small):
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in corpus_pipeline.STAGES[4][1](spark, docs, small).collect())
    assert got == sorted((i or -1, len(lib.encode(t or ""))) for i, t, *_ in corpus())


def test_empty_tables(spark, docs, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), small).count() == 0, name


def test_mix_chances():
    """Every document's chance is its source's fraction, whatever the sizes, and the words are kept."""
    rng = np.random.default_rng(8)
    for n, f in ((5, 0.2), (40, 0.3), (120, 0.85)):
        size = np.sort(np.maximum(1, rng.lognormal(4.5, 1.3, n).astype(int)))[::-1]
        total = np.zeros(n)
        for _ in range(3000):
            p, at = mixing.pivot_together(f, size, rng.random(n))
            assert abs((p * size).sum() - f * size.sum()) < 1e-6 * size.sum() and set(np.delete(p, at if at >= 0 else []).tolist()) <= {0.0, 1.0}
            total += p
        assert np.abs(total / 3000 - f).max() < 4.5 * np.sqrt(f * (1 - f) / 3000)
    assert mixing.pivot_together(0.0, np.array([3, 1]), rng.random(2))[0].tolist() == [0, 0] and mixing.pivot_together(0.4, np.array([0, 0]), rng.random(2))[1] == -1


def test_workers_are_lean(spark, docs, small):
    """Batches are small, and a stage holds no tables of the one before it."""
    from palaver.llm import common, spm

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([len(spm._codecs)])], ["n", "kept"])

    assert corpus_pipeline.encode(spark, docs.coalesce(1), small).count() == docs.count()
    rows = spark.range(0, 3000, 1, 1)
    before = rows.transform(common.in_batches).mapInArrow(common.lean(kept, "spm"), "n long, kept long").collect()
    after = rows.transform(common.in_batches).mapInArrow(common.lean(kept), "n long, kept long").collect()
    assert sum(r["n"] for r in after) == 3000 and max(r["n"] for r in after) <= 250
    assert {r["kept"] for r in after} == {0} and len(before) == len(after)
