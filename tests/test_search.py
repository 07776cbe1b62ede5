import math

import numpy as np
import pytest

from millrace.model import DimensionMismatch, HybridWeights, InvalidQuery
from millrace.operators import hybrid, keyword, metrics, vectors


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((60, 5)).astype(np.float32)
    m[7] = 0
    m[11] = m[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>"), m


def oracle(m, q, k):
    return [(int(i), round(float(s), 6)) for i, s in sorted(((i, float(m[i] @ q)) for i in range(len(m))), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


def test_dot_topk_with_ties(spark, space):
    df, m = space
    m = m.astype(float)
    q = spark.createDataFrame([(1, [float(x) for x in m[3]]), (2, [0.0] * 5)], "query_id int, embedding array<float>")
    got = vectors.search(df, q, 6, block_bytes=40).orderBy("query_id", "rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got if r.query_id == 1] == oracle(m, m[3], 6)
    assert [r.chunk_id for r in got if r.query_id == 2] == [0, 1, 2, 3, 4, 5]


def test_cosine_keeps_a_zero_vector_at_zero(spark, space):
    df, m = space
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = {r.chunk_id: r.score for r in vectors.search(df, q, 60, metric="cosine").collect()}
    assert got[7] == 0.0
    assert got[0] == pytest.approx(m[0, 0] / np.linalg.norm(m[0].astype(float)), rel=1e-6)


def test_quantisation_matches_its_columns(spark, space):
    df, m = space
    rows = df.select("chunk_id", vectors.quantise(df["embedding"]).alias("z")).orderBy("chunk_id").collect()
    q, scale = vectors.encode(m.astype(float), "i8")
    for r in rows:
        assert list(map(int, q[r.chunk_id])) == r.z.q and r.z.scale == pytest.approx(scale[r.chunk_id])


def test_half_precision_rounds_up_in_magnitude():
    x = np.array([[1.0 + 2.0**-11]])
    assert vectors.encode(x, "f16")[0][0, 0] == 1.0 + 2.0**-10
    assert vectors.encode(np.array([[1.0 + 2.0**-8]]), "bf16")[0][0, 0] == 1.0 + 2.0**-7


def test_errors(spark, space):
    df, _ = space
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        vectors.search(df, q, 3).collect()
    with pytest.raises(InvalidQuery):
        vectors.search(df, q, 3, metric="l2")
    with pytest.raises(DimensionMismatch):
        vectors.search(df, q, 0)
    assert issubclass(DimensionMismatch, InvalidQuery)


DOCS = ["red red fox", "a fox and a dog", "the dog sleeps", "", "it's 10.5 red-ish"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)] + [(9, None)], "chunk_id long, text string")


def brute(query, docs, k1=1.2, b=0.75):
    import re

    toks = [re.findall(r"\w+(?:['.]\w+)*", (t or "").lower()) for t in docs]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    out = {}
    for term in set(re.findall(r"\w+(?:['.]\w+)*", query.lower())):
        df = sum(term in t for t in toks)
        for i, t in enumerate(toks):
            if term in t:
                tf = t.count(term)
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return out


def test_bm25(spark, texts):
    q = spark.createDataFrame([(1, "Red fox fox"), (2, "nothing here"), (3, ""), (4, "it's")], "query_id long, text string")
    got = keyword.search(texts, q, 10).collect()
    want = brute("red fox", [*DOCS, None])
    assert {r.chunk_id: round(r.score, 9) for r in got if r.query_id == 1} == {i: round(s, 9) for i, s in want.items()}
    assert {r.matched_terms for r in got if r.query_id == 1 and r.chunk_id == 0} == {"fox,red"}
    assert {r.query_id for r in got} == {1, 4}


def test_bm25_in_blocks_and_from_a_stored_index(spark, texts, monkeypatch):
    rows = [(1, "Red fox fox"), (2, "dog sleeps"), (3, "it's a fox"), (4, "10.5 red-ish and"), (5, None), (6, "and the dog")]
    q = spark.createDataFrame(rows, "query_id int, text string")
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9), r.matched_terms) for r in df.collect())
    whole = key(keyword.search(texts, q, 3))
    for i, t in rows[:4]:
        want = brute(t, [*DOCS, None])
        got = {c: s for j, _, c, s, _ in key(keyword.search(texts, q, 10)) if j == i}
        assert got == {c: round(s, 9) for c, s in want.items()}
    monkeypatch.setattr(keyword, "BLOCK_CELLS", 5)
    assert key(keyword.search(texts, q, 3)) == whole
    stored = keyword.index(texts.repartition(2))
    assert keyword.validate(stored) == [] and key(keyword.search(None, q, 3, indexed=stored)) == whole
    dog = texts["text"].contains("dog")
    assert key(keyword.search(texts, q, 3, where=dog, indexed=stored)) == key(keyword.search(texts, q, 3, where=dog)) != whole
    assert keyword.search(texts, q, 0).count() == 0 == keyword.search(texts.limit(0), q, 3).count()
    assert keyword.validate(stored.unionByName(stored.limit(1))) == ["chunk ids are distinct"]


def test_statistics_ignore_filter_and_scope(spark, texts):
    q = spark.createDataFrame([(1, "fox")], "query_id long, text string")
    whole = {r.chunk_id: r.score for r in keyword.search(texts, q, 10).collect()}
    some = keyword.search(texts, q, 10, where=texts["chunk_id"] == 1).collect()
    scoped = keyword.search(texts, q, 10, scope=spark.createDataFrame([(1,)], "chunk_id long")).collect()
    assert [(r.chunk_id, r.score) for r in some] == [(1, whole[1])] == [(r.chunk_id, r.score) for r in scoped]


def hits(spark, rows, terms=False):
    schema = "query_id long, chunk_id long, score double, rank long" + (", matched_terms string" if terms else "")
    return spark.createDataFrame(rows, schema)


def test_fusion(spark):
    v = hits(spark, [(1, 10, 0.9, 1), (1, 11, 0.5, 2), (1, 12, 0.1, 3)])
    k = hits(spark, [(1, 11, 4.0, 1, "a"), (1, 13, 4.0, 2, "b")], True)
    got = {r.chunk_id: r.score for r in hybrid.fuse(v, k, 10).collect()}
    assert got == pytest.approx({10: 0.6, 11: 0.3 + 0.4, 12: 0.0, 13: 0.4})
    rrf = hybrid.fuse(v, k, 2, HybridWeights.reciprocal(60)).orderBy("rank").collect()
    assert [r.chunk_id for r in rrf] == [11, 10]
    assert rrf[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert [r.chunk_id for r in hybrid.fuse(v, None, 5, HybridWeights.alpha(1)).orderBy("rank").collect()] == [10, 11, 12]
    for bad in (lambda: HybridWeights.alpha(1.5), lambda: HybridWeights(0, 0).check(), lambda: HybridWeights.reciprocal(0), lambda: HybridWeights(-1, 1).check()):
        with pytest.raises(InvalidQuery):
            bad()


def test_metrics(spark):
    runs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, doc_id long, rank long")
    qrels = spark.createDataFrame([(1, 11, 2), (1, 12, 0), (1, 14, 1), (2, 10, 0), (3, 1, 1)], "query_id long, doc_id long, grade int")
    got = {r.query_id: r for r in metrics.per_query(runs, qrels, 3).collect()}
    assert got[1].ndcg == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert (got[1].recall, got[1].precision, got[1].mrr, got[1].ap) == pytest.approx((0.5, 1 / 3, 0.5, 0.25))
    assert got[1].judged == pytest.approx(2 / 3)
    assert (got[2].ndcg, got[2].recall) == (0.0, 0.0) and (got[3].recall, got[3].judged) == (0.0, 0.0)
    assert {r.query_id: r.ndcg for r in metrics.per_query(runs, qrels, 3, empty=1.0).collect()}[2] == 1.0
