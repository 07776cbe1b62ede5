import pytest

from millrace.database import GraphDatabase, Index, Pipeline, best_per_record
from millrace.model import DimensionMismatch, GraphSchema, HybridWeights, InvalidQuery, MillraceError, Relationship, StaleScope, TraversalStep


@pytest.fixture(scope="module")
def index(spark):
    i = Index(spark, 2, encoding="f32")
    i = i.add("a", [("k1", "red fox", [1.0, 0.0], {"page": 1}), ("k2", "slow dog", [0.0, 1.0], {"page": 2, "lang": "de"})], {"lang": "en"})
    return i.add("b", [("k1", "red dog", [0.6, 0.8], {})], {"lang": "en"})


def keys(hits):
    return [(r.record_id, r.chunk_key) for r in hits.collect()]


def test_searches(index):
    assert keys(index.search([1.0, 0.0], 2)) == [("a", "k1"), ("b", "k1")]
    assert keys(index.search([1.0, 0.0], 5, {"lang": "de"})) == [("a", "k2")]
    assert keys(index.keyword_search("dog", 5)) == [("a", "k2"), ("b", "k1")]
    assert keys(index.hybrid_search("fox", [0.0, 1.0], 1, HybridWeights.alpha(0.0))) == [("a", "k1")]
    assert set(keys(index.hybrid_search("fox", [0.0, 1.0], 3))) == {("a", "k1"), ("a", "k2"), ("b", "k1")}
    assert [r.record_id for r in best_per_record(index.search([1.0, 0.0], 3)).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(DimensionMismatch):
        index.search([1.0], 0)


def test_scopes_and_changes(index):
    s = index.scope({"lang": "en"})
    assert keys(index.search([0.0, 1.0], 5, scope=s)) == [("b", "k1"), ("a", "k1")]
    assert keys(index.identities(s)) == [("a", "k1"), ("b", "k1")]
    assert keys(index.identities(index.scope({"page": 1}, s))) == [("a", "k1")]
    later, n = index.delete("a")
    assert n == 2 and keys(later.search([1.0, 0.0], 5)) == [("b", "k1")]
    with pytest.raises(StaleScope):
        later.search([1.0, 0.0], 5, scope=s)
    small, dead = later.compact()
    assert dead == 2 and small.counts()["chunks"] == 1
    with pytest.raises(DimensionMismatch):
        index.add("c", [("k", "t", [1.0], {})])
    with pytest.raises(InvalidQuery):
        Index(index.spark, 2, metric="l2")


def test_save_and_load(index, tmp_path):
    index.save(str(tmp_path / "x"))
    back = Index.load(index.spark, str(tmp_path / "x"))
    assert back.counts() == index.counts() and keys(back.search([1.0, 0.0], 2)) == [("a", "k1"), ("b", "k1")]
    assert keys(back.add("z", [("k", "new", [2.0, 0.0], {})]).search([1.0, 0.0], 1)) == [("z", "k")]


def test_graph_database(index):
    spark = index.spark
    schema = GraphSchema({"Document": "Doc"}, [Relationship("cites", "Doc", "Doc", ("to",), "many", missing="omit", inverse="cited_by")], {"Doc": [("name",)]}, "Chunk", "owns", "part_of")
    refs = spark.createDataFrame([("a", {"to": ["b", "zz"]}), ("b", {"to": []})], "record_id string, refs map<string, array<string>>")
    props = spark.createDataFrame([("Doc", "name", "str", "first", "Doc:a")], "node_type string, path string, kind string, value string, node string")
    db = GraphDatabase.build(index, refs, schema, props)
    assert db.diagnostics.count() == 1
    cited = db.query([TraversalStep("cites")], ids=["Doc:a"])
    assert [r.node for r in cited.collect()] == ["Doc:b"]
    assert keys(db.search([1.0, 0.0], cited)) == [("b", "k1")]
    own = db.query([TraversalStep("owns")], node_type="Doc", path=("name",), values=["first"])
    assert keys(db.keyword_search("dog", own)) == [("a", "k2")]
    both = db.query([TraversalStep("cites", min_hops=0)], ids=["Doc:a"])
    assert set(keys(db.hybrid_search("red", [1.0, 0.0], both, 3))) == {("a", "k1"), ("a", "k2"), ("b", "k1")}
    assert keys(db.index.identities(db.candidates(both, {"lang": "de"}))) == [("a", "k2")]
    stale = GraphDatabase(index.delete("b")[0], schema, db.nodes, db.edges, db.properties, db.diagnostics, db.generation)
    with pytest.raises(MillraceError):
        stale.candidates(cited)
    with pytest.raises(InvalidQuery):
        db.query([TraversalStep("cites")])


def test_pipeline(spark):
    embedder = lambda texts: [[float(t.count("a")), float(len(t))] for t in texts]
    docs = spark.createDataFrame([("d1", "One sentence. Another banana sentence."), ("d2", "  ")], "record_id string, text string")
    p = Pipeline(Index(spark, 2, encoding="f32"), embedder, 20, 0).add(docs)
    rows = p.search("banana", 5, HybridWeights.alpha(0.0)).collect()
    assert [r.text for r in rows] == ["Another banana"] and rows[0].metadata["start"].i == 14
    assert p.index.counts()["records"] == 2
