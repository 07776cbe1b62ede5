"""Walks over more customers than the default and the greatest limits of a traversal, against the queries' SQL."""

import pytest

from millrace.model import InvalidQuery, TraversalLimits, TraversalStep
from millrace.plans import catalog

#: One region and segment hold more than the 100,000 results and states that a limit can allow.
MANY = 100_100
QUERIES = [
    "graph_truncation",
    "graph_traverse_optional",
    "graph_trace",
    "graph_scoped_vector",
    "graph_scoped_hybrid",
    "graph_scoped_bm25",
    "graph_scope_project",
    "graph_path_edges",
    "graph_candidates",
]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Tables with customers of one region, the last of which in the order of nodes own the documents and vectors."""
    duckdb = pytest.importorskip("duckdb")
    d, con = str(tmp_path_factory.mktemp("wide")), duckdb.connect()
    at = MANY - 200  # nodes are in the order of their names, so 99900 to 99999 come last
    for name, sql in {
        "region": "SELECT 0 AS r_regionkey, 'ALL' AS r_name",
        "nation": "SELECT i::INT AS n_nationkey, 'N' || i AS n_name, 0 AS n_regionkey FROM range(2) t(i)",
        "customer": f"SELECT i AS c_custkey, (i // {MANY // 2 + 1})::INT AS c_nationkey, 'ONE' AS c_mktsegment FROM range({MANY}) t(i)",
        "supplier": "SELECT i AS s_suppkey, 0 AS s_nationkey FROM range(1) t(i)",
        "orders": "SELECT i AS o_orderkey, i AS o_custkey FROM range(1) t(i)",
        "documents": f"SELECT {at} + i AS doc_id, 'word' || i || ' and word' || (i % 7) AS text, CASE WHEN i % 2 = 0 THEN 'en' ELSE 'de' END AS lang, 's' AS source, 20::BIGINT AS n_chars FROM range(100) t(i) UNION ALL SELECT i, 'and so', 'en', 's', 6 FROM range(5) t(i)",
        "embeddings": f"SELECT {at} + i AS vec_id, [cos(i), sin(i), i / 100]::FLOAT[] AS embedding, 0 AS label FROM range(100) t(i)",
        "benchmark": f"SELECT {at} + 50 + i AS item_id, 'and word' || i || ' of word' || (i * 2) AS text FROM range(3) t(i)",
    }.items():
        con.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return d, con


@pytest.mark.parametrize("name", QUERIES)
def test_walks_are_whole(spark, wide, name):
    d, con = wide
    found = catalog.queries()[name](spark, d)
    cols = sorted(found.columns)
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({catalog.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple(map(str, r)))
    assert plain(found.select(cols).collect()) == plain(want)


def test_no_limits_but_those_named():
    assert TraversalLimits.only() == TraversalLimits(None, None, None, None)
    assert TraversalLimits.only(max_results=7) == TraversalLimits(None, None, 7, None)
    TraversalLimits.only().check([TraversalStep("p")])
    with pytest.raises(InvalidQuery):
        TraversalLimits.only(max_results=0).check([TraversalStep("p")])
    with pytest.raises(TypeError):
        TraversalLimits.only(max_rows=1)
