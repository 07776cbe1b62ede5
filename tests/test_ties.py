"""Rows that a query's SQL leaves in any order: the query takes one of them, the same whatever the order of the input."""

import pytest

from millrace.plans import catalog


@pytest.mark.parametrize("step", [1, -1])
def test_lines_of_one_price_and_number_rank_by_part(spark, tmp_path, step):
    lines = [(7, part, 1, price, flag) for part, price, flag in [(1, 9.0, "A"), (2, 9.0, "A"), (3, 9.0, "B"), (4, 1.0, "B")]]
    rows = spark.createDataFrame(lines[::step], "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_returnflag string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.k: (r.supporting, r.complete) for r in catalog.queries()["metric_evidence_cutoffs"](spark, str(tmp_path)).collect()}
    assert got == {2: (1.0, 1), 5: (1.0, 1)}
