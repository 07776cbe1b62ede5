import pytest
from pyspark.sql import functions as F

from millrace.functions import filters
from millrace.model import METADATA, InvalidFilter, Millis, metadata_map
from pyspark.sql import types as T

ROWS = [
    (1, {"n": 5, "name": "a", "on": True}),
    (2, {"n": 5.0, "name": "b", "on": False}),
    (3, {"n": Millis(5), "zero": -0.0}),
    (4, {"name": "a", "nan": float("nan")}),
    (5, {}),
]


@pytest.fixture(scope="module")
def rows(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("metadata", METADATA)])
    return spark.createDataFrame([(i, metadata_map(m)) for i, m in ROWS], schema)


def ids(df, condition):
    return sorted(r[0] for r in df.filter(condition).collect())


@pytest.mark.parametrize(
    "spec,want",
    [
        ({"n": 5}, [1]),
        ({"n": 5.0}, [2]),
        ({"n": Millis(5)}, [3]),
        ({"n": {"$ne": 5}}, [2, 3, 4, 5]),
        ({"n": {"$gte": 5, "$lte": 5}}, [1, 2, 3]),
        ({"name": {"$in": ["a", "c"]}}, [1, 4]),
        ({"name": {"$in": []}}, []),
        ({"name": {"$gte": 1}}, []),
        ({"n": {"$exists": True}}, [1, 2, 3]),
        ({"zero": 0.0}, [3]),
        ({"nan": float("nan")}, []),
        ({"on": True, "name": "a"}, [1]),
        ({"$or": [{"on": False}, {"name": "a"}]}, [1, 2, 4]),
        ({"$and": []}, [1, 2, 3, 4, 5]),
        ({"$or": []}, []),
        ({"n": {"$gte": 9, "$lte": 1}}, []),
        (None, [1, 2, 3, 4, 5]),
    ],
)
def test_where(rows, spec, want):
    assert ids(rows, filters.where(spec)) == want


@pytest.mark.parametrize("spec", [{}, {"a": {}}, {"a": {"$lt": 1}}, {"$not": []}, {"a": {"$exists": False}}, {"a": {"$gte": "x"}}, {"a": {"$in": 3}}, {"$and": {}}])
def test_errors_come_before_the_plan(rows, spec):
    with pytest.raises(InvalidFilter):
        filters.where(spec)


def test_tree_and_the_stricter_reading(rows):
    node = {"op": "not_equals", "field": "name", "value": {"type": "string", "value": "a"}}
    assert ids(rows, filters.tree(node)) == [2, 3, 5]
    assert ids(rows, filters.judged(node, filters.MapFields())) == [2]
    span = {"op": "range", "field": "n", "lower": {"type": "integer", "value": 1}, "upper": None}
    assert ids(rows, filters.tree(span)) == [1, 2, 3]
    assert ids(rows, filters.judged(span, filters.MapFields())) == [1]


def test_promoted_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = df.filter(filters.where({"v": 6}, filters.ColumnFields({"v": ("v", "int")})))
    assert [r["id"] for r in got.collect()] == [3]
