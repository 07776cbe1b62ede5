"""Fusion of a vector ranking and a keyword ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.model import HybridWeights
from millrace.operators.vectors import DIGITS

#: Width of scores below which a list counts as flat: the step of 32-bit floats at 1.
FLAT = 1.1920929e-07


def min_max(ranked: DataFrame, name: str) -> DataFrame:
    """Scores of one truncated list per query, scaled to 0..1; a flat list gives 1, a score that is not finite null."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    finite = ~(F.isnan("score") | (F.abs("score") == float("inf")))
    value = F.when(finite, F.when(high - low <= FLAT, 1.0).otherwise((F.col("score") - low) / (high - low)))
    return ranked.withColumn(name, value)


def fuse(vector_hits: DataFrame | None, keyword_hits: DataFrame | None, k: int, weights: HybridWeights = HybridWeights()) -> DataFrame:
    """query_id, chunk_id, score, rank with the trace: ranks, scaled scores and matched terms of both sides.

    A source whose weight is 0 may be None and takes no part. A missing side
    counts 0. Order: score, vector rank, keyword rank, id.
    """
    weights.check()
    sides = []
    if vector_hits is not None and weights.vector > 0:
        v = min_max(vector_hits, "vector_norm")
        sides.append(v.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), "vector_norm"))
    if keyword_hits is not None and weights.keyword > 0:
        w = min_max(keyword_hits, "keyword_norm")
        sides.append(w.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"), "keyword_norm", "matched_terms"))
    joined = sides[0] if len(sides) == 1 else sides[0].join(sides[1], ["query_id", "chunk_id"], "full_outer")
    for name, kind in (("vector_rank", "long"), ("vector_norm", "double"), ("keyword_rank", "long"), ("keyword_norm", "double"), ("matched_terms", "string")):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(kind))
    zero = F.lit(0.0)
    if weights.rrf_k is not None:
        part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(weights.rrf_k) + F.col(c)), zero)
        score = part("vector_rank") + part("keyword_rank")
        joined = joined.withColumn("vector_norm", F.lit(None).cast("double")).withColumn("keyword_norm", F.lit(None).cast("double"))
    else:
        score = weights.vector * F.coalesce("vector_norm", zero) + weights.keyword * F.coalesce("keyword_norm", zero)
    joined = joined.withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), "chunk_id")
    return joined.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def one_per_document(hits: DataFrame, document: str) -> DataFrame:
    """The best chunk of every document, ranked anew, with the number of chunks collapsed into it."""
    own = Window.partitionBy("query_id", document)
    best = hits.withColumn("_n", F.row_number().over(own.orderBy("rank"))).withColumn("collapsed", F.count("*").over(own) - 1).filter("_n = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")).drop("_n")


def projected_to_depth(hits: DataFrame, document: str, depth: int) -> DataFrame:
    """One row per document up to depth, counting only duplicates that stand before the last document taken."""
    seen = Window.partitionBy("query_id", document).orderBy("rank")
    first = hits.withColumn("_first", (F.row_number().over(seen) == 1).cast("int"))
    scan = Window.partitionBy("query_id").orderBy("rank")
    first = first.withColumn("_docs", F.sum("_first").over(scan))
    taken = first.filter((F.col("_docs") < depth) | ((F.col("_docs") == depth) & (F.col("_first") == 1)))
    dup = taken.groupBy("query_id").agg(F.sum(1 - F.col("_first")).alias("duplicates"))
    return taken.filter("_first = 1").join(dup, "query_id").withColumn("rank", F.col("_docs").cast("long")).drop("_first", "_docs")


def canonical_ties(hits: DataFrame, record: str, key: str) -> DataFrame:
    """Ranks anew with ties of score broken by (record, chunk key)."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), record, key)
    return hits.withColumn("rank", F.row_number().over(order).cast("long"))
