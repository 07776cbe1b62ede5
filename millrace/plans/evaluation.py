"""Evaluation plans: run matrices, parameter grids, gates, and registered queries over runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.model import MillraceError
from millrace.operators import hybrid, metrics
from millrace.plans import search_queries as sq
from millrace.session import table


@dataclass(frozen=True)
class Run:
    """One cell of the matrix: what is searched, how it is ranked, how vectors are stored, and who chose the seeds."""

    name: str
    scope: str  # whole or graph
    ranking: str  # semantic, weighted or selection
    encoding: str
    lane: str = "explicit"


def run_matrix(lanes: tuple[str, ...] = ("explicit", "derived")) -> list[Run]:
    """A to C over the whole corpus, D the graph's selection alone, E to G as A to C inside it, for every seed lane."""
    kinds = [("semantic", "f32"), ("semantic", "i8"), ("weighted", "i8")]
    whole = [Run(n, "whole", *k) for n, k in zip("ABC", kinds)]
    scoped = [Run(n, "graph", *k, lane) for lane in lanes for n, k in zip("DEFG", [("selection", "none"), *kinds])]
    return whole + scoped


def grid() -> list[dict]:
    """Thirty-six candidates: four alphas, three depths of each source."""
    return [{"alpha": a, "vector_k": v, "keyword_k": w} for a in (0.4, 0.5, 0.6, 0.7) for v in (25, 50, 100) for w in (25, 50, 100)]


def best_candidate(scored: DataFrame) -> DataFrame:
    """The candidate first by quality (complete evidence, NDCG, MAP, recall, MRR), then by cost: both depths added, the deeper one, and the candidate's canonical JSON decide ties."""
    depth = F.col("vector_k") + F.col("keyword_k")
    quality = [F.desc(c) for c in ("complete_evidence", "ndcg", "map", "recall", "mrr")]
    return scored.orderBy(*quality, depth.asc(), F.greatest("vector_k", "keyword_k").asc(), candidate_json().asc()).limit(1)


def candidate_json():
    """Sorted keys and shortest numbers, as candidates are written."""
    number = lambda c: F.col(c).cast("string")
    return F.concat(F.lit('{"alpha":'), number("alpha"), F.lit(',"keyword_candidate_limit":'), number("keyword_k"), F.lit(',"vector_candidate_limit":'), number("vector_k"), F.lit("}"))


def check_gates(values: dict[str, float], gates: dict[str, tuple[str, float]]) -> list[str]:
    """Names of gates that do not hold; a gate without a value is an error."""
    lost = sorted(set(gates) - set(values))
    if lost:
        raise MillraceError(f"no value for gate {lost[0]}")
    return sorted(k for k, (op, bound) in gates.items() if not metrics.gate(values[k], op, bound))


def lifecycle_violations(hits: DataFrame, forbidden: DataFrame, required: DataFrame) -> DataFrame:
    """Hits on forbidden documents (query_id, doc_id), and hits whose text lacks what a replacement must hold (doc_id, contains)."""
    a = hits.join(forbidden, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", F.lit("forbidden document").alias("fault"))
    b = hits.join(required, "doc_id").filter(~F.contains("text", F.col("contains"))).select("query_id", "doc_id", F.lit("stale text").alias("fault"))
    return a.unionByName(b)


# ---- registered


def micro_recall(spark, d):
    """Pooled recall at 10, and its mean with counts of queries by status."""
    truth = sq.qrels_of(spark, d)
    hits = sq.run_of(spark, d).filter("rank <= 10").join(truth, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hit"))
    per = truth.groupBy("query_id").agg(F.count("*").alias("total")).join(hits, "query_id", "left").fillna(0)
    per = per.withColumn("recall", F.col("hit") / F.col("total")).withColumn("status", F.when(F.col("total") < 3, "undefined").otherwise("valid"))
    pooled, mean = metrics.micro(per, "hit", "total"), metrics.macro_with_status(per, "recall", "status")
    return pooled.crossJoin(mean).select(F.round("micro", 6).alias("micro"), F.round("mean", 6).alias("mean"), "valid", "undefined")


MICRO_SQL = f"""
WITH {sq.QUALITY_CTE},
p AS (SELECT query_id, count(*) AS total FROM qrels GROUP BY query_id), h AS (SELECT query_id, coalesce(sum(rel::INT), 0) AS hit FROM hits GROUP BY query_id)
SELECT round(sum(hit) / sum(total), 6) AS micro, round(avg(hit / total) FILTER (total >= 3), 6) AS mean, count(*) FILTER (total >= 3) AS valid, count(*) FILTER (total < 3) AS undefined FROM p JOIN h ON p.query_id = h.query_id
"""


def lost_documents(spark, d):
    """Relevant documents in the first ten that the first three lack."""
    run, truth = sq.run_of(spark, d), sq.qrels_of(spark, d)

    def found(k):
        rel = run.filter(F.col("rank") <= k).join(truth, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
        return truth.select("query_id").distinct().join(rel, "query_id", "left").fillna(0)

    return metrics.lost(found(10), found(3), "n").select("query_id", F.col("lost").cast("long").alias("lost"))


LOST_SQL = f"WITH {sq.QUALITY_CTE} SELECT query_id, (count(*) FILTER (rel) - count(*) FILTER (rel AND rank <= 3))::BIGINT AS lost FROM hits GROUP BY query_id"


def recall_buckets(spark, d):
    """Queries by how much of their truth the first ten hold."""
    m = metrics.per_query(sq.run_of(spark, d), sq.qrels_of(spark, d), 10)
    name = metrics.bucket(F.round("recall", 9), [0.0, 0.1, 0.5], ["none", "little", "half", "most"])
    return m.groupBy(name.alias("bucket")).agg(F.count("*").alias("queries"))


BUCKETS_SQL = f"WITH {sq.QUALITY_CTE} SELECT CASE WHEN round(recall, 9) <= 0 THEN 'none' WHEN round(recall, 9) <= 0.1 THEN 'little' WHEN round(recall, 9) <= 0.5 THEN 'half' ELSE 'most' END AS bucket, count(*) AS queries FROM m GROUP BY 1"


def by_category(spark, d):
    """Mean quality by the label that a query asks for."""
    m = metrics.per_query(sq.run_of(spark, d), sq.qrels_of(spark, d), 10)
    kinds = sq.vectors_of(spark, d).select(F.col("chunk_id").alias("query_id"), F.col("label").alias("category"))
    out = metrics.macro(m.join(kinds, "query_id"), "category")
    return out.select("category", "queries", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))


CATEGORY_SQL = f"WITH {sq.QUALITY_CTE} SELECT label AS category, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM m JOIN embeddings ON vec_id = query_id GROUP BY label"


def depth_projection(spark, d):
    """Sources in ranked order until five are found, with the duplicates passed over on the way."""
    hits = hybrid.fuse(*sq._hybrid_inputs(spark, d), sq.DEPTH).join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    return hybrid.projected_to_depth(hits, "source", 5).select("query_id", "chunk_id", "source", "rank", F.col("duplicates").cast("long").alias("duplicates"))


DEPTH_SQL = f"""
WITH {sq.fill(sq.HYBRID_CTE, score=sq.WEIGHTED, side="true")},
h AS (SELECT r.query_id, chunk_id, source, rank, (row_number() OVER (PARTITION BY r.query_id, source ORDER BY rank) = 1)::INT AS first FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 50),
s AS (SELECT *, sum(first) OVER (PARTITION BY query_id ORDER BY rank) AS docs FROM h),
t AS (SELECT * FROM s WHERE docs < 5 OR (docs = 5 AND first = 1))
SELECT query_id, chunk_id, source, docs::BIGINT AS rank, (sum(1 - first) OVER (PARTITION BY query_id))::BIGINT AS duplicates FROM t QUALIFY first = 1
"""


def inspection(spark, d):
    """What a collection holds: texts, distinct texts, and titles whose texts conflict."""
    docs = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("h"), F.substring("text", 1, 20).alias("title"))
    titles = docs.groupBy("lang", "title").agg(F.countDistinct("h").alias("n"))
    conflicts = titles.groupBy("lang").agg(F.count("*").alias("titles"), F.sum((F.col("n") > 1).cast("long")).alias("conflicting"))
    return docs.groupBy("lang").agg(F.count("*").alias("texts"), F.countDistinct("h").alias("distinct_texts")).join(conflicts, "lang")


INSPECTION_SQL = """
WITH d AS (SELECT lang, sha256(text) AS h, text[1:20] AS title FROM documents), t AS (SELECT lang, title, count(DISTINCT h) AS n FROM d GROUP BY ALL),
c AS (SELECT lang, count(*) AS titles, count(*) FILTER (n > 1) AS conflicting FROM t GROUP BY lang)
SELECT d.lang, count(*) AS texts, count(DISTINCT h) AS distinct_texts, any_value(titles) AS titles, any_value(conflicting) AS conflicting FROM d JOIN c ON d.lang = c.lang GROUP BY d.lang
"""


def cutoffs(spark, d):
    """Recall and precision at every cutoff of the depth searched."""
    run, truth = sq.run_of(spark, d), sq.qrels_of(spark, d)
    out = None
    for k in (c for c in metrics.CUTOFFS if c <= 100):
        m = metrics.per_query(run, truth, k).agg(F.lit(k).alias("k"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"))
        out = m if out is None else out.unionByName(m)
    return out


CUTOFFS_SQL = """
WITH q AS (SELECT vec_id AS query_id, label AS want, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, want = label AS rel, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(qv, embedding::DOUBLE[]), 9) DESC, vec_id) AS rank FROM q, embeddings),
k AS (SELECT unnest([1, 3, 5, 10, 100])::INT AS k),
p AS (SELECT k, query_id, count(*) FILTER (rel AND rank <= k) AS hit, count(*) FILTER (rel) AS relevant FROM s, k GROUP BY ALL)
SELECT k, round(avg(hit / relevant), 6) AS recall, round(avg(hit / k), 6) AS precision FROM p GROUP BY k
"""


def running_peak(spark, d):
    """Running total of each customer's orders with the place where it first passes a million."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, d, "orders").withColumn("run", F.sum("o_totalprice").over(w)).withColumn("n", F.count("*").over(w))
    return o.filter("run > 1000000").groupBy("o_custkey").agg(F.min("n").alias("orders"))


RUNNING_SQL = "SELECT o_custkey, min(n) AS orders FROM (SELECT o_custkey, sum(o_totalprice) OVER w AS run, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE run > 1000000 GROUP BY o_custkey"


def queries() -> dict:
    return {
        "metric_micro": micro_recall,
        "metric_lost_documents": lost_documents,
        "metric_recall_buckets": recall_buckets,
        "metric_by_category": by_category,
        "metric_cutoffs": cutoffs,
        "hybrid_depth_projection": depth_projection,
        "dataset_inspection": inspection,
        "running_total": running_peak,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "metric_micro": MICRO_SQL,
        "metric_lost_documents": LOST_SQL,
        "metric_recall_buckets": BUCKETS_SQL,
        "metric_by_category": CATEGORY_SQL,
        "metric_cutoffs": CUTOFFS_SQL,
        "hybrid_depth_projection": DEPTH_SQL,
        "dataset_inspection": INSPECTION_SQL,
        "running_total": RUNNING_SQL,
    }
