"""Ranking quality: per query, over queries, and between runs.

runs: query_id, doc_id, rank. qrels: query_id, doc_id, grade; a grade above 0
is relevant. Every metric returns one row per query of qrels, also for queries
that found nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import numbered

CUTOFFS = (1, 3, 5, 10, 100, 1000)


def _judged(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    return runs.select("query_id", "doc_id", "rank").join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")


def per_query(runs: DataFrame, qrels: DataFrame, k: int, empty: float = 0.0) -> DataFrame:
    """ndcg, recall, precision, success, mrr, ap, judged at k.

    empty is the ndcg and recall of a query without relevant documents; both
    conventions, 0 and 1, are in use.
    """
    ideal_rank = Window.partitionBy("query_id").orderBy(F.col("grade").desc())
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + F.lit(1.0))
    truth = qrels.withColumn("_r", F.row_number().over(ideal_rank)).groupBy("query_id").agg(
        F.sum(F.when((F.col("_r") <= k) & (F.col("grade") > 0), gain(F.col("grade"), F.col("_r"))).otherwise(0.0)).alias("idcg"),
        F.sum((F.col("grade") > 0).cast("long")).alias("relevant"),
    )
    hits = _judged(runs, qrels).filter(F.col("rank") <= k)
    hits = hits.withColumn("rel", (F.coalesce("grade", F.lit(0)) > 0).cast("long"))
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("seen", F.sum("rel").over(running))
    found = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rel") == 1, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum("rel").alias("hit"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.col("grade").isNotNull().cast("long")).alias("judged"),
        F.count("*").alias("depth"),
    )
    j = truth.join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = F.col("relevant") > 0
    return j.select(
        "query_id",
        F.when(some, zero(F.col("dcg") / F.col("idcg"))).otherwise(F.lit(empty)).alias("ndcg"),
        F.when(some, zero(F.col("hit") / F.col("relevant"))).otherwise(F.lit(empty)).alias("recall"),
        zero(F.col("hit") / F.lit(float(k))).alias("precision"),
        zero((F.col("hit") > 0).cast("double")).alias("success"),
        zero(F.lit(1.0) / F.col("first")).alias("mrr"),
        F.when(some, zero(F.col("precisions") / F.col("relevant"))).otherwise(F.lit(0.0)).alias("ap"),
        zero(F.col("judged") / F.least(F.lit(k), F.col("depth"))).alias("judged"),
    )


METRICS = ("ndcg", "recall", "precision", "success", "mrr", "ap", "judged")


def macro(values: DataFrame, by: str | None = None) -> DataFrame:
    """Mean of every metric over queries, in all or by a column."""
    keys = [by] if by else []
    return values.groupBy(*keys).agg(F.count("*").alias("queries"), *(F.avg(m).alias(m) for m in METRICS))


def macro_with_status(values: DataFrame, value: str, status: str) -> DataFrame:
    """Mean over valid queries, with the count of every status."""
    kinds = ("valid", "undefined", "not_applicable", "invalid", "excluded")
    return values.agg(F.avg(F.when(F.col(status) == "valid", F.col(value))).alias("mean"), *(F.sum((F.col(status) == s).cast("long")).alias(s) for s in kinds))


def micro(values: DataFrame, hit: str, total: str) -> DataFrame:
    """Pooled ratio; null where nothing was asked for."""
    return values.agg((F.sum(hit) / F.nullif(F.sum(total), F.lit(0))).alias("micro"))


def paired(base: DataFrame, other: DataFrame, metric: str, absolute: bool = False) -> DataFrame:
    """Wins, ties and losses of `other` over `base`, with means and deltas; the relative delta divides by the base mean or its magnitude."""
    j = base.select("query_id", F.col(metric).alias("a")).join(other.select("query_id", F.col(metric).alias("b")), "query_id")
    d = F.round(F.col("b") - F.col("a"), 12)
    out = j.agg(F.avg("a").alias("base"), F.avg("b").alias("other"), F.sum((d > 0).cast("long")).alias("wins"), F.sum((d == 0).cast("long")).alias("ties"), F.sum((d < 0).cast("long")).alias("losses"))
    over = F.abs("base") if absolute else F.col("base")
    return out.withColumn("delta", F.col("other") - F.col("base")).withColumn("relative", F.col("delta") / F.nullif(over, F.lit(0.0)))


def lost(base: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """What base found of a count and other did not, per query."""
    j = base.select("query_id", F.col(column).alias("a")).join(other.select("query_id", F.col(column).alias("b")), "query_id")
    return j.select("query_id", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("lost"))


def overlap(reference: DataFrame, run: DataFrame, k: int, empty: float = 1.0) -> DataFrame:
    """Share of the reference's top k that a run's top k holds, whether the first agrees, and whether the order does."""
    a = reference.filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("r"))
    b = run.filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("s"))
    j = a.join(b, ["query_id", "doc_id"], "left")
    return j.groupBy("query_id").agg(
        F.coalesce(F.count("s") / F.count("r"), F.lit(empty)).alias("recall"),
        F.max(((F.col("r") == 1) & (F.col("s") == 1)).cast("long")).alias("top1"),
        F.min(F.coalesce((F.col("r") == F.col("s")).cast("long"), F.lit(0))).alias("ordered"),
    )


def nearest_rank(values: DataFrame, value: str, shares: tuple[float, ...], by: str | None = None) -> DataFrame:
    """Percentiles by nearest rank: the value at place ceil(share * n)."""
    keys = [by] if by else []
    return values.groupBy(*keys).agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in shares))


def evidence(alternatives: DataFrame, found: DataFrame) -> DataFrame:
    """Best evidence set per query: alternatives (query_id, set_id, doc_id), found (query_id, doc_id).

    The set with the greatest share found wins, then more found, then the
    smaller set, then the lesser id.
    """
    j = alternatives.join(found.select("query_id", "doc_id", F.lit(1).alias("_hit")).distinct(), ["query_id", "doc_id"], "left")
    sets = j.groupBy("query_id", "set_id").agg(F.count("_hit").alias("matched"), F.count("*").alias("required"))
    order = Window.partitionBy("query_id").orderBy((F.col("matched") / F.col("required")).desc(), F.col("matched").desc(), "required", "set_id")
    best = sets.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return best.select("query_id", "set_id", "matched", "required", (F.col("matched") / F.col("required")).alias("recall"), (F.col("matched") == F.col("required")).cast("long").alias("complete"))


def evidence_at(alternatives: DataFrame, ranked: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per query and cutoff: supporting (share of the best evidence set found) and complete, over the first distinct documents of a ranking (query_id, doc_id, rank)."""
    first = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    place = first.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))
    out = None
    for k in cutoffs:
        best = evidence(alternatives, place.filter(F.col("_n") <= k)).select("query_id", F.lit(k).alias("k"), F.col("recall").alias("supporting"), "complete")
        out = best if out is None else out.unionByName(best)
    return out


def path_accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, path_accuracy: 1 if any expected path (query_id, path as an array of steps) is among those found, else 0; queries without expected paths have no row."""
    key = lambda df: df.select("query_id", F.to_json("path").alias("_p")).distinct()
    hit = key(found).withColumn("_hit", F.lit(1))
    return key(expected).join(hit, ["query_id", "_p"], "left").groupBy("query_id").agg(F.max(F.coalesce("_hit", F.lit(0))).cast("long").alias("path_accuracy"))


TRUNCATIONS = ("max_hops", "max_results", "max_visited", "max_bytes")


def candidates(report: DataFrame, projected: DataFrame, eligible: DataFrame) -> DataFrame:
    """Per query of a walk's report: how far it narrowed the search, and why it stopped.

    projected and eligible are (query_id, chunk_id): chunks of what the walk
    reached, before and after the metadata filter. reduction_ratio is eligible to
    projected, null where nothing was projected.
    """
    count = lambda df, name: df.groupBy("query_id").agg(F.countDistinct("chunk_id").alias(name))
    j = report.join(count(projected, "projected"), "query_id", "left").join(count(eligible, "eligible"), "query_id", "left").fillna(0, ["projected", "eligible"])
    return j.select(
        "query_id",
        "projected",
        "eligible",
        (F.col("eligible") / F.nullif(F.col("projected"), F.lit(0))).alias("reduction_ratio"),
        (F.col("projected") == 0).cast("long").alias("empty_scope"),
        F.col("truncated").isNotNull().cast("long").alias("truncated"),
        *(F.coalesce((F.col("truncated") == t).cast("long"), F.lit(0)).cast("long").alias(f"truncated_{t}") for t in TRUNCATIONS),
    )


def index_percentile(values: DataFrame, value: str, shares: tuple[int, ...], by: str | None = None) -> DataFrame:
    """Percentiles at the place (n - 1) * share / 100, cut to an integer: another rule than nearest rank."""
    keys = [by] if by else []
    n = values.groupBy(*keys).agg(F.count(value).alias("_c"))
    some = values.filter(F.col(value).isNotNull())
    placed = some.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1) if keys else numbered(some, [value], 0, "_r")
    j = placed.join(n, keys) if keys else placed.crossJoin(F.broadcast(n))
    at = lambda p: F.floor((F.col("_c") - 1) * p / 100)
    return j.groupBy(*keys).agg(*(F.max(F.when(F.col("_r") == at(p), F.col(value))).alias(f"p{p}") for p in shares))


def upper_median(values: DataFrame, value: str, by: str, *ties: str) -> DataFrame:
    """by, median: the upper of two middle elements."""
    w = Window.partitionBy(by)
    placed = values.filter(F.col(value).isNotNull()).select(by, value, F.row_number().over(w.orderBy(value, *ties)).alias("_r"), F.count("*").over(w).alias("_c"))
    return placed.filter(F.col("_r") == F.floor(F.col("_c") / 2) + 1).select(by, F.col(value).alias("median"))


def half_up(value: Column, digits: int) -> Column:
    """Decimal rounding, halves away from zero, as published figures are written."""
    return F.round(value.cast("decimal(38,12)"), digits).cast(f"decimal(28,{digits})")


def populations(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """population, members, digest: how many keys each set holds, and the SHA-256 of its sorted keys, one a line.

    Sets are named by expressions of the caller's; a digest is made on the
    executors from one sorted list, as it names a query set, which is small.
    """
    out = None
    for name, df in parts.items():
        keys = df.select(F.col(key).cast("string").alias("_k")).distinct()
        row = keys.agg(F.lit(name).alias("population"), F.count("*").alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_list("_k")), "\n"), 256).alias("digest"))
        out = row if out is None else out.unionByName(row)
    return out


def lane_populations(queries: DataFrame) -> dict[str, DataFrame]:
    """Query sets of an evaluation: queries (query_id, explicit, derived, and status of the derived seed)."""
    explicit, derived = queries.filter("explicit"), queries.filter("derived")
    done = derived.filter("status = 'resolved'")
    return {"retrieval": queries, "explicit": explicit, "derived": derived, "successful": done, "intersection": explicit.join(done.select("query_id"), "query_id", "left_semi")}


def paired_slices(base: DataFrame, other: DataFrame, metric: str, slices: DataFrame) -> DataFrame:
    """slice, queries, base, other, delta, wins, ties, losses of `other` over `base` in every slice (query_id, slice); a query can be in several."""
    j = base.select("query_id", F.col(metric).alias("a")).join(other.select("query_id", F.col(metric).alias("b")), "query_id").join(slices, "query_id")
    d = F.round(F.col("b") - F.col("a"), 12)
    return j.groupBy("slice").agg(F.count("*").alias("queries"), F.avg("a").alias("base"), F.avg("b").alias("other"), F.avg(d).alias("delta"), *(F.sum(t.cast("long")).alias(n) for n, t in (("wins", d > 0), ("ties", d == 0), ("losses", d < 0))))


def gate(value: float, op: str, bound: float) -> bool:
    return {"eq": value == bound, "gte": value >= bound, "lte": value <= bound}[op]


def bucket(value: Column, edges: list[float], names: list[str]) -> Column:
    """The name of the first edge that value does not exceed; the last name beyond all."""
    out = F.lit(names[-1])
    for edge, name in list(zip(edges, names))[::-1]:
        out = F.when(value <= edge, F.lit(name)).otherwise(out)
    return out
