"""Registered search, filter and quality queries, with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import filters
from millrace.model import HybridWeights
from millrace.operators import hybrid, keyword, metrics, vectors
from millrace.session import table

K = 10


def fill(sql: str, **parts: str) -> str:
    """sql with {name} replaced; other braces, as in patterns, stay."""
    for name, value in parts.items():
        sql = sql.replace("{" + name + "}", value)
    return sql


# ---- tables in their roles


def vectors_of(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark, d) -> DataFrame:
    """Every row whose id is divisible by 100 is a query against all rows."""
    return vectors_of(spark, d).filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def chunks_of(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source", "n_chars")


def text_queries(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", *more)


# ---- vectors

VECTOR_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS cv, label FROM embeddings WHERE {where}),
s AS (SELECT query_id, chunk_id, {score} AS score FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10
"""
DOT = "list_inner_product(cv, qv)"
COSINE = "list_inner_product(cv, qv) / (sqrt(list_inner_product(cv, cv)) * sqrt(list_inner_product(qv, qv)))"

I8_CTE = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS top FROM embeddings),
z AS (SELECT vec_id, label, list_transform(v, lambda x: CASE WHEN top > 0 THEN greatest(-128.0, least(127.0, round(x * (127.0 / top)))) ELSE 0.0 END) AS qv, CASE WHEN top > 0 THEN top / 127.0 ELSE 0.0 END AS scale FROM e)
"""
I8_SQL = f"""
WITH {I8_CTE},
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_inner_product(b.qv, a.qv) * b.scale * a.scale AS score FROM z a, z b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10
"""


def vector_topk(metric: str = "dot", encoding: str = "f32", where: Column | None = None):
    def run(spark, d):
        return _scored(vectors.search(vectors_of(spark, d), vector_queries(spark, d), K, metric=metric, encoding=encoding, where=where))

    return run


def scope_ids(spark, d) -> DataFrame:
    """A scope: vectors whose document is in German or French."""
    return table(spark, d, "documents").filter(F.col("lang").isin("de", "fr")).select(F.col("doc_id").alias("chunk_id"))


def scoped_vector_topk(spark, d):
    return _scored(vectors.search(vectors_of(spark, d), vector_queries(spark, d), K, scope=scope_ids(spark, d)))


def i8_recall(spark, d):
    exact = vectors.search(vectors_of(spark, d), vector_queries(spark, d), K).withColumnRenamed("chunk_id", "doc_id")
    coded = vectors.search(vectors_of(spark, d), vector_queries(spark, d), K, encoding="i8").withColumnRenamed("chunk_id", "doc_id")
    return metrics.overlap(exact, coded, K).select("query_id", F.round("recall", 6).alias("recall"), "top1", "ordered")


I8_RECALL_SQL = f"""
WITH {I8_CTE},
sa AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_inner_product(b.v, a.v) AS score FROM e a, e b WHERE a.vec_id % 100 = 0),
sb AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_inner_product(b.qv, a.qv) * b.scale * a.scale AS score FROM z a, z b WHERE a.vec_id % 100 = 0),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM sa),
rb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS s FROM sb)
SELECT ra.query_id, round(count(rb.s) / count(*), 6) AS recall, max((r = 1 AND coalesce(s, 0) = 1)::BIGINT) AS top1, min(coalesce((r = s)::BIGINT, 0)) AS ordered
FROM ra LEFT JOIN rb ON ra.query_id = rb.query_id AND ra.chunk_id = rb.chunk_id AND rb.s <= 10 WHERE r <= 10 GROUP BY ra.query_id
"""


def quantised(spark, d):
    q = vectors.quantise(F.col("embedding"))
    return vectors_of(spark, d).select("chunk_id", q.alias("z")).select("chunk_id", F.round("z.scale", 9).alias("scale"), F.aggregate("z.q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("total"))


QUANTISED_SQL = f"WITH {I8_CTE} SELECT vec_id AS chunk_id, round(scale, 9) AS scale, list_sum(qv)::BIGINT AS total FROM z"

# ---- filters

EVENT_FIELDS = filters.ColumnFields({"type": ("event_type", "str"), "value": ("value", "float"), "user": ("user_id", "int"), "k": ("k", "int"), "when": ("millis", "ts")})


def events_of(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))


EVENTS_SQL = "WITH e AS (SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k, epoch_ms(ts) AS millis FROM events) SELECT event_id FROM e WHERE "


def filter_query(spec: dict):
    return lambda spark, d: events_of(spark, d).filter(filters.where(spec, EVENT_FIELDS)).select("event_id")


def tree_query(node: dict):
    return lambda spark, d: events_of(spark, d).filter(filters.tree(node, EVENT_FIELDS)).select("event_id")


FILTERS = {
    "filter_eq": ({"type": "click"}, "event_type = 'click'"),
    "filter_ne_missing": ({"k": {"$ne": 7}}, "k IS NULL OR k <> 7"),
    "filter_in": ({"user": {"$in": [1, 5, 9, 13]}}, "user_id IN (1, 5, 9, 13)"),
    "filter_range": ({"value": {"$gte": 10, "$lte": 50.5}}, "value BETWEEN 10 AND 50.5"),
    "filter_exists": ({"k": {"$exists": True}}, "k IS NOT NULL"),
    "filter_all_any": ({"$or": [{"type": "click"}, {"$and": [{"k": {"$gte": 50}}, {"value": {"$lte": 20}}]}]}, "event_type = 'click' OR (k >= 50 AND value <= 20)"),
    "filter_typed_equality": ({"$or": [{"k": 5.0}, {"k": 7}]}, "k = 7"),
    "filter_range_on_string": ({"$or": [{"type": {"$gte": 1}}, {"value": {"$gte": 60}}]}, "value >= 60"),
    "filter_empty_any": ({"$or": [{"$or": []}, {"type": "click"}]}, "event_type = 'click'"),
    "filter_empty_all": ({"$and": []}, "true"),
}
TREE = {"op": "all", "filters": [{"op": "not_equals", "field": "type", "value": {"type": "string", "value": "click"}}, {"op": "range", "field": "value", "lower": {"type": "float", "value": 5}, "upper": None}]}


def metadata_docs(spark, d) -> DataFrame:
    """Documents with tagged metadata in a map."""
    none = {k: F.lit(None).cast(t) for k, t in (("s", "string"), ("i", "long"), ("f", "double"), ("b", "boolean"))}
    value = lambda kind, slot, c: F.struct(F.lit(kind).alias("t"), *((c if k == slot else v).alias(k) for k, v in none.items()))
    return table(spark, d, "documents").select(
        F.col("doc_id"),
        F.map_from_arrays(F.array(F.lit("lang"), F.lit("source"), F.lit("n_chars")), F.array(value("str", "s", F.col("lang")), value("str", "s", F.col("source")), value("int", "i", F.col("n_chars")))).alias("metadata"),
    )


def filter_map(spark, d):
    spec = {"lang": {"$in": ["en", "de"]}, "n_chars": {"$gte": 500.0}, "source": {"$ne": "src0"}, "absent": {"$ne": 1}}
    return metadata_docs(spark, d).filter(filters.where(spec)).select("doc_id")


FILTER_MAP_SQL = "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 500 AND source <> 'src0'"


def document_any_chunk(spark, d):
    """A record satisfies a filter if any of its chunks does."""
    c = table(spark, d, "conversations")
    ok = filters.where({"role": "user", "turn": {"$gte": 2}}, filters.ColumnFields({"role": ("role", "str"), "turn": ("turn", "int")}))
    return c.groupBy("conv_id").agg(F.bool_or(ok).alias("satisfied"))


DOCUMENT_ANY_SQL = "SELECT conv_id, bool_or(role = 'user' AND turn >= 2) AS satisfied FROM conversations GROUP BY conv_id"


def overlap_window(spark, d):
    e = events_of(spark, d).groupBy("user_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return e.select("user_id", filters.windows_overlap(F.col("a"), F.col("b"), 20, 40).alias("overlaps"), filters.window_within(F.col("a"), F.col("b"), 0, 90).alias("within"))


OVERLAP_SQL = "SELECT user_id, min(value) <= 40 AND max(value) >= 20 AS overlaps, min(value) >= 0 AND max(value) <= 90 AS within FROM events GROUP BY user_id"

# ---- keywords

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[''.][\p{L}\p{N}_]+)*')"
BM25_CTE = f"""
c AS (SELECT doc_id AS chunk_id, lang, n_chars, {TOKENS} AS words FROM documents),
stats AS (SELECT count(*) AS n, avg(len(words)) AS average FROM c),
p AS (SELECT term, chunk_id, lang, n_chars, len, count(*) AS tf FROM (SELECT chunk_id, lang, n_chars, len(words) AS len, unnest(words) AS term FROM c) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark)),
parts AS (SELECT query_id, chunk_id, lang, n_chars, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average)) AS part
  FROM qt JOIN p ON qt.term = p.term JOIN df ON df.term = p.term, stats)
"""
KEYWORD_SQL = f"""
WITH {BM25_CTE},
s AS (SELECT query_id, chunk_id, sum(part) AS score, string_agg(term, ',' ORDER BY term) AS matched_terms FROM parts WHERE {{where}} GROUP BY query_id, chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, rank, matched_terms FROM r WHERE rank <= 10
"""


def keyword_topk(where: Column | None = None, scope=None):
    def run(spark, d):
        hits = keyword.search(chunks_of(spark, d), text_queries(spark, d), K, where=where, scope=scope(spark, d) if scope else None)
        return _scored(hits, "matched_terms")

    return run


def long_scope(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("n_chars > 2000").select(F.col("doc_id").alias("chunk_id"))


def term_stats(spark, d):
    return keyword.term_stats(chunks_of(spark, d))


TERM_STATS_SQL = f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM (SELECT term, chunk_id, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term"


def unicode_terms(spark, d):
    words = keyword.tokens(F.col("text"), "unicode")
    return chunks_of(spark, d).select("chunk_id", F.size(words).cast("long").alias("words"))


# ---- hybrid

DEPTH = 50


def _hybrid_inputs(spark, d):
    """Vector and keyword rankings for the benchmark items; item i searches with the vector of id i."""
    items = text_queries(spark, d)
    q = vectors_of(spark, d).select(F.col("chunk_id").alias("query_id"), "embedding").join(items.select("query_id"), "query_id", "left_semi")
    return vectors.search(vectors_of(spark, d), q, DEPTH), keyword.search(chunks_of(spark, d), items, DEPTH)


HYBRID_CTE = f"""
{BM25_CTE},
ks AS (SELECT query_id, chunk_id, sum(part) AS score, string_agg(term, ',' ORDER BY term) AS matched_terms FROM parts GROUP BY query_id, chunk_id),
kr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ks) WHERE rank <= 50),
vs AS (SELECT item_id AS query_id, b.vec_id AS chunk_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM benchmark JOIN embeddings a ON a.vec_id = item_id, embeddings b),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs) WHERE rank <= 50),
kn AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w <= 1.1920929e-07 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM kr WINDOW w AS (PARTITION BY query_id)),
vn AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w <= 1.1920929e-07 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM vr WINDOW w AS (PARTITION BY query_id)),
j AS (SELECT coalesce(vn.query_id, kn.query_id) AS query_id, coalesce(vn.chunk_id, kn.chunk_id) AS chunk_id, vn.rank AS vector_rank, vn.norm AS vector_norm, kn.rank AS keyword_rank, kn.norm AS keyword_norm, kn.matched_terms
  FROM vn FULL OUTER JOIN kn ON vn.query_id = kn.query_id AND vn.chunk_id = kn.chunk_id),
f AS (SELECT *, {{score}} AS score FROM j WHERE {{side}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, chunk_id) AS rank FROM f)
"""
HYBRID_SQL = f"WITH {HYBRID_CTE} SELECT query_id, chunk_id, round(score, 6) AS score, rank, coalesce(vector_rank, 0) AS vector_rank, coalesce(keyword_rank, 0) AS keyword_rank FROM r WHERE rank <= 10"
WEIGHTED = "0.6 * coalesce(vector_norm, 0) + 0.4 * coalesce(keyword_norm, 0)"
RRF = "coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + keyword_rank), 0)"


def hybrid_query(weights: HybridWeights):
    def run(spark, d):
        hits = hybrid.fuse(*_hybrid_inputs(spark, d), K, weights)
        ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("vector_rank", "keyword_rank")]  # 0: not in that list
        return _scored(hits, *ranks)

    return run


def hybrid_by_source(spark, d):
    """The best chunk of each source only."""
    hits = hybrid.fuse(*_hybrid_inputs(spark, d), DEPTH).join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    return hybrid.one_per_document(hits, "source").select("query_id", "chunk_id", "source", "rank", "collapsed")


HYBRID_SOURCE_SQL = f"""
WITH {fill(HYBRID_CTE, score=WEIGHTED, side="true")},
d AS (SELECT r.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n, count(*) OVER (PARTITION BY query_id, source) - 1 AS collapsed FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 50)
SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, collapsed FROM d WHERE n = 1
"""

# ---- quality: a run against grades


def qrels_of(spark, d) -> DataFrame:
    """A vector's own label is relevant to it; equal labels of small ids more so."""
    v = vectors_of(spark, d).select(F.col("chunk_id").alias("doc_id"), "label")
    q = v.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("label").alias("want"))
    return q.join(v, q["want"] == v["label"]).select("query_id", "doc_id", (F.lit(1) + (F.col("doc_id") % 3).cast("int")).alias("grade"))


def run_of(spark, d, encoding: str = "f32", depth: int = 100) -> DataFrame:
    return vectors.search(vectors_of(spark, d), vector_queries(spark, d), depth, encoding=encoding).withColumnRenamed("chunk_id", "doc_id")


def quality(spark, d):
    m = metrics.per_query(run_of(spark, d), qrels_of(spark, d), K)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in metrics.METRICS))


QUALITY_CTE = """
q AS (SELECT vec_id AS query_id, label AS want, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
qrels AS (SELECT query_id, vec_id AS doc_id, 1 + vec_id % 3 AS grade FROM q JOIN embeddings ON label = want),
s AS (SELECT query_id, vec_id AS doc_id, list_inner_product(qv, embedding::DOUBLE[]) AS score FROM q, embeddings),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10),
ideal AS (SELECT query_id, sum((2 ** grade - 1) / log2(r + 1)) FILTER (r <= 10) AS idcg, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM qrels) GROUP BY query_id),
hits AS (SELECT run.query_id, rank, grade, grade IS NOT NULL AS rel, sum((grade IS NOT NULL)::INT) OVER (PARTITION BY run.query_id ORDER BY rank) AS seen FROM run LEFT JOIN qrels ON run.query_id = qrels.query_id AND run.doc_id = qrels.doc_id),
per AS (SELECT query_id, coalesce(sum((2 ** grade - 1) / log2(rank + 1)), 0) AS dcg, sum(rel::INT) AS hit, min(rank) FILTER (rel) AS first, coalesce(sum(seen / rank) FILTER (rel), 0) AS precisions, count(grade) AS judged, count(*) AS depth FROM hits GROUP BY query_id),
m AS (SELECT ideal.query_id, dcg / idcg AS ndcg, hit / relevant AS recall, hit / 10.0 AS precision, (hit > 0)::DOUBLE AS success, coalesce(1.0 / first, 0) AS mrr, precisions / relevant AS ap, judged / least(10, depth) AS judged FROM ideal JOIN per ON ideal.query_id = per.query_id)
"""
QUALITY_SQL = f"WITH {QUALITY_CTE} SELECT query_id, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(precision, 6) AS precision, round(success, 6) AS success, round(mrr, 6) AS mrr, round(ap, 6) AS ap, round(judged, 6) AS judged FROM m"


def quality_macro(spark, d):
    m = metrics.macro(metrics.per_query(run_of(spark, d), qrels_of(spark, d), K))
    return m.select("queries", *(F.round(c, 6).alias(c) for c in metrics.METRICS))


QUALITY_MACRO_SQL = f"WITH {QUALITY_CTE} SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(success), 6) AS success, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap, round(avg(judged), 6) AS judged FROM m"


def paired_runs(spark, d):
    """Precision at 10 against precision at 3 of the same run, as a paired comparison."""
    run, truth = run_of(spark, d), qrels_of(spark, d)
    return metrics.paired(metrics.per_query(run, truth, 10), metrics.per_query(run, truth, 3), "precision").select(
        F.round("base", 6).alias("base"), F.round("other", 6).alias("other"), "wins", "ties", "losses", F.round("delta", 6).alias("delta"), F.round("relative", 6).alias("relative")
    )


PAIRED_SQL = f"""
WITH {QUALITY_CTE},
p AS (SELECT query_id, count(*) FILTER (rel) / 10.0 AS a, count(*) FILTER (rel AND rank <= 3) / 3.0 AS b FROM hits GROUP BY query_id)
SELECT round(avg(a), 6) AS base, round(avg(b), 6) AS other, count(*) FILTER (round(b - a, 12) > 0) AS wins, count(*) FILTER (round(b - a, 12) = 0) AS ties, count(*) FILTER (round(b - a, 12) < 0) AS losses,
       round(avg(b) - avg(a), 6) AS delta, round((avg(b) - avg(a)) / avg(a), 6) AS relative FROM p
"""


def latency(spark, d):
    return metrics.nearest_rank(table(spark, d, "events"), "value", (0.5, 0.95, 0.99), by="event_type")


LATENCY_SQL = "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type"


def evidence_sets(spark, d):
    """An order's lines are its evidence, its return flags alternative sets; parts under 1000 count as found."""
    lines = table(spark, d, "lineitem")
    alternatives = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("set_id"), F.col("l_partkey").alias("doc_id")).distinct()
    found = alternatives.filter("doc_id < 1000").select("query_id", "doc_id")
    return metrics.evidence(alternatives, found).select("query_id", "set_id", "matched", "required", F.round("recall", 6).alias("recall"), "complete")


EVIDENCE_SQL = """
WITH a AS (SELECT DISTINCT l_orderkey AS query_id, l_returnflag AS set_id, l_partkey AS doc_id FROM lineitem),
s AS (SELECT query_id, set_id, count(*) FILTER (doc_id < 1000) AS matched, count(*) AS required FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched / required DESC, matched DESC, required, set_id) AS n FROM s)
SELECT query_id, set_id, matched, required, round(matched / required, 6) AS recall, (matched = required)::BIGINT AS complete FROM r WHERE n = 1
"""


def queries() -> dict:
    return {
        "vector_topk_dot": vector_topk(),
        "vector_topk_cosine": vector_topk("cosine"),
        "vector_topk_i8": vector_topk(encoding="i8"),
        "vector_topk_f16": vector_topk(encoding="f16"),
        "vector_topk_bf16": vector_topk(encoding="bf16"),
        "vector_filtered_topk": lambda spark, d: vector_topk(where=F.col("label") == 3)(spark, d),
        "scoped_vector_topk": scoped_vector_topk,
        "i8_recall_at_10": i8_recall,
        "vector_quantise_i8": quantised,
        **{name: (lambda spark, d, s=spec: filter_query(s)(spark, d)) for name, (spec, _) in FILTERS.items()},
        "filter_json_tree": lambda spark, d: tree_query(TREE)(spark, d),
        "filter_metadata_map": filter_map,
        "filter_document_any_chunk": document_any_chunk,
        "filter_time_window": overlap_window,
        "bm25_topk": lambda spark, d: keyword_topk()(spark, d),
        "bm25_filtered_topk": lambda spark, d: keyword_topk(where=F.col("lang") == "es")(spark, d),
        "scoped_bm25_topk": lambda spark, d: keyword_topk(scope=long_scope)(spark, d),
        "bm25_term_stats": term_stats,
        "tokenise_unicode": unicode_terms,
        "hybrid_weighted": hybrid_query(HybridWeights()),
        "hybrid_rrf": hybrid_query(HybridWeights.reciprocal(60)),
        "hybrid_alpha_one": hybrid_query(HybridWeights.alpha(1.0)),
        "hybrid_alpha_zero": hybrid_query(HybridWeights.alpha(0.0)),
        "hybrid_doc_dedup": hybrid_by_source,
        "metric_per_query": quality,
        "metric_macro": quality_macro,
        "paired_win_tie_loss": paired_runs,
        "latency_nearest_rank": latency,
        "evidence_best_set": evidence_sets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "vector_topk_dot": fill(VECTOR_SQL, where="true", score=DOT),
        "vector_topk_cosine": fill(VECTOR_SQL, where="true", score=COSINE),
        "vector_topk_i8": I8_SQL,
        "vector_filtered_topk": fill(VECTOR_SQL, where="label = 3", score=DOT),
        "scoped_vector_topk": fill(VECTOR_SQL, where="vec_id IN (SELECT doc_id FROM documents WHERE lang IN ('de', 'fr'))", score=DOT),
        "i8_recall_at_10": I8_RECALL_SQL,
        "vector_quantise_i8": QUANTISED_SQL,
        **{name: EVENTS_SQL + f"({sql})" for name, (_, sql) in FILTERS.items()},
        "filter_json_tree": EVENTS_SQL + "event_type <> 'click' AND value >= 5",
        "filter_metadata_map": FILTER_MAP_SQL,
        "filter_document_any_chunk": DOCUMENT_ANY_SQL,
        "filter_time_window": OVERLAP_SQL,
        "bm25_topk": fill(KEYWORD_SQL, where="true"),
        "bm25_filtered_topk": fill(KEYWORD_SQL, where="lang = 'es'"),
        "scoped_bm25_topk": fill(KEYWORD_SQL, where="n_chars > 2000"),
        "bm25_term_stats": TERM_STATS_SQL,
        "hybrid_weighted": fill(HYBRID_SQL, score=WEIGHTED, side="true"),
        "hybrid_rrf": fill(HYBRID_SQL, score=RRF, side="true"),
        "hybrid_alpha_one": fill(HYBRID_SQL, score="vector_norm", side="vector_rank IS NOT NULL").replace("coalesce(keyword_rank, 0) AS", "0::BIGINT AS").replace("keyword_rank NULLS LAST, ", ""),
        "hybrid_alpha_zero": fill(HYBRID_SQL, score="keyword_norm", side="keyword_rank IS NOT NULL").replace("coalesce(vector_rank, 0) AS", "0::BIGINT AS").replace("vector_rank NULLS LAST, ", ""),
        "hybrid_doc_dedup": HYBRID_SOURCE_SQL,
        "metric_per_query": QUALITY_SQL,
        "metric_macro": QUALITY_MACRO_SQL,
        "paired_win_tie_loss": PAIRED_SQL,
        "latency_nearest_rank": LATENCY_SQL,
        "evidence_best_set": EVIDENCE_SQL,
    }
