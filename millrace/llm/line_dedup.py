"""Cross-site boilerplate removal by the distinct-site spread of each line.

A line is keyed by the xxhash64 of its text without surrounding blanks. One
aggregation builds a HyperLogLog sketch of the sites of every line; sketches
merge map-side, so a line on every page costs one small sketch per task.
Lines whose estimate lies clear of the threshold are decided by the sketch;
those inside the sketch's error band get an exact distinct count.

Defined results:
* null text: no lines, returned as it came; empty lines are kept and never counted;
* a null site counts for no line; a null doc_id is treated like any other id;
* repeated rows and ties need no rule: the verdict depends on the line only;
* a line needs min_sites distinct texts as well, so that copies of one text on
  many sites do not make its lines boilerplate; nothing else exempts a line,
  whatever share of its document it is;
* an empty table gives an empty table; extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.sizes import small_or_shuffled
from millrace.session import cut

LG_K = 12
#: Standard error of a sketch with 2**LG_K registers.
SIGMA = 1.04 / 2 ** (LG_K / 2)
BLANKS = " \t\r"
#: Texts with wide-spread lines whose sets of keys are broadcast, some hundred bytes each.
SPREAD_TEXTS = 200_000


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _key(line: Column) -> Column:
    return F.xxhash64(_stripped(line))


def line_table(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """One row for each line that holds more than blanks."""
    return (
        docs.select(F.col(site_col).alias("__site"), F.xxhash64(text_col).alias("__text"), F.explode(F.split(F.col(text_col), "\n", -1)).alias("__line"))
        .filter(F.length(_stripped(F.col("__line"))) > 0)
        .select("__site", "__text", _key(F.col("__line")).alias("__key"))
    )


def boilerplate_keys(lines: DataFrame, min_sites: int) -> DataFrame:
    """Keys of lines on at least min_sites distinct sites."""
    band = max(1, int(4 * SIGMA * min_sites + 0.999))
    # a null site would hash like any value, so it is left out before sketching
    spread = cut(
        lines.filter(F.col("__site").isNotNull())
        .groupBy("__key")
        .agg(F.hll_sketch_agg(F.xxhash64("__site"), F.lit(LG_K)).alias("__sketch"))
        .select("__key", F.hll_sketch_estimate("__sketch").alias("__sites"))
        .filter(F.col("__sites") > min_sites - band)
    )
    clear = spread.filter(F.col("__sites") >= min_sites + band).select("__key")
    near = spread.filter(F.col("__sites") < min_sites + band).select("__key")
    exact = (
        lines.filter(F.col("__site").isNotNull())
        .join(small_or_shuffled(near), "__key", "left_semi")
        .groupBy("__key", "__site")
        .agg(F.lit(1).alias("__one"))
        .groupBy("__key")
        .agg(F.count("__one").alias("__n"))
        .filter(F.col("__n") >= min_sites)
        .select("__key")
    )
    return clear.unionByName(exact)


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = 10,
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """docs with cross-site lines taken out of text_col.

    Adds line_count, removed_lines (of this document) after the columns of docs;
    columns of docs with these names are replaced.
    """
    docs = docs.drop("line_count", "removed_lines")
    lines = line_table(docs, text_col, site_col)
    keys = small_or_shuffled(cut(boilerplate_keys(lines, min_sites)))
    texts = lines.filter(F.col("__site").isNotNull()).join(keys, "__key", "left_semi").select("__key", F.col("__text").alias("__site"))
    keys = small_or_shuffled(cut(boilerplate_keys(texts, min_sites)))
    # by text, so that null ids do not meet and equal texts are listed once
    per_text = lines.select("__text", "__key").join(keys, "__key").groupBy("__text").agg(F.collect_set("__key").alias("__spread"))
    # few texts go to the documents by broadcast, so that these are not shuffled; beyond that copies of one text are a skewed join
    per_text = small_or_shuffled(cut(per_text), SPREAD_TEXTS)
    split = F.split(F.col(text_col), "\n", -1)
    out = docs.withColumn("__hash", F.xxhash64(text_col)).join(per_text, F.col("__hash") == F.col("__text"), "left").drop("__text", "__hash")
    out = out.withColumn("__kept", F.when(F.col("__spread").isNull(), split).otherwise(
        F.filter(split, lambda line: (F.length(_stripped(line)) == 0) | ~F.array_contains(F.col("__spread"), _key(line)))
    ))
    out = out.withColumn("line_count", F.coalesce(F.size(F.filter(split, lambda x: F.length(_stripped(x)) > 0)), F.lit(0)).cast("long"))
    out = out.withColumn("removed_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split) - F.size("__kept")).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("removed_lines") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text_col)))
    return out.select(*docs.columns, "line_count", "removed_lines")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_boilerplate(docs)
    return out.select(
        "doc_id",
        F.col("line_count").alias("n_lines"),
        F.col("removed_lines").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, source, digest, i AS pos, parts[i] AS line, trim(parts[i], chr(32) || chr(9) || chr(13)) AS body
  FROM (SELECT doc_id, source, md5(text) AS digest, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
       LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)
), spread AS (
  SELECT body FROM lines WHERE length(body) > 0 GROUP BY body HAVING count(DISTINCT source) >= 10 AND count(DISTINCT digest) FILTER (source IS NOT NULL) >= 10
), marked AS (
  SELECT l.*, s.body IS NOT NULL AS wide FROM lines l LEFT JOIN spread s ON l.body = s.body
), per_doc AS (
  SELECT doc_id,
         count(*) FILTER (length(body) > 0) AS n_lines,
         count(*) FILTER (wide) AS wide_lines,
         string_agg(line, chr(10) ORDER BY pos) AS whole,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT wide) AS rest
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id,
       coalesce(p.n_lines, 0)::BIGINT AS n_lines,
       coalesce(p.wide_lines, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN p.doc_id IS NULL THEN '' WHEN p.wide_lines = 0 THEN p.whole ELSE coalesce(p.rest, '') END) AS kept_sha256
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""
