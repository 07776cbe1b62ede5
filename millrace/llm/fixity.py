"""Merkle fixity audit of web archives.

Records are laid out in segments (an archive file each) with byte offsets.
A leaf is the SHA-256 of a record's bytes. Records of neighbouring ids form an
offset range, of about sixteen records; with their lengths and their offsets
from the range's start they hash into its node, sixteen ranges into a block,
blocks into a segment, and segments, sixteen at a time, up to the root. An
audit compares roots and then descends level by level into the branches that
differ, so an intact replica costs one comparison and a damaged one costs its
damaged branches only. A range is set by ids, so a lost or added record changes
its own range and none behind it.

Segments hold `segment_ids` consecutive ids, further split by the hash of the
address, so that an id which repeats without end still spreads over segments;
records without an id are spread by their address alone. The node of a range of
very many records is made from nodes of PART records each.

Defined results: nulls in any column are hashed as their own marker; repeated
records are told apart by an occurrence number; an empty archive has the root
of no records; extra columns are ignored. Statuses: damaged (bytes differ),
missing (not in the replica), extra (not in the primary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

FANOUT = 16
#: Records of a range that are hashed together.
PART = 4096
#: Segments for records without an id.
ANONYMOUS = 1024


def record_bytes(id_col: Column, uri: Column, body: Column) -> Column:
    """A record as it stands in the archive: header lines, blank line, block, two line ends."""
    block = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(id_col.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("null")),
        F.when(body.isNull(), F.lit("\r\nWARC-Truncated: unspecified")).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r\n"),
    )


def lay_out(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", segment_ids: int = 4096, splits: int = 8) -> DataFrame:
    """Leaves: segment, ordinal, offset, length, digest, and what names the record."""
    raw = record_bytes(F.col(id_col), F.col(uri_col), F.col(body_col))
    place = F.xxhash64(F.col(uri_col))
    bucket = F.coalesce(F.floor(F.col(id_col) / segment_ids), -1 - F.pmod(place, F.lit(ANONYMOUS))).cast("long")
    leaves = pages.select(
        (bucket * splits + F.pmod(place, F.lit(splits))).alias("segment"),
        F.coalesce(F.floor(F.col(id_col) / (FANOUT * splits)), F.lit(0)).cast("long").alias("range"),
        F.col(id_col).cast("long").alias("record_id"),
        F.col(uri_col).alias("uri"),
        F.octet_length(raw).cast("long").alias("length"),
        F.sha2(raw, 256).alias("digest"),
    )
    order = Window.partitionBy("segment").orderBy("record_id", "uri", "digest")
    same = Window.partitionBy("segment", "record_id", "uri").orderBy("digest")
    within = Window.partitionBy("segment", "range").orderBy("record_id", "uri", "digest")
    return leaves.select(
        "*",
        (F.row_number().over(within) - 1).cast("long").alias("ordinal"),
        (F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("from_range"),
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        F.row_number().over(same).cast("long").alias("occurrence"),
    )


def _parents(nodes: DataFrame, keys: list[str], by: Column, digest: Column) -> DataFrame:
    """Nodes one level up: the hash of their children's hashes in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), digest.alias("d")))), lambda x: x["d"]), "")
    return nodes.groupBy(*keys, by.alias("parent")).agg(F.sha2(joined, 256).alias("digest")).withColumnRenamed("parent", "node")


def build_tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Levels from ranges up to the root, each (segment, node, digest)."""
    stamped = F.concat_ws(":", F.col("from_range").cast("string"), F.col("length").cast("string"), F.col("digest"))
    level = leaves.withColumn("node", F.col("ordinal"))
    level = _parents(level, ["segment", "range"], F.floor(F.col("node") / PART).cast("long"), stamped)
    level = _parents(level, ["segment"], F.col("range"), F.col("digest"))
    levels = [level]
    level = _parents(level, ["segment"], F.floor(F.col("node") / FANOUT).cast("long"), F.col("digest"))
    levels.append(level)
    level = level.groupBy("segment").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
    level = level.select("segment", F.lit(0).cast("long").alias("node"), "digest")
    levels.append(level)
    for _ in range(height):
        up = level.select(F.floor(F.col("segment") / FANOUT).cast("long").alias("up"), "segment", "digest")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "digest"))), lambda x: x["digest"]), "")
        level = up.groupBy("up").agg(F.sha2(joined, 256).alias("digest")).select(F.col("up").alias("segment"), F.lit(0).cast("long").alias("node"), "digest")
        levels.append(level)
    return levels


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """(segment, node) where the two sides hold different hashes or only one holds any."""
    b = b.withColumnRenamed("digest", "other")
    return a.join(b, ["segment", "node"], "full_outer").filter(~F.col("digest").eqNullSafe(F.col("other"))).select("segment", "node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records of two laid-out archives that differ: segment, record_id, uri, occurrence, offset, length, status."""
    primary, replica = cut(primary), cut(replica)
    widest = primary.select("segment").unionByName(replica.select("segment")).agg(F.max("segment"), F.min("segment")).first()
    height, reach = 1, max(abs(widest[0] or 0), abs(widest[1] or 0))
    while reach >= FANOUT**height:
        height += 1
    ours, theirs = build_tree(primary, height), build_tree(replica, height)
    bad = _differ(ours[-1], theirs[-1])
    for depth in range(len(ours) - 2, -1, -1):
        a, b = ours[depth], theirs[depth]
        if depth >= 2:  # segments and what stands above them
            key, on = [F.floor(F.col("segment") / FANOUT).cast("long").alias("up")], ["up"]
            held = bad.select(F.col("segment").alias("up")).distinct()
        elif depth == 1:
            key, on, held = [F.col("segment").alias("up")], ["up"], bad.select(F.col("segment").alias("up")).distinct()
        else:
            key, on = [F.col("segment").alias("up"), F.floor(F.col("node") / FANOUT).cast("long").alias("up_node")], ["up", "up_node"]
            held = bad.select(F.col("segment").alias("up"), F.col("node").alias("up_node")).distinct()
        a, b = (x.select("*", *key).join(held, on, "left_semi").select("segment", "node", "digest") for x in (a, b))
        bad = cut(_differ(a, b))
    ranges = bad.withColumnRenamed("node", "range")
    within = lambda x: x.join(ranges, ["segment", "range"], "left_semi")
    p, r = within(primary).alias("p"), within(replica).alias("r")
    same = (F.col("p.segment") == F.col("r.segment")) & F.col("p.record_id").eqNullSafe(F.col("r.record_id")) & F.col("p.uri").eqNullSafe(F.col("r.uri")) & (F.col("p.occurrence") == F.col("r.occurrence"))
    status = F.when(F.col("r.digest").isNull(), "missing").when(F.col("p.digest").isNull(), "extra").otherwise("damaged")
    pick = lambda c: F.coalesce(F.col(f"p.{c}"), F.col(f"r.{c}")).alias(c)
    return (
        p.join(r, same, "full_outer")
        .filter(~F.col("p.digest").eqNullSafe(F.col("r.digest")))
        .select(pick("segment"), pick("record_id"), pick("uri"), pick("occurrence"), pick("offset"), pick("length"), status.alias("status"))
    )


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica of pages with known faults, chosen by the MD5 of the id: bytes altered, records lost."""
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    return pages.filter(F.coalesce(mark != "1f", F.lit(True))).withColumn("html", F.when(mark == "2e", F.concat("html", F.lit(" "))).otherwise(F.col("html")))


def query(spark, sf_dir: str) -> DataFrame:
    """Audits the archive of pages against a replica with known faults."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = audit(lay_out(pages), lay_out(damaged_copy(pages)))
    return found.select(F.col("record_id").alias("page_id"), "uri", "length", "status")


SQL = r"""
WITH p AS (
  SELECT page_id, url, html, substr(md5(page_id::VARCHAR), 1, 2) AS mark,
         strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
           || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)) AS length
  FROM pages
)
SELECT page_id, url AS uri, length::BIGINT AS length, CASE mark WHEN '1f' THEN 'missing' ELSE 'damaged' END AS status
FROM p WHERE mark IN ('1f', '2e')
"""
