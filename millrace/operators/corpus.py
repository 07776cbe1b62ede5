"""Corpus tables under change: upserts, deletions, versions, compaction and lookups.

A corpus is two tables: records (record_id, record_type, content, version) and
chunks (chunk_id, record_id, chunk_key, text, version, deleted). Every change
gives new tables and a generation one higher. Deleted chunks stay as
tombstones until compaction; chunk ids are never used again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.model import MillraceError, StaleScope
from millrace.session import cut, numbered


@dataclass(frozen=True)
class Corpus:
    records: DataFrame
    chunks: DataFrame
    generation: int = 0
    next_id: int = 0

    @classmethod
    def empty(cls, spark) -> Corpus:
        return cls(
            spark.createDataFrame([], "record_id string, record_type string, content string, version long"),
            spark.createDataFrame([], "chunk_id long, record_id string, chunk_key string, text string, version long, deleted boolean"),
        )

    def active(self) -> DataFrame:
        return self.chunks.filter(~F.col("deleted"))

    def upsert(self, records: DataFrame, chunks: DataFrame) -> Corpus:
        """Replaces records and their chunks as one change; a record without chunks loses those it had."""
        for df, keys, what in ((records, ["record_id"], "record"), (chunks, ["record_id", "chunk_key"], "chunk key")):
            twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
            if twice:
                raise MillraceError(f"{what} {twice[0][0]} comes twice")
        stray = chunks.join(records, "record_id", "left_anti").limit(1).collect()
        if stray:
            raise MillraceError(f"chunk of unknown record {stray[0]['record_id']}")
        old = self.records.select("record_id", F.col("version").alias("_v"))
        fresh = records.join(old, "record_id", "left").select("record_id", "record_type", "content", (F.coalesce("_v", F.lit(0)) + 1).alias("version"))
        ids = records.select("record_id")
        kept = self.records.join(ids, "record_id", "left_anti")
        buried = self.chunks.join(ids.withColumn("_gone", F.lit(True)), "record_id", "left")
        buried = buried.withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).select(*self.chunks.columns)
        fresh_chunks = numbered(chunks.select("record_id", "chunk_key", "text"), ["record_id", "chunk_key"], self.next_id, "chunk_id")
        new = fresh_chunks.join(fresh.select("record_id", "version"), "record_id").select("chunk_id", "record_id", "chunk_key", "text", "version", F.lit(False).alias("deleted"))
        new = cut(new)
        count = new.count()
        return replace(self, records=cut(kept.unionByName(fresh)), chunks=cut(buried.unionByName(new)), generation=self.generation + 1, next_id=self.next_id + count)

    def upsert_documents(self, documents: DataFrame) -> Corpus:
        """(record_id, texts): records of type Document whose chunks are named by their place."""
        records = documents.select("record_id", F.lit("Document").alias("record_type"), F.lit(None).cast("string").alias("content"))
        chunks = documents.select("record_id", F.posexplode("texts").alias("_i", "text")).select("record_id", F.concat(F.lit("ordinal-"), F.col("_i").cast("string")).alias("chunk_key"), "text")
        return self.upsert(records, chunks)

    def delete(self, ids: DataFrame) -> tuple[Corpus, int]:
        """Buries the active chunks of the records and removes them; returns how many chunks went. Without a chunk or record to go nothing changes, nor does the generation."""
        gone = cut(ids.select("record_id").distinct())
        hit = self.active().join(gone, "record_id", "left_semi").count()
        if not hit and self.records.join(gone, "record_id", "left_semi").isEmpty():
            return self, 0
        mark = self.chunks.join(gone.withColumn("_gone", F.lit(True)), "record_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False)))
        left = self.records.join(gone, "record_id", "left_anti")
        return replace(self, records=cut(left), chunks=cut(mark.select(*self.chunks.columns)), generation=self.generation + 1), hit

    def add_chunks(self, chunks: DataFrame) -> Corpus:
        """Chunks with ids of the caller's: chunk_id, record_id, chunk_key, text. Ids must be new and not negative; records must exist. Later ids go on behind the greatest."""
        twice = chunks.groupBy("chunk_id").count().filter("count > 1 OR chunk_id IS NULL OR chunk_id < 0").limit(1).collect()
        taken = twice or chunks.join(self.chunks.select("chunk_id"), "chunk_id", "left_semi").limit(1).collect()
        if taken:
            raise MillraceError(f"chunk id {taken[0]['chunk_id']} can't be given")
        stray = chunks.join(self.records, "record_id", "left_anti").limit(1).collect()
        if stray:
            raise MillraceError(f"chunk of unknown record {stray[0]['record_id']}")
        keys = self.active().select("record_id", "chunk_key").unionByName(chunks.select("record_id", "chunk_key"))
        again = keys.groupBy("record_id", "chunk_key").count().filter("count > 1").limit(1).collect()
        if again:
            raise MillraceError(f"chunk key {again[0]['chunk_key']} comes twice")
        top = chunks.agg(F.max("chunk_id")).first()[0]
        if top is None:
            return self
        new = chunks.join(self.records.select("record_id", "version"), "record_id").select("chunk_id", "record_id", "chunk_key", "text", "version", F.lit(False).alias("deleted"))
        return replace(self, chunks=cut(self.chunks.unionByName(new)), generation=self.generation + 1, next_id=max(self.next_id, top + 1))

    def compact(self) -> tuple[Corpus, int]:
        """Drops tombstones, ids stay; without tombstones nothing changes."""
        dead = self.chunks.filter("deleted").count()
        if not dead:
            return self, 0
        return replace(self, chunks=cut(self.active()), generation=self.generation + 1), dead

    def scope(self, chunk_ids: DataFrame) -> Scope:
        return Scope(chunk_ids.join(self.active().select("chunk_id"), "chunk_id", "left_semi").distinct(), self.generation)

    def lookup(self, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
        """Rows of ids (pos, key) in their order, repeats kept; deleted or unknown ids give nulls."""
        return hydrate(ids, self.active(), key).orderBy("pos")

    def lookup_any(self, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
        """As lookup, but buried chunks are found as well, with their `deleted` mark."""
        return hydrate(ids, self.chunks, key).orderBy("pos")


@dataclass(frozen=True)
class Scope:
    """Admitted chunks, bound to the generation that they were taken from."""

    chunks: DataFrame
    generation: int

    def within(self, corpus: Corpus) -> DataFrame:
        if self.generation != corpus.generation:
            raise StaleScope(f"scope of generation {self.generation}, corpus at {corpus.generation}")
        return self.chunks


def hydrate(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """ids with the columns of the rows they name; an id may come often, and one without a row keeps nulls."""
    return ids.join(rows, key, "left")


def latest(log: DataFrame, key: str, version: str, deleted: str) -> DataFrame:
    """The current rows of an append-only change log."""
    fields = [c for c in log.columns if c != key]
    top = log.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(version)).alias("_r"))
    return top.select(key, "_r.*").filter(~F.col(deleted))


def merged_metadata(record: str, chunk: str):
    """Chunk metadata over record metadata."""
    return F.map_concat(F.map_filter(record, lambda k, v: ~F.map_contains_key(chunk, k)), chunk)


def size_estimate(chunks: DataFrame, *by: str) -> DataFrame:
    """Chunks, active ones and bytes of text, in all or by columns."""
    measures = F.count("*").alias("chunks"), F.coalesce(F.sum((~F.col("deleted")).cast("long")), F.lit(0)).alias("active"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes")
    return chunks.groupBy(*by).agg(*measures)
