"""Change logs as streams: each micro-batch becomes one change of a stored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.corpus import Corpus
from millrace.sources import store


def latest_in_batch(batch: DataFrame, key: str = "record_id", order: str = "seq") -> DataFrame:
    """The last change of every record in a batch."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def apply_batch(corpus: Corpus, batch: DataFrame) -> Corpus:
    """batch: record_id, seq, op (upsert or delete), texts."""
    last = latest_in_batch(batch)
    corpus = corpus.upsert_documents(last.filter("op = 'upsert'").select("record_id", "texts"))
    return corpus.delete(last.filter("op = 'delete'").select("record_id"))[0]


def load(spark, folder: str) -> tuple[Corpus, int]:
    """The stored corpus and the last batch applied to it; an empty one where nothing was ever stored. A damaged store is an error."""
    if not store.exists(spark, folder):
        return Corpus.empty(spark), -1
    tables, body = store.load(spark, folder)
    meta = body["meta"]
    return Corpus(tables["records"], tables["chunks"], meta["generation"], meta["next_id"]), meta["batch"]


def upsert_stream(changes: DataFrame, folder: str, checkpoint: str):
    """Starts a query that applies each micro-batch once: a batch already in the manifest is passed over after a restart."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        corpus, done = load(spark, folder)
        if number <= done:
            return
        corpus = apply_batch(corpus, batch)
        store.save(spark, folder, {"records": corpus.records, "chunks": corpus.chunks}, {"generation": corpus.generation, "next_id": corpus.next_id, "batch": number})

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
