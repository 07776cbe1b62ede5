"""BM25 keyword search for batches of queries.

Statistics (number of chunks, document frequency, average length) cover all
active chunks, never the filter or the scope. A chunk is tokenised once, into
its distinct terms and their counts; that table can be stored and searched
again. Terms and queries come in blocks of bounded size, which are broadcast;
every task scores its chunks by a product of weights and query terms and keeps
its own best k per query, so k rows per query and task are shuffled however
common a word is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.vectors import best_rows, top_k
from millrace.session import cut, small_or_shuffled

K1 = 1.2
B = 0.75
#: Words of letters, digits and underscore, with inner apostrophes and dots.
WORD = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"
#: Cells of the table of terms by queries in one block, and of chunks by terms at a time.
BLOCK_CELLS = 1 << 22


def portable_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unicode_tokens(texts: pd.Series) -> pd.Series:
    """Words by the default Unicode word boundaries that hold a letter or digit, in lower case."""
    import regex

    cut, word = regex.compile(r"(?wV1)\b"), regex.compile(r"[\p{L}\p{N}]")
    return texts.map(lambda t: [w.lower() for w in cut.split(t or "") if word.search(w)])


TOKENISERS = {"portable": portable_tokens, "unicode": unicode_tokens}


def tokens(text: Column, tokeniser: str = "portable", stop_words: tuple[str, ...] = ()) -> Column:
    out = TOKENISERS[tokeniser](text)
    return F.filter(out, lambda w: ~w.isin(*stop_words)) if stop_words else out


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", tokeniser: str = "portable", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """term, chunk_id, tf of every chunk."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(tokens(F.col(text_col), tokeniser, stop_words)).alias("term"))
    return words.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def term_stats(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", tokeniser: str = "portable", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """term, df, total of every term."""
    p = postings(chunks, id_col, text_col, tokeniser, stop_words)
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def idf(n: Column | float, df: Column) -> Column:
    return F.log(F.lit(1.0) + (F.lit(n) - df + 0.5) / (df + 0.5))


def index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", tokeniser: str = "portable", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, len, terms (distinct, in order), tfs: the stored form of a keyword index, one row a chunk."""
    words = chunks.select(F.col(id_col).cast("long").alias("chunk_id"), tokens(F.col(text_col), tokeniser, stop_words).alias("words"))
    return words.mapInArrow(_counted, "chunk_id long, len int, terms array<string>, tfs array<int>")


def _counted(batches):
    for b in batches:
        lists = b.column(1)
        size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        flat = lists.flatten().dictionary_encode()
        codes, names = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
        order = np.argsort(pc.array_sort_indices(names).to_numpy(), kind="stable") if len(names) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(size)), size)
        key, count = np.unique(row * max(len(names), 1) + order[codes], return_counts=True)
        back = np.argsort(order, kind="stable") if len(names) else order
        ends = np.searchsorted(key // max(len(names), 1), np.arange(len(size) + 1)).astype(np.int32)
        terms = names.take(pa.array(back[key % max(len(names), 1)])) if len(key) else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(ends, terms.cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))],
            names=["chunk_id", "len", "terms", "tfs"],
        )


def validate(indexed: DataFrame) -> list[str]:
    """Broken rules of a stored index: one row a chunk, distinct terms in order, positive counts that add up to the length."""
    terms, tfs = F.col("terms"), F.col("tfs")
    rules = {
        "chunk ids are not null": F.col("chunk_id").isNull(),
        "each term has a count": F.size(terms) != F.size(tfs),
        "terms are distinct and in order": terms != F.array_sort(F.array_distinct(terms)),
        "counts are positive": F.exists(tfs, lambda x: x <= 0),
        "counts add up to the length": F.aggregate(tfs, F.lit(0), lambda s, x: s + x) != F.col("len"),
    }
    found = indexed.agg(*[F.count(F.when(F.coalesce(test, F.lit(True)), 1)).alias(str(i)) for i, test in enumerate(rules.values())], (F.count("*") - F.countDistinct("chunk_id")).alias("twice")).first()
    broken = [name for i, name in enumerate(rules) if found[str(i)]]
    return broken + (["chunk ids are distinct"] if found["twice"] and "chunk ids are not null" not in broken else [])


def _blocks(queries: DataFrame, query_id: str, query_text: str, tokeniser: str, stop_words: tuple[str, ...]):
    """Queries in blocks: ids, sorted terms of the block, and its table of terms by queries."""
    listed = queries.select(query_id, F.array_distinct(tokens(F.col(query_text), tokeniser, stop_words)).alias("terms")).orderBy(query_id).toArrow()
    ids, own = listed.column(0).combine_chunks(), listed.column(1).to_pylist()
    held, names = [], set()

    def block():
        terms = sorted(names)
        place = {t: i for i, t in enumerate(terms)}
        table = np.zeros((len(terms), len(held)))
        for j, i in enumerate(held):
            table[[place[t] for t in own[i]], j] = 1.0
        return ids.take(pa.array(held, pa.int64())), terms, table

    for i, terms in enumerate(own):
        if held and len(names | set(terms)) * (len(held) + 1) > BLOCK_CELLS:
            yield block()
            held, names = [], set()
        if terms:
            held.append(i)
            names |= set(terms)
    if held:
        yield block()


def _matched(indexed: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of an index with numbers of the wanted terms in place of names; chunks without any stay, as they count."""
    shared = indexed.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        wanted = pa.array(shared.value, pa.string())
        for b in batches:
            listed, tfs = b.column(b.schema.get_field_index("terms")), b.column(b.schema.get_field_index("tfs"))
            size = np.diff(listed.offsets.to_numpy()) if len(listed) else np.zeros(0, np.int64)
            number = pc.index_in(listed.flatten(), value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False)
            keep = number >= 0
            row = np.repeat(np.arange(len(size)), size)[keep]
            ends = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
            parts = [pa.ListArray.from_arrays(ends, pa.array(x[keep].astype(np.int32))) for x in (number, tfs.flatten().to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("chunk_id", "allowed", "len")] + parts, names=["chunk_id", "allowed", "len", "numbers", "tfs"])

    return indexed.mapInArrow(run, "chunk_id long, allowed boolean, len int, numbers array<int>, tfs array<int>")


def _local_best(rows: DataFrame, ids: pa.Array, weight: np.ndarray, table: np.ndarray, average: float, k: int, k1: float, b: float, kind: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, weight, table))

    def run(batches):
        names, idf_of, wanted = shared.value
        held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(len(names))]
        step = max(16, BLOCK_CELLS // len(idf_of))
        for batch in batches:
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            norm = k1 * (1 - b + b * batch.column(1).to_numpy(zero_copy_only=False) / average)
            ends = batch.column(2).offsets.to_numpy()
            number, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            ends = ends - (ends[0] if len(ends) else 0)
            for lo in range(0, len(chunk), step):
                hi = min(lo + step, len(chunk))
                part = slice(ends[lo], ends[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                cells = np.zeros((hi - lo, len(idf_of)))
                cells[row, number[part]] = idf_of[number[part]] * tf[part] * (k1 + 1) / (tf[part] + norm[lo:hi][row])
                scores = cells @ wanted
                for j in range(len(names)):
                    hit = np.flatnonzero(scores[:, j] > 0)
                    if len(hit):
                        s, i = np.concatenate([held[j][0], scores[hit, j]]), np.concatenate([held[j][1], chunk[lo:hi][hit]])
                        best = best_rows(s, i, k)
                        held[j] = s[best], i[best]
        sizes = [len(x[0]) for x in held]
        if sum(sizes):
            which = np.repeat(np.arange(len(names)), sizes)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), pa.array(np.concatenate([x[1] for x in held])), pa.array(np.concatenate([x[0] for x in held]))], names=["query_id", "chunk_id", "score"])

    return rows.select("chunk_id", "len", "numbers", "tfs").mapInArrow(run, f"query_id {kind}, chunk_id long, score double")


def search(
    chunks: DataFrame | None,
    queries: DataFrame,
    k: int,
    id_col: str = "chunk_id",
    text_col: str = "text",
    query_id: str = "query_id",
    query_text: str = "text",
    where: Column | None = None,
    scope: DataFrame | None = None,
    tokeniser: str = "portable",
    stop_words: tuple[str, ...] = (),
    k1: float = K1,
    b: float = B,
    indexed: DataFrame | None = None,
) -> DataFrame:
    """query_id, chunk_id, score, matched_terms (sorted, comma-joined), rank; chunks without a match are left out.

    indexed is a stored index of the same chunks, in place of tokenising them;
    then where needs chunks with the columns that it reads. k of 0 and queries
    without terms give no rows; a null id is left out.
    """
    spark = queries.sparkSession
    kind = queries.schema[query_id].dataType.simpleString()
    blocks = list(_blocks(queries, query_id, query_text, tokeniser, stop_words)) if k > 0 else []
    nothing = spark.createDataFrame([], f"query_id {kind}, chunk_id long, score double, matched_terms string, rank long")
    if not blocks:
        return nothing
    allowed = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    if indexed is None:
        words = chunks.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("chunk_id"), allowed.alias("allowed"), tokens(F.col(text_col), tokeniser, stop_words).alias("words"))
        rows = words.mapInArrow(lambda it: _with_allowed(it), "chunk_id long, allowed boolean, len int, terms array<string>, tfs array<int>")
        rows = rows if len(blocks) == 1 else cut(rows)
    elif where is None:
        rows = indexed.withColumn("allowed", allowed)
    else:
        rows = indexed.join(chunks.select(F.col(id_col).cast("long").alias("chunk_id"), allowed.alias("allowed")), "chunk_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    found = None
    for ids, terms, table in blocks:
        matched = cut(_matched(rows, terms))
        totals = matched.agg(F.count("*"), F.sum("len")).first()
        n, length = totals[0], totals[1] or 0
        seen = np.zeros(len(terms))
        for r in matched.select(F.explode("numbers").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
            seen[r["t"]] = r["count"]
        weight = np.log1p((n - seen + 0.5) / (seen + 0.5))
        inside = matched.filter("allowed AND size(numbers) > 0")
        if scope is not None:
            inside = inside.join(scope.select(F.col(scope.columns[0]).cast("long").alias("chunk_id")), "chunk_id", "left_semi")
        best = top_k(_local_best(inside, ids, weight, table, length / n if length else 1.0, k, k1, b, kind), k)
        found_here = _with_terms(best, matched, ids, terms, table, kind)
        found = found_here if found is None else found.unionByName(found_here)
    return found


def _with_allowed(batches):
    """Counted terms of (chunk_id, allowed, words)."""
    for b in batches:
        for out in _counted([pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["chunk_id", "words"])]):
            yield pa.RecordBatch.from_arrays([out.column(0), b.column(1), *out.columns[1:]], names=["chunk_id", "allowed", "len", "terms", "tfs"])


def _with_terms(best: DataFrame, matched: DataFrame, ids: pa.Array, terms: list[str], table: np.ndarray, kind: str) -> DataFrame:
    """The best hits with the terms that they share with their query."""
    spark = best.sparkSession
    t, j = np.nonzero(table)
    wanted = spark.createDataFrame(pa.table({"query_id": ids.take(pa.array(j)), "number": pa.array(t.astype(np.int32)), "term": pa.array(terms, pa.string()).take(pa.array(t))})).withColumn("query_id", F.col("query_id").cast(kind))
    best = cut(best)
    shared = matched.select("chunk_id", "numbers").join(small_or_shuffled(best.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", F.explode("numbers").alias("number"))
    named = best.join(shared, "chunk_id").join(F.broadcast(wanted), ["query_id", "number"])
    return named.groupBy("query_id", "chunk_id", "score", "rank").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("matched_terms")).select("query_id", "chunk_id", "score", "matched_terms", "rank")
