"""Exact vector search for batches of queries.

Queries come as a DataFrame. A block of them, bounded in bytes, is broadcast;
every task multiplies its vectors with the block in numpy and keeps its own
best k per query, so k rows per query and task are shuffled, whatever the
corpus holds. More queries than a block are walked block by block. Filters and
scopes apply before the ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.model import DimensionMismatch, InvalidQuery

#: Scores are ranked at nine digits, so that summation order decides nothing.
DIGITS = 9
#: Bytes of query vectors in one broadcast block.
BLOCK_BYTES = 32 * 2**20
ENCODINGS = ("f32", "f16", "bf16", "i8")
METRICS = ("dot", "cosine")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """L2-normalised array; a zero vector stays zero."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def quantise(a: Column) -> Column:
    """Struct of int8 values and a scale: the greatest magnitude becomes 127, halves round away from zero."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = top / 127.0
    values = F.transform(a, lambda x: F.when(top > 0, F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round(x.cast("double") * (127.0 / top))))).otherwise(F.lit(0.0)).cast("tinyint"))
    return F.struct(values.alias("q"), F.when(top > 0, scale).otherwise(F.lit(0.0)).alias("scale"))


def _half_away(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


#: Dimensions up to which sums of products of bytes are exact in single precision: 127 * 127 * 1040 < 2**24.
EXACT_WIDTH = 1040


def _whole(q: np.ndarray) -> np.ndarray:
    """Byte values in the narrowest floats that keep their products exact."""
    return q.astype(np.float32 if q.shape[1] <= EXACT_WIDTH else np.float64)


def encode(m: np.ndarray, encoding: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows as stored, in double, and the scale of each row."""
    if encoding == "i8":
        top = np.abs(m).max(1, initial=0.0)
        safe = np.where(top > 0, top, 1.0)
        q = np.clip(_half_away(m * (127.0 / safe)[:, None]), -128, 127)
        return _whole(np.where((top > 0)[:, None], q, 0.0)), np.where(top > 0, top / 127.0, 0.0)
    ones = np.ones(len(m))
    if encoding == "f16":
        # halves round up in magnitude: add half a step to the bits, then cut
        bits = m.astype(np.float32).view(np.uint32)
        with np.errstate(over="ignore"):
            cut = ((bits + np.uint32(0x1000)) & np.uint32(0xFFFFE000)).view(np.float32)
            return cut.astype(np.float16).astype(np.float64), ones
    if encoding == "bf16":
        bits = m.astype(np.float32).view(np.uint32)
        return ((bits + np.uint32(0x8000)) & np.uint32(0xFFFF0000)).view(np.float32).astype(np.float64), ones
    return m, ones


def prepare(m: np.ndarray, metric: str, encoding: str) -> tuple[np.ndarray, np.ndarray]:
    if metric == "cosine":
        n = np.sqrt((m * m).sum(1))
        m = m / np.where(n > 0, n, 1.0)[:, None]
    return encode(m, encoding)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise DimensionMismatch("a vector is null")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    if n and len(flat) % n:
        raise DimensionMismatch("vectors differ in length")
    out = flat.reshape(n, -1)
    if width is not None and n and out.shape[1] != width:
        raise DimensionMismatch(f"a vector has {out.shape[1]} dimensions, the query {width}")
    return out


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k scores and of all that tie with the last at DIGITS digits."""
    if len(scores) <= k:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - k)[len(scores) - k]
    places = np.flatnonzero(scores >= last - 2 * 10.0**-DIGITS)
    if len(places) > 4 * k + 64:  # many ties: ids decide
        places = places[np.lexsort((ids[places], -np.round(scores[places], DIGITS)))[: 2 * k]] if np.ptp(scores[places]) == 0 else places
    return places


def query_blocks(queries: DataFrame, query_id: str, vector: str, block_bytes: int):
    """Queries as (ids, matrix) in blocks of bounded size."""
    head = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    n, width = head[0], head[1] or 1
    blocks = max(1, -(-n * width * 8 // block_bytes))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b)
        rows = part.select(query_id, vector).orderBy(query_id).toArrow()
        if rows.num_rows:
            yield rows.column(0).combine_chunks(), _matrix(rows.column(1))


def encoded(vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", metric: str = "dot", encoding: str = "f32") -> DataFrame:
    """chunk_id, values, scale: vectors as they are stored, bytes for i8 and floats else; search takes them with stored."""
    kind = "tinyint" if encoding == "i8" else "float"

    def run(batches):
        for b in batches:
            m, scale = prepare(_matrix(b.column(1)), metric, encoding)
            flat = pa.array(m.astype(np.int8 if encoding == "i8" else np.float32).ravel())
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (m.shape[1] if b.num_rows else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat), pa.array(scale)], names=["chunk_id", "values", "scale"])

    rows = vectors.select(F.col(id_col).cast("long").alias("chunk_id"), F.col(vector_col).alias("v")).filter("chunk_id IS NOT NULL")
    return rows.mapInArrow(run, f"chunk_id long, values array<{kind}>, scale double")


def fidelity(vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """chunk_id, cosine of each vector with its quantised form; a zero vector has 1."""
    z = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("_v"), F.transform(quantise(F.col(vector_col))["q"], lambda x: x.cast("double")).alias("_q"))
    size = F.sqrt(dot(F.col("_v"), F.col("_v")) * dot(F.col("_q"), F.col("_q")))
    return z.select("chunk_id", F.when(size > 0, dot(F.col("_v"), F.col("_q")) / size).otherwise(F.lit(1.0)).alias("cosine"))


def check_width(rows: DataFrame, vector_col: str, queries: DataFrame, query_vector: str) -> None:
    """An error on the driver if queries and stored vectors differ in length; of the stored ones the first is looked at, the others as they are read."""
    got = queries.agg(F.min(F.size(query_vector)), F.max(F.size(query_vector))).first()
    if got[0] is None:
        return
    if got[0] != got[1]:
        raise DimensionMismatch(f"queries have {got[0]} to {got[1]} dimensions")
    one = rows.filter(F.col(vector_col).isNotNull()).select(F.size(vector_col)).limit(1).collect()
    if one and one[0][0] != got[0]:
        raise DimensionMismatch(f"vectors have {one[0][0]} dimensions, queries {got[0]}")


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    metric: str = "dot",
    encoding: str = "f32",
    where: Column | None = None,
    scope: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
    stored: bool = False,
) -> DataFrame:
    """query_id, chunk_id, score, rank of the best k of every query; ties go to the smaller id.

    With stored, vectors are rows of encoded() in the same metric and encoding,
    and are not encoded again.

    where filters vectors; scope is a DataFrame of admitted ids. A null id is
    left out; vectors of another length than the query's are an error.
    """
    if metric not in METRICS or encoding not in ENCODINGS:
        raise InvalidQuery(f"metric {metric!r}, encoding {encoding!r}")
    if k < 0:
        raise InvalidQuery("k is negative")
    rows = vectors if where is None else vectors.filter(where)
    vector_col = "values" if stored else vector_col
    scale_col = F.col("scale") if stored else F.lit(1.0)
    rows = rows.select(F.col(id_col).cast("long").alias("chunk_id"), F.col(vector_col).alias("v"), scale_col.alias("scale")).filter("chunk_id IS NOT NULL")
    if scope is not None:
        rows = rows.join(scope.select(F.col(scope.columns[0]).cast("long").alias("chunk_id")), "chunk_id", "left_semi")
    kind = queries.schema[query_id].dataType.simpleString()
    check_width(vectors, vector_col, queries, query_vector)
    if k == 0:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id long, score double, rank long")
    found = None
    for ids, matrix in query_blocks(queries, query_id, query_vector, block_bytes):
        shared = queries.sparkSession.sparkContext.broadcast((ids, *prepare(matrix, metric, encoding)))

        def local_best(batches, shared=shared):
            names, q, scale = shared.value
            held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(len(names))]
            for b in batches:
                if not b.num_rows:
                    continue
                chunk = _matrix(b.column(1), q.shape[1])
                if stored:
                    chunk, rows_scale = (_whole(chunk) if encoding == "i8" else chunk), b.column(2).to_numpy(zero_copy_only=False)
                else:
                    chunk, rows_scale = prepare(chunk, metric, encoding)
                chunk_ids = b.column(0).to_numpy(zero_copy_only=False)
                scores = (chunk @ q.T) * rows_scale[:, None] * scale[None, :]
                scores = np.where(np.isfinite(scores), scores, 0.0)
                for j in range(len(names)):
                    s, i = np.concatenate([held[j][0], scores[:, j]]), np.concatenate([held[j][1], chunk_ids])
                    keep = best_rows(s, i, k)
                    held[j] = s[keep], i[keep]
            sizes = [len(x[0]) for x in held]
            if sum(sizes):
                which = np.repeat(np.arange(len(names)), sizes)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), pa.array(np.concatenate([x[1] for x in held])), pa.array(np.concatenate([x[0] for x in held]))], names=["query_id", "chunk_id", "score"])

        part = rows.mapInArrow(local_best, f"query_id {kind}, chunk_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id long, score double, rank long")
    return top_k(found, k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Rank within each query: score downwards at DIGITS digits, then id."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
