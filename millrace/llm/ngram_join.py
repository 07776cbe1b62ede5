"""Similarity self-join of documents on word n-grams, by Jaccard similarity.

Texts with one set of shingles form a class; everything below works on classes.

1. One pass hashes shingles, fingerprints sets and sketches how often shingles
   occur (one counter per hash bucket). The sketch sets a global rare-first
   order; any order is correct, this one keeps frequent shingles out of
   prefixes.
2. A class puts out its prefix: two classes similar enough share a shingle of
   both prefixes. Classes that share one form a bucket.
3. A small bucket gives all its pairs that pass the length and the positional
   filter. A large bucket gives only pairs with its least class, the pivot.
4. These pairs are verified, each once, on whole sets; before that, counts of
   both sets over ranges of the hash space bound the difference from below (the
   suffix filter). Members of large buckets are also written as differences from
   their pivot, and steps of least labels over the links found merge most of a
   group of near copies.
5. What is left of a pivot's group are pairs of members under different labels.
   |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, so members under other labels than the
   group's most frequent one are judged against all by products of incidence
   matrices of the differences, block by block. A block gives no pairs but what
   connects its members, at most a row each. A pair that shares two pivots is
   judged in both groups. Where a group of k near copies has r members that are
   similar to no pivot of the group, this takes k * r products.
6. Links are counted in full once components are known, as similar classes lie
   in one component. Every class is written as its difference from the least
   class; |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, so all pairs of two blocks of
   classes are judged by products of their incidence matrices. This takes
   k * k / 2 pairs for a component of k classes, whatever their similarity.

Similarity is exact in integers: percent * union <= 100 * intersection.

Defined results: null text and text without words have an empty set and link
with nothing; a text of fewer words than n is one shingle, its whole sequence;
rows with a null id get the component of their class and link nothing
themselves; repeated rows and ties share a class; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import textkit as tk
from millrace.llm.components import components
from millrace.llm.sizes import small_or_shuffled
from millrace.session import cut

U64 = np.uint64
#: Buckets of up to this many classes are joined pair by pair; larger ones go by their pivot.
SMALL_BUCKET = 24
LABEL_STEPS = 3
SALTS = 16
#: Classes of a group or component in a block of pairs, on average: a sixteenth of it, within these bounds.
LEAST_BLOCK = 128
LINK_BLOCK = 512
#: Columns of an incidence matrix at a time.
LINK_COLUMNS = 2048
#: Counters of the frequency sketch, as powers of two: sixteen for each document within these bounds. Tasks send
#: them compressed, which takes no more than a few bits for each shingle that a task has read.
SKETCH_BITS = (18, 24)
RANGES = 16
#: Bytes of differences that a task holds before it puts them out.
FLUSH_BYTES = 1 << 22


def shingle_sets(offsets, data, n: int):
    """Sorted distinct shingle hashes of each text, and first of each text."""
    w = tk.Words(offsets, data)
    hashes, begin = tk.window_hash(w.hashes, w.first, n)
    return tk.ragged_unique(hashes, begin)


def _class_ids(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """16 bytes that name each set: two independent sums of its mixed members."""
    n = np.diff(begin).astype(U64)
    out = np.zeros((len(n), 2), U64)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(tk.mix(values ^ U64(salt)), dtype=U64)])
        out[:, k] = tk.mix((total[begin[1:]] - total[begin[:-1]]) + n * U64(salt | 1))
    return out


def _binary16(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _binaries(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer((begin * 8).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _sketch_bits(n_docs: int) -> int:
    return int(min(SKETCH_BITS[1], max(SKETCH_BITS[0], np.ceil(np.log2(max(n_docs, 1))) + 4)))


def _measure(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Per document: doc_id, class, size; and the task's sketch in pieces, as rows with a piece number."""
    kind = docs.schema["doc_id"].dataType
    piece_bits = min(bits, 14)

    def run(batches):
        sketch = np.zeros(1 << bits, np.int32)
        arrow_id = None
        for b in batches:
            arrow_id = b.schema.field(0).type
            for lo, hi, offsets, data in tk.blocks(b.column(1)):
                values, begin = shingle_sets(offsets, data, n)
                np.add.at(sketch, (values >> U64(64 - bits)).astype(np.int64), 1)
                size = np.diff(begin)
                rows = hi - lo
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, rows), _binary16(_class_ids(values, begin)), pa.array(size.astype(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=["doc_id", "cls", "size", "piece", "counts"])
        if arrow_id is not None and sketch.any():
            parts = np.minimum(sketch, 255).astype(np.uint8).reshape(-1, 1 << piece_bits)
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, arrow_id), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["doc_id", "cls", "size", "piece", "counts"])

    return docs.select("doc_id", "text").mapInArrow(tk.tidy(run), f"doc_id {kind.simpleString()}, cls binary, size long, piece int, counts binary")


def _merge_sketch(pieces: DataFrame, bits: int) -> np.ndarray:
    """Sum of the tasks' sketches; its size is set by `bits`, whatever the corpus."""

    def add(key, table, kind):
        total = np.zeros(0, np.int64)
        for v in table.column("counts"):
            x = np.frombuffer(zlib.decompress(v.as_py()), kind).astype(np.int64)
            total = x if not len(total) else total + x
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)], pa.binary())})

    # a second key spreads the tasks' pieces before the last sum
    spread = pieces.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(8)))
    half = spread.groupBy("piece", "part").applyInArrow(lambda key, t: add(key, t, np.uint8), "piece int, counts binary")
    out = np.zeros(1 << bits, np.int32)
    for row in half.groupBy("piece").applyInArrow(lambda key, t: add(key, t, np.int32), "piece int, counts binary").collect():
        part = np.frombuffer(zlib.decompress(row["counts"]), np.int32)
        out[row["piece"] * len(part) : (row["piece"] + 1) * len(part)] = part
    return out


def max_difference(a, b, percent: int):
    """Greatest symmetric difference of sets of sizes a and b that are still similar."""
    return (a + b) * (100 - percent) // (100 + percent)


def _prefix_rows(docs: DataFrame, n: int, percent: int, bits: int, sketch) -> DataFrame:
    def run(batches):
        counts = sketch.value
        for b in batches:
            for _, _, offsets, data in tk.blocks(b.column(0)):
                values, begin = shingle_sets(offsets, data, n)
                size = np.diff(begin)
                doc = np.repeat(np.arange(len(size)), size)
                rank = counts[(values >> U64(64 - bits)).astype(np.int64)].astype(np.int64)
                order = np.argsort((doc << 32) | rank, kind="stable")  # by text, then rare first, then hash
                values = values[order]
                pos = np.arange(len(values)) - np.repeat(begin[:-1], size)
                # |x| - least overlap + 1, with the least overlap over partners of any size
                prefix = size - (size * percent + 99) // 100 + 1
                keep = pos < prefix[doc]
                ids = _class_ids(values, begin)  # sums do not depend on the order within a set
                yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), _binary16(ids[doc[keep]]), pa.array(size[doc[keep]].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["token", "cls", "size", "pos"])

    return docs.select("text").mapInArrow(tk.tidy(run), "token long, cls binary, size int, pos int")


def _buckets(rows: DataFrame) -> DataFrame:
    """Rows of buckets of two classes or more, with the bucket's count and its pivot: the class with fewest rarer elements before."""
    per = rows.repartition("token").dropDuplicates(["token", "cls"])
    bucket = Window.partitionBy("token")
    counted = per.select("*", F.count("cls").over(bucket).alias("members"), F.min(F.struct("pos", "cls")).over(bucket)["cls"].alias("pivot"))
    return counted.filter("members > 1")


def _tasks(buckets: DataFrame, percent: int, small_bucket: int) -> DataFrame:
    """(pivot, cls, expand): pairs to verify; expand asks for the difference as well.

    Sizes of sets give the length filter. Similar classes share (a + b - allowed
    difference) / 2 elements, and none before their first shared one: the
    positional filter.
    """
    small = buckets.filter(F.col("members") <= small_bucket)
    a, b = small.alias("a"), small.alias("b")
    near = (F.col("a.token") == F.col("b.token")) & (F.col("a.cls") < F.col("b.cls"))
    sa, sb = F.col("a.size"), F.col("b.size")
    near &= 100 * F.least(sa, sb) >= percent * F.greatest(sa, sb)
    allowed = F.floor((sa + sb) * (100 - percent) / F.lit(100.0 + percent) + 1e-9)
    near &= 2 * F.least(sa - F.col("a.pos"), sb - F.col("b.pos")) >= sa + sb - allowed
    pairs = a.join(b, near).select(F.col("a.cls").alias("pivot"), F.col("b.cls").alias("cls"), F.lit(False).alias("expand"))
    large = buckets.filter((F.col("members") > small_bucket) & (F.col("cls") != F.col("pivot"))).select("pivot", "cls", F.lit(True).alias("expand"))
    return pairs.unionByName(large).groupBy("pivot", "cls").agg(F.max("expand").alias("expand"))


def _verify(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(pivot, cls, linked, size, diff): pairs that are similar, and all members that were to be expanded with their difference from the pivot."""
    salted = tasks.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    heads = salted.select("pivot", "salt").distinct().select("pivot", "salt", F.col("pivot").alias("cls"), F.lit(False).alias("expand"), F.lit(True).alias("head"))
    work = salted.select("pivot", "salt", "cls", "expand", F.lit(False).alias("head")).unionByName(heads).join(sets, "cls")
    # a representative's row that repeats gives its set again; equal classes are next to each other, and only the first counts
    work = work.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("head").desc(), "cls")

    def run(batches):
        held, mine, own_hist, last = None, None, None, None
        edges = np.arange(1, RANGES, dtype=U64) << U64(60)
        hist = lambda x: np.diff(np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]))
        for b in batches:
            out, held_bytes = ([], [], [], [], []), 0
            pivots, classes, expands, heads, blobs = (b.column(b.schema.get_field_index(c)) for c in ("pivot", "cls", "expand", "head", "shingles"))
            for pivot, cls, expand, head, blob in zip(pivots.to_pylist(), classes.to_pylist(), expands.to_pylist(), heads.to_pylist(), blobs):
                values = np.frombuffer(blob.as_buffer(), U64)
                if head:
                    held, mine, own_hist, last = pivot, values.copy(), hist(values), None
                    continue
                if held != pivot:
                    raise ValueError("a pair arrived without its pivot")
                if cls == last:
                    continue
                last = cls
                allowed = max_difference(len(values), len(mine), percent)
                if not expand and np.abs(hist(values) - own_hist).sum() > allowed:
                    continue
                merged = np.concatenate([mine, values])
                merged.sort(kind="stable")
                twin = merged[1:] == merged[:-1]
                linked = len(merged) - 2 * int(twin.sum()) <= allowed
                diff = None
                if expand:
                    single = np.ones(len(merged), bool)
                    single[1:] &= ~twin
                    single[:-1] &= ~twin
                    diff = merged[single].tobytes()
                    held_bytes += len(diff)
                if linked or expand:
                    _put(out, pivot, cls, linked, len(values), diff)
                if held_bytes >= FLUSH_BYTES:
                    yield _verified(out)
                    out, held_bytes = ([], [], [], [], []), 0
            if out[0]:
                yield _verified(out)

    return work.select("pivot", "salt", "cls", "expand", "head", "shingles").mapInArrow(tk.tidy(run), "pivot binary, cls binary, linked boolean, size long, diff binary")


def _verified(out) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["pivot", "cls", "linked", "size", "diff"])


def _labels(links: DataFrame) -> DataFrame:
    """(cls, label) after LABEL_STEPS steps of least labels over links (pivot, cls).

    Equal labels mean one component; a component can keep several, which costs
    comparisons but no result.
    """
    known = links.select(F.col("pivot").alias("cls")).unionByName(links.select("cls")).distinct().withColumn("label", F.col("cls"))
    for _ in range(LABEL_STEPS):
        known = cut(known)
        named = small_or_shuffled(known)
        least = links.join(named.select(F.col("cls").alias("pivot"), F.col("label").alias("_p")), "pivot").join(named.select("cls", F.col("label").alias("_c")), "cls")
        least = least.withColumn("label", F.least("_p", "_c"))
        known = known.unionByName(least.select(F.col("pivot").alias("cls"), "label")).unionByName(least.select("cls", "label")).groupBy("cls").agg(F.min("label").alias("label"))
    return cut(known)


def _within_groups(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (pivot, cls) that connect similar members under different labels within the groups of pivots; members: pivot, cls, size, diff."""
    named = members.select("pivot", "cls").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = cut(named)
    held = named.groupBy("pivot", "label").agg(F.count("*").alias("n"))
    groups = held.groupBy("pivot").agg(F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    block = F.least(F.lit(LINK_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.col("members") / 16))
    groups = groups.select("pivot", F.col("top.label").alias("major"), F.ceil(F.col("members") / block).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil((F.col("members") - F.col("top.n")) / block)).cast("int").alias("minor_parts"))
    rows = members.join(named, ["pivot", "cls"]).join(small_or_shuffled(cut(groups)), "pivot")
    place = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    all_of = rows.select("pivot", F.explode(F.sequence(F.lit(0), F.col("minor_parts") - 1)).alias("i"), place(F.col("parts")).alias("j"), F.lit(False).alias("minor"), "cls", "size", "label", "diff")
    minor = rows.filter("label <> major").select("pivot", place(F.col("minor_parts")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("minor"), "cls", "size", "label", "diff")
    rows = all_of.unionByName(minor).repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")

    def connect(group):
        minor, classes, sizes, labels, diffs = zip(*group)
        sizes, flag = np.array(sizes), np.array(minor)
        left, right = np.flatnonzero(flag), np.flatnonzero(~flag)
        if not len(left) or not len(right):
            return None
        near = _linked(sizes, [np.frombuffer(d, U64) for d in diffs], left, right, percent)
        _, name = np.unique([x.hex() for x in labels], return_inverse=True)
        near &= name[left][:, None] != name[right][None]
        # least places spread over the links until nothing changes; each member then points to its place
        at = np.arange(len(flag))
        while True:
            over = np.where(near, at[right][None], len(flag)).min(1, initial=len(flag))
            back = np.where(near, at[left][:, None], len(flag)).min(0, initial=len(flag))
            new = at.copy()
            new[left], new[right] = np.minimum(at[left], over), np.minimum(at[right], back)
            if (new == at).all():
                break
            at = new
        moved = np.flatnonzero(at != np.arange(len(flag)))
        if not len(moved):
            return None
        return pa.RecordBatch.from_arrays([pa.array([classes[i] for i in at[moved]], pa.binary()), pa.array([classes[i] for i in moved], pa.binary())], names=["pivot", "cls"])

    def run(batches):
        key, group = None, []
        for b in batches:
            for *now, minor, cls, size, label, diff in zip(*(b.column(k).to_pylist() for k in range(b.num_columns - 1)), b.column(b.num_columns - 1)):
                if now != key:
                    found = connect(group) if group else None
                    if found is not None:
                        yield found
                    key, group = now, []
                group.append((minor, cls, size, label, diff.as_buffer().to_pybytes()))
        found = connect(group) if group else None
        if found is not None:
            yield found

    return rows.mapInArrow(tk.tidy(run), "pivot binary, cls binary").filter("pivot <> cls").distinct()


def _put(out, *values) -> None:
    for column, value in zip(out, values):
        column.append(value)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cls, shingles) of the wanted classes, from the texts of their representatives."""
    chosen = docs.join(small_or_shuffled(wanted.select("doc_id")), "doc_id", "left_semi")

    def run(batches):
        for b in batches:
            for lo, hi, offsets, data in tk.blocks(b.column(0)):
                values, begin = shingle_sets(offsets, data, n)
                yield pa.RecordBatch.from_arrays([_binary16(_class_ids(values, begin)), _binaries(values, begin)], names=["cls", "shingles"])

    return chosen.select("text").mapInArrow(tk.tidy(run), "cls binary, shingles binary")


def _from_pivots(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, cls, diff): the difference of every member from the pivot of its component."""
    salted = members.select("pivot", "cls", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(False).alias("head"))
    heads = salted.select("pivot", F.col("pivot").alias("cls"), "salt", F.lit(True).alias("head")).distinct()
    work = salted.unionByName(heads).join(sets, "cls")
    work = work.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("head").desc(), "cls")

    def run(batches):
        held, mine, last = None, None, None
        for b in batches:
            out = ([], [], [])
            pivots, classes, heads, blobs = (b.column(b.schema.get_field_index(c)) for c in ("pivot", "cls", "head", "shingles"))
            for pivot, cls, head, blob in zip(pivots.to_pylist(), classes.to_pylist(), heads.to_pylist(), blobs):
                values = np.frombuffer(blob.as_buffer(), U64)
                if head:
                    held, mine, last = pivot, values, None
                    continue
                if held != pivot:
                    raise ValueError("a member arrived without its pivot")
                if cls != last:
                    _put(out, pivot, cls, np.setxor1d(mine, values, assume_unique=True).tobytes())
                last = cls
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["pivot", "cls", "diff"])

    return work.select("pivot", "salt", "cls", "head", "shingles").mapInArrow(tk.tidy(run), "pivot binary, cls binary, diff binary")


def _linked(sizes: np.ndarray, diffs: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether each class of `left` is similar to each of `right`; both hold positions in sizes and diffs."""
    count = np.array([len(d) for d in diffs])
    # an element of one difference is common to no pair; only the others get a column, so that memory is little more than the elements'
    values = np.concatenate(diffs)
    values.sort()
    shared = np.unique(values[1:][values[1:] == values[:-1]])
    del values
    rows, columns = [], []
    for i, d in enumerate(diffs):
        at = np.searchsorted(shared, d)
        at = at[shared[np.minimum(at, max(len(shared) - 1, 0))] == d] if len(shared) else at[:0]
        rows.append(np.full(len(at), i, np.int32))
        columns.append(at.astype(np.int32))
    row, column = np.concatenate(rows), np.concatenate(columns)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, LINK_COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + LINK_COLUMNS]))
        held = np.zeros((len(diffs), int(column[part][-1]) - lo + 1), np.float32)
        held[row[part], column[part] - lo] = 1
        common += np.rint(held[left] @ held[right].T).astype(np.int64)
    apart = count[left][:, None] + count[right][None] - 2 * common
    return apart <= max_difference(sizes[left][:, None], sizes[right][None], percent)


def _count_links(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """(cls, n_links) of members, rows (pivot, cls, rep, size) with one pivot for each component: all links of a class with other classes."""
    diffs = cut(_from_pivots(members, _sets(docs, members.select(F.col("rep").alias("doc_id")), n)))
    block = F.least(F.lit(LINK_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.count("*") / 16))
    parts = members.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    many = small_or_shuffled(cut(parts.filter("parts > 1")))
    rows = diffs.join(members.select("cls", "size"), "cls").join(many, "pivot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("pivot", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "cls", "size", "diff")
    rows = rows.repartition("pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi")

    def run(batches):
        key, group = None, []

        def flush():
            sizes, part = np.array([g[2] for g in group]), np.array([g[0] for g in group])
            left, right = np.flatnonzero(part == key[1]), np.flatnonzero(part == key[2])
            near = _linked(sizes, [np.frombuffer(g[3], U64) for g in group], left, right, percent)
            if key[1] == key[2]:
                np.fill_diagonal(near, False)
                links = near.sum(1)
            else:
                links = np.zeros(len(group), np.int64)
                links[left], links[right] = near.sum(1), near.sum(0)
            return pa.RecordBatch.from_arrays([pa.array([g[1] for g in group], pa.binary()), pa.array(links.astype(np.int64))], names=["cls", "links"])

        for b in batches:
            for *now, part, cls, size, diff in zip(*(b.column(k).to_pylist() for k in range(b.num_columns - 1)), b.column(b.num_columns - 1)):
                if now != key:
                    if group:
                        yield flush()
                    key, group = now, []
                group.append((part, cls, size, diff.as_buffer().to_pybytes()))
        if group:
            yield flush()

    return rows.mapInArrow(tk.tidy(run), "cls binary, links long").groupBy("cls").agg(F.sum("links").alias("n_links"))


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (least id with the same set), component_id, n_links.

    n_links counts all other classes that are similar to the row's class. With
    count_links off the column is left out; components do not need it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bits = _sketch_bits(docs.count())
    measured = cut(_measure(docs, n, bits))
    rows = measured.filter(F.col("piece").isNull()).select("doc_id", "cls", "size")
    sketch = spark.sparkContext.broadcast(_merge_sketch(measured.filter(F.col("piece").isNotNull()).select("piece", "counts"), bits))
    reps = cut(rows.filter(F.col("doc_id").isNotNull() & (F.col("size") > 0)).groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size")))
    prefixes = _prefix_rows(docs.filter(F.col("doc_id").isNotNull()), n, percent, bits, sketch)
    tasks = cut(_tasks(cut(_buckets(prefixes)), percent, SMALL_BUCKET))
    wanted = tasks.select("pivot").unionByName(tasks.select(F.col("cls").alias("pivot"))).distinct()
    wanted = cut(wanted.join(reps, wanted["pivot"] == reps["cls"]).select(F.col("rep").alias("doc_id")))
    found = cut(_verify(tasks, _sets(docs, wanted, n), percent))
    links = found.filter("linked").select("pivot", "cls")
    members = found.filter("diff IS NOT NULL").select("pivot", "cls", "size", "diff")
    if not members.isEmpty():
        links = links.unionByName(cut(_within_groups(members, _labels(links), percent)))
    named = links.join(reps.select(F.col("cls"), F.col("rep").alias("b")), "cls").join(reps.select(F.col("cls").alias("pivot"), F.col("rep").alias("a")), "pivot").select("a", "b")
    named = cut(named.distinct())
    comps = components(named, "a", "b")
    groups = cut(comps.join(reps.select(F.col("rep").alias("node"), "cls", "size"), "node"))
    if count_links:
        heads = groups.filter("node = label").groupBy("label").agg(F.min("cls").alias("pivot"))
        members = cut(groups.join(heads, "label").select("pivot", "cls", F.col("node").alias("rep"), "size"))
        groups = groups.join(_count_links(docs, members, n, percent), "cls")
    else:
        groups = groups.withColumn("n_links", F.lit(0))
    groups = groups.select(F.col("cls").alias("linked"), "node", "label", "n_links")
    # classes of one row that link with nothing need no join; the others are spread over salts
    shared = reps.join(groups, reps["cls"] == groups["linked"], "left").filter((F.col("copies") > 1) | F.col("node").isNotNull())
    shared = shared.select("cls", "rep", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(shared, ["cls", "salt"], "left")
    empty = F.col("size") == 0
    return out.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.coalesce("label", "doc_id")).alias("component_id"),
        *([F.when(empty, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")] if count_links else []),
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the members of a group other than the one of least id; of rows with one id and text one stays.

    Rows without an id stay. An id is taken to name one text: where it names
    several, they go or stay together.
    """
    groups = cut(similar_groups(docs, n, percent, count_links=False))
    gone = cut(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    twice = cut(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    kept = docs.join(small_or_shuffled(gone), "doc_id", "left_anti")
    if twice.limit(1).count():
        many = small_or_shuffled(twice)
        others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
        place = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(others))
        one = kept.join(many, "doc_id", "left_semi").withColumn("_place", place).filter("_place = 1")
        kept = kept.join(many, "doc_id", "left_anti").unionByName(one.select(*kept.columns))
    return kept.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar_groups(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
