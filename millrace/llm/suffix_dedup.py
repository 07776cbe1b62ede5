"""Removal of repeated passages by a distributed merge sort of suffixes.

Every byte covered by a string of `length` bytes that also starts elsewhere is
taken out. Sorting the suffixes of all positions would move the corpus many
times over, so suffixes are sorted at anchors only.

1. Anchors. Among the k-grams that start in any window of w = length - k + 1
   consecutive places, the one of least hash is the window's anchor. Equal
   strings of `length` bytes have their anchor at the same place, so the
   anchors of repeated strings are k-grams that occur twice; a count over k-gram
   hashes leaves only these. An anchor carries the range of distances at which
   it is the anchor of a window.
2. Runs. Each task takes, for each of its candidate anchors, the suffix from the
   anchor (cut at `length` bytes) and the bytes before it, and sorts by suffix.
   Equal contexts become one entry with a list of places. The run goes out
   front-coded: shared prefix length, rest.
3. Merge. Runs are exchanged by the k-gram's hash, and by the bytes behind it
   where one k-gram is very common. A loser tree merges the runs: entries carry
   the length of the prefix they share with the last winner, a longer one wins
   without a look at the bytes, and equal ones are compared from there on. The
   merge yields the order and its common prefixes.
4. Decision. The same contexts are sorted by the bytes before the anchor, read
   backwards. A window that starts d bytes before its anchor is repeated if
   another entry shares d bytes before and length - d bytes after it, that is if
   two entries fall into one class of both orders cut at these depths.

Matches are found on bytes; hashes only choose candidates.

Defined results: null and empty texts have no bytes and lose none; a text
shorter than `length` loses none; strings do not cross documents; repeated
rows are documents of their own, told apart by a row number; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkit as tk
from millrace.llm.sizes import small_or_shuffled
from millrace.session import cut

U64 = np.uint64
LENGTH = 400
GRAM = 128
#: Occurrences of one k-gram from which its anchors are dealt by the bytes behind it as well.
HOT = 2000
#: Bytes of contexts that a merge takes on, on average, beyond the least number of parts.
PART_BYTES = 32_000_000
#: Memory of a run before it is sorted and sent on.
RUN_BYTES = 32_000_000


#: Words of passages that are counted where they stand in several rows, and of the marks that tell of them.
PASSAGE_WORDS = 51
PASSAGE_GRAM = 36
#: Windows looked at together; places within them take the low bits of a packed word.
SEGMENT = 1 << 20
PLACE = U64((1 << 24) - 1)
#: Distances dealt together where a k-gram is hot.
STEP = 64


def find_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, k-gram hashes, and least and greatest distance from a window's start, of one text's anchors.

    Within a window the place of least hash counts, the leftmost among equals,
    so what a window holds decides where its anchor lies.
    """
    parts = []
    w = length - gram + 1
    for base in range(0, len(data) - length + 1, SEGMENT):
        piece = data[base : base + SEGMENT + length - 1]
        grams = len(piece) - gram + 1
        windows = len(piece) - length + 1
        begin = np.arange(grams)
        hashes = tk.span_hash(tk.prefix_hash(piece), begin, begin + gram)
        packed = np.full(-(-grams // w) * w, np.iinfo(np.uint64).max, U64)
        packed[:grams] = (hashes & ~PLACE) | begin.astype(U64)
        # least of each window: running minima within blocks of w, from both ends
        ahead = np.minimum.accumulate(packed.reshape(-1, w), 1).ravel()
        back = np.minimum.accumulate(packed.reshape(-1, w)[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], windows) - 1
        at = place[first]
        parts.append((at + base, hashes[at], at - last, at - first))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.view(U64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


class LoserTree:
    """Merges sorted runs of (suffix, shared prefix with the entry before) without comparing known prefixes again."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = [r for r in runs if r[0]]
        self.k = len(self.runs)
        self.at = [0] * self.k
        self.lcp = [0] * self.k  # with the last winner
        self.losers = [-1] * max(self.k, 1)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; the loser learns the prefix it shares with the winner."""
        if a < 0 or b < 0:
            return b < 0
        done_a, done_b = self.at[a] >= len(self.runs[a][0]), self.at[b] >= len(self.runs[b][0])
        if done_a or done_b:
            return done_b and (not done_a or a < b)
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            # the one that shares more with the last winner is closer to it; the other's prefix stays as it is
            return la > lb
        x, y = self.runs[a][0][self.at[a]], self.runs[b][0][self.at[b]]
        shared = la + common_prefix(x, y, la)
        first = shared == len(x) or (shared < len(y) and x[shared] < y[shared])
        if first and shared == len(x) == len(y):
            first = a < b
        if first:
            self.lcp[b] = shared
        else:
            self.lcp[a] = shared
        return first

    def merge(self):
        """Yields (run, index in run, prefix shared with the entry before)."""
        if not self.k:
            return
        k = self.k
        # build: play every leaf up the tree
        winners = [-1] * (2 * k)
        winners[k:] = range(k)
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._beats(a, b):
                winners[node], self.losers[node] = a, b
            else:
                winners[node], self.losers[node] = b, a
        best = winners[1] if k > 1 else 0
        while self.at[best] < len(self.runs[best][0]):
            i = self.at[best]
            yield best, i, self.lcp[best]
            self.at[best] = i + 1
            # the next entry of this run shares with the winner what it shares with its predecessor
            self.lcp[best] = self.runs[best][1][i + 1] if i + 1 < len(self.runs[best][0]) else 0
            node = (best + k) // 2
            while node:
                if self._beats(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2


def common_prefix(x: bytes, y: bytes, start: int) -> int:
    """Bytes that x and y share from start on."""
    n = min(len(x), len(y)) - start
    if n <= 0:
        return 0
    a, b = np.frombuffer(x, np.uint8, n, start), np.frombuffer(y, np.uint8, n, start)
    if n > 16:  # most entries part early
        head = a[:16] != b[:16]
        if head.any():
            return int(head.argmax())
    differ = a != b
    at = int(differ.argmax())
    return at if differ[at] else n


def neighbour_prefixes(items: list[bytes]) -> list[int]:
    """Prefix that each item of a sorted list shares with the one before."""
    return [0] * min(1, len(items)) + [common_prefix(items[i - 1], items[i], 0) for i in range(1, len(items))]


def repeated_windows(after_order: np.ndarray, after_lcp: np.ndarray, before: list[bytes], lo: np.ndarray, hi: np.ndarray, room: np.ndarray, many: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each distance d: (entries, flags) of entries with a window at d, flag set where the window is repeated.

    after_order: entries in suffix order; after_lcp: prefix shared with the one
    before. many: entries that stand for more than one place.
    """
    n = len(before)
    order_b = sorted(range(n), key=before.__getitem__)
    lcp_b = np.array(neighbour_prefixes([before[i] for i in order_b]), np.int64)
    order_b = np.array(order_b)
    rank_a, rank_b = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_a[after_order], rank_b[order_b] = np.arange(n), np.arange(n)
    out = []
    for d in range(int(lo.min()), int(hi.max()) + 1):
        # what a window holds decides its anchor, so equal windows are active together
        active = np.flatnonzero((lo <= d) & (d <= hi) & (room >= length - d))
        if not len(active):
            continue
        class_a = np.cumsum(after_lcp < length - d)[rank_a[active]]
        class_b = np.cumsum(lcp_b < d)[rank_b[active]]
        _, which, size = np.unique(class_a * np.int64(n + 1) + class_b, return_inverse=True, return_counts=True)
        out.append((d, active, (size[which] > 1) | many[active]))
    return out


def _candidates(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of every text: _id, _h, at, key, lo, hi."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for first, _, offsets, data in tk.blocks(b.column(2)):
                parts = []
                for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
                    at, key, lo, hi = find_anchors(data[offsets[i] : offsets[i + 1]], length, gram)
                    parts.append((np.full(len(at), first + i), at, key.view(np.int64), lo, hi))
                if parts:
                    row, at, key, lo, hi = (np.concatenate(x) for x in zip(*parts))
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(at), pa.array(key), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["_id", "_h", "at", "key", "lo", "hi"])

    return docs.select("_id", "_h", "_text").mapInArrow(tk.tidy(run), f"_id {kind}, _h long, at long, key long, lo int, hi int")


def _front_code(suffixes: list[bytes]) -> tuple[list[int], bytes]:
    lcp = neighbour_prefixes(suffixes)
    return lcp, b"".join(x[n:] for x, n in zip(suffixes, lcp))


def _decode(lcp: np.ndarray, sizes: np.ndarray, rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for n, size in zip(lcp.tolist(), sizes.tolist()):
        take = size - n
        last = last[:n] + rest[at : at + take]
        at += take
        out.append(last)
    return out


_RUN = "part int, lcp binary, sizes binary, rest binary, before binary, before_sizes binary, lo binary, hi binary, ids binary, places binary, n_places binary"


def _targets(key: int, hot: bool, lo: int, hi: int, suffix: bytes, before: bytes, length: int, parts: int):
    """(part, lo, hi) that an anchor goes to.

    Entries that match at a distance from d to d + STEP - 1 share d bytes before
    the anchor and length - d - STEP + 1 behind it, so a hot k-gram can be dealt
    out by these as well, step by step.
    """
    if not hot:
        yield key % parts, lo, hi
        return
    for d in range(lo - lo % STEP, hi + 1, STEP):
        common = hash_bytes(before[:d] + b"\0" + suffix[: max(0, length - d - STEP + 1)])
        yield (key ^ common ^ d) % parts, max(lo, d), min(hi, d + STEP - 1)


def _runs(anchored: DataFrame, parts: int, length: int) -> DataFrame:
    """Sorted front-coded runs, one per task and target part; a row of _id and _h is known by its number in the run."""
    blob = lambda x, kind: np.array(x, kind).tobytes()

    def emit(held):
        for part, entries in held.items():
            keys = sorted(entries)
            suffixes = [k[0] for k in keys]
            lcp, rest = _front_code(suffixes)
            before = [k[1] for k in keys]
            places = [entries[k] for k in keys]
            flat = [p for x in places for p in x]
            row = [blob(lcp, np.int32), blob([len(x) for x in suffixes], np.int32), rest, b"".join(before), blob([len(x) for x in before], np.int32), blob([k[2] for k in keys], np.int32), blob([k[3] for k in keys], np.int32), json.dumps([p[0] for p in flat]).encode(), blob([p[1:] for p in flat], np.int64), blob([len(x) for x in places], np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=[c.split()[0] for c in _RUN.split(", ")])

    def run(batches):
        held, size = {}, 0
        for b in batches:
            for doc, h, text, mine in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                data = text.as_buffer().to_pybytes()
                for s in mine.as_py():
                    at = s["at"]
                    suffix, before = data[at : at + length], data[at - s["hi"] : at][::-1]
                    for part, lo, hi in _targets(s["key"], s["hot"], s["lo"], s["hi"], suffix, before, length, parts):
                        entries = held.setdefault(part, {})
                        name = (suffix, before[:hi], lo, hi)
                        known = entries.get(name)
                        if known is None:
                            entries[name] = [(doc, h, at)]
                            size += len(suffix) + hi + 400
                        else:
                            known.append((doc, h, at))
                            size += 100
                if size > RUN_BYTES:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)
        held = None

    return anchored.mapInArrow(tk.tidy(run), _RUN)


def hash_bytes(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def _merge(runs: DataFrame, kind: str, length: int) -> DataFrame:
    """Repeated spans (_id, _h, start, end), not yet united."""

    def merge(rows: list[dict]):
        sorted_runs, before, ids = [], [], []
        lo, hi, places, n_places = [], [], [], []
        for row in rows:
            read = lambda name, dtype: np.frombuffer(row[name], dtype)  # noqa: B023, E731
            lcp = read("lcp", np.int32)
            sorted_runs.append((_decode(lcp, read("sizes", np.int32), row["rest"]), lcp.tolist()))
            at = 0
            for n in read("before_sizes", np.int32).tolist():
                before.append(row["before"][at : at + n])
                at += n
            lo.append(read("lo", np.int32))
            hi.append(read("hi", np.int32))
            ids += json.loads(row["ids"])
            places.append(read("places", np.int64).reshape(-1, 2))
            n_places.append(read("n_places", np.int32))
        first = np.concatenate([[0], np.cumsum([len(r[0]) for r in sorted_runs])])
        lo, hi, places, n_places = (np.concatenate(x) for x in (lo, hi, places, n_places))
        merged = list(LoserTree(sorted_runs).merge())
        order = np.array([first[run] + index for run, index, _ in merged])
        lcps = np.array([shared for _, _, shared in merged])
        room = np.array([len(x) for r in sorted_runs for x in r[0]])
        found = [np.stack([entries[flags], np.full(int(flags.sum()), d)], 1) for d, entries, flags in repeated_windows(order, lcps, before, lo, hi, room, n_places > 1, length)]
        hit = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if not len(hit):
            return
        hit = hit[np.lexsort((-hit[:, 1], hit[:, 0]))]  # by entry, then from left to right
        head = np.flatnonzero(np.concatenate([[True], (hit[1:, 0] != hit[:-1, 0]) | (hit[1:, 1] != hit[:-1, 1] - 1)]))
        tail = np.append(head[1:], len(hit)) - 1
        entry, left, right = hit[head, 0], hit[head, 1], hit[tail, 1]
        # spans of an entry hold for each of its places
        where = np.concatenate([[0], np.cumsum(n_places)])
        count = n_places[entry]
        rep = np.repeat(np.arange(len(entry)), count)
        spot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(where[entry], count)
        at = places[spot, 1]
        arrays = [pa.array([ids[i] for i in spot.tolist()], arrow_kind), pa.array(places[spot, 0]), pa.array(at - left[rep]), pa.array(at - right[rep] + length)]
        yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_h", "start", "end"])

    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches):
        held = []  # a partition holds whole parts, one after the other
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if held and held[-1]["part"] != row["part"]:
                    yield from merge(held)
                    held = []
                held.append(row)
        if held:
            yield from merge(held)
        held = None

    return runs.mapInArrow(tk.tidy(run), f"_id {kind}, _h long, start long, end long")


def passage_marks(offsets: np.ndarray, data: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of word k-grams, the least of each run of `words` words: what two texts share of that length has a mark of both."""
    w = tk.Words(offsets, data, lower=False)
    n = len(w.hashes)
    if n < words:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = tk.powers(n + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(w.hashes * up[:n], dtype=U64)])
    begin = np.arange(n - gram + 1)
    hashes = tk.mix((total[begin + gram] - total[begin]) * down[begin])
    text = np.repeat(np.arange(len(offsets) - 1), w.counts)
    wide = words - gram + 1
    grams, windows = len(begin), n - words + 1
    packed = np.full(-(-grams // wide) * wide, np.iinfo(np.uint64).max, U64)
    packed[:grams] = (hashes & ~PLACE) | begin.astype(U64)
    ahead = np.minimum.accumulate(packed.reshape(-1, wide), 1).ravel()
    back = np.minimum.accumulate(packed.reshape(-1, wide)[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(back[:windows], ahead[wide - 1 : wide - 1 + windows]) & PLACE).astype(np.int64)
    at = np.unique(place[text[:windows] == text[words - 1 :]])
    return text[at], hashes[at]


def shared_passages(texts: DataFrame, words: int = PASSAGE_WORDS, gram: int = PASSAGE_GRAM) -> DataFrame:
    """_id, _h, n_shared of texts that share passages of words with other rows: how many of their marks do.

    Every passage of `words` words that stands in two rows gives a mark of both;
    a mark alone tells of `gram` shared words. Rows with one id and text are one.
    """
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for first, end, offsets, data in tk.blocks(b.column(2)):
                text, key = passage_marks(offsets, data, words, gram)
                if len(text):
                    rows, begin = np.unique(text, return_index=True)
                    ends = pa.array(np.append(begin, len(key)).astype(np.int32))
                    at = pa.array(first + rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64)))], names=["_id", "_h", "keys"])

    marks = cut(texts.select("_id", "_h", "_text").mapInArrow(tk.tidy(run), f"_id {kind}, _h long, keys array<long>"))
    row = F.xxhash64("_id", "_h")
    twice = marks.select(row.alias("u"), F.explode("keys").alias("key")).groupBy("key").agg(F.min("u").alias("a"), F.max("u").alias("b")).filter("a <> b").select("key")
    hits = marks.select("_id", "_h", F.explode("keys").alias("key")).join(small_or_shuffled(cut(twice)), "key")
    return hits.groupBy("_id", "_h").agg(F.countDistinct("key").alias("n_shared"))


def _apply(joined: DataFrame, kind: str, keep_text: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, texts, spans = b.column(0), b.column(1), b.column(2).to_pylist()
            shared = b.column(3).fill_null(0)
            n_bytes, n_removed, n_spans, digests, rest = [], [], [], [], []
            for text, mine in zip(texts, spans):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, at, removed, runs = [], 0, 0, 0
                end = -1
                for start, stop in sorted((s["start"], s["end"]) for s in mine or ()):
                    if start > end:
                        kept.append(data[max(at, 0) : start])
                        runs += 1
                        removed += stop - start
                        end = at = stop
                    elif stop > end:
                        removed += stop - end
                        end = at = stop
                kept.append(data[at:])
                out = b"".join(kept)
                n_bytes.append(len(data))
                n_removed.append(removed)
                n_spans.append(runs)
                digests.append(hashlib.sha256(out).hexdigest())
                if keep_text:
                    rest.append(out)
            arrays = [ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), shared]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_passages"]
            if keep_text:
                arrays, names = [*arrays, pa.array(rest, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(tk.tidy(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_passages long" + ", kept binary" * keep_text)


def _same(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])


def find_repeats(texts: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """Repeated spans of texts (_id, _h, _text): _id, _h, start, end, overlapping still."""
    anchors = cut(_candidates(texts, length, gram))
    twice = anchors.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", (F.col("n") >= HOT).alias("hot"))
    spots = anchors.join(small_or_shuffled(cut(twice)), "key").groupBy("_id", "_h").agg(F.collect_set(F.struct("at", "key", "lo", "hi", "hot")).alias("spots"))
    spots = cut(spots)
    wanted = small_or_shuffled(spots.select("_id", "_h"))
    some = texts.join(wanted, _same(texts, wanted), "left_semi")
    anchored = some.join(spots, _same(some, spots)).select(some["_id"], some["_h"], "_text", "spots")
    kind = texts.schema["_id"].dataType.simpleString()
    n = spots.agg(F.sum(F.size("spots"))).first()[0] or 0
    parts = max(parts, n * 2 * length // PART_BYTES)
    return _merge(_runs(anchored, parts, length).repartition(parts, "part").sortWithinPartitions("part"), kind, length)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_passages and, if asked for, the kept bytes of each row.

    Only strings of `length` bytes are removed. n_shared_passages tells of
    passages of PASSAGE_WORDS words in other rows as well, which can be shorter;
    they are counted by marks, see shared_passages, and stay.
    """
    spark = docs.sparkSession
    parts = parts or max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    spans = find_repeats(texts, length, gram, parts)
    spans = cut(spans.groupBy("_id", "_h").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    hit = small_or_shuffled(spans.select("_id", "_h"))
    shared = cut(shared_passages(texts))
    told = small_or_shuffled(shared)
    texts = texts.join(told, _same(texts, told), "left").select(texts["_id"], texts["_h"], "_text", "n_shared")
    some = texts.join(hit, _same(texts, hit), "left_semi")
    touched = some.join(spans, _same(some, spans)).select(some["_id"], "_text", "spans", "n_shared")
    rest = texts.join(hit, _same(texts, hit), "left_anti").select("_id", "_text", F.lit(None).cast(touched.schema["spans"].dataType).alias("spans"), "n_shared")
    return _apply(touched, kind, keep_text).unionByName(_apply(rest, kind, keep_text))


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
