"""Best-fit packing of tokenised documents into fixed-size sequences.

A piece asks for a vector: tokens, one document, and attention cost (tokens
squared). A sequence offers a capacity in each. Pieces are taken longest first
and go to the open sequence that fits under every constraint and scores best,
by weighted dot-product of demand and residual or by the norm of the residual
that would be left; a new sequence opens only where none fits. All three
dimensions are in the score, also where a limit cannot refuse a piece; there
the residual is scored in steps, so that few states are told apart.

Pieces of one length are interchangeable, so the plan is made on the counts of
lengths: at most `capacity` rows reach the driver whatever the corpus holds.
Sequences in one state are handled together, and the plan assigns ranges of
ranks to ranges of sequences. Ranks within a length come from a two-level
count over hash buckets, so no length, however common, lands in one task.

Defined results: null text is empty; an empty document is its end mark alone;
every document has at least one piece; equal pieces are placed in the order of
(id, piece); null ids and repeated rows are packed like any others; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import textkit as tk
from millrace.session import cut

#: Parts of words a worker remembers, across its tasks, before it starts afresh (about 40 bytes each).
CACHE_WORDS = 500_000
#: Bytes of text tokenised together; larger blocks repeat more words.
BLOCK_BYTES = 1 << 19
#: Plan rows up to which the plan is broadcast (40 bytes each).
PLAN_ROWS = 500_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_BYTES = np.arange(256)
_LETTER, _MARK, _DIGIT, _OTHER = 1, 2, 3, 4
_KIND = np.select(
    [tk.IS_SPACE, ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128), (_BYTES >= 48) & (_BYTES <= 57), _BYTES < 128],
    [0, _LETTER, _DIGIT, _MARK],
    _OTHER,
).astype(np.uint8)


def _opens_token(data: np.ndarray) -> np.ndarray:
    """Where "<|" stands, with which special tokens begin."""
    out = data == 0x3C
    out[:-1] &= data[1:] == 0x7C
    return out


def _lower(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Lower case, but for words that may hold a special token, whose case counts."""
    low = tk.LOWER[data]
    for at in np.flatnonzero(_opens_token(data)):
        k = np.searchsorted(starts, at, "right") - 1
        low[starts[k] : ends[k]] = data[starts[k] : ends[k]]
    return low


def atoms(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of words that the tokenizer surely takes apart.

    It splits runs of letters, single digits and runs of anything else, drops
    blanks and ignores case. Cuts are made between ASCII kinds and Latin-1
    letters only, and not in words with an apostrophe or "<|", where contractions
    and special tokens cross kinds.
    """
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    latin = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    starts, ends = tk.spans(kind > 0, offsets)
    a, b = kind[:-1], kind[1:]
    cut = np.flatnonzero((a > 0) & (b > 0) & (a != _OTHER) & (b != _OTHER) & ((a != b) | (a == _DIGIT))) + 1
    cut = cut[~np.isin(cut, offsets)] if len(cut) else cut
    if len(cut):
        special = np.concatenate([[0], np.cumsum((data == 0x27) | _opens_token(data))])
        plain = special[ends] == special[starts]
        cut = cut[plain[np.searchsorted(starts, cut, "right") - 1]]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


class WordTokens:
    """Token ids by part of word; the tokenizer never joins parts, so their ids can be remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core to a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, tk.U64)  # hashes of words, sorted
        self.slot = np.zeros(0, np.int32)
        self.words = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one run, and how many each has.

        Words go in as one text, parted by a special token that no word holds;
        words that might hold one are encoded by themselves.
        """
        odd = [i for i, w in enumerate(words) if "<|" in w]
        if odd:
            own = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            return np.fromiter((x for i in own for x in i), np.uint32, sum(map(len, own))), np.array([len(x) for x in own], np.int32)
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        return ids[ids != self.mark_id], sizes.astype(np.int32)

    def _add(self, words: list[str]) -> np.ndarray:
        """Slots of new words."""
        out = np.empty(len(words), np.int32)
        odd = np.array(["<|" in w for w in words])
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._store([words[i]])
        plain = np.flatnonzero(~odd)
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            out[part] = self._store([words[i] for i in part.tolist()]) + np.arange(len(part))
        return out

    def _store(self, words: list[str]) -> int:
        """Appends the ids of words; returns the first one's slot."""
        ids, sizes = self._ids(words)
        total, at = len(ids), self.words
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(words) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + total] = ids
        self.begin[at : at + len(words)] = self.used + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
        self.size[at : at + len(words)] = sizes
        self.words += len(words)
        self.used += total
        return at

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and first id of each text."""
        if self.words > CACHE_WORDS:
            self.clear()
        starts, ends = atoms(offsets, data)
        low = _lower(data, starts, ends)
        hashes = tk.span_hash(tk.prefix_hash(low), starts, ends)
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, uniq)
        fresh = np.ones(len(uniq), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != uniq[inside]
        slots = np.empty(len(uniq), np.int32)
        slots[~fresh] = self.slot[place[~fresh]]
        if fresh.any():
            raw, at = low.tobytes(), first[fresh]
            slots[fresh] = self._add([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self.known = np.insert(self.known, place[fresh], uniq[fresh])
            self.slot = np.insert(self.slot, place[fresh], slots[fresh])
        sizes, begin = self.size[slots][inverse], self.begin[slots][inverse]
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ids = self.flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)]
        return ids, upto[np.searchsorted(starts, offsets)]


def word_tokens(path: str) -> WordTokens:
    """The worker's own tokenizer and memory for a file, kept while its tasks tokenise."""
    if path not in tk.kept:
        tk.kept[path] = WordTokens(path)
    return tk.kept[path]


def tokenise(docs: DataFrame, capacity: int, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        words = word_tokens(path)
        mark = end_id.to_bytes(4, "little")
        for b in batches:
            doc_ids = b.column(0)
            for lo, hi, offsets, data in tk.blocks(b.column(1), BLOCK_BYTES):
                ids, first = words.encode(offsets, data)
                out = []
                ids = ids.astype("<u4", copy=False)
                for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    size = z - a + 1  # with the end mark
                    for piece, start in enumerate(range(0, size, capacity)):
                        length = min(capacity, size - start)
                        crc = zlib.crc32(ids[a + start : min(a + start + length, z)])
                        if start + length == size:
                            crc = zlib.crc32(mark, crc)
                        out.append((lo + i, piece, start, length, crc))
                rows, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(rows)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tk.tidy(run, keeps=path), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


#: Steps in which the residual of a dimension is scored where it cannot refuse a piece.
LEVELS = 16


@dataclass(frozen=True)
class Capacity:
    """What a sequence offers: tokens, documents and attention cost. Limits left as None cannot bind, but are scored like the others.

    weights are those of the three dimensions in the score. Under the rule "norm"
    the sequence whose residual is shortest afterwards is best, under "dot" the
    one whose residual points most along the piece.
    """

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    rule: str = "norm"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 1 / 64, 1 / 64)

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2

    def units(self) -> tuple[int, int, int]:
        """Units in which residuals are kept: exact where a dimension can refuse a piece that fits by tokens, LEVELS steps of the cost elsewhere.

        A document has a token or more, and squares sum to no more than the square of the sum.
        """
        _, documents, attention = self.vector()
        return 1, 1 if documents < self.tokens else max(1, documents // (LEVELS * LEVELS)), 1 if attention < self.tokens**2 else max(1, attention // LEVELS)


class _Open:
    """Open sequences by residual: for each pair of documents and attention left, the tokens left in order, and ranges of sequences."""

    def __init__(self):
        self.groups: dict[tuple[int, int], list[int]] = {}
        self.ranges: dict[tuple[int, int, int], list[tuple[int, int, int, int]]] = {}

    def put(self, state: tuple[int, int, int], first: int, n: int, used: int, held: int) -> None:
        if n and state[0] > 0:
            if state not in self.ranges:
                self.ranges[state] = []
                bisect.insort(self.groups.setdefault(state[1:], []), state[0])
            self.ranges[state].append((first, n, used, held))

    def take(self, state: tuple[int, int, int]) -> tuple[int, int, int, int]:
        out = self.ranges[state].pop()
        if not self.ranges[state]:
            del self.ranges[state]
            tokens = self.groups[state[1:]]
            del tokens[bisect.bisect_left(tokens, state[0])]
            if not tokens:
                del self.groups[state[1:]]
        return out


def plan(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): ranks r.. of the length go to sequences s.., one each."""
    cap, unit = capacity.vector(), capacity.units()
    exact = tuple(u == 1 for u in unit)
    full = tuple(c // u for c, u in zip(cap, unit))
    weights = [w / f / f for w, f in zip(capacity.weights, full)]
    norm = capacity.rule == "norm"
    open_, next_sequence, out = _Open(), 0, []

    def after(state, need, held, copies):
        """The residual once `copies` pieces have joined `held` documents of a sequence."""
        documents = state[1] - copies if exact[1] else full[1] - (held + copies) // unit[1]
        attention = state[2] - copies * need[2] if exact[2] else max(0, state[2] - round(copies * need[2] / unit[2]))
        return state[0] - copies * need[0], documents, attention

    def fitting(state, need):
        """How many pieces a sequence in this state takes."""
        n = state[0] // need[0]
        for k in (1, 2):
            if exact[k]:
                n = min(n, state[k] // need[k])
        return n

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = (length, 1, length * length)
        if any(x > c for x, c in zip(need, cap)):
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        soft = tuple(x if e else x / u for x, e, u in zip(need, exact, unit))
        while left:
            best, state = None, None
            for (documents, attention), tokens in open_.groups.items():
                if (exact[1] and documents < 1) or (exact[2] and attention < need[2]) or tokens[-1] < length:
                    continue
                r = tokens[bisect.bisect_left(tokens, length)] if norm else tokens[-1]
                if norm:
                    value = weights[0] * (r - length) ** 2 + weights[1] * (documents - soft[1]) ** 2 + weights[2] * (attention - soft[2]) ** 2
                else:
                    value = -(weights[0] * length * r + weights[1] * soft[1] * documents + weights[2] * soft[2] * attention)
                if best is None or value < best:
                    best, state = value, (r, documents, attention)
            fresh = state is None
            first, have, used, held = (next_sequence, left, 0, 0) if fresh else open_.take(state)
            if fresh:
                state = full
            # under the norm the sequence just used stays the best for the same length
            copies = fitting(state, need) if norm else 1
            whole = min(have, left // copies)
            if whole:
                for k in range(copies):
                    out.append((length, rank + k * whole, whole, first, used + k * length))
                open_.put(after(state, need, held, copies), first, whole, used + copies * length, held + copies)
                rank, left = rank + copies * whole, left - copies * whole
            extra = 0
            if whole < have and 0 < left < copies:
                for k in range(left):
                    out.append((length, rank + k, 1, first + whole, used + k * length))
                open_.put(after(state, need, held, left), first + whole, 1, used + left * length, held + left)
                rank, left, extra = rank + left, 0, 1
            if fresh:
                next_sequence += whole + extra
            else:
                open_.put(state, first + whole + extra, have - whole - extra, used, held)
    return out


def pack(docs: DataFrame, capacity: Capacity = Capacity(), tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = cut(tokenise(docs, capacity.tokens, tokenizer or tokenizer_path(), end_id, id_col, text_col))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity.tokens rows at most
    rows = plan(counts, capacity)
    sequences = spark.createDataFrame(rows, "p_length long, p_rank long, p_n long, p_sequence long, p_offset long") if rows else spark.createDataFrame([], "p_length long, p_rank long, p_n long, p_sequence long, p_offset long")
    buckets = 16 + sum(counts.values()) // 200_000
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = keyed.groupBy("length", "_bucket").count()
    before = before.select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    place = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_n", F.row_number().over(place) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_n"))
    if len(rows) <= PLAN_ROWS:
        sequences = F.broadcast(sequences)
    hit = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_rank")) & (F.col("_rank") < F.col("p_rank") + F.col("p_n"))
    packed = ranked.join(sequences, hit)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("p_sequence") + F.col("_rank") - F.col("p_rank")).alias("sequence_id"), F.col("p_offset").alias("offset"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
