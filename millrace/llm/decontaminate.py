"""Benchmark decontamination by canonical templates.

Words lose their surrounding punctuation and case; numbers, names and units
become typed placeholders. Windows of WIDTH canonical words are hashed, and
the windows of every text are looked up among those of the benchmark. Hits on
one alignment of a text and an item are put together: the share of the item's
windows found is the coverage, and the values in the slots must map one to one
between item and text. An item is found where both hold, so a question that
was given other names and numbers is found too.

Words put in or left out shift what follows, so runs of hits are chained in
order over shifts that differ by no more than SLACK. A chain is found by its
windows (COVERAGE), or by its words: those of the windows, and those in its
gaps and at its ends that a longest common subsequence matches (WORD_SHARE). A
run of RUN words that match in one piece is found whatever its share. An edited
passage without WIDTH words in a row that match is not seen.

The benchmark is a query set: it is walked in blocks of whole items whose
window count is bounded, each broadcast and held against all rows.

Fixed meanings: a number is a word with a digit; a unit is one of UNITS right
after a number; a name is a capitalised word that does not open a sentence.
Windows with fewer literal words than half their width are hashed by their
literal words instead, as placeholders alone say nothing: such passages are
found where they are copied, whatever they consist of, but not with other
values. An item shorter than WIDTH is one window.

Defined results: null or empty text has no hits; coverage is the greater of the
share of all windows and the share of template windows; ties between items go to the higher coverage, then the
smaller id; repeated rows give equal results; a null benchmark text is
ignored; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import textkit as tk

WIDTH = 8
COVERAGE = 0.6
#: Share of an item's words that an edited copy keeps in order, words in a row that are a leak by themselves, words that an edit puts in or leaves out.
WORD_SHARE, RUN, SLACK = 0.8, 13, 8
#: Cells of the table of a gap's common subsequence; larger gaps are held word by word against their place.
GAP_CELLS = 1_000_000
#: Characters of benchmark text in a block; a block has fewer windows than half of this.
BLOCK_CHARS = 8_000_000
U64 = np.uint64
NUMBER, NAME, UNIT = U64(11), U64(12), U64(13)
#: Fixed value: unit words that count as units after a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "metres", "meters", "kilometers", "miles", "feet", "inches", "dollars", "euros", "cents", "percent", "degrees", "litres", "liters", "grams", "kilograms", "pounds")

_BYTES = np.arange(256)
_ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_STOP = np.isin(_BYTES, [ord(c) for c in ".!?:"])


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the accented capitals of Latin-1."""
    low = tk.LOWER[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(wide):
        b = low[wide]
        low[wide] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b)
    return low


def canonical(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical code, literal hash and slot flag of each word, and first word of each text."""
    starts, ends = tk.spans(~tk.IS_SPACE[data], offsets)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool), first
    at = np.arange(len(data))
    alnum = _ALNUM[data]
    left = np.minimum.accumulate(np.where(alnum, at, len(data))[::-1])[::-1]
    right = np.maximum.accumulate(np.where(alnum, at, -1))
    begin, end = left[starts], right[ends - 1] + 1
    word = begin < end
    word &= (begin < ends) & (end > starts)
    # what stands before each word, with words of punctuation only included
    head = np.zeros(len(starts), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    stop = _STOP[data[ends - 1]]
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    opens = head.copy()
    opens[1:] |= stop[:-1] | (breaks[starts[1:]] > breaks[ends[:-1]])
    keep = np.flatnonzero(word)
    kept = np.concatenate([[0], np.cumsum(word)])
    first = kept[first]
    begin, end, opens = begin[keep], end[keep], opens[keep]
    literal = tk.span_hash(tk.prefix_hash(_fold(data)), begin, end)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[end] > digits[begin]
    lead = data[begin]
    capital = _UPPER[lead] | ((lead == 0xC3) & (data[np.minimum(begin + 1, len(data) - 1)] >= 0x80) & (data[np.minimum(begin + 1, len(data) - 1)] <= 0x9E))
    name = capital & ~opens & ~number
    follows = np.zeros(len(begin), bool)
    follows[1:] = number[:-1]
    follows[first[:-1][np.diff(first) > 0]] = False
    unit = follows & ~number & np.isin(literal, _unit_hashes())
    code = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, literal)))
    return code, literal, number | unit | name, first


_units: np.ndarray | None = None


def _unit_hashes() -> np.ndarray:
    global _units
    if _units is None:
        data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        starts, ends = tk.spans(~tk.IS_SPACE[data], np.array([0, len(data)]))
        _units = np.sort(tk.span_hash(tk.prefix_hash(data), starts, ends))
    return _units


def _literal_key(h: np.ndarray) -> np.ndarray:
    """Keys of windows of literal words, apart from those of templates."""
    return tk.mix(h ^ U64(0x9FB21C651E98DF25))


class Block:
    """Windows of a block of items, sorted by hash."""

    def __init__(self, ids: list, texts: list[str], width: int):
        column = pa.array(texts, pa.string())
        offsets, data = tk.column_bytes(column)
        data = data[offsets[0] : offsets[-1]]
        code, literal, slot, first = canonical(offsets - offsets[0], data)
        self.width = width
        hashes, begin = tk.window_hash(code, first, width)
        n = np.diff(first)
        count = np.diff(begin)
        item = np.repeat(np.arange(len(ids)), count)
        pos = np.arange(len(hashes)) - np.repeat(begin[:-1], count)
        size = np.minimum(n, width)[item] if len(item) else np.zeros(0, np.int64)
        slots = np.concatenate([[0], np.cumsum(slot)])
        at = first[item] + pos if len(item) else np.zeros(0, np.int64)
        usable = 2 * (slots[at + size] - slots[at]) <= size
        hashes = np.where(usable, hashes, _literal_key(tk.window_hash(literal, first, width)[0]))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.pos, self.size, self.usable = (x[order] for x in (hashes, item, pos, size, usable))
        self.total = np.bincount(self.item, minlength=len(ids))
        self.templates = np.bincount(self.item[self.usable], minlength=len(ids))
        self.rich = not usable.all()
        self.ids, self.code, self.literal, self.slot, self.first = ids, code, literal, slot, first
        self.widths = np.unique(self.size).tolist()
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes >> U64(48)).astype(np.int64)] = True

    def hits(self, code: np.ndarray, literal: np.ndarray, first: np.ndarray):
        """(text, word, item, item word, width, template) of every window that matches; template is 0 for a match of literal words."""
        out = []
        for width, template in [(w, t) for w in self.widths for t in ((True, False) if self.rich else (True,))]:
            h, begin = tk.window_hash(code if template else literal, first, width)
            h = h if template else _literal_key(h)
            text = np.repeat(np.arange(len(first) - 1), np.diff(begin))
            maybe = np.flatnonzero(self.seen[(h >> U64(48)).astype(np.int64)])
            maybe = maybe[np.diff(first)[text[maybe]] >= width]
            lo, hi = np.searchsorted(self.hashes, h[maybe], "left"), np.searchsorted(self.hashes, h[maybe], "right")
            n = hi - lo
            src = np.repeat(maybe, n)
            row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            ok = (self.size[row] == width) & (self.usable[row] == template)
            src, row = src[ok], row[ok]
            word = first[text[src]] + src - begin[text[src]]
            out.append(np.stack([text[src], word, self.item[row], self.pos[row], np.full(len(row), width), self.usable[row]], 1))
        return np.concatenate(out) if out else np.zeros((0, 6), np.int64)


def _one_to_one(a: np.ndarray, b: np.ndarray) -> bool:
    pairs = np.unique(np.stack([a, b], 1), axis=0)
    return len(np.unique(pairs[:, 0])) == len(pairs) == len(np.unique(pairs[:, 1]))


def _share(block: Block, item: int, hits: np.ndarray) -> float:
    """Share of the item's windows found: of all, or of its templates where that is more."""
    found = len(np.unique(hits[:, 3])) / block.total[item]
    templates = hits[hits[:, 5] == 1, 3]
    return max(found, len(np.unique(templates)) / block.templates[item]) if len(templates) else found


def judge(block: Block, offsets: np.ndarray, data: np.ndarray, coverage: float) -> list[tuple[int, object, float, bool]]:
    """(text, item id, coverage, slots equal) of every item found."""
    code, literal, slot, first = canonical(offsets, data)
    hits = block.hits(code, literal, first)
    if not len(hits):
        return []
    shift = hits[:, 1] - hits[:, 3]
    order = np.lexsort((hits[:, 3], shift, hits[:, 2], hits[:, 0]))
    hits, shift = hits[order], shift[order]
    edge = np.flatnonzero(np.concatenate([[True], (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 2] != hits[:-1, 2]) | (shift[1:] != shift[:-1])]))
    best: dict[tuple[int, int], tuple[float, bool]] = {}

    def keep(text: int, item: int, group: np.ndarray, ours: np.ndarray, theirs: np.ndarray) -> bool:
        """Notes an alignment, words `ours` of the item to `theirs` of the text, if its slots map one to one."""
        slots = block.slot[ours]
        a, b = block.literal[ours[slots]], literal[theirs[slots]]
        if len(a) and not _one_to_one(a, b):
            return False
        found = (_share(block, item, group), bool((a == b).all()))
        best[text, item] = max(best.get((text, item), (0.0, False)), found)
        return True

    for lo, hi in zip(edge, np.append(edge[1:], len(hits))):
        group = hits[lo:hi]
        text, item = int(group[0, 0]), int(group[0, 2])
        if _share(block, item, group) >= coverage:
            words = np.unique((group[:, 3][:, None] + np.arange(group[0, 4])).ravel())
            keep(text, item, group, block.first[item] + words, shift[lo] + words)
    pairs = np.flatnonzero(np.concatenate([[True], (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 2] != hits[:-1, 2])]))
    for lo, hi in zip(pairs, np.append(pairs[1:], len(hits))):
        text, item = int(hits[lo, 0]), int(hits[lo, 2])
        if best.get((text, item), (0.0, False))[0] == 1.0:
            continue
        runs = _runs(hits[lo:hi])
        at, size, width = block.first[item], block.first[item + 1] - block.first[item], int(hits[lo, 4])
        for run in runs:
            words = np.arange(run[0, 3], run[-1, 3] + width)
            ours, theirs = at + words, run[0, 1] - run[0, 3] + words
            if len(words) >= RUN and not keep(text, item, run, ours, theirs):
                same = np.concatenate([[0], block.literal[ours] == literal[theirs], [0]]).astype(np.int8)
                starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
                for x, y in zip(starts, ends):
                    if y - x >= RUN:
                        inside = (run[:, 3] >= words[x]) & (run[:, 3] + width <= words[x] + y - x)
                        keep(text, item, run[inside], ours[x:y], theirs[x:y])
        for chain in _chains(runs):
            group = np.concatenate(chain)
            ours, theirs = _chain_words(chain, width)
            if _share(block, item, group) < coverage:
                ours, theirs = _fill(ours, theirs, block.code[at : at + size], code[first[text] : first[text + 1]], first[text])
                if len(ours) < WORD_SHARE * size:
                    continue
            keep(text, item, group, at + ours, theirs)
    return [(text, block.ids[item], share, same) for (text, item), (share, same) in best.items()]


def _runs(hits: np.ndarray) -> list[np.ndarray]:
    """Hits of one text and item, by shift and place, in runs of consecutive windows at one shift."""
    shift = hits[:, 1] - hits[:, 3]
    edge = np.flatnonzero((shift[1:] != shift[:-1]) | (hits[1:, 3] != hits[:-1, 3] + 1)) + 1
    return np.split(hits, edge)


def _chains(runs: list[np.ndarray]):
    """The longest chain of runs that ends at each run which no longer chain goes on from; each is a list of runs, trimmed where they overlap."""
    runs = sorted(runs, key=lambda r: (r[0, 3], r[0, 1]))
    start, end = np.array([r[0, [3, 1]] for r in runs]), np.array([r[-1, [3, 1]] for r in runs])
    shift = start[:, 1] - start[:, 0]
    total, before, cut = np.zeros(len(runs), np.int64), np.full(len(runs), -1), np.zeros(len(runs), np.int64)
    for k in range(len(runs)):
        size = len(runs[k])
        total[k] = size
        if k:
            trim = np.maximum(0, np.max(end[:k] + 1 - start[k], 1))
            gain = np.where((np.abs(shift[:k] - shift[k]) <= SLACK) & (trim < size), total[:k] + size - trim, 0)
            j = int(np.argmax(gain))
            if gain[j] > size:
                total[k], before[k], cut[k] = gain[j], j, trim[j]
    for k in np.setdiff1d(np.arange(len(runs)), before):
        chain = []
        while k >= 0:
            chain.append(runs[k][cut[k] :])
            k = before[k]
        yield chain[::-1]


def _chain_words(chain: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the item, and of the text, that a chain's windows match; both ascend."""
    ours, theirs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for run in chain:
        words = np.arange(run[0, 3], run[-1, 3] + width)
        there = words + run[0, 1] - run[0, 3]
        if len(ours):
            new = (words > ours[-1]) & (there > theirs[-1])
            words, there = words[new], there[new]
        ours, theirs = np.concatenate([ours, words]), np.concatenate([theirs, there])
    return ours, theirs


def _fill(ours, theirs, item: np.ndarray, text: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """A chain's words with those that match in its gaps and at its ends; theirs counts from base before the text."""
    theirs = theirs - base
    gaps = [(0, ours[0], max(0, theirs[0] - ours[0] - SLACK), theirs[0])]
    gaps += [(ours[k] + 1, ours[k + 1], theirs[k] + 1, theirs[k + 1]) for k in np.flatnonzero((np.diff(ours) > 1) & (np.diff(theirs) > 1))]
    gaps.append((ours[-1] + 1, len(item), theirs[-1] + 1, min(len(text), theirs[-1] + len(item) - ours[-1] + SLACK)))
    more = [(ours, theirs)]
    for k, (a, b, c, d) in enumerate(gaps):
        if a < b and c < d:
            x, y = _common(item[a:b], text[c:d], k == 0)
            more.append((a + x, c + y))
    ours, theirs = (np.concatenate(x) for x in zip(*more))
    order = np.argsort(ours, kind="stable")
    return ours[order], theirs[order] + base


def _common(a: np.ndarray, b: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of a longest common subsequence of a and b; of the words at equal distance from an end where both are very long."""
    if len(a) * len(b) > GAP_CELLS:
        n = min(len(a), len(b))
        x, y = (len(a) - n, len(b) - n) if right else (0, 0)
        same = np.flatnonzero(a[x : x + n] == b[y : y + n])
        return x + same, y + same
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], np.where(b == a[i], best[i, :-1] + 1, 0)))
    x, y, i, j = [], [], len(a), len(b)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            x.append(i)
            y.append(j)
    return np.array(x[::-1], np.int64), np.array(y[::-1], np.int64)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """Whole items in blocks of bounded size, dealt by the hash of the id."""
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + 2 * chars // block_chars
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k).orderBy("id").collect()
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with leak_items (array of item ids), leak_item (the best), leak_coverage and leak_exact added; columns of docs with these names are replaced."""
    docs = docs.drop("leak_items", "leak_item", "leak_coverage", "leak_exact")
    spark = docs.sparkSession
    id_type = benchmark.schema[item_id].dataType
    hit = T.StructType([T.StructField("item", id_type), T.StructField("coverage", T.DoubleType()), T.StructField("exact", T.BooleanType())])
    found = docs.withColumn("__hits", F.array().cast(T.ArrayType(hit)))
    for ids, texts in _blocks(benchmark, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(Block(ids, texts, width))
        at = found.columns.index(text_col)
        arrow_hit = pa.list_(pa.struct([("item", pa.scalar(ids[0]).type if id_type.simpleString() not in ("bigint", "int") else (pa.int64() if id_type.simpleString() == "bigint" else pa.int32())), ("coverage", pa.float64()), ("exact", pa.bool_())]))

        def run(batches, shared=shared, at=at, arrow_hit=arrow_hit):
            for b in batches:
                hits = b.column(b.num_columns - 1).to_pylist()
                for lo, hi, offsets, data in tk.blocks(b.column(at)):
                    for text, item, share, same in judge(shared.value, offsets, data, coverage):
                        hits[lo + text].append({"item": item, "coverage": share, "exact": same})
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hits, arrow_hit)], names=b.schema.names)

        found = found.mapInArrow(tk.tidy(run), found.schema)
    order = F.array_sort(F.transform("__hits", lambda x: F.struct((-x["coverage"]).alias("c"), x["item"].alias("i"), x["exact"].alias("e"))))
    found = found.withColumn("__best", F.get(order, F.lit(0)))
    return found.select(
        *docs.columns,
        F.array_sort(F.transform("__hits", lambda x: x["item"])).alias("leak_items"),
        F.col("__best.i").alias("leak_item"),
        (-F.col("__best.c")).alias("leak_coverage"),
        F.col("__best.e").alias("leak_exact"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the texts that hold an item of the benchmark."""
    return find_leaks(docs, benchmark, text_col=text_col).filter(F.size("leak_items") == 0).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        (F.size("leak_items") > 0).alias("contaminated"),
        F.size("leak_items").cast("long").alias("n_items"),
        "leak_items",
        "leak_item",
        "leak_coverage",
        "leak_exact",
    )
