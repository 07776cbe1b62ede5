"""Language identification with interpolated Kneser-Ney character models.

Each language has one character model of order ORDER. Texts are folded to
lower case; every run of characters that are not letters becomes one boundary
symbol. N-gram counts are gathered on the executors as partial sums. The
model holds, for each order, one sorted array of n-gram hashes and beside it
the log-probability of every language, so a text needs a single lookup for
all languages; a directory over the top bits of the hash narrows the search
to a handful of entries.

A text gets the language with the lowest cross-entropy per character. Its
score is the posterior of that language at a temperature, scaled by how usual
the cross-entropy is for the language: texts whose value lies beyond the
calibrated bound of held-in documents are rejected.

Training reads every text that may be learnt from, whole, for the counts and
again for the bounds; what grows on the driver is the number of different
n-grams. Prediction covers all rows and whole texts.

Defined results: null text or one without letters gives `und` with score 0 and
is rejected; null languages are not learnt from; languages tie by name; a
table without labelled rows gives `und` throughout; extra columns and repeated
rows change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import textkit as tk

ORDER = 4
TEMPERATURE = 0.05  # nats per character between languages that halve the score
DISCOUNT = 0.75
UNSEEN_SYMBOLS = 256  # characters assumed beyond the seen alphabet
BOUNDARY = 1
U64 = np.uint64

_fold_table: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point to folded letter; everything that is no letter maps to the boundary symbol."""
    global _fold_table
    if _fold_table is None:
        table = np.full(0x110000, BOUNDARY, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _fold_table = table
    return _fold_table


def symbols(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of a block with boundary runs squeezed, and first symbol of each text.

    Each text starts with a boundary; one more closes the block.
    """
    fold = _fold()
    lead = (data & 0xC0) != 0x80
    if lead.all():
        sym = fold[data]
        starts = offsets
    else:
        points = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(lead)])
        starts = at[offsets]
        if at[-1] != len(points):  # malformed bytes: decode text by text
            parts = [np.frombuffer(bytes(data[a:b]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
            points = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        sym = fold[points]
    # a boundary before each text, then squeeze runs
    whole = np.insert(sym, starts, BOUNDARY)
    begin = starts + np.arange(len(starts))
    keep = np.ones(len(whole), bool)
    keep[1:] = (whole[1:] != BOUNDARY) | (whole[:-1] != BOUNDARY)
    keep[begin] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return whole[keep], total[begin]


def gram_hashes(sym: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each symbol, for n from 1 to order."""
    out, code = [], sym.astype(U64)
    coded = tk.mix(code + U64(0x51ED270B))
    acc = coded.copy()
    out.append(acc)
    for n in range(1, order):
        acc = acc.copy()
        # the oldest symbol enters under a multiplier of its own
        acc[n:] += coded[:-n] * U64((2 * n + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
        out.append(acc)
    return out


def _crc_mod(doc_col: str, mod: int) -> Column:
    return F.crc32(F.col(doc_col).cast("string")) % mod


class _Tally:
    """Counts of the longest n-gram that ends at each letter, by language, and the symbols of each.

    Most n-grams of a block are met in a table of fixed slots; those whose slot
    holds another one are gathered and merged by sorting.
    """

    SLOTS = 19  # bits
    PENDING = 1 << 18  # n-grams that wait to be added up or merged

    def __init__(self, order: int):
        self.order = order
        self.used = np.zeros(1 << self.SLOTS, bool)
        self.keys = np.zeros(1 << self.SLOTS, U64)
        self.counts = np.zeros(1 << self.SLOTS, np.int64)
        self.lang = np.zeros(1 << self.SLOTS, np.int32)
        self.syms = np.zeros((1 << self.SLOTS, order), np.uint32)
        self.hits: list[np.ndarray] = []
        self.rest: list[tuple] = []
        self.n_hits = self.n_rest = 0

    def add(self, sym: np.ndarray, grams: list[np.ndarray], place: np.ndarray, owner: np.ndarray) -> None:
        at = np.flatnonzero((owner >= 0) & (place >= 1))
        size = np.minimum(place[at] + 1, self.order)
        key = np.empty(len(at), U64)
        for n in range(2, self.order + 1):
            mine = size == n
            key[mine] = grams[n - 1][at[mine]]
        if self.order == 1:
            key = grams[0][at]
        key = tk.mix(key + owner[at].astype(U64) * U64(self.order + 1) + size.astype(U64))
        slot = (key >> U64(64 - self.SLOTS)).astype(np.int64)
        new = np.flatnonzero(~self.used[slot])
        if len(new):
            _, first = np.unique(slot[new], return_index=True)
            new = new[first]
            to = slot[new]
            self.used[to], self.keys[to], self.lang[to], self.syms[to] = True, key[new], owner[at[new]], self._symbols(sym, at[new], size[new])
        hit = self.keys[slot] == key
        self.hits.append(slot[hit].astype(np.int32))
        self.n_hits += len(self.hits[-1])
        if self.n_hits > self.PENDING:
            self._settle()
        missed = np.flatnonzero(~hit)
        if len(missed):
            keys, first, counts = np.unique(key[missed], return_index=True, return_counts=True)
            missed = missed[first]
            self.rest.append((keys, counts, owner[at[missed]].astype(np.int32), self._symbols(sym, at[missed], size[missed])))
            self.n_rest += len(keys)
            if self.n_rest > max(self.PENDING, len(self.rest[0][0])):
                self._merge()

    def _symbols(self, sym: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The symbols of the n-grams that end at the places, newest first; 0, which is no symbol, beyond the size of each."""
        back = np.arange(self.order)
        return np.where(back < size[:, None], sym[np.maximum(at[:, None] - back, 0)], 0).astype(np.uint32)

    def _settle(self) -> None:
        if self.hits:
            self.counts += np.bincount(np.concatenate(self.hits), minlength=len(self.counts))
        self.hits, self.n_hits = [], 0

    def _merge(self) -> None:
        keys, counts, lang, syms = (np.concatenate([p[i] for p in self.rest]) for i in range(4))
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.rest = [(keys, np.bincount(inverse, counts, len(keys)).astype(np.int64), lang[first], syms[first])]
        self.n_rest = 0

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, language and symbols of every n-gram met."""
        self._settle()
        parts = [(self.counts[self.used], self.lang[self.used], self.syms[self.used])]
        if self.rest:
            self._merge()
            parts.append(self.rest[0][1:])
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _counts(batches, langs: list[str], order: int):
    """Counts of the n-grams of all orders: each is the end of the longest ones that it closes."""
    index = {x: i for i, x in enumerate(langs)}
    tally = _Tally(order)
    for batch in batches:
        langs_here = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
        for lo, hi, offsets, data in tk.blocks(batch.column(0)):
            sym, begin = symbols(offsets, data)
            sizes = np.diff(np.append(begin, len(sym)))
            place = np.arange(len(sym)) - np.repeat(begin, sizes)
            owner = np.repeat(np.append(langs_here[lo:hi], -1), sizes)
            tally.add(sym, gram_hashes(sym, order), place, owner)
    counts, lang, syms = tally.longest()
    # hash of the n symbols that end at the newest one, and at the one before it
    hashes = gram_hashes(syms[:, ::-1].reshape(-1), order)
    grams, before = [h[order - 1 :: order] for h in hashes], [h[max(order - 2, 0) :: order] for h in hashes]
    none = np.zeros(len(counts), U64)
    for li in range(len(langs)):
        for n in range(1, order + 1):
            ok = np.flatnonzero((lang == li) & (syms[:, n - 1] > 0))
            keys, first, inverse = np.unique(grams[n - 1][ok], return_index=True, return_inverse=True)
            if not len(keys):
                continue
            at = ok[first]
            # context: the same n-gram without its newest symbol; lower: without its oldest
            context, lower = (before[n - 2][at], grams[n - 2][at]) if n > 1 else (none[at], none[at])
            total = np.bincount(inverse, counts[ok], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), li, np.int32)), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(context.view(np.int64)), pa.array(lower.view(np.int64)), pa.array(total)],
                names=["lang", "n", "gram", "context", "lower", "count"],
            )


@dataclass
class Model:
    langs: list[str]
    order: int
    keys: list[np.ndarray]  # sorted n-gram hashes, for n from 1
    logp: list[np.ndarray]  # float32 [len(keys), languages]
    backoff: list[np.ndarray]  # per context order 1..order-1: log weight passed down, [len(keys of that order), languages]
    floor: np.ndarray  # log-probability of an unseen character
    bound: np.ndarray  # cross-entropy per character beyond which a text is rejected
    usual: np.ndarray  # mean cross-entropy of each language on itself


def fit_model(rows: np.ndarray, langs: list[str], order: int) -> Model:
    """Interpolated Kneser-Ney from n-gram counts.

    rows: records with lang, n, gram, context, lower, count. Orders under the
    highest use continuation counts, the number of distinct preceding symbols.
    """
    L = len(langs)
    keys = [np.unique(rows["gram"][rows["n"] == n]) for n in range(1, order + 1)]
    logp = [np.zeros((len(k), L)) for k in keys]
    backoff = [np.zeros((len(k), L)) for k in keys[:-1]]
    floor = np.zeros(L)
    for li in range(L):
        mine = rows[rows["lang"] == li]
        by_n = [np.sort(mine[mine["n"] == n], order="gram") for n in range(1, order + 1)]
        # continuation counts of order n: distinct grams of order n + 1 whose newest n symbols are it
        weights = []
        for n in range(1, order + 1):
            g = by_n[n - 1]
            if n == order:
                weights.append(g["count"].astype(float))
            else:
                cont = np.zeros(len(g))
                up = by_n[n]["lower"]
                at = np.searchsorted(g["gram"], up)
                ok = (at < len(g)) & (g["gram"][np.minimum(at, max(len(g) - 1, 0))] == up) if len(g) else np.zeros(0, bool)
                np.add.at(cont, at[ok], 1.0)
                weights.append(np.maximum(cont, 1.0))
        alphabet = len(keys[0]) + UNSEEN_SYMBOLS
        p_low = None
        for n in range(1, order + 1):
            g, w = by_n[n - 1], weights[n - 1]
            if n == 1:
                total = w.sum() + 1e-9
                gamma = DISCOUNT * len(w) / total if len(w) else 1.0
                floor[li] = np.log(max(gamma, 1e-9) / alphabet)
                p = np.full(len(keys[0]), gamma / alphabet)
                p[np.searchsorted(keys[0], g["gram"])] += np.maximum(w - DISCOUNT, 0) / total
            else:
                ctx_keys = keys[n - 2]
                at = np.searchsorted(ctx_keys, g["context"])
                at = np.minimum(at, len(ctx_keys) - 1)
                total, kinds = np.zeros(len(ctx_keys)), np.zeros(len(ctx_keys))
                np.add.at(total, at, w)
                np.add.at(kinds, at, 1.0)
                gamma = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
                backoff[n - 2][:, li] = np.log(gamma)
                # every gram of this order seen in any language gets this language's interpolated value
                ctx_of, low_of = _links(rows, n, keys)
                p = gamma[ctx_of] * p_low[low_of]
                mine_at = np.searchsorted(keys[n - 1], g["gram"])
                p[mine_at] += np.maximum(w - DISCOUNT, 0) / np.maximum(total[at], 1e-9)
            logp[n - 1][:, li] = np.log(np.maximum(p, 1e-12))
            p_low = p
    return Model(langs, order, keys, [x.astype(np.float32) for x in logp], [x.astype(np.float32) for x in backoff], floor.astype(np.float32), np.full(L, np.inf), np.zeros(L))


def _links(rows: np.ndarray, n: int, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each key of order n: place of its context and of its newest n - 1 symbols among the keys of order n - 1."""
    mine = rows[rows["n"] == n]
    _, first = np.unique(mine["gram"], return_index=True)
    below = keys[n - 2]
    place = lambda v: np.minimum(np.searchsorted(below, v), len(below) - 1)
    return place(mine["context"][first]), place(mine["lower"][first])


class Scorer:
    """Lookup of every n-gram of a block in the model's arrays."""

    BITS = 18

    def __init__(self, model: Model):
        self.m = model
        self.dirs, self.depth = [], []
        for k in model.keys:
            edge = np.arange(1 << self.BITS, dtype=U64) << U64(64 - self.BITS)
            d = np.append(np.searchsorted(k, edge), len(k)).astype(np.int32)
            self.dirs.append(d)
            self.depth.append(int(np.diff(d).max()) if len(k) else 0)

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys of order n, or -1."""
        keys, d = self.m.keys[n - 1], self.dirs[n - 1]
        out = np.full(len(h), -1, np.int32)
        if not len(keys) or not len(h):
            return out
        slot = (h >> U64(64 - self.BITS)).astype(np.int32)
        at, end = d[slot], d[slot + 1]
        live = np.arange(len(h))
        last = len(keys) - 1
        for _ in range(self.depth[n - 1]):
            ok = at < end
            if not ok.all():
                live, at, end, h = live[ok], at[ok], end[ok], h[ok]
            if not len(live):
                break
            hit = keys[np.minimum(at, last)] == h
            out[live[hit]] = at[hit]
            miss = ~hit
            live, at, end, h = live[miss], at[miss] + 1, end[miss], h[miss]
        return out

    def entropy(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text under each language, and its letters."""
        m = self.m
        sym, begin = symbols(offsets, data)
        n_docs = len(offsets) - 1
        ends = begin[1:]
        total = len(sym)
        L = len(m.langs)
        grams = gram_hashes(sym, m.order)
        place = np.minimum(np.arange(total) - np.repeat(begin, np.diff(np.append(begin, total))), m.order)
        value = np.zeros((total, L), np.float32)
        todo = np.flatnonzero(place >= 1)
        weight = np.zeros((total, L), np.float32)
        for n in range(m.order, 0, -1):
            can = place[todo] >= n - 1 if n > 1 else np.ones(len(todo), bool)
            here = todo[can]
            spot = self.find(n, grams[n - 1][here])
            hit = spot >= 0
            value[here[hit]] = weight[here[hit]] + m.logp[n - 1][spot[hit]]
            missed = here[~hit]
            if n > 1:  # the context's weight goes along where the context is known
                ctx = self.find(n - 1, grams[n - 2][missed - 1])
                known = ctx >= 0
                weight[missed[known]] += m.backoff[n - 2][ctx[known]]
            else:
                value[missed] = weight[missed] + m.floor
            rest = todo[~can]
            todo = np.concatenate([missed, rest]) if len(rest) else missed
        sums = np.concatenate([np.zeros((1, L)), np.cumsum(value, 0, dtype=np.float64)])
        letters = np.concatenate([[0], np.cumsum(sym != BOUNDARY)])
        first = begin[:n_docs]
        size = np.maximum(ends - first - 1, 1)
        return -(sums[ends] - sums[first]) / size[:, None], letters[ends] - letters[first]


def predict(h: np.ndarray, letters: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number (-1 for und), score in 0..1, rejected."""
    best = np.argmin(h, 1)
    gap = np.exp(-(h - h.min(1, keepdims=True)) / TEMPERATURE)
    share = gap[np.arange(len(h)), best] / gap.sum(1)
    over = h[np.arange(len(h)), best] - m.bound[best] * 1.0
    slack = m.bound[best] - m.usual[best]
    fit = 1.0 / (1.0 + np.exp(np.clip(6.0 * over / np.maximum(slack, 1e-6), -50, 50)))
    fit = np.where(np.isfinite(m.bound[best]), fit, 1.0)
    none = letters == 0
    # few letters say little about how usual a text is: the bound widens as for a mean of so many draws
    rejected = none | (over > slack * np.sqrt(200.0 / np.maximum(letters, 1)))
    return np.where(none, -1, best), np.where(none, 0.0, share * (0.5 + 0.5 * fit)), rejected


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Model:
    """Fits on all rows where `train` holds and the language is known."""
    spark = docs.sparkSession
    known = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    langs = sorted(r[0] for r in known.select("l").distinct().collect())
    if not langs:
        return Model([], order, [np.zeros(0, U64)] * order, [np.zeros((0, 0), np.float32)] * order, [np.zeros((0, 0), np.float32)] * (order - 1), np.zeros(0), np.zeros(0), np.zeros(0))
    partial = known.mapInArrow(tk.tidy(lambda it: _counts(it, langs, order)), "lang int, n int, gram bigint, context bigint, lower bigint, count bigint")
    merged = partial.groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("lower").alias("lower"), F.sum("count").alias("count"))
    got = merged.toArrow()  # a row for each different n-gram of a language
    rows = np.zeros(got.num_rows, dtype=[("lang", np.int32), ("n", np.int32), ("gram", U64), ("context", U64), ("lower", U64), ("count", np.int64)])
    for name in rows.dtype.names:
        v = got.column(name).to_numpy()
        rows[name] = v.view(U64) if name in ("gram", "context", "lower") else v
    model = fit_model(rows, langs, order)
    # calibration on the same texts: mean and spread of each language's cross-entropy on its own texts
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        scorer, acc = Scorer(shared.value), np.zeros((len(langs), 3))
        index = {x: i for i, x in enumerate(langs)}
        for b in batches:
            own = np.array([index[x] for x in b.column(1).to_pylist()], np.int64)
            for lo, hi, offsets, data in tk.blocks(b.column(0)):
                h, letters = scorer.entropy(offsets, data)
                x = h[np.arange(hi - lo), own[lo:hi]]
                ok = letters >= 50
                for k, v in enumerate((np.ones(len(x)), x, x * x)):
                    acc[:, k] += np.bincount(own[lo:hi][ok], v[ok], len(langs))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(langs), dtype=np.int32)), *(pa.array(acc[:, k]) for k in range(3))], names=["lang", "n", "s", "q"])

    stats = known.mapInArrow(tk.tidy(measure), "lang int, n double, s double, q double").groupBy("lang").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()
    for lang, n, s, q in stats:
        if n:
            mean = s / n
            model.usual[lang] = mean
            model.bound[lang] = mean + max(6 * np.sqrt(max(q / n - mean * mean, 0.0)), 0.35)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected added; columns of docs with these names are replaced."""
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        scorer = Scorer(m) if m.langs else None
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            n = b.num_rows
            pred, score, rejected = np.full(n, -1), np.zeros(n), np.ones(n, bool)
            if scorer:
                for lo, hi, offsets, data in tk.blocks(b.column(at)):
                    h, letters = scorer.entropy(offsets, data)
                    pred[lo:hi], score[lo:hi], rejected[lo:hi] = predict(h, letters, m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[pred].tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=[*b.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    return docs.mapInArrow(tk.tidy(run), schema)


def keep_identified(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the texts whose language the model rejects; learns from the languages that docs gives.

    Where docs gives none there is no model to reject by, and all rows stay.
    """
    model = learn(docs, F.lit(True), text_col=text_col)
    if not model.langs:
        return docs
    found = identify(docs, model, text_col)
    return found.filter(~F.col("lang_rejected")).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = _crc_mod("doc_id", 4) == 2
    model = learn(docs, F.coalesce(~held, F.lit(True)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
