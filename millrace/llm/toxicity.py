"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Every word enters as its word embedding plus the embeddings of its character
n-grams, taken over the whole word between boundary marks, so unseen words and
word forms are judged by their characters. Embeddings are hashed; features in
fewer than MIN_DOCS training texts are left out, as they can only be learnt by
heart. The network reads windows of WINDOW words, each half over the next, runs
a gated recurrent unit in both directions, pools by attention and gives one
logit a window; a text has the score of its worst window.

It is trained in numpy on the driver, on a bounded sample: about `sample_docs`
documents of each label, drawn by the hash of the id, and of a text of more than
SAMPLE_WORDS words that many, in windows spread evenly over it. Labels are known
for documents only, so each pass picks the window of every text that scores worst
so far, and a random one of the clean texts. Embeddings start from the log-odds
of their feature in toxic and clean texts, as far as these stand out from chance.
A part of the sample is held back: the pass with the least loss on it is kept,
and logits are moved so that THRESHOLD is the best cut there.

Defined results: null text and text without words score 0; labels that are
null are not learnt from; of repeated labels of one id the greatest counts;
without labels of both kinds every text scores 0; repeated rows score alike;
extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import textkit as tk
from millrace.llm.sizes import small_or_shuffled
from millrace.session import cut

WINDOW = 32
STRIDE = 16
HIDDEN = 8
WIDTH = 8
ATTEND = 8
SAMPLE_DOCS = 3000
SAMPLE_WORDS = 4096
#: Texts of the sample of which one is held back.
HOLD = 5
MIN_DOCS = 4
#: Steps without a better loss on the texts held back after which training ends, and the most of all.
PATIENCE = 120
MOST_STEPS = 1500
#: Loss on the texts held back, of both labels together, at which nothing is left to learn.
ENOUGH = 0.01
THRESHOLD = 0.7
#: Bits of the hash tables: words and character n-grams.
WORD_BITS, GRAM_BITS = 15, 16
ROWS = (1 << WORD_BITS) + (1 << GRAM_BITS)
#: Words whose inputs are summed together.
SUM_WORDS = 8192
#: Bytes of an n-gram, boundary marks included.
GRAMS = (3, 4, 5, 6, 7)
U64 = np.uint64


@dataclass
class Block:
    """Texts as places in a list of distinct words; each of these has rows of the embedding table."""

    word: np.ndarray  # distinct word of every word
    first: np.ndarray  # first word of each text
    rows: np.ndarray  # rows of distinct words: itself, then its n-grams
    begin: np.ndarray  # first row of each distinct word
    hashes: np.ndarray  # of distinct words

    def sums(self, emb: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
        """Input of each distinct word: word embedding, and n-gram embeddings over the root of their number."""
        rows, begin = (self.rows, self.begin) if chosen is None else _pick(self.rows, self.begin, chosen)
        n = np.diff(begin)
        out = np.zeros((len(n), emb.shape[1]), emb.dtype)
        for lo in range(0, len(n), SUM_WORDS):  # the gathered rows take some hundred bytes a word and column
            hi = min(lo + SUM_WORDS, len(n))
            part = rows[begin[lo] : begin[hi]]
            heads = begin[lo:hi] - begin[lo]
            total, own = np.add.reduceat(emb[part], heads), emb[part[heads]]
            out[lo:hi] = own + (total - own) / np.sqrt(np.maximum(n[lo:hi] - 1, 1))[:, None].astype(emb.dtype)
        return out


def _pick(rows: np.ndarray, begin: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = begin[chosen + 1] - begin[chosen]
    out = np.concatenate([[0], np.cumsum(n)])
    return rows[np.arange(out[-1]) + np.repeat(begin[chosen] - out[:-1], n)], out


def features(offsets: np.ndarray, data: np.ndarray) -> Block:
    start, end, first = tk.core_words(offsets, data)
    low = tk.LOWER[data]
    hashes = tk.span_hash(tk.prefix_hash(low), start, end)
    hashes, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    start, size = start[at], (end - start)[at]
    # distinct words side by side, each between boundary marks
    edge = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.ones(edge[-1], np.uint8)
    place = np.arange(edge[-1]) - np.repeat(edge[:-1], size + 2)
    inside = (place > 0) & (place <= np.repeat(size, size + 2))
    text[inside] = low[(np.repeat(start, size + 2) + place - 1)[inside]]
    prefix = tk.prefix_hash(text)
    owner, keys = [np.arange(len(at))], [(hashes >> U64(64 - WORD_BITS)).astype(np.int32)]
    left = np.repeat(edge[1:], size + 2) - np.arange(edge[-1])  # bytes to the end of the word
    whose = np.repeat(np.arange(len(at)), size + 2)
    for n in GRAMS:
        i = np.flatnonzero(left >= n)
        owner.append(whose[i])
        keys.append((1 << WORD_BITS) + (tk.span_hash(prefix, i, i + n) >> U64(64 - GRAM_BITS)).astype(np.int32))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return Block(word, first, np.concatenate(keys)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at)))]), hashes)


def gathered(texts: pa.Array) -> Block:
    """All texts as one block, made in blocks of bounded size whose distinct words are put together."""
    words, firsts, rows, sizes, known, at = [], [], [], [], np.zeros(0, U64), 0
    place = np.zeros(0, np.int64)
    for _, _, offsets, data in tk.blocks(texts):
        b = features(offsets, data)
        spot = np.minimum(np.searchsorted(known, b.hashes), max(len(known) - 1, 0))
        fresh = known[spot] != b.hashes if len(known) else np.ones(len(b.hashes), bool)
        slot = np.empty(len(b.hashes), np.int64)
        slot[~fresh] = place[spot[~fresh]] if len(known) else 0
        new = np.flatnonzero(fresh)
        slot[new] = len(known) + np.arange(len(new))
        part, ends = _pick(b.rows, b.begin, new)
        rows.append(part)
        sizes.append(np.diff(ends))
        words.append(slot[b.word].astype(np.int32))
        firsts.append(at + b.first[:-1])
        at += len(b.word)
        joined, numbers = np.concatenate([known, b.hashes[new]]), np.concatenate([place, slot[new]])
        order = np.argsort(joined, kind="stable")
        known, place = joined[order], numbers[order]
    empty = np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(np.concatenate([empty, *sizes]))])
    names = np.empty(len(known), U64)
    names[place] = known
    return Block(np.concatenate([np.zeros(0, np.int32), *words]), np.append(np.concatenate([empty, *firsts]), at), np.concatenate([np.zeros(0, np.int32), *rows]), begin, names)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of every window: one each STRIDE words until the text's end is covered."""
    n = np.diff(first)
    count = np.where(n > WINDOW, 1 + -(-(n - WINDOW) // STRIDE), (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + nth * STRIDE
    return start, np.minimum(WINDOW, first[text + 1] - start), text


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, log_odds: np.ndarray, known: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        emb = (rng.standard_normal((len(log_odds), WIDTH)) * 0.02).astype(np.float32)
        emb[:, 0] = 0.5 * log_odds
        emb[~known] = 0
        return cls(
            {
                "emb": emb,
                "wx": draw(2, WIDTH, 3 * HIDDEN),
                "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
                "u": draw(2, HIDDEN, 3 * HIDDEN),
                "wa": draw(2 * HIDDEN, ATTEND),
                "ba": np.zeros(ATTEND, np.float32),
                "va": 0.5 * np.ones(ATTEND, np.float32),
                "wo": 0.5 * draw(2 * HIDDEN, 1)[:, 0],
                "bo": np.zeros(1, np.float32),
            }
        )

    def forward(self, inputs: np.ndarray, word: np.ndarray, start: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logit of each window; with keep, also what backward needs. inputs: of distinct words; word: distinct word at each place."""
        p, n = self.p, len(start)
        steps = int(size.max()) if n else 0
        at = np.arange(steps)[:, None] + start[None, :]
        mask = np.arange(steps)[:, None] < size[None, :]
        rows = word[np.where(mask, at, start[None, :])]  # steps, windows
        x = inputs[rows]
        flat = x.reshape(-1, WIDTH)
        gates = np.stack([(flat @ p["wx"][0] + p["b"][0]).reshape(steps, n, -1), (flat @ p["wx"][1] + p["b"][1]).reshape(steps, n, -1)[::-1]], 1)
        masks = np.stack([mask, mask[::-1]], 1)[..., None].astype(np.float32)
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, 2, n, HIDDEN), np.float32)
        held = []
        for t in range(steps):
            a = h @ p["u"]
            zr = _gate(gates[t][..., : 2 * HIDDEN] + a[..., : 2 * HIDDEN])
            z, r, an = zr[..., :HIDDEN], zr[..., HIDDEN:], a[..., 2 * HIDDEN :]
            c = np.tanh(gates[t][..., 2 * HIDDEN :] + r * an)
            new = h + masks[t] * (1 - z) * (c - h)
            if keep:
                held.append((h, z, r, an, c))
            h = states[t] = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], -1)  # steps, windows, 2 * HIDDEN
        u = np.tanh(both @ p["wa"] + p["ba"])
        s = np.where(mask, u @ p["va"], -1e9)
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = (w[..., None] * both).sum(0)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, (rows, x, mask, masks, held, both, u, w, pooled)) if keep else logit

    def backward(self, kept, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the summed loss, by hand; that of the inputs under `x`."""
        p = self.p
        rows, x, mask, masks, held, both, u, w, pooled = kept
        steps, n = mask.shape
        g = {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["wo"]
        d_both = w[..., None] * d_pooled
        d_w = (both * d_pooled).sum(-1)
        d_s = w * (d_w - (w * d_w).sum(0))
        g["va"] = np.tensordot(d_s, u, ((0, 1), (0, 1)))
        d_u = d_s[..., None] * p["va"] * (1 - u * u)
        g["wa"] = both.reshape(-1, 2 * HIDDEN).T @ d_u.reshape(-1, ATTEND)
        g["ba"] = d_u.sum((0, 1))
        d_both = d_both + d_u @ p["wa"].T
        d_states = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]], 1)
        d_gates = np.empty((steps, 2, n, 3 * HIDDEN), np.float32)
        g["u"] = np.zeros_like(p["u"])
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, an, c = held[t]
            d_new = d_h + d_states[t]
            m = masks[t]
            d_c = d_new * m * (1 - z) * (1 - c * c)
            d_z = d_new * m * (h - c) * z * (1 - z)
            d_r = d_c * an * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_c], -1)
            d_a = np.concatenate([d_z, d_r, d_c * r], -1)
            g["u"] += h.transpose(0, 2, 1) @ d_a
            d_h = d_new * (1 - m * (1 - z)) + d_a @ p["u"].transpose(0, 2, 1)
        own = np.stack([d_gates[:, 0], d_gates[::-1, 1]], 0).reshape(2, -1, 3 * HIDDEN)
        flat = x.reshape(-1, WIDTH)
        g["wx"] = flat.T[None] @ own
        g["b"] = own.sum(1, keepdims=True)
        d_x = ((own[0] @ p["wx"][0].T + own[1] @ p["wx"][1].T).reshape(steps, n, WIDTH) * mask[..., None]).reshape(-1, WIDTH)
        g["x"] = (rows.ravel(), d_x)
        return g


def _gate(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def train(block: Block, labels: np.ndarray, rate: float = 4e-3, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    batch = int(np.clip(len(labels) // 16, 8, 64))
    start, size, text = windows(block.first)
    held = np.zeros(len(labels), bool)
    for y in (0, 1):
        mine = np.flatnonzero(labels == y)
        held[rng.permutation(mine)[: len(mine) // HOLD]] = True
    log_odds, known = _log_odds(block, labels, ~held)
    net = Network.fresh(log_odds, known, seed)
    strongest = block.sums(log_odds[:, None])[:, 0][block.word]
    score = np.maximum.reduceat(np.append(strongest, -np.inf), np.stack([start, start + size], 1).ravel())[::2] if len(start) else np.zeros(0)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, best, best_step, kept = 0, np.inf, 0, net.p
    while len(start) and step < MOST_STEPS and step - best_step < PATIENCE and best > ENOUGH:
        learnt = np.flatnonzero(~held[text])
        order = learnt[np.lexsort((score[learnt], text[learnt]))]
        worst = order[np.append(text[order][1:] != text[order][:-1], True)] if len(order) else order
        clean = learnt[labels[text[learnt]] == 0]
        extra = rng.choice(clean, min(len(clean), len(worst)), replace=False) if len(clean) else clean
        chosen = np.concatenate([worst, extra])
        rng.shuffle(chosen)
        y = labels[text[chosen]].astype(np.float32)
        # both labels weigh the same
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
        for lo in range(0, len(chosen), batch):
            w, part = chosen[lo : lo + batch], slice(lo, lo + batch)
            step += 1
            _step(net, block, start[w], size[w], y[part], weight[part], m, v, step, rate, known)
        score = score_windows(net, block, start, size)
        logit, y = _worst(score, text, held), labels[held & (np.diff(block.first) > 0)]
        loss = _loss(logit, y)
        if loss < best - 1e-4:
            best, best_step, kept = loss, step, {k: x.copy() for k, x in net.p.items()}
    net.p = kept
    if len(start):
        score = score_windows(net, block, start, size)
        logit, y = _worst(score, text, held), labels[held & (np.diff(block.first) > 0)]
        net.p["bo"] = net.p["bo"] + np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - _cut(logit, y))
    return net


def _step(net, block, start, size, y, weight, m, v, step, rate, known) -> None:
    """One step of Adam on the windows; rows of the embedding table that the windows lack stay as they are."""
    at = np.arange(int(size.max()))[:, None] + start[None, :]
    used = np.unique(block.word[np.minimum(at, len(block.word) - 1)])
    local = np.searchsorted(used, block.word[np.minimum(at, len(block.word) - 1)])
    rows, begin = _pick(block.rows, block.begin, used)
    inputs = block.sums(net.p["emb"], used)
    flat = local.T.ravel()  # a window's words side by side
    logit, kept = net.forward(inputs, flat, np.arange(len(start)) * at.shape[0], size, keep=True)
    g = net.backward(kept, (weight * (_sigmoid(logit) - y) / len(y)).astype(np.float32))
    which, d_x = g.pop("x")
    per_word = np.stack([np.bincount(which, d_x[:, k], len(used)) for k in range(WIDTH)], 1).astype(np.float32)
    n = np.diff(begin)
    share = np.repeat(1 / np.sqrt(np.maximum(n - 1, 1)), n)
    share[begin[:-1]] = 1
    touched, slot = np.unique(rows, return_inverse=True)
    weighted = np.repeat(per_word, n, 0) * share[:, None]
    g_emb = np.stack([np.bincount(slot, weighted[:, k], len(touched)) for k in range(WIDTH)], 1).astype(np.float32) * known[touched][:, None]
    for k, x in net.p.items():
        at = touched if k == "emb" else slice(None)
        d = g_emb if k == "emb" else g[k]
        m[k][at] += 0.1 * (d - m[k][at])
        v[k][at] += 0.01 * (d * d - v[k][at])
        x[at] -= rate * (m[k][at] / (1 - 0.9**step)) / (np.sqrt(v[k][at] / (1 - 0.99**step)) + 1e-7)


def _worst(score: np.ndarray, text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Greatest score of each wanted text that has windows."""
    head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    return np.maximum.reduceat(score, head)[wanted[text[head]]]


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    """Mean loss in which both labels weigh the same."""
    each = np.logaddexp(0, np.where(y == 1, -logit, logit))
    return float(sum(each[y == k].mean() for k in (0, 1) if (y == k).any()))


def _cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit above which texts are best called toxic by the F measure: the middle of the best gap."""
    order = np.argsort(-logit, kind="stable")
    hit = np.cumsum(y[order])
    if not len(hit) or not hit[-1] or hit[-1] == len(hit):
        return float(np.log(THRESHOLD / (1 - THRESHOLD)))
    f = 2 * hit / (np.arange(1, len(hit) + 1) + hit[-1])
    top = np.append(logit[order], logit[order][-1] - 1)
    good = np.flatnonzero((f >= f.max() - 1e-9) & (top[:-1] > top[1:]))
    at = good[np.argmax(top[good] - top[good + 1])] if len(good) else int(np.argmax(f))
    return float((top[at] + top[at + 1]) / 2)


def _log_odds(block: Block, labels: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each feature to stand in a toxic rather than a clean text, shrunk to nothing where chance explains them; features in enough texts."""
    counts = np.zeros((2, ROWS))
    for i in np.flatnonzero(learnt):
        rows = _pick(block.rows, block.begin, np.unique(block.word[block.first[i] : block.first[i + 1]]))[0]
        counts[int(labels[i])] += np.bincount(rows, minlength=ROWS) > 0
    n = np.bincount(labels[learnt].astype(np.int64), minlength=2).astype(float)[:, None]
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    # signed root of the likelihood ratio against one rate for both labels
    seen = counts.sum(0)
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)
    ratio = sum(part(counts[k], n[k] * seen / n.sum()) + part(n[k] - counts[k], n[k] * (n.sum() - seen) / n.sum()) for k in (0, 1))
    root = np.sqrt(np.maximum(2 * ratio, 0))
    known = seen >= MIN_DOCS
    return (np.clip(odds, -4, 4) * np.clip((root - 3) / 2, 0, 1) * known).astype(np.float32), known


def score_windows(net: Network, block: Block, start: np.ndarray, size: np.ndarray, step: int = 2048) -> np.ndarray:
    inputs = block.sums(net.p["emb"])
    parts = [net.forward(inputs, block.word, start[i : i + step], size[i : i + step]) for i in range(0, len(start), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def spread_words(offsets: np.ndarray, data: np.ndarray, most: int) -> list[bytes]:
    """Each text, or of a text of more than `most` words that many, in runs of WINDOW words spread evenly."""
    start, end, first = tk.core_words(offsets, data)
    raw, out = data.tobytes(), []
    for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if z - a <= most:
            out.append(raw[offsets[i] : offsets[i + 1]])
            continue
        runs = max(1, most // WINDOW)
        heads = (a + np.arange(runs) * (z - a - WINDOW) // max(runs - 1, 1)).tolist()
        out.append(b" ".join(raw[start[h] : end[min(h + WINDOW, z) - 1]] for h in heads))
    return out


def learn(docs: DataFrame, labels: DataFrame, train_on: Column, sample_docs: int = SAMPLE_DOCS, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Fits on labels of rows where train_on (over doc_col) holds."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(doc_col).isNotNull() & train_on).groupBy(doc_col).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    known = cut(known.withColumn("_y", (F.col("_y") > 0).cast("int")))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.col(doc_col), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("_y") == 1, min(1.0, sample_docs / counts[1])).otherwise(min(1.0, sample_docs / counts[0]))
    sample = small_or_shuffled(known.filter(draw < share))
    rows = docs.select(doc_col, F.col(text_col).alias("_t")).join(sample, doc_col).select("_y", "_t")

    def run(batches):
        for b in batches:
            for lo, hi, offsets, data in tk.blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(spread_words(offsets, data, SAMPLE_WORDS), pa.binary())], names=["_y", "words"])

    got = rows.mapInArrow(tk.tidy(run), "_y int, words binary").orderBy(F.xxhash64("words"), "_y").collect()
    got = [(r[0], bytes(r[1])) for r in got if len(r[1])]
    y = np.array([r[0] for r in got])
    if len(np.unique(y)) < 2:
        return None
    block = gathered(pa.array([r[1] for r in got], pa.binary()).cast(pa.large_binary()).view(pa.large_string()))
    got.clear()
    out = train(block, y)
    tk.release()
    return out


def score(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """docs with toxicity added; a column of docs with this name is replaced."""
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for b in batches:
            out = np.zeros(b.num_rows)
            if model is not None:
                for lo, hi, offsets, data in tk.blocks(b.column(at)):
                    block = features(offsets, data)
                    start, size, text = windows(block.first)
                    if len(start):
                        logit = score_windows(model, block, start, size)
                        head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                        out[lo + text[head]] = _sigmoid(np.maximum.reduceat(logit, head).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "toxicity"])

    return docs.mapInArrow(tk.tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    net = learn(docs, labels, ~held)
    out = score(docs, net)
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
