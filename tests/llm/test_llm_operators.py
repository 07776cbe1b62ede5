"""Each operator against brute force on a small corpus with the awkward cases: nulls, empties, repeats, ties, long texts, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import decontaminate, fixity, langid, licenses, line_dedup, ngram_join, packing, quality, suffix_dedup, toxicity
from millrace.llm import textkit as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "an the re on ti ou er in ed ha éa ñu öz st".split()


def prose(rng, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "", ".", ","]))
    return " ".join(out)


def corpus():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One"), (4, "one"), (None, "lost words here"), (None, None)]
    base = prose(rng, 120)
    for i in range(10, 40):
        w = base.split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 10])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(i, prose(rng, rng.randrange(1, 60))) for i in range(50, 70)]
    rows += [(80, rows[-1][1]), (81, rows[-1][1]), (81, rows[-1][1])]  # copies, and a row that repeats
    rows.append((90, prose(rng, 30) + "\n" + base + "\n" + prose(rng, 4000)))
    rows.append((91, base.upper()))
    return rows


ROWS = corpus()
SCHEMA = "doc_id long, text string, lang string, source string, toxicity string, line_count int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, f"s{k % 4}", "extra", 7) for k, (i, t) in enumerate(ROWS)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 60)])
@pytest.mark.parametrize("small", [2, 24])
def test_ngram_join(docs, monkeypatch, n, percent, small):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", small)
    got = ngram_join.similar_groups(docs, n, percent).collect()
    named = {i: shingles(t, n) for i, t in ROWS if i is not None}
    parent = {i: i for i in named}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in named:
        for b in named:
            x, y = named[a], named[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(named[r.doc_id]), find(r.doc_id)), r
    kept = [r.doc_id for r in ngram_join.keep_one(docs, n, percent).select("doc_id").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({find(i) for i in named})
    assert kept.count(None) == 2


@pytest.mark.parametrize("small,block", [(2, 4), (24, 512)])
def test_ngram_join_counts_every_link(docs, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", small)
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
    monkeypatch.setattr(ngram_join, "LINK_COLUMNS", 8 * block)
    sets = {i: shingles(t, 5) for i, t in ROWS if i is not None}
    classes = set(sets.values())
    want = {i: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in classes if y) if x else 0 for i, x in sets.items()}
    got = {r.doc_id: r.n_links for r in ngram_join.similar_groups(docs, 5, 80).collect() if r.doc_id is not None}
    assert got == want and max(want.values()) > 4


def test_ngram_join_reads_repeated_rows_once(spark):
    texts = ["one two three four five six seven eight", "one two three four five six other words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) for _ in range(3)], "doc_id long, text string")
    sets = ngram_join._sets(df, df.select("doc_id").distinct(), 3)
    a, b = sorted(bytes(r.cls) for r in sets.select("cls").distinct().collect())
    found = ngram_join._verify(spark.createDataFrame([(a, b, True)], "pivot binary, cls binary, expand boolean"), sets, 40).collect()
    assert [(r.linked, len(r.diff) // 8) for r in found] == [(True, len(shingles(texts[0], 3) ^ shingles(texts[1], 3)))]


@pytest.mark.parametrize("n,percent", [(1, 60), (2, 50)])
def test_ngram_join_of_a_dense_group(spark, monkeypatch, n, percent):
    """Many texts around one, with each other similar here and there only, in blocks of a few."""
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", 2)
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "LABEL_STEPS", 1)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(14)]
    rows = [(i, " ".join(w if rng.random() > 0.3 else f"x{rng.randrange(6)}" for w in base)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, n) for i, t in rows}
    near = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            root[i] = min(root[j] for j in sets if near(sets[i], sets[j]))
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.similar_groups(df, n, percent).collect()}
    assert got == {i: (root[i], len({sets[j] for j in sets if near(sets[i], sets[j])} - {sets[i]})) for i in sets}
    assert 1 < len(set(root.values())) < 80


@pytest.mark.parametrize("rows,hub", [(10**6, 10**4), (0, 3), (0, 10**4)])
def test_components_with_hubs(spark, monkeypatch, rows, hub):
    from millrace.llm import components

    monkeypatch.setattr(components, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(components, "HUB_LINKS", hub)
    rng = random.Random(hub + rows)
    links = [(0, i) for i in range(1, 30)] + [(90, i) for i in range(60, 80)] + [(i, i + 1) for i in range(30, 50)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)] + [(29, 61), (7, 7)]
    root = {i: i for pair in links for i in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([p for p in links for _ in range(2)], "a long, b long")
    assert {r.node: r.label for r in components.components(df, "a", "b").collect()} == root


def test_ngram_join_of_nothing(nothing):
    assert ngram_join.similar_groups(nothing).count() == 0 == ngram_join.keep_one(nothing).count()


def test_shared_passages_are_marked(spark):
    rng = random.Random(12)
    word = lambda n: [f"{rng.choice(SYLLABLES)}{rng.randrange(10**6)}" for _ in range(n)]
    passage = {n: word(n) for n in (20, 51, 60, 300)}
    rows, want = [], {}
    for i in range(60):
        n = [0, 20, 51, 60, 300][i % 5]
        rows.append((i, " ".join(word(rng.randrange(0, 80)) + (passage[n] if n else []) + word(rng.randrange(0, 80)))))
        want[i] = n >= 51
    rows += [(90, rows[2][1]), (91, None), (92, ""), (93, " ".join(word(200) * 2)), (None, " ".join(passage[51]))]
    want |= {90: True, 91: False, 92: False, 93: False, None: True}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_shared_passages for r in suffix_dedup.remove_repeats(df, keep_text=False).collect()}
    assert {i: n > 0 for i, n in got.items()} == want
    text, keys = suffix_dedup.passage_marks(np.array([0, 3, 3]), np.frombuffer(b"a b", np.uint8), 51, 36)
    assert not len(text) and not len(keys)


@pytest.mark.parametrize("length,gram,hot", [(40, 12, 10**9), (40, 12, 2), (25, 8, 3), (400, 128, 2000)])
def test_suffix_dedup(docs, monkeypatch, length, gram, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 20_000)
    got = suffix_dedup.remove_repeats(docs, length, gram, parts=3).drop("n_shared_passages").collect()
    raw = [(t or "").encode() for _, t in ROWS]
    count = Counter(x[p : p + length] for x in raw for p in range(len(x) - length + 1))
    want = []
    for (i, _), x in zip(ROWS, raw):
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if count[x[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        want.append((i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    key = lambda r: (str(r[0]), r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_suffix_dedup_of_nothing(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_loser_tree_orders_and_learns_prefixes():
    rng = random.Random(0)
    for _ in range(100):
        runs = []
        for _ in range(rng.randrange(1, 6)):
            items = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(8))) for _ in range(rng.randrange(9)))
            runs.append((items, suffix_dedup.neighbour_prefixes(items)))
        tree = suffix_dedup.LoserTree(runs)
        merged = list(tree.merge())
        items = [tree.runs[r][0][i] for r, i, _ in merged]
        assert items == sorted(x for r in runs for x in r[0])
        assert [n for _, _, n in merged][1:] == suffix_dedup.neighbour_prefixes(items)[1:]


def test_anchors_of_segments_agree(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.find_anchors(data, 50, 10)
    covered = sorted((int(a) - d) for a, lo, hi in zip(whole[0], whole[2], whole[3]) for d in range(int(lo), int(hi) + 1))
    assert covered == list(range(len(data) - 49))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    parts = suffix_dedup.find_anchors(data, 50, 10)
    flat = lambda x: sorted((int(a), int(a) - d) for a, lo, hi in zip(x[0], x[2], x[3]) for d in range(int(lo), int(hi) + 1))
    assert flat(parts) == flat(whole)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, packing.Capacity(tokens=64)).collect()
    want = []
    for i, t in ROWS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[s : s + 64], "<u4")
            want.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * -(-sum(r[3] for r in want) // 64) + 1
    assert packing.pack(nothing).count() == 0


def test_plan_scores_attention_where_it_cannot_bind():
    """Two sequences with as many tokens left: the one with less attention left gets the next piece in the query's own call; without its weight the documents left decide."""
    counts = {3000: 1, 1500: 2, 500: 1}
    place = lambda capacity: {r[0]: r[3] for r in packing.plan(counts, capacity)}
    both = place(packing.Capacity())
    assert both[500] == both[3000] != both[1500]
    few = place(packing.Capacity(documents=4, weights=(1.0, 1.0, 0.0)))
    assert few[500] == few[1500]
    assert place(packing.Capacity(documents=2))[500] == both[3000]
    assert place(packing.Capacity(attention=9_100_000, weights=(1.0, 0.0, 0.0)))[500] != both[3000]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents,attention", [(None, None), (3, None), (None, 2500), (2, 3000)])
def test_plan_holds_every_constraint(rule, documents, attention):
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 50) for _ in range(500))
    c = packing.Capacity(64, documents, attention, rule, (1.0, 0.5, 0.25))
    load, placed = defaultdict(list), Counter()
    for length, _, n, first, offset in packing.plan(counts, c):
        placed[length] += n
        for s in range(first, first + n):
            load[s].append((offset, length))
    assert placed == counts
    for parts in load.values():
        assert sum(x for _, x in parts) <= 64 and len(parts) <= (documents or 64) and sum(x * x for _, x in parts) <= (attention or 64**2)
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_workers_drop_what_other_tasks_kept(spark):
    import pyarrow as pa

    def kept_after(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([",".join(sorted(tk.kept))] * b.num_rows)], names=["id", "kept"])

    df = spark.range(40).repartition(4)
    docs = df.selectExpr("id AS doc_id", "'some words' AS text")
    path = packing.tokenizer_path()
    assert packing.tokenise(docs, 64, path, 1, "doc_id", "text").count() == 40
    told = lambda keeps: {r.kept for r in df.mapInArrow(tk.tidy(kept_after, keeps), "id long, kept string").collect()}
    assert told(path) <= {"", path} and told(None) == {""}


def test_words_split_like_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = [*"ab'sS tT,.!9é́ \t\n\x0b\x0c\r \x85 \x1c\x00中ΣİE😀É×ñ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "'re", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    tok, words, got = Tokenizer.from_file(packing.tokenizer_path()), packing.WordTokens(packing.tokenizer_path()), []
    for lo, hi, offsets, data in tk.blocks(pa.array(texts), 5000):
        ids, first = words.encode(offsets, data)
        got += [ids[first[i] : first[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_quality_counts(docs, nothing):
    got = quality.score(docs).collect()
    want = []
    for i, t in ROWS:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = Counter(grams)
        repeat = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), failed))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.score(nothing).count() == 0


def test_quality_posterior_document_by_document(spark):
    """Expectation-maximisation over single documents, from the votes that the operator gives."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "house,", "tree.", "runs", "##", "x" * 17]) if i % 3 else "spam" for _ in range(rng.randrange(1, 160)))) for i in range(150)] + [(900, None), (901, "")]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = [f"vote_{r.name}" for r in quality.rules()]
    votes = np.array([[np.nan if r[n] is None else r[n] for n in names] for r in got], float)
    voted = ~np.isnan(votes)
    yes = np.nan_to_num(votes)
    prior, good, bad = 0.8, np.full(len(names), 0.95), np.full(len(names), 0.7)

    def posterior():
        odds = np.log(prior / (1 - prior)) + (voted * (yes * np.log(good / bad) + (1 - yes) * np.log((1 - good) / (1 - bad)))).sum(1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(50):
        p = posterior()
        prior = min(0.99, max(0.05, (p.sum() + 8) / (len(p) + 10)))
        good = np.clip(((voted * yes * p[:, None]).sum(0) + 9.5) / ((voted * p[:, None]).sum(0) + 10), 0.5, 0.995)
        bad = np.minimum(good - 0.01, np.maximum(0.02, ((voted * yes * (1 - p)[:, None]).sum(0) + 7) / ((voted * (1 - p)[:, None]).sum(0) + 10)))
    for r, p in zip(got, posterior()):
        assert r.posterior == pytest.approx(p, abs=1e-6)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and p >= 0.5)
    assert len({r.kept for r in got}) == 2


def test_quality_repeats(spark):
    texts = ["a b c a b c", "x x x x", "a b c d\na b c d\nq", "# $ | w*", "p q r s p q r t u p q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_repeat_words, r.n_dup_lines, r.n_symbols) for r in quality.metrics(df).collect()}
    assert got == {0: (6, 0, 0), 1: (4, 0, 0), 2: (8, 1, 0), 3: (0, 0, 4), 4: (6, 0, 0)}


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(4)
    g, b = (0.95, 0.9, 0.85, 0.9), (0.2, 0.3, 0.5, 0.4)
    rows = Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        rows[tuple(None if rng.random() < 0.1 else int(rng.random() < (g if good else b)[k]) for k in range(4))] += 1
    m = quality.fit(list(rows.items()), 4)
    assert m.prior == pytest.approx(0.7, abs=0.05)
    assert m.good_rate == pytest.approx(g, abs=0.05) and m.bad_rate == pytest.approx(b, abs=0.08)


def test_line_dedup(spark, nothing):
    rng = random.Random(3)
    rows = [(i, "\n".join([f"own words of page {i} that nobody repeats anywhere"] * 1 + ["shared footer"] * (i % 3 > 0) + ["few"] * (i < 2) + ["", "  "] * (i % 2)), f"site{i % 9}") for i in range(30)]
    rows += [(100, "shared footer\nshared footer", "x"), (101, None, "x"), (102, "", None), (103, "shared footer", None), (None, "shared footer\nlonger text of its own, quite long", "y"), (None, "shared footer\nx", "y"), (5, rows[5][1], "site5")]
    rows.append((104, "shared footer\n" + "a long line " * 20_000, "z"))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, line_count int, removed_lines int")
    sites, texts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" \t\r") and s is not None:
                sites[line.strip(" \t\r")].add(s)
                texts[line.strip(" \t\r")].add(t)
    want = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        body = [x.strip(" \t\r") for x in lines]
        kept = [x for x, b in zip(lines, body) if not b or len(sites[b]) < 5 or len(texts[b]) < 5]
        want.append((i, "\n".join(kept) if t is not None else None, s, len(lines) - len(kept)))
    got = line_dedup.remove_boilerplate(df, min_sites=5).select("doc_id", "text", "source", "removed_lines").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.removed_lines for r in got) > 10
    out = line_dedup.remove_boilerplate(nothing)
    assert out.count() == 0 and out.columns.count("line_count") == 1


def test_line_dedup_of_short_pages_and_copies(spark):
    rows = [(i, f"shared header\nshared footer\nown {i}", f"site{i}") for i in range(6)]
    rows += [(20 + i, "a text of two lines\nthat was copied whole", f"site{i}") for i in range(6)]
    rows += [(40, "shared header\nshared footer", "site1"), (41, "shared footer\nx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in corpus_pipeline.line_dedup.remove_boilerplate(df, min_sites=5).collect()}
    want = {i: (f"own {i}", 2) for i in range(6)} | {20 + i: (rows[6][1], 0) for i in range(6)}
    assert got == want | {40: ("", 2), 41: ("x", 1)}
    many = spark.createDataFrame([(i, f"shared header\nown {i}", f"site{i}") for i in range(12)], "doc_id long, text string, source string")
    assert {r.text for r in corpus_pipeline.drop_boilerplate(spark, many, "").collect()} == {f"own {i}" for i in range(12)}


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Without labels, with nulls, empty texts, repeated rows and null ids: what no stage has a reason to drop is packed."""
    rng = random.Random(8)
    texts = [prose(rng, 40) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, None), (21, ""), (22, "..."), (3, texts[3]), (3, texts[3]), (30, texts[5]), (None, texts[6] + " more"), (None, None)]
    bench = spark.createDataFrame([(1, texts[2])], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(i, t, None, f"s{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    for docs in (df, df.withColumn("lang", corpus_pipeline.langid.F.lit("xx")), df.limit(0)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        step = spark.read.parquet(f"{tmp_path}/documents.parquet")
        columns = step.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            step = stage(spark, step, str(tmp_path))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert step.columns == columns
        got = sorted((r.doc_id if r.doc_id is not None else -1) for r in step.collect())
        labelled = docs.filter("lang IS NOT NULL").limit(1).count()
        # one of equal rows stays, one of equal texts, one of groups without an id each; the copy of the item goes
        left = [i for i in range(12) if i != 2] + ([-1] if labelled else [-1, -1, 20, 21, 22])
        assert got == (sorted(left) if docs.count() else [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


BENCH = [
    (1, "A train leaves Boston at 40 km per hour and meets Alice after 3 hours near the old stone bridge by the river"),
    (2, "Compute the sum of all odd numbers below the given bound and explain each step of your reasoning in full"),
    (3, None),
    (4, "too short"),
    (5, "12 34 56 78 90 12 34 56 78 90"),
]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    reworded = BENCH[0][1].replace("Boston", "Denver").replace("Alice", "Carol").replace("40", "75").replace("3 hours", "8 hours")
    broken = BENCH[0][1] + " " + BENCH[0][1].replace("Alice", "Boston")
    texts = [
        (1, "noise before " + BENCH[1][1] + " and after", [2], True),
        (2, "He said: " + reworded, [1], False),
        (3, BENCH[1][1][:40] + " something else entirely follows here", [], None),
        (4, None, [], None),
        (5, "", [], None),
        (6, "1 2 3 4 5 6 7 8 9 10 11 12", [], None),
        (7, BENCH[1][1].upper() + "&&& " + BENCH[0][1], [1], True),
        (8, "so too short a text", [4], True),
        (9, broken, [1], True),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t, _, _ in texts], "doc_id long, text string, leak_item int")
    for block in (decontaminate.BLOCK_CHARS, 100):
        got = {r.doc_id: r for r in decontaminate.find_leaks(df, bench, block_chars=block).collect()}
        for i, _, items, exact in texts:
            if i == 7:
                assert 1 in got[i].leak_items
            else:
                assert (list(got[i].leak_items), got[i].leak_exact) == (items, exact), i
    assert decontaminate.find_leaks(docs, bench).count() == len(ROWS)
    assert decontaminate.keep_clean(df, bench.limit(0)).count() == len(texts)


def test_decontamination_recall_on_edited_items(spark):
    """Items of 24 to 45 words inside other prose: copied, with a word put in, left out or changed, and with other numbers and names."""
    rng = random.Random(21)
    people, places = ["Alice", "Boris", "Chen", "Dora", "Emil"], ["Boston", "Kyoto", "Lima", "Oslo"]

    def item(who, where, n):
        body = prose(rng, rng.randrange(16, 37)).split()
        for at, w in ((3, who), (7, f"{n} km"), (11, where), (14, str(n * 3))):
            body.insert(at, w)
        return body

    def edit(words, kind):
        words = list(words)
        at = rng.randrange(2, len(words) - 2)
        if kind == "put in":
            words.insert(at, "really")
        elif kind == "left out":
            del words[at]
        elif kind == "changed":
            words[at] = "other"
        elif kind == "re-parameterised":
            names = {w: rng.choice([x for x in people + places if x != w]) for w in people + places if w in words}
            while len(set(names.values())) < len(names):
                names = {w: rng.choice([x for x in people + places if x != w]) for w in names}
            values = {w: str(rng.randrange(1000, 9999)) for w in words if w.isdigit()}
            words = [names.get(w, values.get(w, w)) for w in words]
        return words

    items = [item(rng.choice(people), rng.choice(places), rng.randrange(10, 90)) for _ in range(40)]
    items = [" ".join(x).split() for x in items]
    kinds = ["copied", "put in", "left out", "changed", "re-parameterised"]
    rows = [(len(items) * k + i, " ".join(prose(rng, 30).split() + edit(x, kind) + prose(rng, 30).split())) for k, kind in enumerate(kinds) for i, x in enumerate(items)]
    rows += [(1000 + i, prose(rng, 120)) for i in range(100)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r.leak_items for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    for k, kind in enumerate(kinds):
        found = sum(i in got[len(items) * k + i] for i in range(len(items)))
        assert found >= (1.0 if kind == "copied" else 0.9) * len(items), (kind, found)
    assert not any(got[1000 + i] for i in range(100))


def _judged(items, text):
    import pyarrow as pa

    block = decontaminate.Block(list(range(len(items))), items, decontaminate.WIDTH)
    offsets, data = tk.column_bytes(pa.array([text]))
    return {item: share for _, item, share, _ in decontaminate.judge(block, offsets, data, decontaminate.COVERAGE)}


def test_items_rich_in_slots_are_found_where_copied():
    items = ["12 34 56 78 90 12 34 56 78 91 11", "List: Anna Ben Carl Dora Emil Frieda Georg Hanna Ida Jakob", "3 cm 4 kg", "add 1 2 3 4 5 6 7 8 9 10 11 to the sum of all of the numbers above"]
    for k, item in enumerate(items):
        assert _judged(items, f"some words before {item} and after it") == {k: 1.0}
    assert _judged(items, "10 34 56 78 90 10 34 56 78 95 19") == {}


def test_edited_and_partial_items_are_found():
    w = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(38)]
    item, short = " ".join(w), " ".join(w[:16])
    around = lambda x: "noise stands before " + " ".join(x) + " and some after"
    edits = [w[:19] + ["new"] + w[19:], w[:19] + w[20:], w[:12] + ["x"] + w[13:25] + ["y"] + w[26:], w[:19], w[19:], w[:9] + ["x", "y"] + w[9:20] + w[21:30] + ["z"] + w[31:]]
    for edit in edits:
        assert list(_judged([item], around(edit))) == [0], edit
    assert _judged([item], around(edits[0]))[0] == pytest.approx(24 / 31)
    assert list(_judged([short], around(w[:7] + ["x"] + w[8:16]))) == [0]
    assert _judged([item], around(w[:10])) == {} == _judged([short], around(w[:8] + ["x", "y", "z"]))
    assert _judged([item], around(w[20:30] + ["x"] * 9 + w[:10])) == {}


def test_slots_must_map_one_to_one(spark):
    item = "First Alice gave Bob the red box and then Alice asked Bob for the blue box again"
    swapped = item.replace("then Alice", "then Carol")
    df = spark.createDataFrame([(1, "So " + item), (2, "So " + swapped)], "doc_id long, text string")
    got = {r.doc_id: list(r.leak_items) for r in decontaminate.find_leaks(df, spark.createDataFrame([(1, "So " + item)], "item_id long, text string")).collect()}
    assert got == {1: [1], 2: []}


def test_license_scan_matches_brute_force(spark, docs):
    rows = [(1, "Intro\nReleased under the MIT License.\nend"), (2, "# licensed UNDER the Apache license version 2.0"), (3, None), (4, ""), (5, "All rights"), (6, "All rights reserved. All rights reserved."), (7, licenses.TEMPLATES[1][1].replace(". ", ".\n")), (8, "nothing at all")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license_matches string")

    def words(t):
        return [w for w in (re.sub(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", "", x).lower() for x in WORD.findall(t)) if w]

    def grams(t):
        w = words(t)
        return Counter(zip(w, w[1:]))

    want = set()
    for i, t in rows:
        t = t or ""
        pieces = set(t.split("\n")) | set(re.split(r"\n[ \t]*\n", t))
        for s in pieces:
            g = grams(s)
            for k, (_, template) in enumerate(licenses.TEMPLATES):
                h = grams(template)
                if g and 2 * sum((g & h).values()) / (sum(g.values()) + sum(h.values())) >= 0.85:
                    want.add((i, k))
    got = {(r.doc_id, m.template) for r in licenses.scan(df).collect() for m in r.license_matches}
    assert got == want and (7, 1) in got and (2, 0) in got
    assert licenses.scan(docs).count() == len(ROWS)


@pytest.mark.parametrize("text,name", [("MIT License", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("Mozilla Public License Version 2.0", "MPL-2.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "AGPL-3.0"), ("This code is licensed under the BSD 3-Clause License and so on", "BSD-3-Clause")])
def test_license_titles(spark, text, name):
    df = spark.createDataFrame([(1, f"some words before\n{text}\nand behind")], "doc_id long, text string")
    found = licenses.scan(df, licenses.library(), anywhere=True).first().license_matches
    assert name in {m.license for m in found}


def test_license_texts_from_a_table(spark, nothing):
    whole = "Own Licence.\n\nYou may do this.\n\n" + " ".join(f"clause {i} says {i * i}" for i in range(200))
    table = spark.createDataFrame([("Own", whole), (None, "x"), ("Y", None)], "license string, text string")
    own = licenses.read_templates(table)
    df = spark.createDataFrame([(1, "intro\n" + whole.replace("clause 7 ", "term 7 ") + "\nend"), (2, whole[:200])], "doc_id long, text string")
    got = {r.doc_id: [m.license for m in r.license_matches] for r in licenses.scan(df, own, anywhere=True).collect()}
    assert got == {1: ["Own"], 2: []}
    assert licenses.scan(nothing, licenses.library(), anywhere=True).count() == 0
    with pytest.raises(ValueError):
        licenses.read_templates(table.unionByName(table), most=1)


def test_licenses_inside_and_across_lines(spark, tmp_path):
    apache = licenses.TEMPLATES[1][1]
    texts = {
        1: ("This project is licensed under the MIT License.", "MIT"),
        2: ("Copyright 2020 Foo. Licensed under the MIT License.", "MIT"),
        3: (apache.replace(" You may", "\n\nYou may").replace(" Unless", "\n\n Unless").replace(" See", "\n\nSee"), "Apache-2.0"),
        4: ("Released under\nthe MIT License. And then a long line of prose goes on about other things\nwithout end", "MIT"),
        5: ("the license of all of the rights under which this work is not reserved", ""),
        6: ("All rights reserved. Some words. All rights reserved.", "Proprietary"),
        7: ("# " + licenses.TEMPLATES[4][1].replace(" ", "\n# ", 40), "MIT"),
        8: (None, ""),
    }
    spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in licenses.query(spark, str(tmp_path)).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: want for i, (_, want) in texts.items()}
    assert got[6].n_matches == 2 and got[3].best_dice == 1.0


def test_fixity(spark):
    pages = [(i, f"http://a/{i % 7}", f"<p>{i}</p>" * (i % 5)) for i in range(300)] + [(None, "u", None), (5, None, "x"), (9, "http://a/2", "dup"), (9, "http://a/2", "dup")]
    schema = "page_id long, url string, html string"
    a = spark.createDataFrame(pages, schema)
    kw = {"segment_ids": 64, "splits": 2}
    assert fixity.audit(fixity.lay_out(a, **kw), fixity.lay_out(a.repartition(7), **kw)).count() == 0
    changed = [(p, u, "!" if p == 17 else h) for p, u, h in pages if p != 200] + [(999, "new", "n")]
    got = fixity.audit(fixity.lay_out(a, **kw), fixity.lay_out(spark.createDataFrame(changed, schema), **kw)).collect()
    assert sorted((r.record_id, r.status) for r in got) == [(17, "damaged"), (200, "missing"), (999, "extra")]
    leaf = next(r for r in fixity.lay_out(a, **kw).collect() if r.record_id == 17)
    raw = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:17>\r\nWARC-Target-URI: http://a/3\r\nContent-Length: 18\r\n\r\n<p>17</p><p>17</p>\r\n\r\n"
    assert (leaf.length, leaf.digest) == (len(raw), hashlib.sha256(raw.encode()).hexdigest())
    # the lost and the added record change their own ranges and none behind them
    levels = [{(r.segment, r.node): r.digest for r in fixity.build_tree(fixity.lay_out(x, **kw), 1)[0].collect()} for x in (a, spark.createDataFrame(changed, schema))]
    assert len(levels[0]) > 15 and sum(levels[0].get(k) != levels[1].get(k) for k in {*levels[0], *levels[1]}) == 3
    clash = a.withColumn("digest", fixity.F.lit("x")).withColumn("segment", fixity.F.lit(1)).withColumn("range", fixity.F.lit(2))
    assert fixity.audit(fixity.lay_out(clash, **kw), fixity.lay_out(a, **kw)).count() == 0
    many = spark.createDataFrame([(None, f"u{i}", "x" * 200_000 * (i == 3)) for i in range(50)], schema)
    assert len({r.segment for r in fixity.lay_out(many).collect()}) > 20
    none = spark.createDataFrame([], schema)
    assert fixity.audit(fixity.lay_out(none), fixity.lay_out(none)).count() == 0
    assert fixity.audit(fixity.lay_out(none), fixity.lay_out(a)).count() == len(pages)


def test_language_id_on_held_out_texts(spark, docs, nothing):
    rng = random.Random(8)
    parts = {"aa": "ba ko mi tu na".split(), "bb": "schtz ung lich ver en".split(), "cc": "ção ñor ía que el".split()}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(k, rng.randrange(5, 60)), k) for i in range(240) for k in [list(parts)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !!! 456", "bb"), (903, "日本語の文章です" * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, langid._crc_mod("doc_id", 4) != 2)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [(i, k) for i, _, k in rows[:240] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and sum(got[i].lang_pred == k for i, k in held) == len(held)
    assert not any(got[i].lang_rejected for i, _, _ in rows[:240])
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].lang_score, got[i].lang_rejected) == ("und", 0.0, True)
    assert got[903].lang_rejected
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert langid.identify(nothing, model).count() == 0
    unknown = langid.learn(nothing, langid.F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, unknown).collect()} == {"und"}


def test_language_id_learns_from_all_texts(spark):
    """Four million characters of a language, each text with a letter of its own: the model knows them all."""
    own = [chr(0x4E00 + i) for i in range(40)]
    rows = [(i, f"{c} " + "ba ko mi tu " * 8400, "aa") for i, c in enumerate(own)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), langid.F.lit(True))
    sym, _ = langid.symbols(np.array([0, 3 * len(own)]), np.frombuffer("".join(own).encode(), np.uint8))
    assert np.isin(langid.gram_hashes(sym[1:-1], 1)[0], model.keys[0]).all()


@pytest.mark.parametrize("order", [1, 2, 4])
def test_gram_counts_by_dictionaries(monkeypatch, order):
    """Counts of all orders against plain ones, with a table so small that most n-grams are merged by sorting."""
    monkeypatch.setattr(langid._Tally, "SLOTS", 4)
    monkeypatch.setattr(langid._Tally, "PENDING", 50)
    rng = random.Random(3)
    texts = [("".join(rng.choice("abcdeé ") for _ in range(rng.randrange(0, 90))), rng.choice("xyz")) for _ in range(200)]
    langs, want = ["x", "y"], Counter()
    for t, k in texts:
        s = " " + " ".join(t.split()) + " " * t.endswith(" ")
        s = " " + s.lstrip() if s.strip() else " "
        if k in langs:
            want.update((langs.index(k), n, s[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(max(n - 1, 1), len(s)))
    code = lambda g: int(langid.gram_hashes(np.array([ord(c) if c != " " else langid.BOUNDARY for c in g], np.uint32), len(g))[-1][-1])
    batches = [langid.pa.RecordBatch.from_arrays([langid.pa.array([t for t, _ in texts[i : i + 20]]), langid.pa.array([k for _, k in texts[i : i + 20]])], names=["t", "l"]) for i in range(0, 200, 20)]
    got, links = Counter(), {}
    for b in langid._counts(iter(batches), langs, order):
        for lang, n, gram, context, lower, count in zip(*(c.to_pylist() for c in b.columns)):
            got[lang, n, gram % 2**64] += count
            links[n, gram % 2**64] = context % 2**64, lower % 2**64
    assert got == {(k, n, code(g)): c for (k, n, g), c in want.items()}
    assert all(links[n, code(g)] == ((code(g[:-1]), code(g[1:])) if n > 1 else (0, 0)) for _, n, g in want)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_by_dictionaries(spark, order):
    """Interpolated Kneser-Ney from plain counts of strings, against cross-entropies of the sorted arrays."""
    texts = {"x": ["abracadabra abba", "cab bad dab", "a"], "y": ["über öde bäder", "bad dab öd"]}
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)], "doc_id long, text string, lang string")
    model = langid.learn(df, langid.F.lit(True), order=order)
    scorer = langid.Scorer(model)
    D = langid.DISCOUNT
    alphabet = len({c for ts in texts.values() for t in ts for c in t}) + langid.UNSEEN_SYMBOLS

    def weights(lang):
        raw = [Counter() for _ in range(order + 1)]
        for t in texts[lang]:
            s = " " + t  # a boundary first
            for n in range(1, order + 1):
                raw[n].update(s[i - n + 1 : i + 1] for i in range(max(n - 1, 1), len(s)))
        out = [Counter() for _ in range(order + 1)]
        out[order] = raw[order]
        for n in range(1, order):
            before = Counter(g[1:] for g in raw[n + 1])
            out[n] = Counter({g: max(1, before[g]) for g in raw[n]})
        return out

    def probability(w, gram):
        n = len(gram)
        if n == 1:
            total, kinds = sum(w[1].values()), len(w[1])
            return max(w[1][gram] - D, 0) / total + D * kinds / total / alphabet
        with_context = {g: c for g, c in w[n].items() if g[:-1] == gram[:-1]}
        total = sum(with_context.values())
        lower = probability(w, gram[1:])
        return max(w[n][gram] - D, 0) / total + D * len(with_context) / total * lower if total else lower

    for text in ("abba", "bad über", "zebra dab", "ö", "cab dab bad abracadabra"):
        s, data = " " + text, np.frombuffer(text.encode(), np.uint8)
        h, letters = scorer.entropy(np.array([0, len(data)]), data)
        assert letters[0] == sum(c != " " for c in text)
        for k, lang in enumerate(model.langs):
            w = weights(lang)
            want = -sum(np.log(probability(w, s[max(0, i - order + 1) : i + 1])) for i in range(1, len(s))) / len(text)
            assert h[0, k] == pytest.approx(want, rel=1e-4), (text, lang)


def test_kneser_ney_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, "abracadabra abba", "x"), (2, "cab bad dab", "x")], "doc_id long, text string, lang string")
    m = langid.learn(df, langid.F.lit(True), order=3)
    scorer = langid.Scorer(m)
    alphabet = sorted(set("abracadabrabbacabbaddab"))
    total = 0.0
    for c in [*alphabet, " "]:
        text = ("ab" + c + "x").encode() if c == " " else ("ab" + c).encode()
        offs, data = np.array([0, len(text)]), np.frombuffer(text, np.uint8)
        sym, begin = langid.symbols(offs, data)
        short = np.frombuffer(b"ab", np.uint8)
        h3, _ = scorer.entropy(np.array([0, 3]), np.frombuffer(("ab" + c).encode(), np.uint8)) if c != " " else (None, None)
        if c == " ":
            h3, _ = scorer.entropy(np.array([0, 4]), np.frombuffer(b"ab a", np.uint8))
            ha, _ = scorer.entropy(np.array([0, 3]), np.frombuffer(b"ab ", np.uint8))
            h3 = ha
        h2, _ = scorer.entropy(np.array([0, 2]), short)
        total += float(np.exp(-(h3[0, 0] * 3 - h2[0, 0] * 2)))
    unseen = langid.UNSEEN_SYMBOLS / (len(m.keys[0]) + langid.UNSEEN_SYMBOLS)
    assert 0.9 < total < 1.0 + 1e-6 and total + unseen > 0.99


def small_network(rows=40):
    net = toxicity.Network.fresh(np.zeros(rows, np.float32), np.ones(rows, bool))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    word, net = rng.integers(0, 20, 60), small_network()
    inputs = rng.standard_normal((20, toxicity.WIDTH))
    start, size, weight = np.array([0, 10, 30]), np.array([5, 9, 2]), np.array([1.0, -0.5, 2.0])
    _, kept = net.forward(inputs, word, start, size, keep=True)
    g = net.backward(kept, weight)
    which, d_x = g.pop("x")
    g["x"] = np.zeros_like(inputs)
    np.add.at(g["x"], which, d_x)
    params = {**{k: v for k, v in net.p.items() if k != "emb"}, "x": inputs}
    for name, x in params.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in x.shape)
            old = x[at]
            x[at] = old + 1e-3
            up = net.forward(inputs, word, start, size) @ weight
            x[at] = old - 1e-3
            down = net.forward(inputs, word, start, size) @ weight
            x[at] = old
            assert (up - down) / 2e-3 == pytest.approx(g[name][at], abs=1e-4), name


def test_toxicity_forward_word_by_word():
    """Each window by itself, a word at a time, from the equations of the network."""
    rng = np.random.default_rng(1)
    word, net = rng.integers(0, 20, 60), small_network()
    inputs, H = rng.standard_normal((20, toxicity.WIDTH)), toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    p, start, size = net.p, np.array([0, 7, 50]), np.array([6, 12, 1])
    for k, got in enumerate(net.forward(inputs, word, start, size)):
        xs, states = inputs[word[start[k] : start[k] + size[k]]], []
        for way in (0, 1):
            h, run = np.zeros(H), []
            for x in xs[::-1] if way else xs:
                gate, a = x @ p["wx"][way] + p["b"][way, 0], h @ p["u"][way]
                z, r = sig(gate[:H] + a[:H]), sig(gate[H : 2 * H] + a[H : 2 * H])
                h = z * h + (1 - z) * np.tanh(gate[2 * H :] + r * a[2 * H :])
                run.append(h)
            states.append(run[::-1] if way else run)
        both = np.concatenate(states, 1)
        score = np.tanh(both @ p["wa"] + p["ba"]) @ p["va"]
        share = np.exp(score) / np.exp(score).sum()
        assert got == pytest.approx(share @ both @ p["wo"] + p["bo"][0], rel=1e-5, abs=1e-6)


def _raw(texts):
    parts = [t.encode() for t in texts]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.frombuffer(b"".join(parts), np.uint8)


def test_toxicity_features_are_words_and_their_parts(monkeypatch):
    raw = "Ab, abc ab! \u00fcber".encode()
    offsets, data = np.array([0, len(raw), len(raw)]), np.frombuffer(raw, np.uint8)
    b = toxicity.features(offsets, data)
    assert b.first.tolist() == [0, 4, 4] and b.word[0] == b.word[2] and len(set(b.word.tolist())) == 3
    sizes = sorted(np.diff(b.begin).tolist())
    grams = lambda n: 1 + sum(max(0, n + 2 - g + 1) for g in toxicity.GRAMS)
    assert sizes == sorted([grams(2), grams(3), grams(5)])
    emb = np.random.default_rng(2).standard_normal((toxicity.ROWS, 3)).astype(np.float32)
    for w in range(3):
        rows = b.rows[b.begin[w] : b.begin[w + 1]]
        assert b.sums(emb)[w] == pytest.approx(emb[rows[0]] + emb[rows[1:]].sum(0) / np.sqrt(max(len(rows) - 1, 1)), abs=1e-5)
    assert toxicity.spread_words(offsets, data, 100) == [raw, b""]
    import pyarrow as pa

    texts = [prose(random.Random(i), 50) for i in range(9)] + ["", "one"]
    monkeypatch.setattr(tk, "BLOCK_BYTES", 1)
    monkeypatch.setattr(tk.blocks, "__defaults__", (700,))
    whole, parts = toxicity.features(*_raw(texts)), toxicity.gathered(pa.array(texts))
    assert parts.first.tolist() == whole.first.tolist() and len(parts.hashes) == len(set(parts.hashes.tolist())) == len(whole.hashes)
    assert (parts.hashes[parts.word] == whole.hashes[whole.word]).all()
    assert parts.sums(emb)[parts.word] == pytest.approx(whole.sums(emb)[whole.word], abs=1e-5)
    long = ("w " * 1000).encode()
    (part,) = toxicity.spread_words(np.array([0, len(long)]), np.frombuffer(long, np.uint8), 96)
    assert len(part.split()) == 96


def test_toxicity_windows_cover_every_word():
    first = np.array([0, 0, 5, 37, 37 + 33, 37 + 33 + 500])
    start, size, text = toxicity.windows(first)
    for i in range(len(first) - 1):
        words = {w for s, n, t in zip(start, size, text) if t == i for w in range(s, s + n)}
        assert words == set(range(first[i], first[i + 1]))


def test_toxicity_on_held_out_texts(spark, docs):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, rng.randrange(5, 120)).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vilescum", "vilemoron", "Vilefool!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "***")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, toxicity string")
    lab = spark.createDataFrame([*labels, (0, None), (4, 0)], "doc_id long, toxic int")
    net = toxicity.learn(df, lab, toxicity.F.crc32(toxicity.F.col("doc_id").cast("string")) % 3 != 1)
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, net).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == bool(y) for i, y in held)
    assert right / len(held) > 0.95
    assert got[900] == got[901] == got[902] == 0.0
    assert toxicity.learn(df, lab.filter("toxic = 0"), toxicity.F.lit(True)) is None
    assert {r.toxicity for r in toxicity.score(docs, None).collect()} == {0.0}


def test_long_text_spans_blocks():
    import pyarrow as pa

    texts = ["a b", "x " * 400_000, None, "", "c"]
    seen = [(lo, hi) for lo, hi, _, _ in tk.blocks(pa.array(texts), 1000)]
    assert seen[0][0] == 0 and seen[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))
    assert sum(len(tk.Words(o, d).starts) for _, _, o, d in tk.blocks(pa.array(texts), 1000)) == 400_003
