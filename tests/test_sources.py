import hashlib
import json
import os

import numpy as np
import pytest

from millrace.model import CorruptStore, DimensionMismatch, MillraceError
from millrace.operators import metrics, text, vectors
from millrace.operators.corpus import Corpus
from millrace.plans import evaluation
from millrace.sources import formats, models, store
from millrace.streaming import changes


def docs(spark, *rows):
    return spark.createDataFrame([(r, [t]) for r, t in rows], "record_id string, texts array<string>")


def test_deleting_nothing_changes_nothing(spark):
    c = Corpus.empty(spark).upsert_documents(docs(spark, ("a", "x"), ("b", "y")))
    ids = spark.createDataFrame([("a",)], "record_id string")
    c1, n = c.delete(ids)
    c2, m = c1.delete(ids)
    assert (n, c1.generation, m, c2.generation) == (1, 2, 0, 2)
    empty = c1.upsert(spark.createDataFrame([("z", "Note", None)], "record_id string, record_type string, content string"), docs(spark).selectExpr("record_id", "'' AS chunk_key", "'' AS text").limit(0))
    gone, n = empty.delete(spark.createDataFrame([("z",)], "record_id string"))
    assert n == 0 and gone.generation == empty.generation + 1  # a record without chunks went


def test_raw_chunks_and_buried_ones(spark):
    c = Corpus.empty(spark).upsert_documents(docs(spark, ("a", "x"), ("b", "y")))
    raw = lambda *rows: spark.createDataFrame(rows, "chunk_id long, record_id string, chunk_key string, text string")
    c = c.add_chunks(raw((7, "a", "k", "z")))
    assert (c.generation, c.next_id) == (2, 8)
    for bad in (raw((7, "a", "j", "")), raw((9, "q", "k", "")), raw((9, "a", "k", "")), raw((-1, "a", "j", "")), raw((9, "a", "i", ""), (9, "a", "j", ""))):
        with pytest.raises(MillraceError):
            c.add_chunks(bad)
    c, _ = c.delete(spark.createDataFrame([("a",)], "record_id string"))
    ids = spark.createDataFrame([(0, 7), (1, 1), (2, 7), (3, 99)], "pos long, chunk_id long")
    assert [r.text for r in c.lookup(ids).collect()] == [None, "y", None, None]
    assert [(r.text, r.deleted) for r in c.lookup_any(ids).collect()] == [("z", True), ("y", False), ("z", True), (None, None)]


def test_a_damaged_store_is_no_fresh_start(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    assert changes.load(spark, folder)[1] == -1
    c = Corpus.empty(spark).upsert_documents(docs(spark, ("a", "x")))
    store.save(spark, folder, {"records": c.records, "chunks": c.chunks}, {"generation": c.generation, "next_id": c.next_id, "batch": 4})
    assert changes.load(spark, folder)[1] == 4
    with open(f"{folder}/manifest.json", "w") as f:
        f.write("{broken")
    for x in os.listdir(folder):
        if x.startswith(".manifest"):
            os.remove(f"{folder}/{x}")
    with pytest.raises(CorruptStore):
        changes.load(spark, folder)
    os.remove(f"{folder}/manifest.json")
    with pytest.raises(CorruptStore):
        changes.load(spark, folder)


def test_one_writer_at_a_time(spark, tmp_path):
    folder, df = str(tmp_path / "s"), spark.range(3)
    with store.writer(spark, folder):
        with pytest.raises(MillraceError, match="another"):
            store.save(spark, folder, {"t": df})
    assert store.save(spark, folder, {"t": df})["version"] == 1
    assert store.save(spark, folder, {"t": df})["version"] == 2 and not store.break_lock(spark, folder)
    assert store.load(spark, folder)[1]["version"] == 2 and store.clean(spark, folder) == ["v1"]


def test_dimensions_count_also_for_no_results(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    q = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "query_id long, embedding array<float>")
    for bad in (q([1.0]), q([1.0], [1.0, 2.0])):
        for k in (0, 1):
            with pytest.raises(DimensionMismatch):
                vectors.search(v, bad, k)
    assert vectors.search(v, q([1.0, 2.0]), 0).count() == 0


@pytest.mark.parametrize("metric,encoding", [("dot", "i8"), ("cosine", "i8"), ("cosine", "f32"), ("dot", "bf16")])
def test_stored_vectors_score_as_fresh_ones(spark, metric, encoding):
    v = spark.createDataFrame([(i, [float(i % 7 - 3), i / 9, 1.0]) for i in range(50)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.3, -1.0, 2.0])], "query_id long, embedding array<float>")
    fresh = vectors.search(v, q, 20, metric=metric, encoding=encoding).collect()
    read = vectors.search(vectors.encoded(v, metric=metric, encoding=encoding), q, 20, metric=metric, encoding=encoding, stored=True).collect()
    assert [(r.chunk_id, pytest.approx(r.score, abs=1e-6)) for r in fresh] == [(r.chunk_id, r.score) for r in read]


def test_tie_break_of_candidates(spark):
    row = lambda a, v, w, **m: (a, v, w, *(m.get(k, 0.5) for k in ("complete_evidence", "ndcg", "map", "recall", "mrr")))
    schema = "alpha double, vector_k long, keyword_k long, complete_evidence double, ndcg double, map double, recall double, mrr double"
    best = lambda *rows: evaluation.best_candidate(spark.createDataFrame(rows, schema)).first()[:3]
    assert best(row(0.4, 25, 25, ndcg=0.9), row(0.5, 100, 100, complete_evidence=0.6)) == (0.5, 100, 100)
    assert best(row(0.4, 25, 25, map=0.4), row(0.5, 100, 100)) == (0.5, 100, 100)
    assert best(row(0.4, 25, 100), row(0.7, 50, 50)) == (0.7, 50, 50)
    assert best(row(0.7, 50, 25), row(0.4, 25, 50), row(0.5, 25, 50)) == (0.4, 25, 50)


def sections(t, limit, overlap):
    n = lambda s: len(s) // 4
    if n(t) <= limit:
        return [t]
    mark = "\n\n" if "\n\n" in t else "\n" if "\n" in t else ". "
    parts = t.split(mark)
    if mark == ". ":
        parts = [p + ". " for p in parts[:-1]] + parts[-1:]
    out, held = [], []
    for p in parts:
        if held and sum(map(n, held)) + n(p) > limit:
            out.append(mark.join(held))
            held = held[len(held) - overlap :] if overlap else []
        held.append(p)
    return out + ([mark.join(held)] if held else [])


@pytest.mark.parametrize("limit,overlap", [(8, 1), (8, 0), (5, 2), (100, 1)])
def test_section_chunks(spark, limit, overlap):
    texts = ["", "short", "a b c d e f\n\n\n\ng h i j k l m n o p\n\nq r s t u v w x y z 1 2 3", "line one is here\nline two is longer than one\n\tthree", "First sentence. Second one here. Third. And the very last one of all of them", "x" * 90]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = text.section_chunks(df, limit, overlap).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.ordinal, r.text) for r in got] == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(sections(t, limit, overlap))]


def test_aliases_in_the_text_as_written():
    t = "  Die STRASSE  nach\tSa\u0303o Paulo, strasse!"
    found = text.alias_spans_original(t, ["strasse", "s\u00e3o paulo", "paul"])
    assert [(a, t[lo:hi]) for a, lo, hi in found] == [("strasse", "STRASSE"), ("strasse", "strasse"), ("s\u00e3o paulo", "Sa\u0303o Paulo")]
    assert [t2[lo:hi] for t2 in ["Gro\u00dfe Stra\u00dfe"] for _, lo, hi in text.alias_spans_original(t2, ["strasse"])] == ["Stra\u00dfe"]


def test_long_aliases_are_found(spark):
    name = "the society for the protection of very long names of things"
    q = spark.createDataFrame([(1, f"What is {name}?"), (2, "What is the society?")], "question_id long, text string")
    a = spark.createDataFrame([(name, "n1"), ("society", "n2")], "alias string, node string")
    assert {r.question_id: r.seed for r in text.resolve_seeds(q, a).collect()} == {1: "n1", 2: "n2"}


def test_questions_and_abstracts(spark, tmp_path):
    rows = [("q1", "who?", "me", "bridge", "hard", {"title": ["A", "B"], "sent_id": [0, 2]}, {"title": ["A"], "sentences": [["s1", "s2"]]})]
    schema = "id string, question string, answer string, type string, level string, supporting_facts struct<title: array<string>, sent_id: array<int>>, context struct<title: array<string>, sentences: array<array<string>>>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/q")
    t = formats.read_questions(spark, f"{tmp_path}/q")
    assert [tuple(r) for r in t["facts"].collect()] == [("q1", "A", 0), ("q1", "B", 2)]
    assert [tuple(r) for r in t["contexts"].collect()] == [("q1", "A", 0, "s1"), ("q1", "A", 1, "s2")]
    spark.createDataFrame(rows, schema).drop("level").write.parquet(f"{tmp_path}/bad")
    with pytest.raises(MillraceError):
        formats.read_questions(spark, f"{tmp_path}/bad")
    page = {"id": "12", "url": "u", "title": "T", "text": ["a", "b"], "text_with_links": ["a", "<b>"], "charoffset": [], "charoffset_with_links": []}
    for name, body, good in (("ok", page, True), ("id", {**page, "id": "x1"}, False), ("len", {**page, "text": ["a"]}, False)):
        spark.createDataFrame([(json.dumps(body),)], "value string").write.option("compression", "bzip2").text(f"{tmp_path}/{name}")
        if good:
            assert [(r.page_id, r.sentences) for r in formats.read_abstracts(spark, f"{tmp_path}/{name}").collect()] == [(12, ["a", "b"])]
        else:
            with pytest.raises(MillraceError):
                formats.read_abstracts(spark, f"{tmp_path}/{name}")


def test_scenes(spark):
    body = {"metadata": {"media_name": "film"}, "scenes": {"s1": {"scene_number": 3, "shots": ["h1"], "descriptions": {"plot": " they meet ", "mood": {"a": 1}, "none": ""}}}, "shots": {"h1": {"structure": {"shot_number": 9}, "sections": {"video": "a door"}}, "h2": {"sections": {"video": "a wall"}}}}
    got = {r.document_id: (r.media_name, r.kind, r.scene_number, r.shot_number, r.text) for r in formats.flatten_scenes(spark.createDataFrame([(json.dumps(body),)], "body string")).collect()}
    assert got == {"scene:s1:plot": ("film", "scene", 3, None, "they meet"), "scene:s1:mood": ("film", "scene", 3, None, '{"a":1}'), "shot:h1:video": ("film", "shot", 3, 9, "a door"), "shot:h2:video": ("film", "shot", None, None, "a wall")}


def test_closed_collections(spark, tmp_path):
    rows = {
        "records": [{"record_id": "r1", "record_type": "Page", "content": "c", "fields": "{}"}],
        "queries": [{"query_id": "q1", "text": "t", "tasks": ["retrieval", "path"]}],
        "qrels": [{"query_id": "q1", "doc_id": "r1", "grade": 1}],
        "evidence": [{"query_id": "q1", "evidence_sets": [["r1"]]}],
        "expected_paths": [{"query_id": "q1", "seed_policy": "explicit", "expected_paths": [["e1"]]}],
        "exclusions": [{"query_id": "q1", "reason": "none"}],
        "corpus_embeddings": [{"record_id": "r1", "embedding": [0.6, 0.8]}],
        "query_embeddings": [{"query_id": "q1", "embedding": [1.0, 0.0]}],
    }

    def write(name, **change):
        os.makedirs(f"{tmp_path}/{name}")
        for t, lines in {**rows, **change}.items():
            with open(f"{tmp_path}/{name}/{t}.jsonl", "w") as f:
                f.writelines(json.dumps(x) + "\n" for x in lines)
        return f"{tmp_path}/{name}"

    assert {k: v.count() for k, v in formats.read_closed_collection(spark, write("ok")).items()} == dict.fromkeys(rows, 1)
    bad = {
        "field": {"records": [{**rows["records"][0], "x": 1}]},
        "twice": {"queries": rows["queries"] * 2},
        "unknown": {"evidence": [{"query_id": "q1", "evidence_sets": [["r9"]]}]},
        "empty": {"evidence": [{"query_id": "q1", "evidence_sets": [[]]}]},
        "width": {"query_embeddings": [{"query_id": "q1", "embedding": [1.0]}]},
        "missing": {"expected_paths": [{"query_id": "q1", "seed_policy": "e", "expected_paths": []}], "exclusions": [{"query_id": "q2", "reason": ""}]},
        "unit": {"corpus_embeddings": [{"record_id": "r1", "embedding": [1.0, 1.0]}]},
    }
    for name, change in bad.items():
        with pytest.raises(MillraceError):
            formats.read_closed_collection(spark, write(name, **change))


def test_word_pieces_as_rows_and_pooled_vectors():
    pieces = text.WordPiece(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "red", "fox", "##es"], most=6)
    assert pieces.encode("Red foxes") == ([2, 4, 5, 6, 3, 0], [1, 1, 1, 1, 1, 0])
    assert pieces.encode("red red red red red red", pad=None) == ([2, 4, 4, 4, 4, 3], [1] * 6)
    table = np.random.default_rng(0).standard_normal((7, 4))
    provide = text.encoder(pieces, lambda ids, mask: table[ids])
    (v,) = provide(["red fox"])
    mean = table[[2, 4, 5, 3]].mean(0)
    assert v == pytest.approx(mean / np.linalg.norm(mean)) and provide([]) == []
    assert not text.pooled(np.ones((1, 3, 2)), np.zeros((1, 3))).any()


def test_model_files(tmp_path):
    body = b"weights"
    digest = hashlib.sha256(body).hexdigest()
    folder = str(tmp_path / "m")
    with pytest.raises(MillraceError):
        models.resolve(folder, {"a.bin": digest})
    with pytest.raises(CorruptStore):
        models.resolve(folder, {"a.bin": digest}, fetch=lambda n: b"other")
    path = models.resolve(folder, {"a.bin": digest}, fetch=lambda n: body)["a.bin"]
    assert open(path, "rb").read() == body and models.resolve(folder, {"a.bin": digest}) == {"a.bin": path}
    with open(path, "wb") as f:
        f.write(b"changed")
    with pytest.raises(CorruptStore):
        models.resolve(folder, {"a.bin": digest})
    with pytest.raises(MillraceError):
        models.resolve(folder, {"../a.bin": digest}, fetch=lambda n: body)


def test_small_measures(spark):
    found = spark.createDataFrame([(1, [1, 2]), (2, [3])], "query_id long, path array<long>")
    want = spark.createDataFrame([(1, [9]), (1, [1, 2]), (2, [4]), (3, [1])], "query_id long, path array<long>")
    assert {r.query_id: r.path_accuracy for r in metrics.path_accuracy(found, want).collect()} == {1: 1, 2: 0, 3: 0}
    v = spark.createDataFrame([(float(i),) for i in (5, 1, 4, 2, 3, 6)], "x double")
    assert metrics.index_percentile(v, "x", (50, 95)).first()[:] == (3.0, 5.0)
    assert metrics.nearest_rank(v, "x", (0.5, 0.95)).first()[:] == (3.0, 6.0)
