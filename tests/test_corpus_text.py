import pytest

from millrace.model import CorruptStore, MillraceError, StaleScope
from millrace.operators import corpus, text
from millrace.sources import formats, store


def docs(spark, rows):
    return spark.createDataFrame(rows, "record_id string, texts array<string>")


def active(c):
    return sorted((r.chunk_id, r.record_id, r.chunk_key, r.text, r.version) for r in c.active().collect())


def test_lifecycle(spark):
    c = corpus.Corpus.empty(spark).upsert_documents(docs(spark, [("a", ["x", "y"]), ("b", ["z"])]))
    assert active(c) == [(0, "a", "ordinal-0", "x", 1), (1, "a", "ordinal-1", "y", 1), (2, "b", "ordinal-0", "z", 1)]
    scope = c.scope(spark.createDataFrame([(0,), (77,)], "chunk_id long"))
    assert scope.within(c).count() == 1
    c2 = c.upsert_documents(docs(spark, [("a", ["new"])]))
    assert active(c2) == [(2, "b", "ordinal-0", "z", 1), (3, "a", "ordinal-0", "new", 2)]
    with pytest.raises(StaleScope):
        scope.within(c2)
    c3, n = c2.delete(spark.createDataFrame([("b",), ("zz",)], "record_id string"))
    assert n == 1 and c3.delete(spark.createDataFrame([("b",)], "record_id string"))[1] == 0
    c4, dead = c3.compact()
    assert dead == 3 and active(c4) == [(3, "a", "ordinal-0", "new", 2)] and c4.compact()[1] == 0
    c5 = c4.upsert_documents(docs(spark, [("a", [])]))
    assert active(c5) == [] and c5.records.count() == 1
    c6 = c5.upsert_documents(docs(spark, [("q", ["w"])]))
    assert active(c6)[0][0] == 4  # ids are never used again


def test_repeated_keys_are_refused(spark):
    r = spark.createDataFrame([("a", "T", None)], "record_id string, record_type string, content string")
    k = spark.createDataFrame([("a", "k", "x"), ("a", "k", "y")], "record_id string, chunk_key string, text string")
    with pytest.raises(MillraceError):
        corpus.Corpus.empty(spark).upsert(r, k)


def test_lookup_keeps_order_repeats_and_gaps(spark):
    c = corpus.Corpus.empty(spark).upsert_documents(docs(spark, [("a", ["x"]), ("b", ["y"])]))
    ids = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 9)], "pos long, chunk_id long")
    assert [r.text for r in c.lookup(ids).collect()] == ["y", "x", "y", None]


@pytest.mark.parametrize("size,overlap,sentences", [(10, 0, False), (10, 3, False), (25, 5, True), (7, 2, True), (1, 0, False)])
def test_chunks_are_slices_and_cover(size, overlap, sentences):
    t = "Één zin. Another one!  And a third? yes\n\nend。 done 中文。 x" * 3
    raw, got = t.encode(), text.chunk_text(t, size, overlap, sentences)
    covered = set()
    for k, (ordinal, part, a, b) in enumerate(got):
        assert ordinal == k and raw[a:b].decode() == part and part == part.strip() and 0 < len(part) <= size
        covered |= set(range(a, b))
    assert all(i in covered for i, c in enumerate(raw) if not chr(c).isspace())
    assert text.chunk_text("  \n ", 5) == [] == text.chunk_text(None, 5)


def test_sentences_end_chunks():
    assert [c[1] for c in text.chunk_text("One two. Three four. Five", 14, 0, True)] == ["One two.", "Three four.", "Five"]
    with pytest.raises(MillraceError):
        text.chunk_text("a", 3, 3)


def test_seeds(spark):
    q = spark.createDataFrame([(1, "Who wrote ÉMILE Zola's book?"), (2, "nothing"), (3, "rome or paris")], "question_id long, text string")
    a = spark.createDataFrame([("émile", "n1"), ("émile zola's", "n2"), ("rome", "n3"), ("paris", "n4"), ("pari", "n5")], "alias string, node string")
    got = {r.question_id: (r.status, r.seed) for r in text.resolve_seeds(q, a).collect()}
    assert got[1] == ("resolved", "n2") and got[2] == ("no_match", None) and got[3] == ("resolved", "n4")
    assert text.alias_spans("the rome of romes", ["rome"]) == [("rome", 4, 8)]


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, '<a href="/A%20b&amp;c">x</a><a href="/A%20b&amp;c">')], "page_id long, html string")
    assert [r.alias for r in text.link_aliases(df).collect()] == ["/a b&c"]
    wp = text.WordPiece(["[UNK]", "un", "##able", "able", "!"])
    assert wp.pieces("Unáble able! zzz") == ["un", "##able", "able", "!", "[UNK]"] and wp.count("able") == 3
    assert text.within_tokens("a b c d", 2, lambda t: len(t.split())) == ["a b", " c d"] or all(len(x.split()) <= 2 for x in text.within_tokens("a b c d", 2, lambda t: len(t.split())))
    assert formats.canonical_json({"b": 1.0, "a": [1.5, "é"]}) == '{"a":[1.5,"é"],"b":1}'
    with pytest.raises(MillraceError):
        formats.canonical_json([float("inf")])


def test_store_round_trip_and_corruption(spark, tmp_path):
    folder = str(tmp_path / "s")
    t = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert store.save(spark, folder, {"t": t})["version"] == 1
    assert store.save(spark, folder, {"t": t, "u": t.limit(1)}, {"generation": 3})["version"] == 2
    tables, body = store.load(spark, folder)
    assert sorted(map(tuple, tables["t"].collect())) == [(1, "a"), (2, None)] and body["meta"] == {"generation": 3}
    assert store.clean(spark, folder) == ["v1"] and store.size_report(spark, folder)["t"] > 0
    spark.createDataFrame([(1, "a"), (2, "z")], "id long, text string").write.mode("overwrite").parquet(f"{folder}/v2/t")
    with pytest.raises(CorruptStore):
        store.validate(spark, folder)
    with pytest.raises(CorruptStore):
        store.load(spark, str(tmp_path / "none"))


def test_formats(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "body"}\n{"_id": "d2", "title": "", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "?"}\n')
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td9\t1\n")
    c = formats.read_collection(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in c["corpus"].collect()} == {"d1": "T\n\nbody", "d2": "x"}
    assert [tuple(r) for r in formats.broken_references(c["qrels"], c["corpus"], c["queries"]).collect()] == [("q1", "d9", "unknown document")]
    runs = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 2)], "query_id string, doc_id string, rank long")
    assert sorted(r.value for r in formats.run_lines(runs, 10, "me").collect()) == ["q1 Q0 d1 1 10 me", "q1 Q0 d2 2 9 me"]
    assert formats.synthetic_chunks(spark, 3).first().text == "note 0 on subject0 by team0, see entry0"


def test_portable_seeds_keep_lengths(spark):
    q = spark.createDataFrame([(1, "Er\u00dfie und enlich."), (2, None)], "question_id long, text string")
    a = spark.createDataFrame([("er\u00dfie", "n1"), ("enlich", "n2")], "alias string, node string")
    assert {r.question_id: (r.status, r.seed) for r in text.resolve_seeds(q, a, portable=True).collect()} == {1: ("resolved", "n2"), 2: ("no_match", None)}
    folded = a.replace("er\u00dfie", "erssie", "alias")
    assert {r.question_id: r.status for r in text.resolve_seeds(q, folded).collect()} == {1: "ambiguous", 2: "no_match"}
