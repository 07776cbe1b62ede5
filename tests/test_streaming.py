from millrace.streaming import changes


def test_batches_apply_once_and_last_change_wins(spark, tmp_path):
    schema = "record_id string, seq long, op string, texts array<string>"
    src, folder = str(tmp_path / "in"), str(tmp_path / "corpus")

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)

    def run():
        stream = spark.readStream.schema(schema).json(src)
        q = changes.upsert_stream(stream, folder, str(tmp_path / "ck"))
        q.awaitTermination(120)
        corpus, batch = changes.load(spark, folder)
        return sorted((r.record_id, r.text, r.version) for r in corpus.active().collect()), batch

    put([("a", 1, "upsert", ["x"]), ("b", 2, "upsert", ["y"]), ("a", 3, "upsert", ["x2"])])
    assert run() == ([("a", "x2", 1), ("b", "y", 1)], 0)
    put([("b", 4, "delete", None), ("a", 5, "upsert", ["x3", "x4"])])
    assert run() == ([("a", "x3", 2), ("a", "x4", 2)], 1)
    assert run()[1] == 1
