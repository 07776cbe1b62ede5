"""Readers and writers of retrieval collections: JSON lines, judgements, runs."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import MillraceError

QRELS4 = "query_id string, iteration string, doc_id string, grade int"
QRELS3 = "query_id string, doc_id string, grade int"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a closed schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def canonical_json(value) -> str:
    """Sorted keys, no blanks, integral floats as integers; non-finite numbers are an error."""

    def norm(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise MillraceError("a number is not finite")
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {k: norm(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [norm(v) for v in x]
        return x

    return json.dumps(norm(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def read_qrels(spark: SparkSession, path: str, sep: str = "\t", header: bool = False, fields: int = 4) -> DataFrame:
    df = spark.read.schema(QRELS4 if fields == 4 else QRELS3).option("sep", sep).option("header", header).option("mode", "FAILFAST").csv(path)
    return df.select("query_id", "doc_id", "grade")


def run_lines(runs: DataFrame, depth: int, tag: str) -> DataFrame:
    """Lines "query Q0 doc rank score tag"; the score is the depth less the place, which keeps the order in tools that sort by score."""
    score = F.lit(depth) - F.col("rank") + 1
    return runs.filter(F.col("rank") <= depth).select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), score.cast("string"), F.lit(tag)).alias("value"))


def qrels_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("grade").cast("string")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def read_collection(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """corpus.jsonl (_id, title, text), queries.jsonl (_id, text) and qrels.tsv with a header; title and text are joined by a blank line."""
    corpus = read_jsonl(spark, f"{folder}/corpus.jsonl", "_id string, title string, text string")
    title = F.coalesce("title", F.lit(""))
    return {
        "corpus": corpus.select(F.col("_id").alias("doc_id"), F.when(title != "", F.concat_ws("\n\n", title, F.col("text"))).otherwise(F.col("text")).alias("text")),
        "queries": read_jsonl(spark, f"{folder}/queries.jsonl", "_id string, text string").select(F.col("_id").alias("query_id"), "text"),
        "qrels": read_qrels(spark, f"{folder}/qrels.tsv", header=True, fields=3),
    }


def broken_references(qrels: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Judgements whose document or query is unknown, or that repeat."""
    a = qrels.join(corpus.select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id", F.lit("unknown document").alias("fault"))
    b = qrels.join(queries.select("query_id"), "query_id", "left_anti").select("query_id", "doc_id", F.lit("unknown query").alias("fault"))
    c = qrels.groupBy("query_id", "doc_id").count().filter("count > 1").select("query_id", "doc_id", F.lit("repeated").alias("fault"))
    return a.unionByName(b).unionByName(c)


def synthetic_chunks(spark: SparkSession, n: int, topics: int = 13, teams: int = 89, fields: int = 8) -> DataFrame:
    """A deterministic corpus: chunk_id, a text of common, shared and single words, and a filter field."""
    i = F.col("id")
    return spark.range(n).select(i.alias("chunk_id"), F.format_string("note %d on subject%d by team%d, see entry%d", i, i % topics, i % teams, i).alias("text"), (i % fields).alias("field"))


def synthetic_vectors(spark: SparkSession, n: int, width: int, seed: int = 1) -> DataFrame:
    """Deterministic unit vectors from the hash of (seed, row, place)."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(1 << 20)).cast("double") / float(1 << 19) - 1.0)
    norm = F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x))
    return spark.range(n).select("id", raw.alias("r")).select(F.col("id").alias("chunk_id"), F.transform("r", lambda x: (x / norm).cast("float")).alias("embedding"))


#: Steps to the records that a record refers to, and the step that every fifth record lacks.
LINK_STEPS, LAST_STEP = (1, 7, 13, 13), 3


def linked_records(spark: SparkSession, n: int) -> DataFrame:
    """record_id, refs: a deterministic graph workload in which every record refers to four or five others, one of them twice."""
    i = F.col("id")
    step = lambda k: ((i + k) % n).cast("string")
    refs = F.concat(F.array(*[step(k) for k in LINK_STEPS]), F.when(i % 5 != 0, F.array(step(LAST_STEP))).otherwise(F.array().cast("array<string>")))
    return spark.range(n).select(i.cast("string").alias("record_id"), refs.alias("refs"))


#: Columns of a question table.
QUESTION_COLUMNS = ("answer", "context", "id", "level", "question", "supporting_facts", "type")


def read_questions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Multi-hop questions in Parquet: queries (query_id, text, answer, kind, level), facts (query_id, title, sentence) and contexts (query_id, title, place, text).

    Columns other than the seven known ones, or fewer, are an error, and so are ids that repeat.
    """
    df = spark.read.parquet(path)
    if set(df.columns) != set(QUESTION_COLUMNS):
        raise MillraceError(f"question columns are {sorted(df.columns)}")
    twice = df.groupBy("id").count().filter("count > 1 OR id IS NULL").limit(1).collect()
    if twice:
        raise MillraceError(f"question id {twice[0][0]} comes twice")
    pairs = lambda c, a, b: F.explode(F.arrays_zip(F.col(f"{c}.{a}"), F.col(f"{c}.{b}")))
    return {
        "queries": df.select(F.col("id").alias("query_id"), F.col("question").alias("text"), "answer", F.col("type").alias("kind"), "level"),
        "facts": df.select(F.col("id").alias("query_id"), pairs("supporting_facts", "title", "sent_id").alias("f")).select("query_id", F.col("f.title").alias("title"), F.col("f.sent_id").cast("int").alias("sentence")),
        "contexts": df.select(F.col("id").alias("query_id"), pairs("context", "title", "sentences").alias("c")).select("query_id", F.col("c.title").alias("title"), F.posexplode("c.sentences").alias("place", "text")),
    }


#: Fields of an abstract.
ABSTRACT = "id string, url string, title string, text array<string>, text_with_links array<string>, charoffset string, charoffset_with_links string"


def read_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """page_id, title, url, sentences, linked from JSON lines, also compressed ones; ids that are no decimal numbers and sentence lists of different lengths are errors."""
    df = read_jsonl(spark, path, ABSTRACT)
    whole = F.col("id").rlike("^[0-9]+$") & F.col("title").isNotNull() & F.col("url").isNotNull() & (F.size("text") == F.size("text_with_links")) & ~F.exists("text", lambda s: s.isNull()) & ~F.exists("text_with_links", lambda s: s.isNull())
    bad = df.filter(~F.coalesce(whole, F.lit(False))).select("id").limit(1).collect()
    if bad:
        raise MillraceError(f"abstract {bad[0][0]} breaks the format")
    return df.select(F.col("id").cast("long").alias("page_id"), "title", "url", F.col("text").alias("sentences"), F.col("text_with_links").alias("linked"))


def flatten_scenes(media: DataFrame, body: str = "body") -> DataFrame:
    """document_id, media_name, kind, scene_number, shot_number, field, text: one row for every description of a scene or section of a shot.

    body is JSON text: metadata.media_name, scenes and shots as objects by id. A
    description that is an object or list is kept as its JSON; blank ones are left
    out. A shot has the number of the scene that lists it under `shots`.
    """
    name = F.coalesce(F.get_json_object(body, "$.metadata.media_name"), F.lit("unknown"))
    v = lambda path: F.try_variant_get(F.parse_json(body), path, "map<string, variant>")
    text = lambda c: F.trim(F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).when(F.schema_of_variant(c).startswith("OBJECT") | F.schema_of_variant(c).startswith("ARRAY"), F.to_json(c)))
    scenes = media.select(name.alias("media_name"), F.explode(v("$.scenes")).alias("scene_id", "s"))
    fields = scenes.select("media_name", "scene_id", F.try_variant_get("s", "$.scene_number", "int").alias("scene_number"), F.try_variant_get("s", "$.shots", "array<string>").alias("shots"), F.explode(F.try_variant_get("s", "$.descriptions", "map<string, variant>")).alias("field", "value"))
    a = fields.select(F.concat_ws(":", F.lit("scene"), "scene_id", "field").alias("document_id"), "media_name", F.lit("scene").alias("kind"), "scene_number", F.lit(None).cast("int").alias("shot_number"), "field", text(F.col("value")).alias("text"))
    member = scenes.select("media_name", F.try_variant_get("s", "$.scene_number", "int").alias("scene_number"), F.explode(F.try_variant_get("s", "$.shots", "array<string>")).alias("shot_id")).groupBy("media_name", "shot_id").agg(F.min("scene_number").alias("scene_number"))
    shots = media.select(name.alias("media_name"), F.explode(v("$.shots")).alias("shot_id", "s"))
    parts = shots.select("media_name", "shot_id", F.try_variant_get("s", "$.structure.shot_number", "int").alias("shot_number"), F.explode(F.try_variant_get("s", "$.sections", "map<string, variant>")).alias("field", "value"))
    b = parts.join(member, ["media_name", "shot_id"], "left").select(F.concat_ws(":", F.lit("shot"), "shot_id", "field").alias("document_id"), "media_name", F.lit("shot").alias("kind"), "scene_number", "shot_number", "field", text(F.col("value")).alias("text"))
    return a.unionByName(b).filter(F.length("text") > 0)


#: Tables of a closed collection and their schemas.
COLLECTION = {
    "records": "record_id string, record_type string, content string, fields string",
    "queries": "query_id string, text string, tasks array<string>",
    "qrels": "query_id string, doc_id string, grade int",
    "evidence": "query_id string, evidence_sets array<array<string>>",
    "expected_paths": "query_id string, seed_policy string, expected_paths array<array<string>>",
    "exclusions": "query_id string, reason string",
    "corpus_embeddings": "record_id string, embedding array<float>",
    "query_embeddings": "query_id string, embedding array<float>",
}


def read_closed_collection(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a collection as JSON lines, each under its closed schema: lines that do not parse or hold another field are errors, and so is a collection with faults."""
    out = {}
    for name, schema in COLLECTION.items():
        path = f"{folder}/{name}.jsonl"
        known = {f.name for f in spark.createDataFrame([], schema).schema}
        keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("k")).distinct().limit(1000)
        strange = [r[0] for r in keys.collect() if r[0] not in known]
        if strange:
            raise MillraceError(f"{name} has the unknown field {min(strange)}")
        out[name] = read_jsonl(spark, path, schema)
    faults = collection_faults(out).orderBy("rule", "key").limit(1).collect()
    if faults:
        raise MillraceError(f"{faults[0]['rule']}: {faults[0]['key']}")
    return out


def collection_faults(t: dict[str, DataFrame]) -> DataFrame:
    """rule, key of everything that breaks a rule of a closed collection; empty for a valid one."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("key")
    found = []

    def rule(name: str, df: DataFrame, column: str) -> None:
        found.append(df.select(F.lit(name).alias("rule"), key(column)))

    def unique(table: str, *cols: str) -> None:
        twice = t[table].groupBy(*cols).count().filter("count > 1")
        rule(f"{table} repeat", twice, cols[0])

    def known(table: DataFrame, column: str, to: str, there: str, name: str) -> None:
        rule(name, table.join(t[to].select(F.col(there).alias(column)).distinct(), column, "left_anti"), column)

    unique("records", "record_id")
    unique("queries", "query_id")
    unique("qrels", "query_id", "doc_id")
    unique("evidence", "query_id")
    unique("expected_paths", "query_id", "seed_policy")
    unique("exclusions", "query_id")
    rule("record ids have 1 to 512 bytes", t["records"].filter("record_id IS NULL OR octet_length(record_id) NOT BETWEEN 1 AND 512"), "record_id")
    rule("record types are names", t["records"].filter(~F.coalesce(F.col("record_type").rlike("^[A-Za-z_][A-Za-z0-9_]{0,63}$"), F.lit(False))), "record_id")
    rule("queries have text", t["queries"].filter("text IS NULL OR trim(text) = ''"), "query_id")
    rule("tasks are known", t["queries"].filter(F.exists(F.coalesce("tasks", F.array().cast("array<string>")), lambda x: ~F.coalesce(x.isin("retrieval", "evidence", "path"), F.lit(False)))), "query_id")
    rule("grades are not negative", t["qrels"].filter("grade IS NULL OR grade < 0"), "query_id")
    for name in ("qrels", "evidence", "expected_paths", "exclusions", "query_embeddings"):
        known(t[name], "query_id", "queries", "query_id", f"{name} of an unknown query")
    known(t["qrels"], "doc_id", "records", "record_id", "qrels of an unknown record")
    sets = t["evidence"].select("query_id", F.explode_outer("evidence_sets").alias("s"))
    rule("evidence sets hold records", sets.filter("s IS NULL OR size(s) = 0"), "query_id")
    rule("evidence sets name a record once", sets.filter("size(s) <> size(array_distinct(s))"), "query_id")
    known(sets.select(F.explode("s").alias("record")), "record", "records", "record_id", "evidence of an unknown record")
    asks = lambda task: t["queries"].filter(F.array_contains("tasks", task))
    out = t["exclusions"].select("query_id")
    for task, name in (("evidence", "evidence"), ("path", "expected_paths")):
        rule(f"{name} are missing", asks(task).join(t[name].select("query_id"), "query_id", "left_anti").join(out, "query_id", "left_anti"), "query_id")
    for name, to, column in (("corpus_embeddings", "records", "record_id"), ("query_embeddings", "queries", "query_id")):
        unique(name, column)
        rule(f"{name} are missing", t[to].join(t[name].select(column), column, "left_anti"), column)
        rule(f"{name} are unit vectors", t[name].filter(F.coalesce(F.abs(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) - 1.0) > 1e-3, F.lit(True))), column)
    known(t["corpus_embeddings"], "record_id", "records", "record_id", "embedding of an unknown record")
    width = t["corpus_embeddings"].select(F.size("embedding").alias("w")).unionByName(t["query_embeddings"].select(F.size("embedding").alias("w"))).distinct()
    found.append(width.agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("embeddings differ in length").alias("rule"), F.col("n").cast("string").alias("key")))
    all_of = found[0]
    for f in found[1:]:
        all_of = all_of.unionByName(f)
    return all_of
