"""Databases in the shape callers know: build, search, save, load.

Thin objects over the operators. Every search takes one query or a DataFrame
of queries, and returns a DataFrame of hits with text and metadata joined on
last, so that ranking moves ids and scores only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import filters
from millrace.model import METADATA, CorruptStore, DimensionMismatch, GraphSchema, HybridWeights, InvalidQuery, MillraceError, TraversalLimits, TraversalStep, check_bytes, check_name, metadata_map
from millrace.operators import graph, hybrid, keyword, vectors
from millrace.operators.corpus import Corpus, Scope
from millrace.session import cut
from millrace.sources import store

CHUNKS = T.StructType(
    [
        T.StructField("record_id", T.StringType(), False),
        T.StructField("chunk_key", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", METADATA),
    ]
)


@dataclass(frozen=True)
class Index:
    """Records with embedded chunks. Changes give a new Index; the old one stays as it was."""

    spark: SparkSession
    dimension: int
    metric: str = "dot"
    encoding: str = "i8"
    tokeniser: str = "unicode"
    corpus: Corpus | None = None
    extra: DataFrame | None = field(default=None)  # chunk_id, embedding, metadata
    coded: DataFrame | None = field(default=None)  # stored vectors of this generation, as vectors.encoded gives them
    words: DataFrame | None = field(default=None)  # stored keyword index of this generation

    def __post_init__(self):
        if self.dimension <= 0:
            raise InvalidQuery("the dimension must be positive")
        if self.metric not in vectors.METRICS or self.encoding not in vectors.ENCODINGS:
            raise InvalidQuery(f"metric {self.metric!r}, encoding {self.encoding!r}")
        if self.corpus is None:
            object.__setattr__(self, "corpus", Corpus.empty(self.spark))
            object.__setattr__(self, "extra", self.spark.createDataFrame([], T.StructType([T.StructField("chunk_id", T.LongType()), CHUNKS["embedding"], CHUNKS["metadata"]])))

    # ---- changes

    def rows(self, record_id: str, chunks: list[tuple[str, str, list[float], dict]], metadata: dict | None = None) -> DataFrame:
        """Chunk rows of one record; chunk metadata goes over record metadata."""
        check_bytes(record_id, 1, 512, "a record id")
        out = []
        for key, text, embedding, own in chunks:
            check_bytes(key, 1, 512, "a chunk key")
            if len(embedding) != self.dimension:
                raise DimensionMismatch(f"{len(embedding)} dimensions, {self.dimension} wanted")
            out.append((record_id, key, text, [float(x) for x in embedding], metadata_map({**(metadata or {}), **own})))
        return self.spark.createDataFrame(out, CHUNKS)

    def upsert(self, chunks: DataFrame, records: DataFrame | None = None, record_type: str = "Document") -> Index:
        """chunks in the CHUNKS schema. records (record_id, record_type, content) may name records without chunks."""
        check_name(record_type, "a record type")
        bad = chunks.filter((F.size("embedding") != self.dimension) | F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        if bad.limit(1).count():
            raise DimensionMismatch(f"every embedding needs {self.dimension} finite numbers")
        if records is None:
            records = chunks.select("record_id").distinct().select("record_id", F.lit(record_type).alias("record_type"), F.lit(None).cast("string").alias("content"))
        before = self.corpus.next_id
        corpus = self.corpus.upsert(records, chunks.select("record_id", "chunk_key", "text"))
        fresh = corpus.chunks.filter(F.col("chunk_id") >= before).select("chunk_id", "record_id", "chunk_key")
        added = fresh.join(chunks, ["record_id", "chunk_key"]).select("chunk_id", "embedding", "metadata")
        return replace(self, corpus=corpus, extra=cut(self.extra.unionByName(added)), coded=None, words=None)

    def add(self, record_id: str, chunks: list[tuple[str, str, list[float], dict]], metadata: dict | None = None) -> Index:
        none = self.spark.createDataFrame([(record_id, "Document", None)], "record_id string, record_type string, content string")
        return self.upsert(self.rows(record_id, chunks, metadata), none)

    def delete(self, *record_ids: str) -> tuple[Index, int]:
        corpus, n = self.corpus.delete(self.spark.createDataFrame([(r,) for r in record_ids], "record_id string"))
        return (self, 0) if corpus is self.corpus else (replace(self, corpus=corpus, coded=None, words=None), n)

    def compact(self) -> tuple[Index, int]:
        corpus, n = self.corpus.compact()
        kept = self.extra.join(corpus.chunks.select("chunk_id"), "chunk_id", "left_semi")
        return (replace(self, corpus=corpus, extra=cut(kept), coded=None, words=None), n) if n else (self, 0)

    def counts(self) -> dict[str, int]:
        r = self.corpus.chunks.agg(F.count("*"), F.coalesce(F.sum((~F.col("deleted")).cast("long")), F.lit(0))).first()
        return {"records": self.corpus.records.count(), "chunks": r[0], "active": r[1], "generation": self.corpus.generation}

    # ---- searches

    def chunks(self) -> DataFrame:
        return self.corpus.active().join(self.extra, "chunk_id")

    def _vector_queries(self, embedding) -> DataFrame:
        if isinstance(embedding, DataFrame):
            return embedding
        if len(embedding) != self.dimension:
            raise DimensionMismatch(f"{len(embedding)} dimensions, {self.dimension} wanted")
        return self.spark.createDataFrame([(0, [float(x) for x in embedding])], "query_id long, embedding array<float>")

    def _text_queries(self, text) -> DataFrame:
        return text if isinstance(text, DataFrame) else self.spark.createDataFrame([(0, text)], "query_id long, text string")

    def _scope(self, scope: Scope | None) -> DataFrame | None:
        return scope.within(self.corpus) if scope is not None else None

    def _hydrated(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.chunks().select("chunk_id", "record_id", "chunk_key", "text", "metadata"), "chunk_id").orderBy("query_id", "rank")

    def ranked_vectors(self, embedding, k: int, where: dict | None, scope: Scope | None) -> DataFrame:
        queries = self._vector_queries(embedding)
        if self.coded is not None:
            return vectors.search(self.coded, queries, k, metric=self.metric, encoding=self.encoding, scope=self._admitted(where, scope), stored=True)
        return vectors.search(self.chunks(), queries, k, metric=self.metric, encoding=self.encoding, where=filters.where(where) if where is not None else None, scope=self._scope(scope))

    def _admitted(self, where: dict | None, scope: Scope | None) -> DataFrame | None:
        """Ids that a filter and a scope let through; none if there is neither."""
        if where is None:
            return self._scope(scope)
        return self.scope(where, scope).chunks

    def ranked_words(self, text, k: int, where: dict | None, scope: Scope | None) -> DataFrame:
        if self.words is not None:
            return keyword.search(None, self._text_queries(text), k, scope=self._admitted(where, scope), tokeniser=self.tokeniser, indexed=self.words)
        return keyword.search(self.chunks(), self._text_queries(text), k, where=filters.where(where) if where is not None else None, scope=self._scope(scope), tokeniser=self.tokeniser)

    def search(self, embedding, k: int = 10, where: dict | None = None, scope: Scope | None = None) -> DataFrame:
        return self._hydrated(self.ranked_vectors(embedding, k, where, scope))

    def keyword_search(self, text, k: int = 10, where: dict | None = None, scope: Scope | None = None) -> DataFrame:
        return self._hydrated(self.ranked_words(text, k, where, scope))

    def hybrid_search(self, text, embedding, k: int = 10, weights: HybridWeights = HybridWeights(), vector_k: int = 50, keyword_k: int = 50, where: dict | None = None, scope: Scope | None = None) -> DataFrame:
        weights.check()
        v = self.ranked_vectors(embedding, vector_k, where, scope) if weights.vector > 0 else None
        w = self.ranked_words(text, keyword_k, where, scope) if weights.keyword > 0 else None
        return self._hydrated(hybrid.fuse(v, w, k, weights))

    def scope(self, where: dict | None = None, within: Scope | None = None) -> Scope:
        """Active chunks that satisfy a filter, inside another scope if one is given."""
        ids = self.chunks().filter(filters.where(where)).select("chunk_id")
        if within is not None:
            ids = ids.join(within.within(self.corpus), "chunk_id", "left_semi")
        return self.corpus.scope(ids)

    def identities(self, scope: Scope) -> DataFrame:
        """(record_id, chunk_key) of a scope in their order."""
        return self.chunks().join(scope.within(self.corpus), "chunk_id", "left_semi").select("record_id", "chunk_key").orderBy("record_id", "chunk_key")

    # ---- storage

    def tables(self, keywords: bool = True) -> tuple[dict[str, DataFrame], dict]:
        """What is stored: records, chunks, embeddings, encoded vectors and, if asked for, the keyword index; and what else to know."""
        active = self.chunks()
        out = {"records": self.corpus.records, "chunks": self.corpus.chunks, "extra": self.extra}
        out["vectors"] = self.coded if self.coded is not None else vectors.encoded(active, metric=self.metric, encoding=self.encoding)
        if keywords:
            out["keywords"] = self.words if self.words is not None else keyword.index(active, tokeniser=self.tokeniser)
        meta = {"dimension": self.dimension, "metric": self.metric, "encoding": self.encoding, "tokeniser": self.tokeniser, "generation": self.corpus.generation, "next_id": self.corpus.next_id}
        return out, meta

    def save(self, folder: str, keywords: bool = True) -> dict:
        """Writes the index; without keywords a later search tokenises the chunks again."""
        return store.save(self.spark, folder, *self.tables(keywords))

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        tables, body = store.load(spark, folder)
        return cls.of(spark, tables, body["meta"])

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame], m: dict) -> Index:
        """The index that stored tables hold, once their rules are checked."""
        if tables["chunks"].groupBy("chunk_id").count().filter("count > 1").limit(1).count():
            raise CorruptStore("chunk ids repeat")
        if not tables["chunks"].filter(~F.col("deleted")).join(tables["vectors"], "chunk_id", "left_anti").isEmpty():
            raise CorruptStore("an active chunk has no vector")
        broken = keyword.validate(tables["keywords"]) if "keywords" in tables else []
        if broken:
            raise CorruptStore(f"keyword index: {broken[0]}")
        corpus = Corpus(tables["records"], tables["chunks"], m["generation"], m["next_id"])
        return cls(spark, m["dimension"], m["metric"], m["encoding"], m["tokeniser"], corpus, tables["extra"], tables["vectors"], tables.get("keywords"))


@dataclass(frozen=True)
class GraphDatabase:
    """An index with a typed graph over its records."""

    index: Index
    schema: GraphSchema
    nodes: DataFrame
    edges: DataFrame
    properties: DataFrame
    diagnostics: DataFrame
    generation: int

    @classmethod
    def build(cls, index: Index, refs: DataFrame, schema: GraphSchema, properties: DataFrame | None = None) -> GraphDatabase:
        """refs: record_id, refs (map from field path to ids). properties: node_type, path, kind, value, node."""
        schema.check()
        records = index.corpus.records.join(refs, "record_id", "left").select("record_type", "record_id", "refs")
        chunks = index.corpus.active().select("record_id", "chunk_key")
        nodes = cut(graph.build_nodes(records, schema, chunks))
        edges, notes = graph.build_edges(records, graph.references(records, schema), schema, chunks)
        if properties is None:
            properties = index.spark.createDataFrame([], "node_type string, path string, kind string, value string, node string")
        return cls(index, schema, nodes, cut(edges), cut(graph.property_index(properties)), notes, index.corpus.generation)

    # ---- storage

    def save(self, folder: str, keywords: bool = True) -> dict:
        """Index and graph under one manifest, so that a reader sees both of one version."""
        tables, meta = self.index.tables(keywords)
        graph_tables = {"nodes": self.nodes, "edges": self.edges, "properties": self.properties, "diagnostics": self.diagnostics}
        graph_meta = {"schema": self.schema.canonical(), "schema_digest": self.schema.digest(), "graph_generation": self.generation}
        return store.save(self.index.spark, folder, {**tables, **graph_tables}, {**meta, **graph_meta})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> GraphDatabase:
        tables, body = store.load(spark, folder)
        m = body["meta"]
        if "schema" not in m:
            raise CorruptStore("the folder holds no graph")
        schema = GraphSchema.parse(m["schema"])
        if schema.digest() != m["schema_digest"]:
            raise CorruptStore("the schema differs from its digest")
        broken = graph.validate(tables["nodes"], tables["edges"], schema)
        if broken:
            raise CorruptStore(f"graph: {broken[0]}")
        return cls(Index.of(spark, tables, m), schema, tables["nodes"], tables["edges"], tables["properties"], tables["diagnostics"], m["graph_generation"])

    @classmethod
    def validate(cls, spark: SparkSession, folder: str) -> dict:
        """Loads the folder as load does and returns its manifest."""
        cls.load(spark, folder)
        return store.manifest(spark, folder)

    def stats(self) -> dict[str, int]:
        return graph.build_stats(self.index.corpus.records, self.nodes, self.edges, self.diagnostics)

    def report(self, steps: list[TraversalStep], seeds: DataFrame, limits: TraversalLimits = TraversalLimits(), **more) -> tuple[DataFrame, DataFrame]:
        """Results and report of a walk from seeds (query_id, node)."""
        return graph.walk(self.edges, seeds, steps, limits, **more)

    def projected(self, results: DataFrame, where: dict | None = None) -> tuple[DataFrame, dict[str, int]]:
        """Identities (record_id, chunk_key) of the chunks of a walk that satisfy a filter, and their numbers before and after it."""
        before, after = self.candidates(results), self.candidates(results, where)
        return self.index.identities(after), {"before": before.chunks.count(), "after": after.chunks.count()}

    def query(self, steps: list[TraversalStep], ids: list[str] | None = None, node_type: str | None = None, path: tuple[str, ...] = (), values: list | None = None, limits: TraversalLimits = TraversalLimits()) -> DataFrame:
        """Walks from seeds, by id or by a declared field, in the order depth, node."""
        limits.check(steps)
        if (ids is None) == (values is None):
            raise InvalidQuery("seeds come by ids or by values")
        seeds = graph.seeds_by_id(self.nodes, ids) if ids is not None else graph.seeds_by_property(self.properties, self.schema, node_type, path, values)
        return graph.traverse(self.edges, seeds.withColumn("query_id", F.lit(0).cast("long")), steps, limits).orderBy("depth", "node")

    def owned(self) -> DataFrame:
        """(node, chunk_id): a record node owns its chunks, a chunk node itself."""
        active = self.index.corpus.active().select(F.col("record_id").alias("r"), "chunk_key", "chunk_id")
        own = self.nodes.join(active, self.nodes["record_id"] == active["r"])
        chunk_node = F.lit(self.schema.chunk_type) == F.col("node_type") if self.schema.chunk_type else F.lit(False)
        mine = F.col("node") == graph.node_key(F.col("node_type"), F.col("r"), F.col("chunk_key"))
        return own.filter(~chunk_node | mine).select("node", "chunk_id")

    def candidates(self, results: DataFrame, where: dict | None = None) -> Scope:
        if self.generation != self.index.corpus.generation:
            raise MillraceError("the graph is older than the corpus")
        ids = graph.project(results, self.owned()).select("chunk_id").distinct()
        scope = self.index.corpus.scope(ids)
        return self.index.scope(where, scope) if where is not None else scope

    def search(self, embedding, results: DataFrame, k: int = 10, where: dict | None = None) -> DataFrame:
        return self.index.search(embedding, k, where, self.candidates(results))

    def keyword_search(self, text, results: DataFrame, k: int = 10, where: dict | None = None) -> DataFrame:
        return self.index.keyword_search(text, k, where, self.candidates(results))

    def hybrid_search(self, text, embedding, results: DataFrame, k: int = 10, weights: HybridWeights = HybridWeights(), where: dict | None = None) -> DataFrame:
        return self.index.hybrid_search(text, embedding, k, weights, where=where, scope=self.candidates(results))


class Pipeline:
    """Texts in, hits out: chunks, embeds through the caller's function, upserts and searches."""

    def __init__(self, index: Index, embedder, size: int = 1000, overlap: int = 100, sentences: bool = True):
        self.index, self.embedder, self.size, self.overlap, self.sentences = index, embedder, size, overlap, sentences

    def add(self, documents: DataFrame) -> Pipeline:
        """documents: record_id, text. Chunk metadata holds the chunk's place and byte offsets."""
        from millrace.operators import text

        made = text.chunks(documents, self.size, self.overlap, self.sentences, "record_id", "text")
        embedded = text.embed(made, self.embedder)
        value = lambda c: F.struct(F.lit("int").alias("t"), F.lit(None).cast("string").alias("s"), F.col(c).cast("long").alias("i"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("boolean").alias("b"))
        meta = F.map_from_arrays(F.array(*map(F.lit, ("chunk_index", "start", "end"))), F.array(value("ordinal"), value("start"), value("end")))
        chunks = cut(embedded.select("record_id", F.concat(F.lit("ordinal-"), F.col("ordinal").cast("string")).alias("chunk_key"), "text", "embedding", meta.alias("metadata")))
        records = documents.select("record_id").distinct().select("record_id", F.lit("Document").alias("record_type"), F.lit(None).cast("string").alias("content"))
        self.index = self.index.upsert(chunks, records)
        return self

    def search(self, text: str, k: int = 10, weights: HybridWeights = HybridWeights(), where: dict | None = None) -> DataFrame:
        return self.index.hybrid_search(text, list(self.embedder([text])[0]), k, weights, where=where)


def best_per_record(hits: DataFrame) -> DataFrame:
    """One hit for each record, its best."""
    w = Window.partitionBy("query_id", "record_id").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
