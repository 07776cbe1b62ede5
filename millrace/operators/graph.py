"""Typed graphs: built from reference fields of records, walked by bounded traversals.

nodes: node (string key), node_type, record_id. edges: edge_index, relationship,
src, dst, occurrence, inverse. Edge order is (relationship, src, dst,
occurrence). A node key is "type:record" or "type:record/chunk".
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.model import GraphSchema, InvalidQuery, MillraceError, SchemaError, TraversalLimits, TraversalStep, UnknownNode
from millrace.session import cut, numbered


def node_key(node_type: Column, record: Column, chunk: Column | None = None) -> Column:
    base = F.concat(node_type, F.lit(":"), record.cast("string"))
    return base if chunk is None else F.concat(base, F.lit("/"), chunk.cast("string"))


def _by_type(schema: GraphSchema) -> Column:
    """Node type of a record's type; null where the schema has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in schema.nodes.items() for x in pair]), F.col("record_type"))


def build_nodes(records: DataFrame, schema: GraphSchema, chunks: DataFrame | None = None) -> DataFrame:
    """One node per record by its type, and one per chunk if the schema has a chunk type; unmapped types are an error."""
    schema.check()
    unknown = records.agg(F.min(F.when(_by_type(schema).isNull(), F.coalesce("record_type", F.lit("null"))))).first()[0]
    if unknown is not None:
        raise SchemaError(f"record type {unknown!r} has no node type")
    kind = _by_type(schema)
    nodes = records.select(node_key(kind, F.col("record_id")).alias("node"), kind.alias("node_type"), F.col("record_id").cast("string").alias("record_id"))
    if schema.chunk_type and chunks is not None:
        own = F.lit(schema.chunk_type)
        nodes = nodes.unionByName(chunks.select(node_key(own, F.col("record_id"), F.col("chunk_key")).alias("node"), own.alias("node_type"), F.col("record_id").cast("string").alias("record_id")))
    return nodes.distinct()


def _listed(records: DataFrame, schema: GraphSchema, ids_of) -> DataFrame:
    """relationship, source_record, ids, fault (what is wrong with the field, or null) of every record and relationship of its type."""
    kind = _by_type(schema)
    each = [F.when(kind == r.source_type, F.struct(F.lit(r.name).alias("relationship"), *ids_of(r))) for r in schema.relationships]
    rows = records.select(F.col("record_id").cast("string").alias("source_record"), F.explode(F.array_compact(F.array(*each))).alias("r"))
    return rows.select("source_record", "r.*")


def _checked(listed: DataFrame) -> DataFrame:
    """One row a reference; the first fault of all relationships is an error, found in one pass."""
    bad = listed.filter("fault IS NOT NULL").agg(F.min(F.struct("relationship", "source_record", "fault"))).first()[0]
    if bad:
        raise SchemaError(f"{bad['relationship']}: record {bad['source_record']} {bad['fault']}")
    return listed.select("relationship", "source_record", F.posexplode("ids").alias("occurrence", "target_record"))


def references(records: DataFrame, schema: GraphSchema) -> DataFrame:
    """relationship, source_record, target_record, occurrence of every reference; records hold `refs`: map from field path to list of ids.

    A missing list is empty, which only `one` does not allow.
    """

    def ids_of(r):
        ids = F.element_at("refs", F.lit("/".join(r.field)))
        size = F.coalesce(F.size(ids), F.lit(0))
        wrong = {"one": size != 1, "optional": size > 1, "many": F.lit(False)}[r.cardinality]
        return ids.alias("ids"), F.when(wrong, f"does not fit cardinality {r.cardinality}").alias("fault")

    return _checked(_listed(records, schema, ids_of))


def field_references(records: DataFrame, schema: GraphSchema, fields: str = "fields") -> DataFrame:
    """As references, read from records' fields as JSON text along nested paths.

    `one` and `optional` take a string, `many` a list of strings; a field that is
    missing or null is an error for `one` and no reference otherwise; anything
    else, as an object on the way that is none, is as if missing or an error by
    its type.
    """

    def ids_of(r):
        path = "$" + "".join(f"['{step}']" for step in r.field)
        value = F.try_variant_get(F.col("_v"), path, "variant")
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        text, none = F.try_variant_get(F.col("_v"), path, "string"), kind == "VOID"
        if r.cardinality == "many":
            fits = none | kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
            ids = F.when(kind == "ARRAY<STRING>", F.try_variant_get(F.col("_v"), path, "array<string>"))
            fault = F.when(~fits | F.exists(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isNull()) | (kind == "ARRAY<VOID>") & (F.size(F.try_variant_get(F.col("_v"), path, "array<variant>")) > 0), "needs a list of ids")
        else:
            ids = F.when(kind == "STRING", F.array(text))
            fault = F.when(~none & (kind != "STRING"), "does not match its cardinality")
            if r.cardinality == "one":
                fault = F.coalesce(fault, F.when(none, "lacks its one reference"))
        return ids.alias("ids"), fault.alias("fault")

    return _checked(_listed(records.withColumn("_v", F.parse_json(F.coalesce(fields, F.lit("{}")))), schema, ids_of))


def build_edges(records: DataFrame, refs: DataFrame, schema: GraphSchema, chunks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges in order, and diagnostics (relationship, source_record, target_record, reason) of references left out.

    All relationships go through one aggregation, one join and one check; what
    differs between them comes from a small table of their policies.
    """
    rules = F.broadcast(
        records.sparkSession.createDataFrame(
            [(r.name, r.source_type, r.target_type, r.missing, r.duplicates, r.self_edges or r.source_type != r.target_type, r.inverse) for r in schema.relationships],
            "relationship string, source_type string, target_type string, missing string, duplicates string, self_edges boolean, inverse_name string",
        )
    )
    kinds = records.select(F.col("record_id").cast("string").alias("target_record"), _by_type(schema).alias("found_type"))
    once = refs.groupBy("relationship", "source_record", "target_record").agg(F.min("occurrence").cast("long").alias("occurrence"), F.count("*").alias("times"))
    joined = once.join(kinds, "target_record", "left").join(rules, "relationship")
    fault = (
        F.when((F.col("times") > 1) & (F.col("duplicates") == "error"), "refers more than once")
        .when(F.col("found_type") != F.col("target_type"), "wrong type")
        .when(F.col("found_type").isNull() & (F.col("missing") == "error"), "missing target")
        .when(~F.col("self_edges") & (F.col("source_record") == F.col("target_record")), "self edge")
    )
    joined = cut(joined.withColumn("fault", fault))
    bad = joined.filter("fault IS NOT NULL").agg(F.min(F.struct("relationship", "source_record", "target_record", "fault"))).first()[0]
    if bad:
        raise SchemaError(f"{bad['relationship']}: {bad['fault']} {bad['source_record']} -> {bad['target_record']}")
    notes = joined.filter("found_type IS NULL").select("relationship", "source_record", "target_record", F.lit("missing target").alias("reason"))
    src, dst = node_key(F.col("source_type"), F.col("source_record")), node_key(F.col("target_type"), F.col("target_record"))
    kept = joined.filter("found_type IS NOT NULL").select("relationship", "inverse_name", src.alias("src"), dst.alias("dst"), "occurrence")
    if schema.chunk_type and schema.owns and chunks is not None:
        kind = records.select("record_id", _by_type(schema).alias("kind"))
        place = F.row_number().over(Window.partitionBy("record_id").orderBy("chunk_key")) - 1
        owned = chunks.select("record_id", "chunk_key", place.cast("long").alias("occurrence")).join(kind, "record_id")
        a, b = node_key(F.col("kind"), F.col("record_id")), node_key(F.lit(schema.chunk_type), F.col("record_id"), F.col("chunk_key"))
        kept = kept.unionByName(owned.select(F.lit(schema.owns).alias("relationship"), F.lit(schema.owned_by).cast("string").alias("inverse_name"), a.alias("src"), b.alias("dst"), "occurrence"))
    edge = lambda name, x, y, inverse: F.struct(F.col(name).alias("relationship"), F.col(x).alias("src"), F.col(y).alias("dst"), F.col("occurrence"), F.lit(inverse).alias("inverse"))
    both = kept.select(F.explode(F.array_compact(F.array(edge("relationship", "src", "dst", False), F.when(F.col("inverse_name").isNotNull(), edge("inverse_name", "dst", "src", True))))).alias("e"))
    return with_index(both.select("e.*")), notes


def with_index(edges: DataFrame) -> DataFrame:
    """edge_index in the order (relationship, src, dst, occurrence), by ranges of that order and so without one task for all."""
    return numbered(edges, ["relationship", "src", "dst", "occurrence"], 0, "edge_index")


def validate(nodes: DataFrame, edges: DataFrame, schema: GraphSchema) -> list[str]:
    """Broken rules of a stored graph: nodes are distinct and of known types, edges are numbered from 0 in order, of known relationships, between nodes."""
    types = [*schema.nodes.values(), *([schema.chunk_type] if schema.chunk_type else [])]
    names = [n for r in schema.relationships for n in (r.name, r.inverse) if n] + [n for n in (schema.owns, schema.owned_by) if n]
    broken = []
    a = nodes.agg(F.count("*"), F.countDistinct("node"), F.count(F.when(~F.col("node_type").isin(types), 1))).first()
    b = edges.agg(F.count("*"), F.countDistinct("edge_index"), F.min("edge_index"), F.max("edge_index"), F.count(F.when(~F.col("relationship").isin(names), 1))).first()
    if a[0] != a[1]:
        broken.append("nodes repeat")
    if a[2]:
        broken.append("a node has an unknown type")
    if b[0] and (b[1] != b[0] or b[2] != 0 or b[3] != b[0] - 1):
        broken.append("edges are not numbered from 0 on")
    if b[4]:
        broken.append("an edge has an unknown relationship")
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    if not ends.join(nodes, "node", "left_anti").isEmpty():
        broken.append("an edge ends at no node")
    key = F.struct("relationship", "src", "dst", "occurrence")
    if numbered(edges.select(key.alias("k"), "edge_index"), ["k"], 0, "_n").filter("_n <> edge_index").limit(1).count():
        broken.append("edges are out of order")
    return broken


def build_stats(records: DataFrame, nodes: DataFrame, edges: DataFrame, notes: DataFrame) -> dict[str, int]:
    return {name: df.count() for name, df in (("records", records), ("nodes", nodes), ("edges", edges), ("diagnostics", notes))}


def layout(edges: DataFrame) -> DataFrame:
    """direction, relationship, node, neighbours and edge indexes in order: what leaves and what enters every node.

    A node's row grows with its links, as an adjacency list does; walks join the
    edge table, whose hubs can be split.
    """
    ways = [edges.select(F.lit(way).alias("direction"), "relationship", F.col(a).alias("node"), F.col(b).alias("next"), "edge_index") for way, a, b in (("outgoing", "src", "dst"), ("incoming", "dst", "src"))]
    lists = ways[0].unionByName(ways[1]).groupBy("direction", "relationship", "node").agg(F.array_sort(F.collect_list(F.struct("edge_index", "next"))).alias("_l"))
    return lists.select("direction", "relationship", "node", F.col("_l.next").alias("neighbours"), F.col("_l.edge_index").alias("edges"))


def property_index(values: DataFrame) -> DataFrame:
    """node_type, path, kind, value, node from rows with a scalar; nulls are skipped."""
    return values.filter("value IS NOT NULL").select("node_type", "path", "kind", "value", "node").distinct()


def seeds_by_property(index: DataFrame, schema: GraphSchema, node_type: str, path: tuple[str, ...], values: list) -> DataFrame:
    """Nodes whose declared field equals any of the values, each once."""
    if tuple(path) not in {tuple(p) for p in schema.queryable.get(node_type, [])}:
        raise InvalidQuery(f"{'/'.join(path)} of {node_type} is not declared queryable")
    wanted = [(type(v).__name__, str(v)) for v in values]
    test = F.lit(False)
    for kind, v in wanted:
        test = test | ((F.col("kind") == kind) & (F.col("value") == v))
    return index.filter((F.col("node_type") == node_type) & (F.col("path") == "/".join(path)) & test).select("node").distinct()


def seeds_by_id(nodes: DataFrame, ids: list[str]) -> DataFrame:
    found = nodes.filter(F.col("node").isin(*ids)).select("node").distinct()
    lost = set(ids) - {r[0] for r in found.collect()}
    if lost:
        raise UnknownNode(sorted(lost)[0])
    return found


#: Bytes that the limit counts for a queued state and for each edge of its path.
STATE_BYTES, PATH_EDGE_BYTES = 48, 4
#: Frontier rows up to which a generation is broadcast to the edges.
FRONTIER_ROWS = 200_000
STATE = ["query_id", "node", "step", "hops"]


def traverse(edges: DataFrame, seeds: DataFrame, steps: list[TraversalStep], limits: TraversalLimits = TraversalLimits()) -> DataFrame:
    """query_id, node, depth, path (edge indexes): where each query's walk from its seeds ends."""
    return walk(edges, seeds, steps, limits)[0]


def walk(edges: DataFrame, seeds: DataFrame, steps: list[TraversalStep], limits: TraversalLimits = TraversalLimits(), timeout: float | None = None, cancelled=None) -> tuple[DataFrame, DataFrame]:
    """Results as of traverse, and a report: query_id, seed_count, visited_states, traversed_edges, result_count, max_depth, truncated.

    seeds: query_id, node. A state is (node, step, hops in the step); of the
    ways to reach one, the first in first-in-first-out order counts, over all
    seeds of a query. All queries advance together, one generation of the queue
    a round; a state's place is its parent's place and then: passing on without
    a hop, edges by index, and for each edge advancing before staying.

    A query stops where a limit does: at the result that fills max_results, or
    at the state that does not fit max_visited or max_bytes; states behind it in
    the queue count no more; a limit of None stops nothing. truncated names the limit (max_results only if the
    queue still held states; max_hops if a walk could have gone on) or is null.
    A walk beyond `timeout` seconds, or after `cancelled()` says so, ends with an
    error between two generations.
    """
    limits.check(steps)
    limits = limits.numbers()
    began = time.monotonic()
    last = len(steps)
    ways = sorted({(s.relationship, s.direction) for s in steps})
    moves = None
    for name, direction in ways:
        a, b = ("src", "dst") if direction == "outgoing" else ("dst", "src")
        part = edges.filter(F.col("relationship") == name).select(F.lit(f"{direction} {name}").alias("way"), F.col(a).alias("node"), F.col(b).alias("next"), F.col("edge_index").alias("edge"))
        moves = part if moves is None else moves.unionByName(part)
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in [*values, values[-1]]]), F.col("step") + 1)
    way, lo, hi = of([f"{s.direction} {s.relationship}" for s in steps], "string"), of([s.min_hops for s in steps], "int"), of([s.max_hops for s in steps], "int")

    first = seeds.select("query_id", "node").distinct().select("query_id", "node", F.lit(0).alias("step"), F.lit(0).alias("hops"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path"), F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("edge"), F.lit(0).alias("turn"))
    frontier = _placed(first, ["query_id", "node"])
    status = frontier.groupBy("query_id").agg(F.count("*").alias("seed_count")).select("query_id", "seed_count", *[F.lit(0).cast("long").alias(c) for c in ("visited", "bytes", "edges", "results")], F.lit(0).alias("max_depth"), F.lit(False).alias("stopped"), F.lit(None).cast("string").alias("truncated"))
    status = cut(status)
    status, frontier = _enqueued(status, frontier, limits)
    visited, results = None, None
    while not frontier.isEmpty():
        if cancelled is not None and cancelled():
            raise MillraceError("the traversal was cancelled")
        if timeout is not None and time.monotonic() - began > timeout:
            raise MillraceError(f"the traversal took more than {timeout} seconds")
        states = frontier.select(*STATE)
        visited = states if visited is None else visited.unionByName(states)
        here = frontier.filter(F.col("step") < last)
        can = (F.col("hops") < hi) & (F.col("depth") < limits.max_hops)
        here = here.select("*", way.alias("way"), lo.alias("lo"), hi.alias("hi"))
        passing = here.filter((F.col("hops") == 0) & (F.col("lo") == 0)).select("query_id", "node", (F.col("step") + 1).alias("step"), F.lit(0).alias("hops"), "depth", "path", F.col("place").alias("parent"), F.lit(-1).cast("long").alias("edge"), F.lit(0).alias("turn"))
        going = here.filter(can).drop("edge")
        met = going.join(moves.withColumnRenamed("node", "at"), (going["node"] == F.col("at")) & (going["way"] == moves["way"]))
        if going.count() <= FRONTIER_ROWS:
            met = F.broadcast(going).join(moves.withColumnRenamed("node", "at"), (going["node"] == F.col("at")) & (going["way"] == moves["way"]))
        child = lambda step, hops, turn: F.struct(step.alias("step"), hops.alias("hops"), F.lit(turn).alias("turn"))
        kinds = F.array_compact(F.array(F.when(F.col("hops") + 1 >= F.col("lo"), child(F.col("step") + 1, F.lit(0), 0)), F.when(F.col("hops") + 1 < F.col("hi"), child(F.col("step"), F.col("hops") + 1, 1))))
        grown = met.select("query_id", F.col("next").alias("node"), F.explode(kinds).alias("k"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("edge")).alias("path"), F.col("place").alias("parent"), "edge")
        born = grown.select("query_id", "node", "k.step", "k.hops", "depth", "path", "parent", "edge", "k.turn").unionByName(passing)
        fresh = born.groupBy(*STATE).agg(F.min(F.struct("parent", "edge", "turn", "depth", "path")).alias("b")).select(*STATE, "b.*").join(visited, STATE, "left_anti")
        fresh = _placed(fresh, ["query_id", "parent", "edge", "turn"])
        done = frontier.filter(F.col("step") == last)
        status, frontier, kept = _advanced(status, frontier, done, fresh, met, hi, last, limits)
        results = kept if results is None else results.unionByName(kept)
    if results is None:
        results = frontier.select("query_id", "node", "depth", "path").limit(0)
    report = status.select("query_id", "seed_count", F.col("visited").alias("visited_states"), F.col("edges").alias("traversed_edges"), F.col("results").alias("result_count"), "max_depth", "truncated")
    return results, report


def _placed(states: DataFrame, order: list[str]) -> DataFrame:
    """states with `place`, which grows in the given order, and the range that each fell into; cut from their lineage."""
    ranged = states.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()))


def _running(states: DataFrame) -> DataFrame:
    """states with how many, and how many bytes, their query has up to and with each: counted by ranges, then within them."""
    size = F.lit(STATE_BYTES) + PATH_EDGE_BYTES * F.size("path")
    per = states.groupBy("query_id", "range").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    earlier = Window.partitionBy("query_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("query_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("_b"))
    within = Window.partitionBy("query_id", "range").orderBy("place")
    return states.join(before, ["query_id", "range"]).withColumn("nth", F.col("_n") + F.row_number().over(within)).withColumn("used", F.col("_b") + F.sum(size).over(within)).drop("_n", "_b")


def _enqueued(status: DataFrame, states: DataFrame, limits: TraversalLimits) -> tuple[DataFrame, DataFrame]:
    """status after queueing the first generation, and what of it fits."""
    size = F.lit(STATE_BYTES) + PATH_EDGE_BYTES * F.size("path")
    most = states.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    over = (F.col("n") > limits.max_visited) | (F.col("b") > limits.max_bytes)
    if not most.filter(over).isEmpty():
        ranked = _running(states)
        states = cut(ranked.filter((F.col("nth") <= limits.max_visited) & (F.col("used") <= limits.max_bytes)).drop("nth", "used"))
        why = F.when(F.col("n") > limits.max_visited, F.when(F.lit(limits.max_visited * STATE_BYTES <= limits.max_bytes), "max_visited").otherwise("max_bytes")).otherwise("max_bytes")
        marks = most.filter(over).select("query_id", why.alias("why"))
        status = status.join(marks, "query_id", "left").withColumn("truncated", F.coalesce("why", "truncated")).drop("why")
    now = states.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    status = status.join(now, "query_id", "left")
    status = status.withColumn("visited", F.coalesce("n", F.lit(0))).withColumn("bytes", F.coalesce("b", F.lit(0)).cast("long")).drop("n", "b")
    return cut(status), states


def _advanced(status, frontier, done, fresh, met, hi, last, limits):
    """status, frontier and results after one generation: what is behind the place where a query stops does not count."""
    size = F.lit(STATE_BYTES) + PATH_EDGE_BYTES * F.size("path")
    could = (F.col("step") < last) & (F.col("hops") < hi) & (F.col("depth") >= limits.max_hops)
    now = status.filter("NOT stopped")
    for part in (
        fresh.groupBy("query_id").agg(F.count("*").alias("n_new"), F.sum(size).alias("b_new")),
        done.groupBy("query_id").agg(F.count("*").alias("n_done")),
    ):
        now = now.join(part, "query_id", "left")
    now = now.fillna(0, ["n_new", "b_new", "n_done"])
    full = F.col("results") + F.col("n_done") >= limits.max_results
    over = (F.col("visited") + F.col("n_new") > limits.max_visited) | (F.col("bytes") + F.col("b_new") > limits.max_bytes)
    now = cut(now.withColumn("full", full).withColumn("over", over))
    marks = now.filter("full OR over")
    edge_rows = met.select("query_id", F.col("place").alias("parent"), "edge")
    if not marks.isEmpty():
        # places where queries stop: the result that fills the limit, and the state that fits no more
        ends = _running(done.join(F.broadcast(marks.filter("full").select("query_id", "results")), "query_id"))
        ends = ends.filter(F.col("results") + F.col("nth") == limits.max_results).select("query_id", F.col("place").alias("end"))
        tight = _running(fresh.join(F.broadcast(marks.filter("over").select("query_id", "visited", "bytes")), "query_id"))
        crowd, heavy = F.col("visited") + F.col("nth") > limits.max_visited, F.col("bytes") + F.col("used") > limits.max_bytes
        fails = tight.filter(crowd | heavy).groupBy("query_id").agg(F.min(F.struct("place", "parent", "edge", F.when(crowd, "max_visited").otherwise("max_bytes").alias("why"))).alias("fail"))
        stop = marks.select("query_id").join(ends, "query_id", "left").join(fails, "query_id", "left")
        by_result = F.col("end").isNotNull() & (F.col("fail").isNull() | (F.col("end") < F.col("fail.parent")))
        stop = cut(stop.select("query_id", by_result.alias("by_result"), F.when(by_result, F.col("end")).otherwise(F.col("fail.parent") - 1).alias("end"), F.when(~by_result, F.col("fail.place")).alias("fail"), F.when(~by_result, F.col("fail.parent")).alias("fail_parent"), F.when(~by_result, F.col("fail.edge")).alias("fail_edge"), F.when(~by_result, F.col("fail.why")).alias("why")))
        marked = F.broadcast(stop)
        popped = frontier.join(marked, "query_id", "left")
        rest = popped.filter(F.col("by_result") & (F.col("place") > F.col("end"))).select("query_id")
        queued = fresh.join(marked, "query_id", "left").filter(F.col("end").isNull() | F.when(F.col("by_result"), F.col("parent") < F.col("end")).otherwise(F.col("place") < F.col("fail")))
        waiting = rest.unionByName(queued.filter("by_result").select("query_id")).distinct().withColumn("waiting", F.lit(True))
        done = popped.filter((F.col("step") == last) & (F.col("end").isNull() | (F.col("place") <= F.col("end")))).select(*frontier.columns)
        frontier_popped = popped.filter(F.col("end").isNull() | (F.col("place") <= F.col("end")))
        edge_rows = edge_rows.join(marked, "query_id", "left").filter(F.col("end").isNull() | (F.col("parent") <= F.col("end")) | ((F.col("parent") == F.col("fail_parent")) & (F.col("edge") <= F.col("fail_edge"))))
        stops = stop.join(waiting, "query_id", "left").select("query_id", F.lit(True).alias("stops"), F.when(F.col("by_result"), F.when(F.col("waiting"), "max_results")).otherwise(F.col("why")).alias("reason"))
        fresh_counted, fresh = queued.select(*fresh.columns), queued.filter("end IS NULL").select(*fresh.columns)
    else:
        frontier_popped, fresh_counted = frontier, fresh
        stops = now.limit(0).select("query_id", F.lit(True).alias("stops"), F.lit("").alias("reason"))
    kept = cut(done.select("query_id", "node", "depth", "path"))
    status = status.join(fresh_counted.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(size).alias("b")), "query_id", "left")
    status = status.join(kept.groupBy("query_id").agg(F.count("*").alias("r"), F.max("depth").alias("d")), "query_id", "left")
    status = status.join(edge_rows.groupBy("query_id").agg(F.count("*").alias("e")), "query_id", "left")
    status = status.join(frontier_popped.filter(could).select("query_id", F.lit("max_hops").alias("hop")).distinct(), "query_id", "left").join(stops, "query_id", "left")
    add = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).cast("long").alias(c)
    status = status.select("query_id", "seed_count", add("visited", "n"), add("bytes", "b"), add("edges", "e"), add("results", "r"), F.greatest("max_depth", F.coalesce("d", F.lit(0))).alias("max_depth"), (F.col("stopped") | F.coalesce("stops", F.lit(False))).alias("stopped"), F.coalesce("reason", "hop", "truncated").alias("truncated"))
    return cut(status), fresh, kept


def path_edges(results: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, node, depth, steps: the edges of each path in order, with what they came from: relationship, src, dst, occurrence, inverse."""
    places = results.select("query_id", "node", "depth", F.posexplode_outer("path").alias("_i", "edge_index"))
    named = places.join(edges.select("edge_index", F.struct("relationship", "src", "dst", "occurrence", "inverse").alias("_e")), "edge_index", "left")
    listed = named.groupBy("query_id", "node", "depth").agg(F.array_sort(F.collect_list(F.when(F.col("_e").isNotNull(), F.struct("_i", "_e")))).alias("_l"))
    return listed.select("query_id", "node", "depth", F.transform("_l", lambda x: x["_e"]).alias("steps"))


def trace(report: DataFrame) -> DataFrame:
    """Seeds, results and greatest depth of every query, from a walk's report."""
    return report.select("query_id", "seed_count", "result_count", "max_depth")


def project(results: DataFrame, owned: DataFrame) -> DataFrame:
    """query_id, chunk_id: the chunks of all nodes a traversal reached; owned is (node, chunk_id)."""
    return results.select("query_id", "node").distinct().join(owned, "node").select("query_id", "chunk_id").distinct()
