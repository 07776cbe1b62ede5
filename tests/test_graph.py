import itertools
import random
from collections import deque

import pytest

from millrace.model import GraphSchema, InvalidQuery, MillraceError, Relationship, SchemaError, TraversalLimits, TraversalStep, UnknownNode
from millrace.operators import graph


class Full(Exception):
    pass


def reference_report(edges, seeds, steps, limits=TraversalLimits()):
    """First-in-first-out search over (node, step, hops), first arrival counts; stops where a limit is met. Results, states, edges, reason."""
    queue, seen, out, tally = deque(), set(), {}, {"bytes": 0, "edges": 0, "why": None}

    def put(node, step, hops, path):
        if (node, step, hops) in seen:
            return
        size = 48 + 4 * len(path)
        for full, why in ((len(seen) >= limits.max_visited, "max_visited"), (tally["bytes"] + size > limits.max_bytes, "max_bytes")):
            if full:
                tally["why"] = why
                raise Full
        tally["bytes"] += size
        seen.add((node, step, hops))
        queue.append((node, step, hops, path))

    try:
        for n in sorted(seeds):
            put(n, 0, 0, ())
    except Full:
        pass
    try:
        while queue:
            node, step, hops, path = queue.popleft()
            if step == len(steps):
                out.setdefault(node, path)
                if len(out) >= limits.max_results:
                    if queue:
                        tally["why"] = "max_results"
                    break
                continue
            s = steps[step]
            if s.min_hops == 0 and hops == 0:
                put(node, step + 1, 0, path)
            if hops >= s.max_hops:
                continue
            if len(path) >= limits.max_hops:
                tally["why"] = "max_hops"
                continue
            for i, rel, a, b in edges:
                x, y = (a, b) if s.direction == "outgoing" else (b, a)
                if rel == s.relationship and x == node:
                    tally["edges"] += 1
                    if hops + 1 >= s.min_hops:
                        put(y, step + 1, 0, (*path, i))
                    if hops + 1 < s.max_hops:
                        put(y, step, hops + 1, (*path, i))
    except Full:
        pass
    return out, len(seen), tally["edges"], tally["why"]


def reference_walk(edges, seeds, steps, limits=TraversalLimits()):
    return reference_report(edges, seeds, steps, limits)[0]


def run(spark, edges, seeds, steps, limits=TraversalLimits()):
    e = spark.createDataFrame([(i, r, a, b) for i, r, a, b in edges], "edge_index long, relationship string, src string, dst string")
    s = spark.createDataFrame([(1, n) for n in seeds], "query_id long, node string")
    return {r.node: tuple(r.path) for r in graph.traverse(e, s, steps, limits).collect()}


def test_zero_hops_follow_the_queue_not_the_depth(spark):
    edges = [(0, "p", "A", "X"), (1, "q", "A", "B"), (2, "r", "B", "X")]
    steps = [TraversalStep(r, min_hops=0) for r in "pqr"]
    want = reference_walk(edges, ["A"], steps)
    assert run(spark, edges, ["A"], steps) == want
    assert want["X"] == (1, 2)


@pytest.mark.parametrize("seed", range(4))
def test_random_walks(spark, seed):
    rng = random.Random(seed)
    names = "ABCDEF"
    pairs = sorted({(rng.choice("pq"), rng.choice(names), rng.choice(names)) for _ in range(14)})
    edges = [(i, *p) for i, p in enumerate(pairs)]
    steps = [TraversalStep(rng.choice("pq"), rng.choice(["outgoing", "incoming"]), lo, max(1, lo + rng.randrange(2))) for lo in (rng.randrange(2), rng.randrange(3))]
    limits = TraversalLimits(max_hops=rng.choice([2, 8]))
    assert run(spark, edges, ["A", "C"], steps, limits) == reference_walk(edges, ["A", "C"], steps, limits)


def test_result_limit_follows_the_queue(spark):
    edges = [(i, "p", "A", n) for i, n in enumerate("BCD")]
    assert set(run(spark, edges, ["A"], [TraversalStep("p")], TraversalLimits(max_results=2))) == {"B", "C"}


@pytest.mark.parametrize("seed", range(5))
def test_reports_of_limited_walks(spark, seed):
    rng = random.Random(100 + seed)
    names = "ABCDEFG"
    pairs = sorted({(rng.choice("pq"), rng.choice(names), rng.choice(names)) for _ in range(24)})
    edges = [(i, *p) for i, p in enumerate(pairs)]
    steps = [TraversalStep(rng.choice("pq"), rng.choice(["outgoing", "incoming"]), lo, max(1, lo + 1)) for lo in (rng.randrange(2), 0)]
    limits = [TraversalLimits(max_results=2), TraversalLimits(max_visited=rng.randrange(1, 14)), TraversalLimits(max_bytes=rng.randrange(60, 700)), TraversalLimits(max_hops=1), TraversalLimits(max_results=3, max_visited=9)][seed]
    e = spark.createDataFrame(edges, "edge_index long, relationship string, src string, dst string")
    starts = {1: ["A", "C"], 2: ["B"], 3: list(names)}
    s = spark.createDataFrame([(q, n) for q, ns in starts.items() for n in ns], "query_id long, node string")
    results, report = graph.walk(e, s, steps, limits)
    found, told = results.collect(), {r.query_id: r for r in report.collect()}
    for q, ns in starts.items():
        out, states, walked, why = reference_report(edges, ns, steps, limits)
        assert {r.node: tuple(r.path) for r in found if r.query_id == q} == out
        r = told[q]
        assert (r.seed_count, r.visited_states, r.traversed_edges, r.result_count, r.truncated) == (len(ns), states, walked, len(out), why)


def test_walks_can_be_stopped(spark):
    e = spark.createDataFrame([(0, "p", "A", "B")], "edge_index long, relationship string, src string, dst string")
    s = spark.createDataFrame([(1, "A")], "query_id long, node string")
    with pytest.raises(MillraceError, match="cancelled"):
        graph.walk(e, s, [TraversalStep("p")], cancelled=lambda: True)
    with pytest.raises(MillraceError, match="seconds"):
        graph.walk(e, s, [TraversalStep("p")], timeout=0.0)
    nothing = spark.createDataFrame([], "query_id long, node string")
    assert [x.count() for x in graph.walk(e, nothing, [TraversalStep("p")])] == [0, 0]


def test_limits_are_checked():
    for steps, limits in (([], TraversalLimits()), ([TraversalStep("p")], TraversalLimits(max_hops=65)), ([TraversalStep("p", "up")], TraversalLimits()), ([TraversalStep("p", min_hops=2)], TraversalLimits())):
        with pytest.raises(InvalidQuery):
            limits.check(steps)


def schema(**more):
    return GraphSchema({"t": "Topic"}, [Relationship("rel", "Topic", "Topic", ("to",), "many", inverse="rev", **more)], {"Topic": [("name",)]}, "Chunk", "owns", "part_of")


def records(spark, rows):
    return spark.createDataFrame([("t", i, {"to": refs}) for i, refs in rows], "record_type string, record_id string, refs map<string, array<string>>")


def build(spark, rows, s, chunks=None):
    r = records(spark, rows)
    return graph.build_edges(r, graph.references(r, s), s, chunks)


def test_edges_inverse_and_chunks(spark):
    chunks = spark.createDataFrame([("a", "k2"), ("a", "k1")], "record_id string, chunk_key string")
    edges, notes = build(spark, [("a", ["b"]), ("b", [])], schema(), chunks)
    got = [(r.edge_index, r.relationship, r.src, r.dst, r.occurrence, r.inverse) for r in edges.orderBy("edge_index").collect()]
    assert got == [
        (0, "owns", "Topic:a", "Chunk:a/k1", 0, False),
        (1, "owns", "Topic:a", "Chunk:a/k2", 1, False),
        (2, "part_of", "Chunk:a/k1", "Topic:a", 0, True),
        (3, "part_of", "Chunk:a/k2", "Topic:a", 1, True),
        (4, "rel", "Topic:a", "Topic:b", 0, False),
        (5, "rev", "Topic:b", "Topic:a", 0, True),
    ]
    assert notes.count() == 0


def test_policies(spark):
    for rows in ([("a", ["a"])], [("a", ["b", "b"]), ("b", [])], [("a", ["z"])]):
        with pytest.raises(SchemaError):
            build(spark, rows, schema())
    edges, notes = build(spark, [("a", ["b", "z", "b", "a"]), ("b", [])], schema(missing="omit", duplicates="first", self_edges=True))
    assert sorted((r.src, r.dst, r.occurrence) for r in edges.filter("relationship = 'rel'").collect()) == [("Topic:a", "Topic:a", 3), ("Topic:a", "Topic:b", 0)]
    assert [tuple(r)[:3] for r in notes.collect()] == [("rel", "a", "z")]


def test_seeds(spark):
    s = schema()
    index = graph.property_index(spark.createDataFrame([("Topic", "name", "str", "x", "Topic:a"), ("Topic", "name", "str", None, "Topic:b"), ("Topic", "name", "int", "5", "Topic:c")], "node_type string, path string, kind string, value string, node string"))
    assert [r.node for r in graph.seeds_by_property(index, s, "Topic", ("name",), ["x", "y"]).collect()] == ["Topic:a"]
    assert [r.node for r in graph.seeds_by_property(index, s, "Topic", ("name",), [5]).collect()] == ["Topic:c"]
    with pytest.raises(InvalidQuery):
        graph.seeds_by_property(index, s, "Topic", ("size",), [1])
    nodes = spark.createDataFrame([("Topic:a",)], "node string")
    with pytest.raises(UnknownNode):
        graph.seeds_by_id(nodes, ["Topic:a", "Topic:q"])


def test_missing_lists_are_empty_for_many_only(spark):
    r = spark.createDataFrame([("t", "a", {}), ("t", "b", {"to": ["a"]})], "record_type string, record_id string, refs map<string, array<string>>")
    assert [(x.source_record, x.target_record) for x in graph.references(r, schema()).collect()] == [("b", "a")]


def test_nested_fields(spark):
    def read(cardinality, *fields):
        s = GraphSchema({"t": "Topic"}, [Relationship("rel", "Topic", "Topic", ("a", "b"), cardinality)])
        rows = spark.createDataFrame([("t", str(i), f) for i, f in enumerate(fields)], "record_type string, record_id string, fields string")
        return sorted((x.source_record, x.target_record, x.occurrence) for x in graph.field_references(rows, s).collect())

    assert read("many", '{"a":{"b":["x","y"]}}', '{"a":{"b":[]}}', '{"a":{"b":null}}', "{}", None, '{"a":5}') == [("0", "x", 0), ("0", "y", 1)]
    assert read("optional", '{"a":{"b":"x"}}', '{"a":{}}') == [("0", "x", 0)]
    for cardinality, field in (("many", '{"a":{"b":"x"}}'), ("many", '{"a":{"b":[1]}}'), ("many", '{"a":{"b":["x",null]}}'), ("optional", '{"a":{"b":["x"]}}'), ("one", "{}"), ("one", '{"a":{"b":3}}')):
        with pytest.raises(SchemaError):
            read(cardinality, field)


def test_schema_text_and_stored_graphs(spark):
    s = schema(missing="omit", duplicates="first")
    assert GraphSchema.parse(s.canonical()).canonical() == s.canonical()
    for bad in ("{}", "x", s.canonical().replace(",", ", ", 1)):
        with pytest.raises(SchemaError):
            GraphSchema.parse(bad)
    r = records(spark, [("a", ["b"]), ("b", ["a"])])
    nodes, (edges, notes) = graph.build_nodes(r, s), graph.build_edges(r, graph.references(r, s), s)
    assert graph.validate(nodes, edges, s) == [] and graph.build_stats(r, nodes, edges, notes) == {"records": 2, "nodes": 2, "edges": 4, "diagnostics": 0}
    assert graph.validate(nodes.filter("node <> 'Topic:a'"), edges, s) == ["an edge ends at no node"]
    assert graph.validate(nodes, edges.filter("edge_index > 0"), s)[0] == "edges are not numbered from 0 on"
    assert "edges are out of order" in graph.validate(nodes, edges.withColumn("edge_index", 3 - edges["edge_index"]), s)


def test_schema_rules():
    assert schema().digest() == schema().digest()
    for bad in (GraphSchema({}), GraphSchema({"a": "X", "b": "X"}), GraphSchema({"a": "X"}, chunk_type="X"), GraphSchema({"a": "X"}, [Relationship("r", "X", "Y", ("f",))]), GraphSchema({"a": "X"}, [Relationship("r", "X", "X", ("f",), inverse="r")])):
        with pytest.raises(SchemaError):
            bad.check()
    assert len(list(itertools.islice(schema().nodes, 2))) == 1
