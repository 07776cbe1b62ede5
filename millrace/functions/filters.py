"""Metadata filters as column expressions.

Two front ends, a nested dict and a JSON tree with an `op`, compile to one
Column. Fields are looked up in a tagged map, or in plain columns that were
promoted, where Parquet can push the predicate down.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.model import InvalidFilter, Millis, tag

SLOT = {"str": "s", "int": "i", "ts": "i", "float": "f", "bool": "b"}


class MapFields:
    """Fields of a METADATA map column."""

    def __init__(self, column: str = "metadata"):
        self.column = column

    def value(self, name: str) -> Column:
        return F.element_at(F.col(self.column), F.lit(name))

    def exists(self, name: str) -> Column:
        return F.coalesce(F.map_contains_key(F.col(self.column), F.lit(name)), F.lit(False))

    def equals(self, name: str, value) -> Column:
        kind, plain = tag(value)
        if kind == "float" and math.isnan(plain):
            return F.lit(False)
        v = self.value(name)
        return F.coalesce((v["t"] == kind) & (v[SLOT[kind]] == F.lit(plain)), F.lit(False))

    def number(self, name: str) -> Column:
        v = self.value(name)
        return F.when(v["t"].isin("int", "ts"), v["i"].cast("double")).when(v["t"] == "float", v["f"])


class ColumnFields:
    """Fields promoted to columns: name -> (column, tag). A null is a missing field."""

    def __init__(self, fields: dict[str, tuple[str, str]]):
        self.fields = fields

    def exists(self, name: str) -> Column:
        return F.col(self.fields[name][0]).isNotNull() if name in self.fields else F.lit(False)

    def equals(self, name: str, value) -> Column:
        kind, plain = tag(value)
        if name not in self.fields or self.fields[name][1] != kind or (kind == "float" and math.isnan(plain)):
            return F.lit(False)
        return F.coalesce(F.col(self.fields[name][0]) == F.lit(plain), F.lit(False))

    def number(self, name: str) -> Column:
        if name not in self.fields or self.fields[name][1] not in ("int", "ts", "float"):
            return F.lit(None).cast("double")
        return F.col(self.fields[name][0]).cast("double")


def eq(fields, name, value) -> Column:
    return fields.equals(name, value)


def ne(fields, name, value) -> Column:
    """True where the field is missing or differs."""
    return ~fields.equals(name, value)


def is_in(fields, name, values) -> Column:
    return any_of([fields.equals(name, v) for v in values])


def bounds(fields, name, low=None, high=None) -> Column:
    """Inclusive range over numbers and timestamps, compared as doubles; other types never match."""
    number = fields.number(name)
    tests = [fields.exists(name)]
    for bound, side in ((low, "low"), (high, "high")):
        if bound is None:
            continue
        kind, plain = tag(bound)
        if kind not in ("int", "ts", "float"):
            raise InvalidFilter(f"a range bound of {name} is no number")
        if isinstance(plain, float) and math.isnan(plain):
            return F.lit(False)
        tests.append(number >= float(plain) if side == "low" else number <= float(plain))
    tests.append(number.isNotNull())
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def exists(fields, name) -> Column:
    return fields.exists(name)


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def where(spec: dict | None, fields=None) -> Column:
    """A nested dict: {"field": value}, {"field": {"$gte": 1}}, {"$and": [...]}, {"$or": [...]}.

    Several keys, and several operators of a field, must all hold.
    """
    fields = fields or MapFields()
    if spec is None:
        return F.lit(True)
    if not isinstance(spec, dict) or not spec:
        raise InvalidFilter("a filter is a dict with at least one key")
    parts = []
    for key, body in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(body, (list, tuple)):
                raise InvalidFilter(f"{key} takes a list")
            parts.append((all_of if key == "$and" else any_of)([where(x, fields) for x in body]))
        elif key.startswith("$"):
            raise InvalidFilter(f"unknown operator {key}")
        elif isinstance(body, dict):
            parts.append(_operators(fields, key, body))
        else:
            parts.append(eq(fields, key, body))
    return all_of(parts)


def _operators(fields, name: str, body: dict) -> Column:
    if not body:
        raise InvalidFilter(f"no operator for {name}")
    known: dict[str, Callable[[object], Column]] = {
        "$eq": lambda v: eq(fields, name, v),
        "$ne": lambda v: ne(fields, name, v),
        "$in": lambda v: is_in(fields, name, v),
        "$gte": lambda v: bounds(fields, name, low=v),
        "$lte": lambda v: bounds(fields, name, high=v),
        "$exists": lambda v: exists(fields, name),
    }
    parts = []
    for op, value in body.items():
        if op not in known:
            raise InvalidFilter(f"unknown operator {op}")
        if op == "$in" and not isinstance(value, (list, tuple)):
            raise InvalidFilter("$in takes a list")
        if op == "$exists" and value is not True:
            raise InvalidFilter("$exists takes true only")
        parts.append(known[op](value))
    return all_of(parts)


def untag(value):
    """A value of the JSON tree: {"type": ..., "value": ...}."""
    kind = value["type"]
    if kind == "timestamp_millis":
        return Millis(int(value["value"]))
    return {"string": str, "integer": int, "float": float, "boolean": bool}[kind](value["value"])


def tree(node: dict, fields=None) -> Column:
    """A JSON tree: op is equals, not_equals, in, range, exists, all or any."""
    fields = fields or MapFields()
    op = node.get("op")
    if op in ("all", "any"):
        return (all_of if op == "all" else any_of)([tree(x, fields) for x in node["filters"]])
    if op == "exists":
        return exists(fields, node["field"])
    if op == "equals":
        return eq(fields, node["field"], untag(node["value"]))
    if op == "not_equals":
        return ne(fields, node["field"], untag(node["value"]))
    if op == "in":
        return is_in(fields, node["field"], [untag(v) for v in node["values"]])
    if op == "range":
        side = lambda k: untag(node[k]) if node.get(k) is not None else None
        return bounds(fields, node["field"], side("lower"), side("upper"))
    raise InvalidFilter(f"unknown op {op!r}")


def judged(node: dict, fields: MapFields) -> Column:
    """The stricter reading that judgements are checked with: not_equals needs the field, a range needs the bound's own type."""
    op = node.get("op")
    if op in ("all", "any"):
        return (all_of if op == "all" else any_of)([judged(x, fields) for x in node["filters"]])
    if op == "not_equals":
        return exists(fields, node["field"]) & ne(fields, node["field"], untag(node["value"]))
    if op == "range":
        kinds = {tag(untag(node[k]))[0] for k in ("lower", "upper") if node.get(k) is not None}
        typed = fields.value(node["field"])["t"].isin(*kinds) if kinds else F.lit(True)
        return F.coalesce(typed, F.lit(False)) & tree(node, fields)
    return tree(node, fields)


def windows_overlap(start: Column, end: Column, low: float, high: float) -> Column:
    return (start <= high) & (end >= low)


def window_within(start: Column, end: Column, low: float, high: float) -> Column:
    return (start >= low) & (end <= high)
