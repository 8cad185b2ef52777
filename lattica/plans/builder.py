"""From a parsed query to one declarative DataFrame; Catalyst plans the rest.

Each pattern variable is a group of flat columns (var__id, var__label, ...), so that
filters and column pruning go straight to the scans. Nothing is capped before the
final LIMIT. Missing properties are null and comparisons three-valued.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..model import EDGE_COLUMNS, NODE_COLUMNS, Graph, json_number, json_property
from ..operators.traverse import reach
from .syntax import Condition, CypherError, Item, Logic, NodePattern, Property, Query, RelPattern, parse

#: Hops of an unbounded variable-length pattern, and its type where none is given.
MAX_HOPS = 10
DEFAULT_TYPE = "CALLS"
_WHOLE_NODE = ("name", "qualified_name", "label", "file_path", "start_line", "end_line")
_WHOLE_EDGE = ("type", "source_id", "target_id")


def java_regex(pattern: str) -> str:
    """Named groups are written (?P<name>...) by users of other engines."""
    found = pattern.replace("(?P<", "(?<")
    try:
        re.compile(pattern if "(?P<" in pattern else pattern.replace("(?<", "(?P<") if re.search(r"\(\?<[A-Za-z]", pattern) else pattern)
    except re.error as e:
        raise CypherError(f"bad regular expression {pattern!r}: {e}") from None
    return found


class _Binder:
    def __init__(self, query: Query):
        self.query = query
        self.node_vars: dict[str, NodePattern] = {}
        self.edge_vars: dict[str, RelPattern] = {}
        self.node_names: list[str] = []
        self.edge_names: list[str] = []
        for i, node in enumerate(query.nodes):
            name = node.var or f"_n{i}"
            if name in self.node_names:
                raise CypherError(f"the variable {name} stands for two nodes")
            self.node_names.append(name)
            if node.var:
                self.node_vars[name] = node
        for i, rel in enumerate(query.rels):
            name = rel.var or f"_r{i}"
            if name in self.node_names or name in self.edge_names:
                raise CypherError(f"the variable {name} is used twice")
            self.edge_names.append(name)
            if rel.var:
                if rel.variable:
                    raise CypherError(f"{name}: a pattern of several hops has no edge to name")
                self.edge_vars[name] = rel

    def column(self, prop: Property) -> tuple[Column, bool]:
        """The value, and whether it comes from JSON."""
        if prop.var in self.node_vars:
            known = NODE_COLUMNS
        elif prop.var in self.edge_vars:
            known = EDGE_COLUMNS
        else:
            raise CypherError(f"unknown variable {prop.var}")
        if prop.name in known:
            return F.col(f"{prop.var}__{prop.name}"), False
        return json_property(F.col(f"{prop.var}__properties"), prop.name), True

    def condition(self, c: Condition) -> Column:
        value, from_json = self.column(c.prop)
        text = value.cast("string")
        if c.op == "IS NULL":
            return value.isNull()
        if c.op == "IS NOT NULL":
            return value.isNotNull()
        if c.op == "IN":
            return reduce(lambda a, b: a | b, (self.condition(Condition(c.prop, "=", v)) for v in c.value))
        if c.op == "=~":
            return text.rlike(java_regex(str(c.value)))
        if c.op == "CONTAINS":
            return text.contains(str(c.value))
        if c.op == "STARTS WITH":
            return text.startswith(str(c.value))
        if c.op == "ENDS WITH":
            return text.endswith(str(c.value))
        equal = c.op in ("=", "<>")
        if isinstance(c.value, bool):
            left, right = text, F.lit(str(c.value).lower())
        elif isinstance(c.value, str) and equal:
            left, right = text, F.lit(c.value)
        else:
            try:
                number = float(c.value)
            except ValueError:
                raise CypherError(f"{c.op} compares numbers, not {c.value!r}") from None
            whole = isinstance(c.value, int) and not from_json and c.prop.name in ("id", "source_id", "target_id", "start_line", "end_line")
            left = value if whole else value.try_cast("double")  # columns of integers stay so, for the scan to filter
            right = F.lit(c.value) if whole else F.lit(number)
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[c.op]

    def where(self, tree: Condition | Logic) -> Column:
        if isinstance(tree, Condition):
            return self.condition(tree)
        parts = [self.where(p) for p in tree.parts]
        if tree.op == "NOT":
            return ~parts[0]
        return reduce((lambda a, b: a & b) if tree.op == "AND" else (lambda a, b: a | b), parts)

    def output(self, item: Item) -> Column:
        if item.count:
            raise AssertionError(item)
        assert item.prop is not None
        if item.prop.name:
            return self.column(item.prop)[0]
        if item.prop.var in self.node_vars:
            return F.struct(*(F.col(f"{item.prop.var}__{c}").alias(c) for c in _WHOLE_NODE))
        if item.prop.var in self.edge_vars:
            return F.struct(*(F.col(f"{item.prop.var}__{c}").alias(c) for c in _WHOLE_EDGE))
        raise CypherError(f"unknown variable {item.prop.var}")


def _nodes(graph: Graph, node: NodePattern, name: str) -> DataFrame:
    rows = graph.nodes
    if node.label:
        rows = rows.where(F.col("label") == node.label)
    rows = rows.select(*(F.col(c).alias(f"{name}__{c}") for c in (*NODE_COLUMNS, "properties")))
    if node.props:
        probe = _Binder(Query((NodePattern(name, node.label),), ()))
        for key, value in node.props:
            rows = rows.where(probe.condition(Condition(Property(name, key), "=", value)))
    return rows


def _edges(graph: Graph, rel: RelPattern, name: str, left: str) -> DataFrame:
    """Edges with the end that the pattern comes from and the end it goes to; in no
    direction both ways, a loop once."""
    rows = graph.typed(*rel.types).select(*(F.col(c).alias(f"{name}__{c}") for c in (*EDGE_COLUMNS, "properties")))
    out = rows.withColumns({"_from": F.col(f"{name}__source_id"), "_to": F.col(f"{name}__target_id")})
    back = rows.withColumns({"_from": F.col(f"{name}__target_id"), "_to": F.col(f"{name}__source_id")})
    if rel.direction == "out":
        return out
    return back if rel.direction == "in" else out.unionByName(back.where(F.col("_from") != F.col("_to")))


def compile_query(graph: Graph, query: Query | str, max_rows: int | None = None) -> DataFrame:
    """The result of a query as a DataFrame. `max_rows` limits a query that has no
    LIMIT of its own; by default nothing does."""
    query = parse(query) if isinstance(query, str) else query
    bound = _Binder(query)
    where = bound.where(query.where) if query.where is not None else None
    first = bound.node_names[0]
    bare = _bare(bound) if graph.closed else set()
    rows = None if first in bare and query.rels and not query.rels[0].variable else _nodes(graph, query.nodes[0], first)
    if where is not None and any(r.variable for r in query.rels):
        rows = _prefilter(bound, query.where, first, rows)
    for i, rel in enumerate(query.rels):
        here, there, name = bound.node_names[i], bound.node_names[i + 1], bound.edge_names[i]
        if rel.variable:
            types = rel.types or (DEFAULT_TYPE,)
            hops = reach(graph.edges, rows.select(F.col(f"{here}__id").alias("origin")).distinct(), types, rel.direction, MAX_HOPS if rel.high is None else rel.high)
            hops = hops.where(F.col("hop") >= max(rel.low, 1)).select("origin", F.col("node").alias("_to"))
            rows = rows.join(hops, F.col(f"{here}__id") == F.col("origin")).drop("origin")
        elif rows is None:
            rows = _edges(graph, rel, name, here).withColumnRenamed("_from", f"{here}__id")
        else:
            rows = rows.join(_edges(graph, rel, name, here), F.col(f"{here}__id") == F.col("_from")).drop("_from")
        if there in bare:
            rows = rows.withColumnRenamed("_to", f"{there}__id")
        else:
            rows = rows.join(_nodes(graph, query.nodes[i + 1], there), F.col("_to") == F.col(f"{there}__id")).drop("_to")
    if where is not None:
        rows = rows.where(where)
    return _project(bound, rows, max_rows)


def _bare(bound: _Binder) -> set[str]:
    """Nodes of which nothing but the id is asked: no label, no property."""
    query = bound.query
    asked = {i.prop.var for i in (*query.items, *(k for k, _ in query.order)) if i.prop is not None and (i.prop.name or not i.count)}
    asked |= _variables(query.where) if query.where is not None else set()
    asked |= set() if query.items else set(bound.node_vars)
    return {name for name, node in zip(bound.node_names, query.nodes) if not node.label and not node.props and name not in asked}


def _prefilter(bound: _Binder, tree: Condition | Logic, first: str, rows: DataFrame | None) -> DataFrame | None:
    """Conjuncts over the first variable alone, before a frontier grows from it."""
    if rows is None:
        return None
    for part in tree.parts if isinstance(tree, Logic) and tree.op == "AND" else (tree,):
        if _variables(part) == {first}:
            rows = rows.where(bound.where(part))
    return rows


def _variables(tree: Condition | Logic) -> set[str]:
    return {tree.prop.var} if isinstance(tree, Condition) else set().union(*map(_variables, tree.parts))


def _project(bound: _Binder, rows: DataFrame, max_rows: int | None) -> DataFrame:
    query = bound.query
    limit = query.limit if query.limit else max_rows
    if not query.items:
        columns = {f"{v}.{p}": F.col(f"{v}__{p}") for v in bound.node_vars for p in ("name", "qualified_name", "label")}
        columns |= {f"{v}.type": F.col(f"{v}__type") for v in bound.edge_vars}
        out = rows.select(*(columns[c].alias(c) for c in sorted(columns))) if columns else rows.select(F.lit(1).alias("match"))
        return out.limit(limit) if limit else out
    names = [i.column for i in query.items]
    if len(set(names)) < len(names):
        raise CypherError("two results have the same name")
    if any(i.count for i in query.items):
        keys = [bound.output(i).alias(i.column) for i in query.items if not i.count]
        counts = [_count(bound, i).alias(i.column) for i in query.items if i.count]
        grouped = (rows.groupBy(*keys) if keys else rows.groupBy()).agg(*counts)
        out, hidden = grouped.select(*(F.col(f"`{n}`") for n in names)), []
        order = [_order_key(query, k, None) for k, _ in query.order]
    else:
        hidden = [(f"_k{n}", bound.output(k)) for n, (k, _) in enumerate(query.order) if _named(query, k) is None]
        if hidden and query.distinct:
            raise CypherError("ORDER BY of a DISTINCT result needs a key that is returned")
        out = rows.select(*(bound.output(i).alias(i.column) for i in query.items), *(c.alias(n) for n, c in hidden))
        order = [_order_key(query, k, f"_k{n}") for n, (k, _) in enumerate(query.order)]
    if query.distinct:
        out = out.distinct()
    if order:
        out = out.orderBy(*(k.desc_nulls_last() if down else k.asc_nulls_last() for k, (_, down) in zip(order, query.order)))
    if limit:
        out = out.limit(limit)
    return out.drop(*(n for n, _ in hidden)) if hidden else out


def _count(bound: _Binder, item: Item) -> Column:
    if item.prop is None:
        return F.count(F.lit(1))
    if item.prop.name:
        value = bound.column(item.prop)[0]
    elif item.prop.var in bound.node_vars or item.prop.var in bound.edge_vars:
        value = F.col(f"{item.prop.var}__id")
    else:
        raise CypherError(f"unknown variable {item.prop.var}")
    if item.distinct:
        return F.count_distinct(value)
    return F.count(value if item.prop.name else F.lit(1))


def _named(query: Query, key: Item) -> str | None:
    """The returned column that a key of ORDER BY means: an alias or the same source."""
    for item in query.items:
        if key.source in (item.alias, item.source):
            return item.column
    return None


def _order_key(query: Query, key: Item, hidden: str | None) -> Column:
    if (name := _named(query, key)) is not None:
        return F.col(f"`{name}`")
    if hidden is None:
        raise CypherError(f"ORDER BY {key.source}: an aggregated result has no such column")
    return F.col(hidden)
