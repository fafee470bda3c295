"""Nested correction tables: categories, binnings and formulas in any order, compiled to one column.

The tree becomes flat literal arrays (nodes, edges, followers, leaf parameters). A value walks it by index, one step a
level, so the expression has the size of the tree's depth and of its distinct formulas, not of its cells.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventspark.functions import ops
from eventspark.functions.ops import bound

#: Nodes and edges of a table at most.
MAX_CELLS = 100_000


@dataclass(frozen=True)
class Category:
    """A node per value of ``input`` (compared as text); ``default`` for all others and for null."""

    input: str
    of: Mapping[str, Node]
    default: Node | None = None


@dataclass(frozen=True)
class Binning:
    """A node per interval [edge, next edge) of ``input``.

    Beyond the edges: ``clamp`` takes the first or last node, another node counts for all of them, None gives null. Null and
    NaN are beyond the edges, but ``clamp`` gives null for them.
    """

    input: str
    edges: Sequence[float]
    of: Sequence[Node]
    beyond: Node | str | None = None


@dataclass(frozen=True)
class Formula:
    """``fn(inputs, parameters)``; cells that share ``fn`` share its expression."""

    fn: Callable[[Mapping[str, Column], Sequence[Column]], Column]
    parameters: tuple[float, ...] = ()


Node = Category | Binning | Formula | float


class _Flat:
    """Arrays of a tree; a node's number is its place in them, -1 stands for null."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        self.codes: dict[str, list[str]] = {}
        self.formulas: list[Callable] = []
        self.nodes: list[dict] = []
        self.edges: list[float] = []
        self.follow: list[int] = []

    def gather(self, node: Node | str | None) -> None:
        """Values of every category input, over the whole tree."""
        if isinstance(node, Category):
            known = self.codes.setdefault(node.input, [])
            known += [str(k) for k in node.of if str(k) not in known]
            for child in [*node.of.values(), node.default]:
                self.gather(child)
        elif isinstance(node, Binning):
            for child in [*node.of, node.beyond]:
                self.gather(child)

    def add(self, node: Node | None) -> tuple[int, int]:
        """Number and depth of a node."""
        if node is None:
            return -1, 0
        at = len(self.nodes)
        mine: dict = {"k": 0, "i": 0, "s": 0, "n": 0, "e": 0, "o": -1, "c": False, "f": -1, "v": 0.0, "p": []}
        self.nodes.append(mine)
        if isinstance(node, Category):
            values = {str(k): v for k, v in node.of.items()}
            other, deep = self.add(node.default)
            found = [self.add(values[c]) if c in values else (other, 0) for c in self.codes[node.input]]
            mine |= {"k": 1, "i": self.names.index(node.input), "s": len(self.follow), "n": len(found), "o": other}
        elif isinstance(node, Binning):
            if len(node.edges) != len(node.of) + 1 or list(node.edges) != sorted(set(node.edges)):
                raise ValueError(f"edges of {node.input!r} do not fit its {len(node.of)} cells")
            clamp = node.beyond == "clamp"
            other, deep = self.add(None if clamp else node.beyond)
            found = [self.add(child) for child in node.of]
            mine |= {"k": 2, "i": self.names.index(node.input), "s": len(self.follow), "n": len(found), "o": other}
            mine |= {"c": clamp, "e": len(self.edges)}
            self.edges += [float(e) for e in node.edges]
        else:
            if isinstance(node, Formula):
                if node.fn not in self.formulas:
                    self.formulas.append(node.fn)
                mine |= {"f": self.formulas.index(node.fn), "p": [float(p) for p in node.parameters]}
            else:
                mine["v"] = float(node)
            return at, 0
        self.follow += [n for n, _ in found]
        return at, 1 + max([deep, *(d for _, d in found)])


def _inputs(node: Node | str | None) -> list[str]:
    if isinstance(node, Category):
        return [node.input, *(n for c in [*node.of.values(), node.default] for n in _inputs(c))]
    if isinstance(node, Binning):
        return [node.input, *(n for c in [*node.of, node.beyond] for n in _inputs(c))]
    return []


def evaluate(tree: Node, inputs: Mapping[str, Column]) -> Column:
    """The correction for ``inputs`` (columns by name, also items inside a collection); null where the table has none."""
    names = list(dict.fromkeys(_inputs(tree)))
    missing = [n for n in names if n not in inputs]
    if missing:
        raise ValueError(f"a table needs {missing}")
    flat = _Flat(names)
    flat.gather(tree)
    _, depth = flat.add(tree)
    if len(flat.nodes) + len(flat.edges) + len(flat.follow) > MAX_CELLS:
        raise ValueError(f"a table of more than {MAX_CELLS} cells; join it instead")
    kind = "array<struct<k:int,i:int,s:int,n:int,e:int,o:int,c:boolean,f:int,v:double,p:array<double>>>"
    nodes = F.from_json(F.lit(json.dumps(flat.nodes)), kind)
    edges = F.from_json(F.lit(json.dumps(flat.edges)), "array<double>")
    follow = F.from_json(F.lit(json.dumps(flat.follow)), "array<int>")

    def number(name: str) -> Column:
        if name not in flat.codes:
            return inputs[name].cast("double")
        known = F.from_json(F.lit(json.dumps(flat.codes[name])), "array<string>")
        return (F.array_position(known, inputs[name].cast("string")) - 1).cast("double")

    values = F.array(*[number(n) for n in names]) if names else F.array(F.lit(0.0))
    # named once: an expression mentions its parts as often as they are used
    table = F.struct(nodes.alias("nodes"), edges.alias("edges"), follow.alias("follow"), values.alias("values"))
    levels = F.array(*[F.lit(0)] * depth)

    def walked(t: Column) -> Column:
        return F.aggregate(levels, F.lit(0), lambda at, _: bound(_node(t, at), lambda node: _next(t, node, at))) if depth else F.lit(0)

    def leaf(t: Column) -> Column:
        return bound(walked(t), lambda at: bound(_node(t, at), lambda node: F.when(at >= 0, _value(node, flat, inputs))))

    return bound(table, leaf)


def _node(t: Column, at: Column) -> Column:
    return F.get(t["nodes"], F.greatest(at, F.lit(0)))


def _next(t: Column, node: Column, at: Column) -> Column:
    """Number of the node that follows; a leaf follows itself, as does null."""

    def of(value: Column) -> Column:
        usable = value.isNotNull() & ~F.isnan(value)
        code = F.when(usable & (value >= 0), F.get(t["follow"], node["s"] + value.cast("int")))
        own = F.slice(t["edges"], node["e"] + 1, node["n"] + 1)
        place = F.size(F.filter(own, lambda e: e <= value)) - 1
        held = F.when(node["c"], F.least(F.greatest(place, F.lit(0)), node["n"] - 1)).otherwise(place)
        cell = F.when(usable & (held >= 0) & (held < node["n"]), F.get(t["follow"], node["s"] + held))
        return F.coalesce(F.when(node["k"] == 1, code).otherwise(cell), node["o"])

    return F.when((at < 0) | (node["k"] == 0), at).otherwise(bound(F.get(t["values"], node["i"]), of))


def _value(node: Column, flat: _Flat, inputs: Mapping[str, Column]) -> Column:
    width = max((len(n["p"]) for n in flat.nodes), default=0)
    parameters = [F.get(node["p"], F.lit(i)) for i in range(width)]
    cases = [(node["f"] == i, fn(inputs, parameters).cast("double")) for i, fn in enumerate(flat.formulas)]
    return ops.multi_switch(*cases, default=node["v"]) if cases else node["v"]
