"""Fitted models as columns, so that scores are part of the pass over events and need no Python worker.

Parameters are one folded literal each; a model's size bounds the plan, not the data.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions.ops import bound
from eventspark.operators.checkpoints import pinned

Rows = list[list[float]]
#: Parameters of a model that is compiled at most.
MAX_PARAMETERS = 200_000


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _checked(n: int) -> None:
    if n > MAX_PARAMETERS:
        raise ValueError(f"{n} parameters are too many for a plan; score with the model's own transformer")


def probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _normalised(columns: Sequence[Column], mean: Sequence[float], deviation: Sequence[float]) -> Column:
    scaled = [(c.cast("double") - m) / s if s else F.lit(0.0) for c, m, s in zip(columns, mean, deviation, strict=True)]
    return F.array(*scaled)


def _dot(a: Column, b: Column, start: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), start, lambda acc, x: acc + x)


def logit(
    columns: Sequence[Column], mean: Sequence[float], deviation: Sequence[float], layers: Sequence[tuple[Rows, list[float]]]
) -> Column:
    """Output before the sigmoid of rectified layers ``(weights by input and output, offsets)``."""
    _checked(sum(len(b) * (1 + len(w)) for w, b in layers))
    x = _normalised(columns, mean, deviation)
    for i, (w, b) in enumerate(layers):
        units = [{"w": [row[k] for row in w], "b": b[k]} for k in range(len(b))]
        x = _layer(x, _literal(units, "array<struct<w:array<double>,b:double>>"), rectified=i < len(layers) - 1)
    return F.get(x, F.lit(0))


def _layer(x: Column, units: Column, rectified: bool) -> Column:
    def outputs(values: Column) -> Column:
        def one(unit: Column) -> Column:
            z = _dot(unit["w"], values, unit["b"])
            return F.greatest(z, F.lit(0.0)) if rectified else z

        return F.transform(units, one)

    return bound(x, outputs)


def dense(columns, mean, deviation, layers) -> Column:
    """Probability of class 1 of a network."""
    return probability(logit(columns, mean, deviation, layers))


def _tree(model) -> dict[str, list]:
    """A fitted tree as flat arrays: feature (-1: leaf), threshold, the two followers and value of every node."""
    flat: dict[str, list] = {"f": [], "t": [], "l": [], "r": [], "v": []}

    def add(node) -> int:
        at = len(flat["f"])
        leaf = node.subtreeDepth() == 0
        for k, v in zip("ftlrv", (-1, 0.0, at, at, node.prediction()), strict=True):
            flat[k].append(v)
        if not leaf:
            flat["f"][at], flat["t"][at] = node.split().featureIndex(), node.split().threshold()
            flat["l"][at], flat["r"][at] = add(node.leftChild()), add(node.rightChild())
        return at

    add(model._call_java("rootNode"))
    return flat


def trees(x: Column, forest: Sequence[tuple[float, dict[str, list]]], depth: int) -> Column:
    """Weighted sum of the values of the leaves that ``x`` reaches."""
    _checked(sum(5 * len(t["f"]) for _, t in forest))
    kind = "array<struct<w:double,f:array<int>,t:array<double>,l:array<int>,r:array<int>,v:array<double>>>"
    found = _literal([{"w": w, **t} for w, t in forest], kind)
    levels = F.array(*[F.lit(0)] * max(depth, 1))

    def walked(tree: Column, values: Column) -> Column:
        def down(at: Column, _: Column) -> Column:
            value = F.get(values, F.greatest(F.get(tree["f"], at), F.lit(0)))
            return F.when(value <= F.get(tree["t"], at), F.get(tree["l"], at)).otherwise(F.get(tree["r"], at))

        return F.get(tree["v"], F.aggregate(levels, F.lit(0), down))

    return bound(x, lambda values: F.aggregate(found, F.lit(0.0), lambda acc, tree: acc + tree["w"] * walked(tree, values)))


def margin(model: PipelineModel, columns: Mapping[str, Column] | None = None) -> Column:
    """What a model of :func:`model.train` takes the sigmoid of, over its features (or ``columns`` by feature name)."""
    assemble, scale, last = model.stages
    names = assemble.getInputCols()
    inputs = [columns[n] if columns else F.col(n) for n in names]
    mean, deviation = scale.mean.toArray().tolist(), scale.std.toArray().tolist()
    if hasattr(last, "coefficients"):
        return logit(inputs, mean, deviation, [([[c] for c in last.coefficients.toArray().tolist()], [last.intercept])])
    forest = [(float(w), _tree(t)) for w, t in zip(last.treeWeights, last.trees, strict=True)]
    return 2 * trees(_normalised(inputs, mean, deviation), forest, max(t.depth for t in last.trees))


def of_pipeline(model: PipelineModel, columns: Mapping[str, Column] | None = None, shift: float = 0.0) -> Column:
    """Probability of class 1 of a model of :func:`model.train`, its :func:`margin` moved by ``shift``."""
    return probability(margin(model, columns) + shift)


def balancing(rows: DataFrame, z: Column, label: Column, weight: Column, rounds: int = 12) -> float:
    """What to add to the margin ``z`` so that the scored weight of ``rows`` is the weight of their class 1 (Newton).

    An optimiser that compares losses finds a free intercept only to about the root of their precision.
    """
    known = pinned(rows.select(label.alias("y"), weight.alias("w"), z.alias("z")))
    shift = 0.0
    for _ in range(rounds):
        p = probability(F.col("z") + shift)
        gap, slope = known.agg(F.sum(F.col("w") * (p - F.col("y"))), F.sum(F.col("w") * p * (1 - p))).first()
        if not slope or abs(gap) <= 1e-9 * slope:
            break
        shift -= min(max(gap / slope, -2.0), 2.0)
    return shift
