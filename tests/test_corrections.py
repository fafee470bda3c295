"""Nested correction tables."""

import math

import pytest
from pyspark.sql import functions as F

from eventspark.operators.corrections import Binning, Category, Formula, evaluate


def values(spark, tree, rows):
    df = spark.createDataFrame(rows, "k string, x double")
    return [r[0] for r in df.select(evaluate(tree, {"k": F.col("k"), "x": F.col("x")})).collect()]


def test_edges_defaults_and_missing_values(spark):
    square = Formula(lambda v, p: p[0] * v["x"] * v["x"], (2.0,))
    tree = Category("k", {"a": Binning("x", (0, 1, 4), [10.0, square], "clamp"), "b": Binning("x", (0, 2), [7.0], 3.0)}, default=-1.0)
    rows = [("a", -5.0), ("a", 0.0), ("a", 1.0), ("a", 9.0), ("a", None), ("a", math.nan), ("b", 2.0), ("b", 1.9), ("b", None),
            ("c", 1.0), (None, 1.0)]
    assert values(spark, tree, rows) == [10.0, 10.0, 2.0, 162.0, None, None, 3.0, 7.0, 3.0, -1.0, -1.0]


def test_a_number_or_a_formula_alone(spark):
    assert values(spark, 1.5, [("a", 1.0)]) == [1.5]
    assert values(spark, Formula(lambda v, p: v["x"] + 1), [("a", 1.0)]) == [2.0]


def test_unfit_tables_fail_by_name(spark):
    with pytest.raises(ValueError, match="edges of 'x'"):
        evaluate(Binning("x", (0, 1), [1.0, 2.0]), {"x": F.lit(1.0)})
    with pytest.raises(ValueError, match="needs"):
        evaluate(Binning("y", (0, 1), [1.0]), {"x": F.lit(1.0)})
    with pytest.raises(ValueError, match="join it"):
        evaluate(Binning("x", range(60_001), [1.0] * 60_000), {"x": F.lit(1.0)})


def test_formulas_share_their_expression(spark, capsys):
    """Cells of one function add literals, not expressions."""
    double = lambda v, p: p[0] * v["x"]
    for n in (10, 1000):
        tree = Binning("x", range(n + 1), [Formula(double, (float(i),)) for i in range(n)], "clamp")
        assert values(spark, tree, [("a", 7.5), ("a", 1e9)]) == [7 * 7.5, (n - 1) * 1e9]
