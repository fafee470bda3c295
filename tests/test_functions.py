import math

import pytest
from builders import column, events, jet
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventspark.functions import coll, kin, ops


def values(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("x,inside", [(0.6, False), (0.60001, True), (0.8, False), (0.7, True)])
def test_open_range(spark, x, inside):
    assert values(spark, ops.in_range(0.6, F.col("x"), 0.8), x=x) is inside


def test_nan_never_passes_a_lower_bound(spark):
    for cut in (ops.at_least, ops.above):
        assert values(spark, cut(F.col("x"), 1.0), x=math.nan) is False
        assert values(spark, cut(F.col("x"), 1.0), x=2.0) is True


def test_multi_switch_takes_first_match(spark):
    out = ops.multi_switch((F.col("x") > 1, F.lit("a")), (F.col("x") > 0, F.lit("b")), default=F.lit("c"))
    assert [values(spark, out, x=x) for x in (2, 1, 0)] == ["a", "b", "c"]


def test_absent_item_fails_a_cut(spark):
    missing = coll.at(F.array(F.lit(1)), 5) > 0
    assert values(spark, ops.passed(missing)) is False


def test_delta_phi_wraps_at_pi(spark):
    f = lambda a, b: values(spark, kin.delta_phi(F.col("a"), F.col("b")), a=a, b=b)
    assert f(math.pi, -math.pi) == pytest.approx(0.0, abs=1e-12)
    assert f(3.0, -3.0) == pytest.approx(6.0 - 2 * math.pi)
    assert f(math.pi, 0.0) == pytest.approx(math.pi)
    assert f(0.0, math.pi) == pytest.approx(math.pi)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.floats(1, 100), st.floats(-2.5, 2.5), st.floats(-3.1, 3.1), st.floats(0, 10)),
        min_size=2,
        max_size=2,
    )
)
def test_invariant_mass_matches_four_vector_sum(spark, two):
    def p4(pt, eta, phi, m):
        px, py, pz = pt * math.cos(phi), pt * math.sin(phi), pt * math.sinh(eta)
        return px, py, pz, math.sqrt(px * px + py * py + pz * pz + m * m)

    a, b = (p4(*x) for x in two)
    s = [i + j for i, j in zip(a, b)]
    expected = math.sqrt(max(s[3] ** 2 - s[0] ** 2 - s[1] ** 2 - s[2] ** 2, 0.0))
    item = lambda x: F.struct(*[F.lit(v).alias(n) for n, v in zip(("pt", "eta", "phi", "mass"), x)])
    got = spark.range(1).select(kin.inv_mass(item(two[0]), item(two[1])).alias("m")).first()["m"]
    assert got == pytest.approx(expected, abs=1e-3)


def test_mass_of_absent_item_is_null(spark):
    none = F.lit(None).cast("struct<pt:double,eta:double,phi:double,mass:double>")
    assert spark.range(1).select(kin.inv_mass(none, none).alias("m")).first()["m"] is None


def test_sort_breaks_ties_by_position(spark):
    df = events(spark, [jet(pt=20.0), jet(pt=40.0), jet(pt=40.0), jet(pt=10.0)])
    assert column(df, coll.sort(F.col("Jet"), lambda x: x["pt"], desc=True)["idx"]) == [[1, 2, 0, 3]]


def test_pairs_are_ordered_and_unique(spark):
    df = events(spark, [jet(pt=float(i)) for i in range(4)], [], [jet()])
    p = coll.pairs(F.col("Jet"), lambda a, b: F.lit(True))
    got = column(df, F.transform(p, lambda x: F.array(x["l1"]["idx"], x["l2"]["idx"])))
    assert got == [[[i, j] for i in range(4) for j in range(i + 1, 4)], [], []]


def test_follow_guards_invalid_references(spark):
    df = events(spark, [jet(pt=11.0)])
    for i, expected in ((0, 11.0), (-1, None), (3, None)):
        assert column(df, coll.follow(F.col("Jet"), F.lit(i))["pt"]) == [expected]


def test_clean_is_inclusive_and_keep_apart_is_not(spark):
    df = events(spark, [jet(eta=0.5), jet(eta=0.0)])
    one = F.slice("Jet", 2, 1)
    first = F.slice("Jet", 1, 1)
    assert column(df, F.size(coll.clean(first, one, 0.5))) == [0]
    assert column(df, F.size(coll.keep_apart(first, one, 0.5))) == [1]


def test_lead_sub_prefers_first_on_tie(spark):
    a = F.struct(F.lit(5.0).alias("pt"), F.lit("a").alias("n"))
    b = F.struct(F.lit(5.0).alias("pt"), F.lit("b").alias("n"))
    lead, sub = ops.lead_sub(a, b)
    assert spark.range(1).select(lead["n"], sub["n"]).first()[:] == ("a", "b")
