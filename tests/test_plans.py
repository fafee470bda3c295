"""Shape of the physical plans: no cross joins, no Python workers, no expression repeated by a pushed-down filter."""

import pytest
from pyspark.sql import functions as F

from eventspark.operators import objects
from eventspark.plans import analysis
from eventspark.plans import fixture as fx
from suite import load

DIR, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES = load().QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"train_score"}))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text
    assert len(text) < 500_000


def test_a_channel_is_one_pass_without_shuffle(spark):
    """Objects and selections add no exchange to the event frame."""
    events = fx.collisions(spark, DIR)
    flags = analysis.channel(events, "DL").events.select("o_orderkey", "sel_DL_resolved_ee", "sel_DL_boosted_emu")
    assert plan(flags).count("Exchange ") == plan(events).count("Exchange ")


def test_only_needed_columns_are_read(spark):
    text = plan(fx.item_lists(spark, DIR).select("o_orderkey", F.size("items")))
    assert "l_shipdate" not in text.split("ReadSchema")[1]


def test_last_selections_leave_out_the_jets_of_other_events(spark):
    """Every event stays, and jets are made only where the leptons pass; the inner nodes' flags are not offered."""
    late = lambda df: fx.with_collections(df, "Tau", "FatJet", "SubJet")
    short = analysis.channel(fx.leptons_first(spark, DIR), "DL", last=True, stored=late)
    n, made = short.events.agg(F.count("*"), F.count("ak4_jets")).first()
    assert n == fx.headers(spark, DIR).count() and made < n / 3
    assert "sel_elelptSel" not in short.events.columns
    with pytest.raises(ValueError, match="inner nodes"):
        short.cutflow(F.col("weight"))


@pytest.mark.parametrize("names", [("DL", "SL"), ("DL",), ("SL",)])
def test_events_without_candidates_are_not_nested(spark, names):
    """Fewer events are built, and those kept for the channels are the same, each with all its items."""
    few, every = fx.leptons_first(spark, SMALL, having=analysis.candidates(names)), fx.leptons_first(spark, SMALL)
    assert few.count() < every.count() / 2
    kept = [analysis.promising(df, names).selectExpr("o_orderkey", "hash(*) AS h") for df in (few, every)]
    assert kept[1].count() and not kept[0].exceptAll(kept[1]).count() and not kept[1].exceptAll(kept[0]).count()


def test_a_candidate_is_judged_by_its_own_fields(spark):
    """NULL fails and an unset cone-pt limit is not needed: what a tight lepton passes, a candidate passes."""
    df = fx.leptons_first(spark, SMALL)
    found = objects.electrons(objects.muons(df))
    for stored, tight, own in (("Muon", "tight_muons", objects.muon_candidate), ("Electron", "tight_electrons", objects.electron_candidate)):
        can = F.transform(F.filter(stored, lambda x: own(x, 25.0)), lambda x: x["idx"])
        are = F.transform(F.filter(tight, lambda x: x["conept"] > 25.0), lambda x: x["idx"])
        n, lost = found.agg(F.sum(F.size(are)), F.sum(F.size(F.array_except(are, can)))).first()
        assert n and not lost
    x = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema["Muon"].dataType.elementType])
    assert spark.range(1).select(objects.muon_candidate(x, 0.0)).first()[0] is False
