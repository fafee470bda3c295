import math
import random

import pytest
from builders import column, electron, events, fat_jet, jet, muon, sub_jet, tau
from pyspark.sql import functions as F

from eventspark.functions import coll, kin
from eventspark.operators import report, selection
from eventspark.operators.selection import Selection, with_flags
from eventspark.plans import analysis

BJET, JET = jet(eta=2.0, btagDeepFlavB=0.9), jet(eta=-2.0, pt=40.0)
PAIR = [electron(charge=1, phi=0.0), electron(charge=-1, phi=1.5)]


def flags(spark, channel, name, *rows):
    ch = analysis.channel(events(spark, *rows), channel)
    return column(ch.events, f"sel_{name}")


def massive(pt1, pt2, m, kind=electron, **second):
    """Two central opposite-charge leptons with the given mass of the pair."""
    dphi = math.acos(1 - m * m / (2 * pt1 * pt2))
    return [kind(pt=pt1, charge=1, mass=0.0), kind(pt=pt2, charge=-1, mass=0.0, phi=dphi, **second)]


def test_dl_resolved(spark):
    rows = [
        [*PAIR, BJET, JET],
        [*PAIR, BJET],                                   # one jet
        [*PAIR, JET, jet(eta=-1.0, phi=3.0)],            # no b jet
        [*PAIR, BJET, JET, fat_jet(eta=-2.0, phi=2.5), sub_jet(), sub_jet()],  # a fat jet vetoes, tagged or not
        [electron(charge=1), electron(charge=1, phi=1.5), BJET, JET],
        [*PAIR, muon(charge=-1, phi=-1.5), BJET, JET],   # also an e-mu pair
    ]
    assert flags(spark, "DL", "DL_resolved_ee", *rows) == [True, False, False, False, False, False]


def test_dl_boosted_and_flavours(spark):
    fat = [fat_jet(eta=-2.0, phi=2.5), sub_jet(), sub_jet()]
    rows = [
        [*PAIR, *fat],
        [muon(charge=1), muon(charge=-1, phi=1.5), *fat],
        [electron(charge=1), muon(charge=-1, phi=1.5), *fat],
        PAIR,
    ]
    assert flags(spark, "DL", "DL_boosted_ee", *rows) == [True, False, False, False]
    assert flags(spark, "DL", "DL_boosted_mumu", *rows) == [False, True, False, False]
    assert flags(spark, "DL", "DL_boosted_emu", *rows) == [False, False, True, False]


@pytest.mark.parametrize("pts,ok", [((26.0, 16.0), True), ((25.0, 16.0), False), ((26.0, 15.0), False), ((30.0, 30.0), True)])
def test_pair_pt(spark, pts, ok):
    row = [electron(charge=1, pt=pts[0]), electron(charge=-1, pt=pts[1], phi=2.0)]
    assert flags(spark, "DL", "elelptSel", row) == [ok]


def test_mass_vetoes(spark):
    rows = [massive(40, 30, m) for m in (11.5, 12.5, 60.0)] + [massive(60, 60, m) for m in (82.0, 81.0, 101.0, 102.0)]
    assert flags(spark, "DL", "OSoutZelelSel", *rows) == [False, True, True, False, True, False, True]


def test_mixed_flavour_ignores_z_but_not_low_mass(spark):
    mixed = lambda m: [massive(60, 60, m)[0], massive(60, 60, m, kind=muon)[1]]
    assert flags(spark, "DL", "OSoutZelmuSel", mixed(91.0), mixed(11.0)) == [True, False]


def test_exact_limits():
    """12 passes the low-mass veto; exactly 10 from the Z mass is vetoed."""
    assert selection.LOW_MASS == 12.0 and selection.Z_WINDOW == 10.0


def test_veto_boundaries(spark):
    """At rest along one axis two massless leptons of the same pt, back to back, have twice that pt as mass."""
    df = events(spark, [electron(pt=6.0, mass=0.0, charge=1), electron(pt=6.0, mass=0.0, charge=-1, phi=math.pi)])
    e, none = F.col("Electron"), F.slice("Muon", 1, 0)
    mass = column(df, F.transform(coll.pairs(e, lambda a, b: F.lit(True)), lambda p: kin.inv_mass(p["l1"], p["l2"])))[0][0]
    v = lambda c: column(df, c)[0]
    assert v(selection.no_low_mass(e, none, limit=mass)) is True
    assert v(selection.no_low_mass(e, none, limit=mass + 1e-9)) is False
    assert v(selection.no_low_mass(none, e, limit=mass + 1e-9)) is False
    assert v(selection.no_z(e, none, mass=mass + 2.0, window=2.5)) is False
    assert v(selection.no_z(e, none, mass=mass + 2.0, window=1.5)) is True


def test_pairs_are_counted_without_being_listed(spark):
    """A large event: numbers and first pairs as listing all pairs gives them."""
    rng = random.Random(5)
    some = lambda kind, n: [kind(charge=rng.choice((1, -1)), phi=i / n, pt=50.0 - i / n) for i in range(n)]
    df = events(spark, [*some(electron, 60), *some(muon, 70)], [electron(charge=1), electron(charge=1, phi=1.0)], [])
    e, m = F.col("Electron"), F.col("Muon")
    opposite = lambda a, b: a["charge"] != b["charge"]
    got = selection.lepton_pairs(df, "Electron", "Muon")
    listed = {"ee": coll.pairs(e, opposite), "mm": coll.pairs(m, opposite), "em": coll.cross(e, m, opposite)}
    for name, pairs in listed.items():
        assert column(got, f"n_{name}") == column(df, F.size(pairs))
        assert column(got, f"first_{name}") == column(df, coll.at(pairs, 0))
    assert column(got, "n_ee")[0] > 500 and column(got, "n_ee")[1:] == [0, 0]


def test_sl(spark):
    jets = [jet(eta=2.0, btagDeepFlavB=0.9), jet(eta=-2.0), jet(eta=1.5, phi=2.0)]
    fat = [fat_jet(eta=-1.0, phi=2.0), sub_jet(), sub_jet()]
    rows = [
        [electron(pt=32.5), *jets],
        [electron(pt=32.0), *jets],
        [muon(pt=25.5), *jets],
        [electron(pt=40.0), *jets[:2]],
        [electron(pt=40.0), *jets, tau(phi=-2.0)],
        [electron(pt=40.0), *jets, *fat],
        [electron(pt=40.0), jet(eta=2.0, phi=-1.0), *fat],
    ]
    assert flags(spark, "SL", "SL_resolved_e", *rows) == [True, False, False, False, False, False, False]
    assert flags(spark, "SL", "SL_resolved_mu", *rows) == [False, False, True, False, False, False, False]
    assert flags(spark, "SL", "SL_boosted_e", *rows) == [False] * 5 + [True, True]


def test_refine_weights_and_cutflow(spark):
    df = spark.range(10).select(F.col("id"), F.lit(2.0).alias("w"))
    base = Selection("noSel").refine("gen", weight=F.col("w"))
    half = base.refine("half", cut=F.col("id") < 5, weight=F.lit(0.5))
    few = half.refine("few", cut=[F.col("id") > 1, F.col("id") != 3])
    rows = report.cutflow(with_flags(df, [few]), [few], F.lit(1.0)).collect()
    got = {r["selection"]: (r["depth"], r["n"], r["sumw"], r["sumw2"]) for r in rows}
    assert got == {
        "noSel": (0, 10, 10.0, 10.0), "gen": (1, 10, 20.0, 40.0), "half": (2, 5, 5.0, 5.0), "few": (3, 2, 2.0, 2.0)
    }


def test_children_never_exceed_parents(spark):
    from eventspark.plans import fixture as fx

    ch = analysis.channel(fx.collisions(spark, "/root/testdata/sf0.001"), "SL")
    n = {r["selection"]: r["n"] for r in ch.cutflow(F.lit(1.0), ()).collect()}
    for sel in ch.selections:
        for child, parent in zip(sel.lineage()[1:], sel.lineage()):
            assert n[child.name] <= n[parent.name]


def test_histograms_keep_every_selected_event(spark):
    """Contents over all bins, with under- and overflow, equal the selection's yield."""
    from eventspark.plans import fixture as fx

    ch = analysis.channel(fx.collisions(spark, "/root/testdata/sf0.001"), "SL")
    yields = {r["selection"]: r["n"] for r in ch.cutflow(F.lit(1.0), ()).collect()}
    h = ch.histograms(F.lit(1.0), ()).groupBy("plot").agg(F.sum("n").alias("n")).collect()
    filled = {r["plot"]: r["n"] for r in h}
    for p in ch.plots:
        if p.name.startswith(("SL_resolved_nJets", "SL_boosted_fatJet_pt")):
            assert filled.get(p.name, 0) == yields[p.flag.removeprefix("sel_")]


def test_plot_catalogue_is_complete():
    from pyspark.sql import SparkSession

    from eventspark.plans import plots

    assert SparkSession.getActiveSession() is not None
    every = plots.dl_plots() + plots.score_plots(F.col("score")) + plots.sl_plots()
    assert len(every) == 156 and len({p.name for p in every}) == 156


def test_score_categories_exclude_edges(spark):
    rows = [[*PAIR, BJET, JET]] * 4
    df = events(spark, *rows, scalars={"s": [0.5, 0.6, 0.85, 1.0]})
    ch = analysis.channel(df, "DL", F.col("s"))
    assert [column(ch.events, f"sel_DNNcat{i}") for i in (1, 2, 3, 4)] == [
        [True, False, False, False], [False] * 4, [False, False, True, False], [False] * 4
    ]
    assert len(ch.plots) == 116
