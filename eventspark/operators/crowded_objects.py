"""Object definitions and selection inputs of crowded events, by the rules of :mod:`objects` and :mod:`selection`."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions import coll, kin, ops
from eventspark.operators import objects, selection
from eventspark.operators.checkpoints import pinned
from eventspark.operators.crowded import Items
from eventspark.operators.objects import DEFAULT, Cuts

#: Collections that selections, plots and skims read.
SUMMARISED = (
    "muons", "tight_muons", "clean_electrons", "tight_electrons", "taus",
    "ak4_jets", "ak4_bjets", "ak8_jets", "ak8_bjets", "ak4_away",
)


@dataclass(frozen=True)
class Crowd:
    """The crowded events (``key`` only) and their collections, stored and derived."""

    events: DataFrame
    collections: Mapping[str, Items] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Items:
        return self.collections[name]

    def adding(self, **made: Items) -> Crowd:
        return Crowd(self.events, {**self.collections, **made})

    @property
    def key(self) -> str:
        return self.events.columns[0]

    def joined(self, *facts: DataFrame) -> DataFrame:
        """The events with tables of one row per event."""
        return reduce(lambda df, f: df.join(f, self.key, "left"), facts, self.events)


def _stamped(items: Items, jets: Items, conept) -> Items:
    found = items.follow(jets, "jetIdx", "_jet")
    out = found.mapped(lambda x: x.withField("jetBtag", F.col("_jet.btagDeepFlavB")).withField("conept", conept(x)))
    out = Items(out.rows.drop("_jet"), out.key)
    return out.sort(lambda x: x["conept"], desc=True).pinned()


def muons(crowd: Crowd, cuts: Cuts = DEFAULT) -> Crowd:
    c = cuts.leptons
    loose = crowd["Muon"].select(lambda x: objects.loose_muon(x, c))
    found = _stamped(loose, crowd["Jet"], lambda x: objects.muon_conept(x, c))
    return crowd.adding(
        muons=found,
        fake_muons=found.select(lambda x: objects.fakeable_muon(x, c)),
        tight_muons=found.select(lambda x: objects.tight_muon(x, c)),
    )


def electrons(crowd: Crowd, cuts: Cuts = DEFAULT) -> Crowd:
    c = cuts.leptons
    loose = crowd["Electron"].select(lambda x: objects.loose_electron(x, c))
    found = _stamped(loose, crowd["Jet"], lambda x: objects.electron_conept(x, c))
    clean = found.clean(crowd["muons"], c.clean_dr).pinned()
    return crowd.adding(
        electrons=found,
        clean_electrons=clean,
        fake_electrons=clean.select(lambda x: objects.fakeable_electron(x, c)),
        tight_electrons=clean.select(lambda x: objects.tight_electron(x, c)),
    )


def taus(crowd: Crowd, cuts: Cuts = DEFAULT) -> Crowd:
    c = cuts.taus
    good = crowd["Tau"].select(lambda x: objects.good_tau(x, c)).clean(crowd["fake_electrons"], c.clean_dr)
    return crowd.adding(taus=good.clean(crowd["fake_muons"], c.clean_dr).pinned())


def lead_leptons(crowd: Crowd, channel: str, electrons: str = "fake_electrons", muons: str = "fake_muons") -> DataFrame:
    """``(key, lead_leptons)`` from the two leading leptons of each flavour."""
    leading = coll.leading_two if channel == "DL" else coll.leading_one
    both = crowd.joined(crowd[electrons].heads("_e"), crowd[muons].heads("_m"))
    return pinned(both.select(crowd.key, leading(F.col("_e"), F.col("_m")).alias("lead_leptons")))


def jets(crowd: Crowd, lead: DataFrame, cuts: Cuts = DEFAULT) -> Crowd:
    c = cuts.jets
    good = crowd["Jet"].select(lambda x: objects.good_jet(x, c)).sort(lambda x: x["pt"], desc=True)
    found = good.keep_apart(lead, "lead_leptons", c.clean_dr).pinned()
    return crowd.adding(
        ak4_jets=found,
        ak4_jets_by_btag=found.sort(lambda x: x["btagDeepFlavB"], desc=True),
        ak4_bjets=found.select(lambda x: objects.b_jet(x, c)),
    )


def fat_jets(crowd: Crowd, lead: DataFrame, channel: str, cuts: Cuts = DEFAULT) -> Crowd:
    c = cuts.jets
    own = crowd["FatJet"].select(lambda x: objects.good_fat_jet(x, c))
    for which in ("subJet1", "subJet2"):
        own = own.follow(crowd["SubJet"], f"{which}Idx", "_sub").mapped(lambda x, n=which: x.withField(n, F.col("_sub")))
        own = Items(own.rows.drop("_sub"), own.key)
    good = own.select(lambda x: objects.good_sub_jets(x, c)).sort(lambda x: x[objects.fat_key(channel)], desc=True)
    found = good.keep_apart(lead, "lead_leptons", c.fat_clean_dr).pinned()
    tagged = found.select(lambda x: objects.b_fat_jet(x, c))
    away = crowd["ak4_jets"].with_event(tagged.first("_fat"))
    away = away.select(lambda x: ops.above(kin.delta_r(x, F.col("_fat")), c.away_dr))
    return crowd.adding(ak8_jets=found, ak8_bjets=tagged, ak4_away=Items(away.rows.drop("_fat"), away.key).pinned())


def define(crowd: Crowd, channel: str, cuts: Cuts = DEFAULT) -> Crowd:
    """All derived collections of a channel."""
    crowd = taus(electrons(muons(crowd, cuts), cuts), cuts)
    lead = lead_leptons(crowd, channel)
    return fat_jets(jets(crowd, lead, cuts), lead, channel, cuts)


def _differs(x: Column, charge: Column) -> Column:
    return x["charge"] != charge


def _first_pair(items: Items, name: str) -> DataFrame:
    """The first item and the first whose charge differs from its."""
    head = items.first("_l1")
    other = items.with_event(head).select(lambda x: _differs(x, F.col("_l1.charge"))).first("_l2")
    pair = F.struct(F.col("_l1").alias("l1"), F.col("_l2").alias("l2"))
    return head.join(other, items.key).select(items.key, pair.alias(name))


def _first_cross(a: Items, b: Items, name: str) -> DataFrame:
    """The first item of ``a`` whose charge differs from that of some item of ``b``, and the first such item."""
    charges = b.rows.groupBy(b.key).agg(F.min("item.charge").alias("_low"), F.max("item.charge").alias("_high"))
    meets = a.with_event(charges).select(lambda x: _differs(x, F.col("_low")) | _differs(x, F.col("_high")))
    own = meets.first("_l1")
    other = b.with_event(own).select(lambda x: _differs(x, F.col("_l1.charge"))).first("_l2")
    pair = F.struct(F.col("_l1").alias("l1"), F.col("_l2").alias("l2"))
    return own.join(other, a.key).select(a.key, pair.alias(name))


def _signs(items: Items, name: str) -> DataFrame:
    charge = F.col("item.charge")
    return items.counts(**{f"_{name}_plus": charge > 0, f"_{name}_minus": charge < 0})


def lepton_pairs(crowd: Crowd, electrons: str = "tight_electrons", muons: str = "tight_muons") -> list[DataFrame]:
    """The columns of :func:`selection.lepton_pairs`, one row per event."""
    e, m = crowd[electrons], crowd[muons]
    signs = crowd.joined(_signs(e, "e"), _signs(m, "m"))
    n = lambda c: F.coalesce(f"_{c}", F.lit(0)).cast("int")
    counts = signs.select(
        crowd.key,
        (n("e_plus") * n("e_minus")).alias("n_ee"),
        (n("m_plus") * n("m_minus")).alias("n_mm"),
        (n("e_plus") * n("m_minus") + n("e_minus") * n("m_plus")).alias("n_em"),
    )
    return [counts, _first_pair(e, "first_ee"), _first_pair(m, "first_mm"), _first_cross(e, m, "first_em")]


def vetoes(crowd: Crowd) -> DataFrame:
    """``(key, ok_low, ok_z)`` on the loose leptons."""
    e, m = crowd["clean_electrons"], crowd["muons"]
    low = selection.low_mass_pair()
    z = selection.z_pair()
    some = lambda found, name: found.distinct().withColumn(name, F.lit(True))
    hit_low = e.has_pair(None, low).union(m.has_pair(None, low)).union(e.has_pair(m, low))
    hit_z = e.has_pair(None, z).union(m.has_pair(None, z))
    both = crowd.joined(some(hit_low, "_low"), some(hit_z, "_z"))
    return both.select(crowd.key, F.col("_low").isNull().alias("ok_low"), F.col("_z").isNull().alias("ok_z"))


def summary(crowd: Crowd, channel: str, cuts: Cuts = DEFAULT) -> DataFrame:
    """One row per crowded event with what selections, plots and skims read.

    Collections are arrays whose length and first two items are right; the others are null (8 bytes an item).
    """
    found = define(crowd, channel, cuts)
    tables = [found[name].heads(name) for name in SUMMARISED]
    tables += [vetoes(found), *(lepton_pairs(found) if channel == "DL" else [])]
    out = pinned(found.joined(*map(pinned, tables)))
    # an event without such items has an empty collection
    empty = lambda c: F.slice(F.array(F.lit(None).cast(out.schema[c].dataType.elementType)), 1, 0)
    out = out.withColumns({c: F.coalesce(c, empty(c)) for c in SUMMARISED})
    return selection.mixed_by_pt(out) if channel == "DL" else out
