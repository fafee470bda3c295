"""Derived object collections of an event: leptons, taus, jets and fat jets.

Input columns are the stored collections ``Muon, Electron, Jet, FatJet, SubJet, Tau`` (``array<struct>`` with ``idx``).
Every step is a narrow projection that adds one column, so the whole object layer runs without a shuffle. Each derived
collection is used by more than one later step, which keeps Catalyst from inlining (and so recomputing) it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions import coll, kin, ops
from eventspark.functions.ops import above, at_least


@dataclass(frozen=True)
class LeptonCuts:
    """Fixed cut values of the lepton definitions."""

    muon_pt: float = 5.0
    muon_eta: float = 2.4
    electron_pt: float = 7.0
    electron_eta: float = 2.5
    dxy: float = 0.05
    dz: float = 0.1
    iso: float = 0.4
    sip3d: float = 8.0
    electron_lost_hits: int = 1
    muon_mva: float = 0.50
    electron_mva: float = 0.30
    conept_scale: float = 0.9
    conept_min: float = 10.0
    btag_loose: float = 0.0494
    btag_medium: float = 0.2770
    btag_tight: float = 0.7264
    btag_ramp: tuple[float, float] = (20.0, 45.0)
    muon_fake_rel_iso: float = 0.8
    electron_fake_rel_iso: float = 0.7
    barrel_eta: float = 1.479
    sieie_barrel: float = 0.011
    sieie_endcap: float = 0.030
    hoe: float = 0.10
    e_inv_minus_p_inv: float = -0.04
    clean_dr: float = 0.3


@dataclass(frozen=True)
class TauCuts:
    pt: float = 20.0
    eta: float = 2.3
    dxy: float = 1000.0
    dz: float = 0.2
    decay_modes: tuple[int, ...] = (0, 1, 2, 10, 11)
    jet_bit: int = 4
    electron_bit: int = 0
    muon_bit: int = 0
    clean_dr: float = 0.3


@dataclass(frozen=True)
class JetCuts:
    jet_id_mask: int = 2
    pt: float = 25.0
    eta: float = 2.4
    btag: float = 0.2770
    clean_dr: float = 0.4
    fat_pt: float = 200.0
    fat_eta: float = 2.4
    sub_pt: float = 20.0
    sub_eta: float = 2.4
    softdrop: tuple[float, float] = (30.0, 210.0)
    tau21: float = 0.75
    fat_clean_dr: float = 0.8
    fat_btag_pt: float = 30.0
    fat_btag: float = 0.4184
    away_dr: float = 1.2


@dataclass(frozen=True)
class Cuts:
    leptons: LeptonCuts = field(default_factory=LeptonCuts)
    taus: TauCuts = field(default_factory=TauCuts)
    jets: JetCuts = field(default_factory=JetCuts)


DEFAULT = Cuts()


# --- leptons -----------------------------------------------------------------------------------------------------


def _soft_pt(x: Column, c: LeptonCuts) -> Column:
    return c.conept_scale * x["pt"] * (1.0 + x["jetRelIso"])


def muon_conept(x: Column, c: LeptonCuts = DEFAULT.leptons) -> Column:
    pdg = F.abs(x["pdgId"])
    return ops.multi_switch(
        (~pdg.isin(11, 13), x["pt"]),
        ((pdg == 13) & x["mediumId"] & above(x["mvaTTH"], c.muon_mva), x["pt"]),
        default=_soft_pt(x, c),
    )


def electron_conept(x: Column, c: LeptonCuts = DEFAULT.leptons) -> Column:
    pdg = F.abs(x["pdgId"])
    return ops.multi_switch(
        (~pdg.isin(11, 13), x["pt"]),
        ((pdg == 11) & above(x["mvaTTH"], c.electron_mva), x["pt"]),
        default=_soft_pt(x, c),
    )


def _near_vertex(x: Column, c: LeptonCuts) -> Column:
    return ops.all_of(
        F.abs(x["dxy"]) <= c.dxy, F.abs(x["dz"]) <= c.dz, x["miniPFRelIso_all"] <= c.iso, x["sip3d"] <= c.sip3d
    )


def _stamped(arr: Column, conept: Callable[[Column], Column]) -> Column:
    """Add ``jetBtag``, the b-tag score of the associated jet (NULL when there is none), and ``conept``."""
    btag = lambda x: coll.follow(F.col("Jet"), x["jetIdx"])["btagDeepFlavB"]
    return F.transform(arr, lambda x: x.withField("jetBtag", btag(x)).withField("conept", conept(x)))


def _jet_btag_at_most(x: Column, limit) -> Column:
    return x["jetBtag"].isNull() | (x["jetBtag"] <= limit)


def _muon_btag_limit(x: Column, c: LeptonCuts) -> Column:
    """b-tag limit that falls linearly from the medium to the loose value along the pt ramp."""
    low, high = c.btag_ramp
    t = F.least(F.greatest(F.lit(0.0), _soft_pt(x, c) - low) / (high - low), F.lit(1.0))
    return t * c.btag_loose + (1 - t) * c.btag_medium


def loose_muon(x: Column, c: LeptonCuts) -> Column:
    return ops.all_of(at_least(x["pt"], c.muon_pt), F.abs(x["eta"]) <= c.muon_eta, _near_vertex(x, c), x["looseId"])


def fakeable_muon(x: Column, c: LeptonCuts) -> Column:
    return at_least(x["conept"], c.conept_min) & (
        _jet_btag_at_most(x, c.btag_medium)
        | ((x["jetRelIso"] < c.muon_fake_rel_iso) & (x["jetBtag"].isNull() | (x["jetBtag"] < _muon_btag_limit(x, c))))
    )


def _tight_muon_alone(x: Column, conept: Column, c: LeptonCuts) -> Column:
    """What a tight muon needs besides its jet."""
    return ops.all_of(at_least(conept, c.conept_min), at_least(x["mvaTTH"], c.muon_mva), x["mediumId"])


def tight_muon(x: Column, c: LeptonCuts) -> Column:
    return _tight_muon_alone(x, x["conept"], c) & _jet_btag_at_most(x, c.btag_medium)


def muon_candidate(x: Column, low: float, c: LeptonCuts = DEFAULT.leptons) -> Column:
    """Whether a stored muon's own fields let it be a tight one with a cone-pt above ``low``."""
    conept = muon_conept(x, c)
    return ops.passed(ops.all_of(loose_muon(x, c), _tight_muon_alone(x, conept, c), conept > low))


def muons(df: DataFrame, c: LeptonCuts = DEFAULT.leptons) -> DataFrame:
    """Loose, fakeable and tight muons, hardest cone-pt first."""
    loose = coll.select(F.col("Muon"), lambda x: loose_muon(x, c))
    stamped = _stamped(loose, lambda x: muon_conept(x, c))
    df = df.withColumn("muons", coll.sort(stamped, lambda x: x["conept"], desc=True))
    return df.withColumns(
        {
            "fake_muons": coll.select(F.col("muons"), lambda x: fakeable_muon(x, c)),
            "tight_muons": coll.select(F.col("muons"), lambda x: tight_muon(x, c)),
        }
    )


def _electron_quality(x: Column, conept: Column, c: LeptonCuts) -> Column:
    """Requirements shared by fakeable and tight electrons."""
    eta_sc = F.abs(x["eta"] + x["deltaEtaSC"])
    shower = F.when(eta_sc <= c.barrel_eta, x["sieie"] <= c.sieie_barrel).otherwise(x["sieie"] <= c.sieie_endcap)
    return ops.all_of(
        at_least(conept, c.conept_min),
        shower,
        x["hoe"] <= c.hoe,
        at_least(x["eInvMinusPInv"], c.e_inv_minus_p_inv),
        x["lostHits"] == 0,
        x["convVeto"],
    )


def loose_electron(x: Column, c: LeptonCuts) -> Column:
    return ops.all_of(
        at_least(x["pt"], c.electron_pt),
        F.abs(x["eta"]) <= c.electron_eta,
        _near_vertex(x, c),
        x["lostHits"] <= c.electron_lost_hits,
    )


def fakeable_electron(x: Column, c: LeptonCuts) -> Column:
    by_mva = F.when(x["mvaTTH"] < c.electron_mva, _jet_btag_at_most(x, c.btag_tight)).otherwise(
        _jet_btag_at_most(x, c.btag_medium)
    )
    return ops.all_of(
        _electron_quality(x, x["conept"], c),
        at_least(x["mvaTTH"], c.electron_mva) | ((x["jetRelIso"] < c.electron_fake_rel_iso) & x["mvaNoIso_WP90"]),
        by_mva,
    )


def _tight_electron_alone(x: Column, conept: Column, c: LeptonCuts) -> Column:
    """What a tight electron needs besides its jet and its distance from muons."""
    return _electron_quality(x, conept, c) & at_least(x["mvaTTH"], c.electron_mva)


def tight_electron(x: Column, c: LeptonCuts) -> Column:
    return _tight_electron_alone(x, x["conept"], c) & _jet_btag_at_most(x, c.btag_medium)


def electron_candidate(x: Column, low: float, c: LeptonCuts = DEFAULT.leptons) -> Column:
    """Whether a stored electron's own fields let it be a tight one with a cone-pt above ``low``."""
    conept = electron_conept(x, c)
    return ops.passed(ops.all_of(loose_electron(x, c), _tight_electron_alone(x, conept, c), conept > low))


def electrons(df: DataFrame, c: LeptonCuts = DEFAULT.leptons) -> DataFrame:
    """Loose, muon-cleaned, fakeable and tight electrons, hardest cone-pt first; needs :func:`muons` first."""
    loose = coll.select(F.col("Electron"), lambda x: loose_electron(x, c))
    stamped = _stamped(loose, lambda x: electron_conept(x, c))
    df = df.withColumn("electrons", coll.sort(stamped, lambda x: x["conept"], desc=True))
    df = df.withColumn("clean_electrons", coll.clean(F.col("electrons"), F.col("muons"), c.clean_dr))
    return df.withColumns(
        {
            "fake_electrons": coll.select(F.col("clean_electrons"), lambda x: fakeable_electron(x, c)),
            "tight_electrons": coll.select(F.col("clean_electrons"), lambda x: tight_electron(x, c)),
        }
    )


# --- taus --------------------------------------------------------------------------------------------------------


def good_tau(x: Column, c: TauCuts) -> Column:
    return ops.all_of(
        above(x["pt"], c.pt),
        F.abs(x["eta"]) < c.eta,
        F.abs(x["dxy"]) <= c.dxy,
        F.abs(x["dz"]) <= c.dz,
        x["idDecayModeOldDMs"],
        x["decayMode"].isin(*c.decay_modes),
        ops.bit(x["idDeepTau2017v2p1VSjet"], c.jet_bit),
        ops.bit(x["idDeepTau2017v2p1VSe"], c.electron_bit),
        ops.bit(x["idDeepTau2017v2p1VSmu"], c.muon_bit),
    )


def taus(df: DataFrame, c: TauCuts = DEFAULT.taus) -> DataFrame:
    """Hadronic taus away from fakeable leptons."""
    good = coll.select(F.col("Tau"), lambda x: good_tau(x, c))
    off_electrons = coll.clean(good, F.col("fake_electrons"), c.clean_dr)
    return df.withColumn("taus", coll.clean(off_electrons, F.col("fake_muons"), c.clean_dr))


# --- jets --------------------------------------------------------------------------------------------------------


def lead_leptons(df: DataFrame, channel: str) -> DataFrame:
    """Axes of the leptons jets are cleaned against: two for channel DL, one for SL."""
    leading = coll.leading_two if channel == "DL" else coll.leading_one
    return df.withColumn("lead_leptons", leading(F.col("fake_electrons"), F.col("fake_muons")))


def good_jet(x: Column, c: JetCuts) -> Column:
    return ops.all_of(
        x["jetId"].bitwiseAND(F.lit(c.jet_id_mask)) != 0, at_least(x["pt"], c.pt), F.abs(x["eta"]) <= c.eta
    )


def b_jet(x: Column, c: JetCuts) -> Column:
    return above(x["btagDeepFlavB"], c.btag)


def jets(df: DataFrame, c: JetCuts = DEFAULT.jets) -> DataFrame:
    """Small jets by pt, the same by b-tag score, and b jets; needs :func:`lead_leptons` first."""
    good = coll.select(F.col("Jet"), lambda x: good_jet(x, c))
    by_pt = coll.sort(good, lambda x: x["pt"], desc=True)
    df = df.withColumn("ak4_jets", coll.keep_apart(by_pt, F.col("lead_leptons"), c.clean_dr))
    return df.withColumns(
        {
            "ak4_jets_by_btag": coll.sort(F.col("ak4_jets"), lambda x: x["btagDeepFlavB"], desc=True),
            "ak4_bjets": coll.select(F.col("ak4_jets"), lambda x: b_jet(x, c)),
        }
    )


def good_fat_jet(x: Column, c: JetCuts) -> Column:
    return ops.all_of(
        at_least(x["pt"], c.fat_pt),
        F.abs(x["eta"]) <= c.fat_eta,
        x["jetId"].bitwiseAND(F.lit(c.jet_id_mask)) != 0,
        at_least(x["msoftdrop"], c.softdrop[0]) & (x["msoftdrop"] <= c.softdrop[1]),
        F.try_divide(x["tau2"], x["tau1"]) <= c.tau21,
    )


def good_sub_jets(x: Column, c: JetCuts) -> Column:
    good = lambda s: s.isNotNull() & at_least(s["pt"], c.sub_pt) & (F.abs(s["eta"]) <= c.sub_eta)
    return good(x["subJet1"]) & good(x["subJet2"])


def b_fat_jet(x: Column, c: JetCuts) -> Column:
    tagged = lambda s: at_least(s["pt"], c.fat_btag_pt) & above(s["btagDeepB"], c.fat_btag)
    return tagged(x["subJet1"]) | tagged(x["subJet2"])


def fat_key(channel: str) -> str:
    """Field by which the fat jets of a channel are sorted."""
    return "pt" if channel == "DL" else "btagDeepB"


def fat_jets(df: DataFrame, channel: str, c: JetCuts = DEFAULT.jets) -> DataFrame:
    """Fat jets with their sub-jets attached, b-tagged fat jets and small jets away from the leading one.

    Sorted by pt for channel DL and by b-tag score for SL; needs :func:`jets` first.
    """
    own = coll.select(F.col("FatJet"), lambda x: good_fat_jet(x, c))
    sub = lambda x, of, which: coll.follow(of, x[f"{which}Idx"])
    attached = ops.bound(
        F.col("SubJet"),
        lambda of: F.transform(
            own, lambda x: x.withField("subJet1", sub(x, of, "subJet1")).withField("subJet2", sub(x, of, "subJet2"))
        ),
    )
    good = coll.select(attached, lambda x: good_sub_jets(x, c))
    ordered = coll.sort(good, lambda x: x[fat_key(channel)], desc=True)
    df = df.withColumn("ak8_jets", coll.keep_apart(ordered, F.col("lead_leptons"), c.fat_clean_dr))
    df = df.withColumn("ak8_bjets", coll.select(F.col("ak8_jets"), lambda x: b_fat_jet(x, c)))
    return df.withColumn("ak4_away", far_from(F.col("ak4_jets"), coll.at(F.col("ak8_bjets"), 0), c.away_dr))


def far_from(small: Column, fat: Column, dr: float) -> Column:
    """Items of ``small`` at distance ``> dr`` from one item; none when that item is absent."""
    return coll.select(small, lambda x: above(kin.delta_r(x, fat), dr))


def define_leptons(df: DataFrame, channel: str, cuts: Cuts = DEFAULT) -> DataFrame:
    """Lepton and tau collections for channel ``DL`` (two leptons) or ``SL`` (one lepton); no jet momentum enters."""
    if channel not in ("DL", "SL"):
        raise ValueError(f"unknown channel {channel!r}")
    df = electrons(muons(df, cuts.leptons), cuts.leptons)
    return lead_leptons(taus(df, cuts.taus), channel)


def define_objects(df: DataFrame, channel: str, cuts: Cuts = DEFAULT) -> DataFrame:
    """All derived collections of a channel."""
    return fat_jets(jets(define_leptons(df, channel, cuts), cuts.jets), channel, cuts.jets)
