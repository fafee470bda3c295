"""The analysis's plot catalogue: 156 one-dimensional histograms in 59 families.

Names, selections, variables and binnings are fixed values of the analysis; variants per lepton flavour are generated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventspark.functions import coll, kin
from eventspark.operators.hist import Plot
from eventspark.operators.mlprep import SCORE_EDGES

PT_300 = (100, 0.0, 300.0)
PT_500 = (100, 0.0, 500.0)
SUB_PT = (50, 0.0, 500.0)
ETA = (30, -3.0, 3.0)
DR = (35, 0.0, 7.0)
COUNT_3 = (3, 0.0, 3.0)
COUNT_10 = (10, 0.0, 10.0)
COUNT_15 = (15, 0.0, 15.0)


def _n(column: str) -> Column:
    return F.size(column)


def _item(column: str, i: int) -> Column:
    return coll.at(F.col(column), i)


def _dl_leptons(flavour: str) -> dict[str, Column]:
    """Members of the first pair as stored (``l1``, ``l2``) and by pt (``lead``, ``sub``) for the mixed flavour."""
    pair = F.col({"ee": "first_ee", "mumu": "first_mm", "emu": "first_em"}[flavour])
    l1, l2 = pair["l1"], pair["l2"]
    lead, sub = (F.col("em_lead"), F.col("em_sub")) if flavour == "emu" else (l1, l2)
    return {"l1": l1, "l2": l2, "lead": lead, "sub": sub}


def _dl_boosted(lep: dict[str, Column]) -> dict[str, tuple[Column, tuple[int, float, float]]]:
    fat, bfat = _item("ak8_jets", 0), _item("ak8_bjets", 0)
    return {
        "nfatJet": (_n("ak8_jets"), COUNT_10),
        "fatJet_pt": (fat["pt"], (100, 200.0, 800.0)),
        "subjet1_pt": (fat["subJet1"]["pt"], SUB_PT),
        "subjet2_pt": (fat["subJet2"]["pt"], SUB_PT),
        "fatJet_eta": (fat["eta"], ETA),
        "InvM": (kin.inv_mass(lep["l1"], lep["l2"]), (60, 0.0, 300.0)),
        "totalCharge": (kin.total_charge(lep["l1"], lep["l2"]), (5, -2.5, 2.5)),
        "InvM_jj": (kin.inv_mass(bfat["subJet1"], bfat["subJet2"]), (100, 0.0, 200.0)),
        "leadingLepton_pt": (lep["lead"]["pt"], PT_300),
        "subleadingLepton_pt": (lep["sub"]["pt"], PT_300),
        "leadingLepton_eta": (lep["lead"]["eta"], ETA),
        "subleadingLepton_eta": (lep["sub"]["eta"], ETA),
        "DR_leptons": (kin.delta_r(lep["l1"], lep["l2"]), DR),
        "DR_leadingleptonANDak8bjet": (kin.delta_r(lep["lead"], fat), DR),
        "DR_subleadingleptonANDak8bjet": (kin.delta_r(lep["sub"], fat), DR),
        "nElectrons": (_n("tight_electrons"), COUNT_3),
        "nMuons": (_n("tight_muons"), COUNT_3),
    }


def _dl_resolved(lep: dict[str, Column]) -> dict[str, tuple[Column, tuple[int, float, float]]]:
    b, j1, j2 = _item("ak4_bjets", 0), _item("ak4_jets", 0), _item("ak4_jets", 1)
    return {
        "nAK4bJets": (_n("ak4_bjets"), COUNT_10),
        "ak4BJet_pt": (b["pt"], PT_500),
        "ak4BJet_eta": (b["eta"], ETA),
        "nak4Jets": (_n("ak4_jets"), COUNT_15),
        "leadingJet_pt": (j1["pt"], PT_500),
        "leadingJet_eta": (j1["eta"], ETA),
        "subleadingJet_pt": (j2["pt"], PT_500),
        "subleadingJet_eta": (j2["eta"], ETA),
        "DR_jets": (kin.delta_r(j1, j2), DR),
        "InvM": (kin.inv_mass(lep["l1"], lep["l2"]), PT_300),
        "totalCharge": (kin.total_charge(lep["l1"], lep["l2"]), (5, -2.5, 2.5)),
        "leadingLepton_pt": (lep["lead"]["pt"], PT_300),
        "subleadingLepton_pt": (lep["sub"]["pt"], (50, 0.0, 200.0)),
        "leadingLepton_eta": (lep["lead"]["eta"], ETA),
        "subleadingLepton_eta": (lep["sub"]["eta"], ETA),
        "DR_leptons": (kin.delta_r(lep["l1"], lep["l2"]), DR),
        "DR_leadingleptonANDak4bjet": (kin.delta_r(lep["lead"], b), DR),
        "DR_subleadingleptonANDak4bjet": (kin.delta_r(lep["sub"], b), DR),
        "nElectrons": (_n("tight_electrons"), COUNT_3),
        "nMuons": (_n("tight_muons"), COUNT_3),
    }


def _sl_boosted(lep: Column) -> dict[str, tuple[Column, tuple[int, float, float]]]:
    fat, bfat = _item("ak8_jets", 0), _item("ak8_bjets", 0)
    sub1, sub2 = bfat["subJet1"], bfat["subJet2"]
    return {
        "nfatJet": (_n("ak8_bjets"), COUNT_10),
        "fatJet_pt": (bfat["pt"], (400, 200.0, 1000.0)),
        "subjet1_pt": (sub1["pt"], SUB_PT),
        "subjet2_pt": (sub2["pt"], SUB_PT),
        "fatJet_eta": (bfat["eta"], ETA),
        "subjet1_eta": (sub1["eta"], ETA),
        "subjet2_eta": (sub2["eta"], ETA),
        "InvM_jj": (kin.inv_mass(sub1, sub2), (100, 0.0, 200.0)),
        "lepton_pt": (lep["pt"], PT_300),
        "lepton_eta": (lep["eta"], ETA),
        "DR_leptonANDak8bjet": (kin.delta_r(lep, fat), DR),
    }


def _sl_resolved(lep: Column) -> dict[str, tuple[Column, tuple[int, float, float]]]:
    b, j1, j2 = _item("ak4_bjets", 0), _item("ak4_jets", 0), _item("ak4_jets", 1)
    return {
        "nJets": (_n("ak4_bjets"), COUNT_15),
        "leadingJet_pt": (b["pt"], PT_500),
        "leadingJet_eta": (b["eta"], ETA),
        "subleadingJet_pt": (j2["pt"], PT_500),
        "subleadingJet_eta": (j2["eta"], ETA),
        "DR_jets": (kin.delta_r(j1, j2), (100, 0.0, 10.0)),
        "DR_leptonANDak4bjet": (kin.delta_r(lep, b), DR),
        "lepton_pt": (lep["pt"], PT_300),
        "lepton_eta": (lep["eta"], ETA),
    }


def _family(prefix: str, suffix: str, variables: dict) -> list[Plot]:
    return [
        Plot(f"{prefix}_{name}_{suffix}", f"sel_{prefix}_{suffix}", var, *binning, title=f"{prefix} {suffix}")
        for name, (var, binning) in variables.items()
    ]


def dl_plots() -> list[Plot]:
    """111 two-lepton plots."""
    out = []
    for flavour in ("ee", "mumu", "emu"):
        lep = _dl_leptons(flavour)
        out += _family("DL_boosted", flavour, _dl_boosted(lep)) + _family("DL_resolved", flavour, _dl_resolved(lep))
    return out


def score_plots(score: Column) -> list[Plot]:
    """5 plots that need a classifier score: the score itself and the di-electron mass per category."""
    lep = _dl_leptons("ee")
    mass = kin.inv_mass(lep["l1"], lep["l2"])
    out = [Plot("dnn_score", "sel_DL_resolved_ee", score, 40, 0.0, 1.0, blinded=(0.25, 0.999))]
    out += [
        Plot(f"DL_resolved_InvM_ee_DNNcat{i}", f"sel_DNNcat{i}", mass, *PT_300) for i in range(1, len(SCORE_EDGES) + 1)
    ]
    return out


def sl_plots() -> list[Plot]:
    """40 one-lepton plots."""
    out = []
    for suffix, leptons in (("e", "tight_electrons"), ("mu", "tight_muons")):
        lep = _item(leptons, 0)
        out += _family("SL_boosted", suffix, _sl_boosted(lep)) + _family("SL_resolved", suffix, _sl_resolved(lep))
    return out
