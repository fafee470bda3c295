"""Hand-written collision events stored as parallel arrays, the way event files hold them."""

from __future__ import annotations

import math

import pyarrow as pa

from eventspark.sources.events_io import FIELDS, zip_collections

DEFAULTS = {
    "Muon": dict(pt=30.0, eta=0.0, phi=0.0, mass=0.1, charge=1, pdgId=-13, dxy=0.0, dz=0.0, sip3d=1.0,
                 miniPFRelIso_all=0.0, mvaTTH=0.9, jetRelIso=0.0, jetIdx=-1, looseId=True, mediumId=True),
    "Electron": dict(pt=30.0, eta=0.0, phi=0.0, mass=0.0, charge=1, pdgId=-11, dxy=0.0, dz=0.0, sip3d=1.0,
                     miniPFRelIso_all=0.0, lostHits=0, deltaEtaSC=0.0, sieie=0.005, hoe=0.01, eInvMinusPInv=0.0,
                     mvaTTH=0.9, jetRelIso=0.0, jetIdx=-1, convVeto=True, mvaNoIso_WP90=True),
    "Jet": dict(pt=50.0, eta=0.0, phi=0.0, mass=5.0, jetId=6, btagDeepFlavB=0.1),
    "FatJet": dict(pt=300.0, eta=0.0, phi=0.0, mass=100.0, jetId=6, msoftdrop=100.0, tau1=0.5, tau2=0.2,
                   btagDeepB=0.5, subJet1Idx=0, subJet2Idx=1),
    "SubJet": dict(pt=100.0, eta=0.0, phi=0.0, mass=5.0, btagDeepB=0.9),
    "Tau": dict(pt=30.0, eta=0.0, phi=0.0, mass=1.7, dxy=0.0, dz=0.0, idDecayModeOldDMs=True, decayMode=0,
                idDeepTau2017v2p1VSjet=31, idDeepTau2017v2p1VSe=1, idDeepTau2017v2p1VSmu=1),
    "GenPart": dict(pt=100.0, pdgId=6, statusFlags=8192),
}


def _type(value) -> pa.DataType:
    if isinstance(value, bool):
        return pa.bool_()
    return pa.int32() if isinstance(value, int) else pa.float64()


def item(kind: str, **changes) -> dict:
    unknown = set(changes) - set(FIELDS[kind])
    assert not unknown, unknown
    return {**DEFAULTS[kind], **changes}


def muon(**c):
    return "Muon", item("Muon", **c)


def electron(**c):
    return "Electron", item("Electron", **c)


def jet(**c):
    return "Jet", item("Jet", **c)


def fat_jet(**c):
    return "FatJet", item("FatJet", **c)


def sub_jet(**c):
    return "SubJet", item("SubJet", **c)


def tau(**c):
    return "Tau", item("Tau", **c)


def top(**c):
    return "GenPart", item("GenPart", **c)


def events(spark, *rows, scalars: dict[str, list] | None = None):
    """One event per argument, each a list of items; ``event`` numbers them from 0."""
    columns: dict[str, pa.Array] = {"event": pa.array(range(len(rows)), pa.int64())}
    for name, values in (scalars or {}).items():
        columns[name] = pa.array(values)
    for kind, fields in FIELDS.items():
        for f in fields:
            values = [[it[f] for k, it in row if k == kind] for row in rows]
            columns[f"{kind}_{f}"] = pa.array(values, pa.list_(_type(DEFAULTS[kind][f])))
    return zip_collections(spark.createDataFrame(pa.table(columns)))


def column(df, expr):
    """Values of one expression in event order."""
    from pyspark.sql import functions as F

    c = F.expr(expr) if isinstance(expr, str) else expr
    return [r[1] for r in df.select("event", c.alias("v")).orderBy("event").collect()]


NAN = math.nan
