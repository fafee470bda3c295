"""Kinematics of (pt, eta, phi, mass) items as plain column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def four_vector(item: Column, *extra: str) -> Column:
    """Common struct of any item, so items of different kinds can meet in one expression."""
    return F.struct(*[item[c].alias(c) for c in ("pt", "eta", "phi", "mass", *extra)])


def delta_phi(phi1: Column, phi2: Column) -> Column:
    """phi1 - phi2 brought into (-pi, pi]."""
    d = phi1 - phi2
    return d - F.lit(TWO_PI) * F.ceil((d - F.lit(math.pi)) / F.lit(TWO_PI))


def delta_r(a: Column, b: Column) -> Column:
    deta = a["eta"] - b["eta"]
    dphi = delta_phi(a["phi"], b["phi"])
    return F.sqrt(deta * deta + dphi * dphi)


def energy(a: Column) -> Column:
    p = a["pt"] * F.cosh(a["eta"])
    return F.sqrt(p * p + a["mass"] * a["mass"])


def inv_mass(a: Column, b: Column) -> Column:
    """Invariant mass of two items; a negative m^2 from rounding counts as zero, an absent item gives NULL."""
    transverse = a["pt"] * b["pt"] * F.cos(a["phi"] - b["phi"])
    longitudinal = a["pt"] * F.sinh(a["eta"]) * b["pt"] * F.sinh(b["eta"])
    m2 = (
        a["mass"] * a["mass"]
        + b["mass"] * b["mass"]
        + F.lit(2.0) * (energy(a) * energy(b) - transverse - longitudinal)
    )
    return F.sqrt(F.abs((m2 + F.abs(m2)) * 0.5))


def total_charge(a: Column, b: Column) -> Column:
    return a["charge"] + b["charge"]
