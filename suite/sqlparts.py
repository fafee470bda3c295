"""Common table expressions the SQL counterparts are composed from.

They are written relationally (self-joins and row numbers), independent of the array expressions they check.
"""

from __future__ import annotations

import re

KEY = "o_orderkey"


def dr(a: str, b: str) -> str:
    """Distance of two aliased rows with eta, phi."""
    d = f"({a}phi - {b}phi)"
    dphi = f"({d} - 2 * pi() * ceil(({d} - pi()) / (2 * pi())))"
    deta = f"({a}eta - {b}eta)"
    return f"sqrt({deta} * {deta} + {dphi} * {dphi})"


def invm(a: str, b: str) -> str:
    """Invariant mass of two aliased rows with pt, eta, phi, mass."""

    def energy(p: str) -> str:
        return f"sqrt({p}pt * cosh({p}eta) * {p}pt * cosh({p}eta) + {p}mass * {p}mass)"

    transverse = f"{a}pt * {b}pt * cos({a}phi - {b}phi)"
    along = f"{a}pt * sinh({a}eta) * {b}pt * sinh({b}eta)"
    return (
        f"sqrt(greatest({a}mass * {a}mass + {b}mass * {b}mass"
        f" + 2.0 * ({energy(a)} * {energy(b)} - {transverse} - {along}), 0.0))"
    )


def binned(v: str, n: int, lo: float, hi: float) -> str:
    """Bin 1..n with 0 and n+1 for under- and overflow."""
    return (
        f"CASE WHEN {v} >= {hi} THEN {n + 1} WHEN {v} < {lo} THEN 0 "
        f"WHEN {v} IS NOT NULL THEN least(CAST(floor({n} * ({v} - {lo}) / ({hi} - {lo})) AS INTEGER) + 1, {n}) END"
    )


CTES: dict[str, str] = {}

CTES["hdr"] = """
SELECT o_orderkey,
  CASE WHEN o_orderdate < TIMESTAMP '1998-05-01' THEN '2022' ELSE '2022EE' END AS era,
  CASE o_orderpriority
    WHEN '1-URGENT' THEN (CASE o_custkey % 3 WHEN 0 THEN 'Muon' WHEN 1 THEN 'EGamma' ELSE 'MuonEG' END) || '_Run2022' ||
      (CASE WHEN o_orderdate < TIMESTAMP '1998-05-01' THEN (CASE WHEN o_custkey % 2 = 0 THEN 'C' ELSE 'D' END)
            ELSE (CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'G' END) END)
    ELSE (CASE o_orderpriority WHEN '2-HIGH' THEN 'ggHH__' WHEN '3-MEDIUM' THEN 'TTbar__'
               WHEN '4-NOT SPECIFIED' THEN 'DY__' ELSE 'WW__' END) ||
      (CASE WHEN o_orderdate < TIMESTAMP '1998-05-01' THEN '2022' ELSE '2022EE' END) END AS sample,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'data' WHEN '2-HIGH' THEN 'signal' ELSE 'mc' END AS type,
  (CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE 1 END) * (0.5::DOUBLE + (o_custkey % 10) / 10.0::DOUBLE) AS weight,
  o_orderstatus = 'F' AS trig_a, o_orderstatus = 'O' AS trig_b, o_custkey % 3 = 0 AS trig_c,
  o_totalprice / 5000.0 AS met_pt, (o_custkey % 628) / 100.0::DOUBLE - 3.14::DOUBLE AS met_phi,
  355100 + o_custkey % 20 AS run, o_orderkey % 64 AS lumi
FROM orders"""

CTES["raw"] = """
SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS size,
  (disc - 0.05::DOUBLE) * 50 AS eta, (pk % 628) / 100.0::DOUBLE - 3.14::DOUBLE AS phi,
  CASE ls WHEN 'O' THEN 1 ELSE -1 END AS charge
FROM (SELECT *, CAST(pos AS INTEGER) AS idx FROM (
  SELECT l_orderkey AS o_orderkey, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q,
    l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_returnflag AS rf, l_linestatus AS ls,
    row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos
  FROM lineitem))"""

CTES["ev"] = """
SELECT * FROM hdr"""

CTES["items"] = """
SELECT o_orderkey, idx,
  CASE rf WHEN 'R' THEN 'electron' WHEN 'A' THEN 'muon' ELSE 'jet' END AS kind,
  q AS pt, eta, phi, tax AS mass, charge, price / 105000.0 AS btag, sk AS mask,
  CASE WHEN ln - 1 >= 0 AND ln - 1 < size THEN ln - 1 ELSE -1 END AS ref
FROM raw"""

_LEPTON = """o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY idx) - 1 AS idx,
  q AS pt, eta, phi, tax AS mass, charge, (sk % 60) / 1000.0::DOUBLE AS dxy, (pk % 23) / 200.0::DOUBLE AS dz,
  CAST(sk % 10 AS DOUBLE) AS sip3d, (pk % 9) / 20.0::DOUBLE AS iso, (sk % 12) / 10.0::DOUBLE AS rel,
  CASE WHEN pk % 4 = 0 AND ln - 1 < size THEN ln - 1 ELSE -1 END AS jet_idx"""

CTES["jet"] = """
SELECT o_orderkey, idx, q * 2 AS pt, eta, phi, tax * 100 AS mass,
  CASE WHEN sk % 8 = 0 THEN 1 ELSE 2 + 4 * (pk % 2) END AS jet_id, price / 105000.0 AS btag
FROM raw"""

CTES["mu_all"] = f"""
SELECT m.*, CASE WHEN medium AND mva > 0.50 THEN pt ELSE 0.9::DOUBLE * pt * (1.0 + rel) END AS conept,
  0.9::DOUBLE * pt * (1.0 + rel) AS soft, j.btag AS jbtag
FROM (SELECT {_LEPTON}, 1 - (pk % 101) / 150.0::DOUBLE AS mva, pk % 20 <> 0 AS loose, pk % 5 <> 0 AS medium
      FROM raw WHERE rf = 'A') m
LEFT JOIN (SELECT o_orderkey, idx AS jidx, btag FROM jet) j
  ON m.o_orderkey = j.o_orderkey AND m.jet_idx = j.jidx"""

CTES["mu"] = """
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY conept DESC, idx) - 1 AS pos,
  conept >= 10 AND (jbtag IS NULL OR jbtag <= 0.2770 OR (rel < 0.8 AND jbtag <
     least(greatest(0.0::DOUBLE, soft - 20.0) / 25.0, 1.0) * 0.0494::DOUBLE
     + (1 - least(greatest(0.0::DOUBLE, soft - 20.0) / 25.0, 1.0)) * 0.2770::DOUBLE)) AS fake,
  conept >= 10 AND (jbtag IS NULL OR jbtag <= 0.2770) AND mva >= 0.50 AND medium AS tight
FROM mu_all
WHERE pt >= 5 AND abs(eta) <= 2.4 AND abs(dxy) <= 0.05 AND abs(dz) <= 0.1 AND iso <= 0.4 AND sip3d <= 8 AND loose"""

CTES["el_all"] = f"""
SELECT m.*, CASE WHEN mva > 0.30 THEN pt ELSE 0.9::DOUBLE * pt * (1.0 + rel) END AS conept, j.btag AS jbtag
FROM (SELECT {_LEPTON}, 1 - (pk % 101) / 120.0::DOUBLE AS mva,
        CASE ln WHEN 7 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS lost, (sk % 5 - 2) / 100.0::DOUBLE AS deta_sc,
        (pk % 8) / 1000.0::DOUBLE + 0.005::DOUBLE AS sieie, (sk % 11) / 100.0::DOUBLE + 0.005::DOUBLE AS hoe,
        (pk % 6) / 100.0::DOUBLE - 0.045::DOUBLE AS einv, sk % 25 <> 0 AS conv, pk % 3 <> 0 AS wp90
      FROM raw WHERE rf = 'R') m
LEFT JOIN (SELECT o_orderkey, idx AS jidx, btag FROM jet) j
  ON m.o_orderkey = j.o_orderkey AND m.jet_idx = j.jidx"""

CTES["el_loose"] = """
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY conept DESC, idx) - 1 AS lpos
FROM el_all
WHERE pt >= 7 AND abs(eta) <= 2.5 AND abs(dxy) <= 0.05 AND abs(dz) <= 0.1 AND sip3d <= 8 AND iso <= 0.4 AND lost <= 1"""

CTES["el"] = f"""
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY lpos) - 1 AS pos,
  good AND (mva >= 0.30 OR (rel < 0.7 AND wp90))
    AND (jbtag IS NULL OR jbtag <= CASE WHEN mva < 0.30 THEN 0.7264 ELSE 0.2770 END) AS fake,
  good AND mva >= 0.30 AND (jbtag IS NULL OR jbtag <= 0.2770) AS tight
FROM (SELECT *, conept >= 10 AND hoe <= 0.10 AND einv >= -0.04 AND lost = 0 AND conv
        AND ((abs(eta + deta_sc) <= 1.479 AND sieie <= 0.011) OR (abs(eta + deta_sc) > 1.479 AND sieie <= 0.030)) AS good
      FROM el_loose e
      WHERE NOT EXISTS (SELECT 1 FROM mu m WHERE m.o_orderkey = e.o_orderkey
                        AND {dr("e.", "m.")} <= 0.3))"""

CTES["fake_mu"] = """
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS fpos FROM mu WHERE fake"""
CTES["fake_el"] = """
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS fpos FROM el WHERE fake"""
CTES["tight_mu"] = """
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS tpos FROM mu WHERE tight"""
CTES["tight_el"] = """
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS tpos FROM el WHERE tight"""

CTES["tau"] = f"""
SELECT * FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY idx) - 1 AS idx,
    q AS pt, eta, phi, (sk % 60) / 1000.0::DOUBLE AS dxy, (pk % 23) / 100.0::DOUBLE AS dz, sk % 10 <> 0 AS old_dm,
    CASE ln WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 10 ELSE 11 END AS dm,
    (sk + pk) % 32 AS vs_jet, CASE WHEN ln = 4 THEN 2 ELSE 3 END AS vs_e, 1 + sk % 3 AS vs_mu
  FROM raw WHERE pk % 7 = 0) t
WHERE pt > 20 AND abs(eta) < 2.3 AND abs(dxy) <= 1000 AND abs(dz) <= 0.2 AND old_dm AND dm IN (0, 1, 2, 10, 11)
  AND (vs_jet >> 4) & 1 = 1 AND vs_e & 1 = 1 AND vs_mu & 1 = 1
  AND NOT EXISTS (SELECT 1 FROM fake_el e WHERE e.o_orderkey = t.o_orderkey
                  AND {dr("t.", "e.")} <= 0.3)
  AND NOT EXISTS (SELECT 1 FROM fake_mu m WHERE m.o_orderkey = t.o_orderkey
                  AND {dr("t.", "m.")} <= 0.3)"""

_two = ", ".join(
    f"max(CASE WHEN f = '{f}' AND p = {p} THEN {c} END) AS {f}{p}{c}"
    for f in "em"
    for p in (0, 1)
    for c in ("conept", "eta", "phi")
)
CTES["lead_wide"] = f"""
SELECT o_orderkey, count_if(f = 'e') AS ne, count_if(f = 'm') AS nm, {_two}
FROM (SELECT o_orderkey, 'e' AS f, fpos AS p, conept, eta, phi FROM fake_el
      UNION ALL SELECT o_orderkey, 'm', fpos, conept, eta, phi FROM fake_mu)
GROUP BY o_orderkey"""


def _case2(which: int) -> str:
    """Name of the first (0) or second (1) lepton jets are cleaned against in the two-lepton channel."""
    pick = lambda a, b: f"'{(a, b)[which]}'"
    return f"""CASE
      WHEN ne >= 2 AND nm = 0 THEN {pick('e0', 'e1')}
      WHEN ne = 0 AND nm >= 2 THEN {pick('m0', 'm1')}
      WHEN ne = 1 AND nm = 1 THEN {pick('e0', 'm0')}
      WHEN ne >= 1 AND nm >= 1 AND e0conept > m0conept THEN
        CASE WHEN ne = 1 THEN {pick('e0', 'm0')} WHEN e1conept > m0conept THEN {pick('e0', 'e1')} ELSE {pick('e0', 'm0')} END
      WHEN ne >= 1 AND nm >= 1 THEN
        CASE WHEN nm = 1 THEN {pick('m0', 'e0')} WHEN m1conept > e0conept THEN {pick('m0', 'm1')} ELSE {pick('m0', 'e0')} END
    END"""


def _axis_of(name: str) -> str:
    return ", ".join(
        f"CASE {name} " + " ".join(f"WHEN '{l}' THEN {l}{c}" for l in ("e0", "e1", "m0", "m1")) + f" END AS {c}"
        for c in ("eta", "phi")
    )


CTES["leads_dl"] = f"""
SELECT o_orderkey, {_axis_of('w')} FROM (
  SELECT *, {_case2(0)} AS w FROM lead_wide UNION ALL SELECT *, {_case2(1)} AS w FROM lead_wide)
WHERE w IS NOT NULL"""
CTES["leads_sl"] = f"""
SELECT o_orderkey, {_axis_of('w')} FROM (
  SELECT *, CASE WHEN ne >= 1 AND nm = 0 THEN 'e0' WHEN ne = 0 AND nm >= 1 THEN 'm0'
                 WHEN e0conept >= m0conept THEN 'e0' ELSE 'm0' END AS w FROM lead_wide)"""

for _ch in ("dl", "sl"):
    CTES[f"ak4_{_ch}"] = f"""
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pt DESC, idx) - 1 AS pos FROM jet j
WHERE jet_id & 2 <> 0 AND pt >= 25 AND abs(eta) <= 2.4
  AND NOT EXISTS (SELECT 1 FROM leads_{_ch} l WHERE l.o_orderkey = j.o_orderkey
                  AND NOT {dr("j.", "l.")} >= 0.4)"""
    CTES[f"b4_{_ch}"] = f"""
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS bpos FROM ak4_{_ch} WHERE btag > 0.2770"""
    _sort = "pt" if _ch == "dl" else "btag"
    CTES[f"ak8_{_ch}"] = f"""
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY {_sort} DESC, idx) - 1 AS pos,
  (s1pt >= 30 AND s1b > 0.4184) OR (s2pt >= 30 AND s2b > 0.4184) AS isb
FROM fat f
WHERE pt >= 200 AND abs(eta) <= 2.4 AND jet_id & 2 <> 0 AND s1pt >= 20 AND s2pt >= 20
  AND abs(s1eta) <= 2.4 AND abs(s2eta) <= 2.4 AND msd >= 30 AND msd <= 210 AND tau1 > 0 AND tau2 / tau1 <= 0.75
  AND NOT EXISTS (SELECT 1 FROM leads_{_ch} l WHERE l.o_orderkey = f.o_orderkey
                  AND NOT {dr("f.", "l.")} >= 0.8)"""
    CTES[f"b8_{_ch}"] = f"""
SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS bpos FROM ak8_{_ch} WHERE isb"""
    CTES[f"away_{_ch}"] = f"""
SELECT j.* FROM ak4_{_ch} j JOIN b8_{_ch} f ON f.o_orderkey = j.o_orderkey AND f.bpos = 0
WHERE {dr("j.", "f.")} > 1.2"""

CTES["sub"] = """
SELECT o_orderkey, idx AS sidx, q * 4 AS pt, eta, phi, tax * 50 AS mass, 1 - price / 105000.0 AS b FROM raw"""
CTES["fat"] = """
SELECT f.*, a.pt AS s1pt, a.eta AS s1eta, a.phi AS s1phi, a.mass AS s1mass, a.b AS s1b,
  c.pt AS s2pt, c.eta AS s2eta, c.phi AS s2phi, c.mass AS s2mass, c.b AS s2b
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY idx) - 1 AS idx,
        q * 10 AS pt, eta, phi, q AS mass, CASE WHEN sk % 8 = 0 THEN 1 ELSE 2 + 4 * (pk % 2) END AS jet_id,
        price / 500.0 AS msd, (pk % 10) / 10.0::DOUBLE AS tau1, (sk % 8) / 12.0::DOUBLE AS tau2,
        price / 105000.0 AS btag, ln - 5 AS i1, ln - 4 AS i2
      FROM raw WHERE ln >= 5) f
LEFT JOIN sub a ON a.o_orderkey = f.o_orderkey AND a.sidx = f.i1
LEFT JOIN sub c ON c.o_orderkey = f.o_orderkey AND c.sidx = f.i2"""


def _pairs(name: str, left: str, right: str, order: tuple[str, str]) -> str:
    same = left == right
    extra = "AND a.pos < b.pos" if same else ""
    cols = ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in ("pt", "eta", "phi", "mass", "charge", "conept"))
    return f"""
SELECT '{name}' AS f, a.o_orderkey, {cols}, {invm("a.", "b.")} AS m,
  row_number() OVER (PARTITION BY a.o_orderkey ORDER BY a.{order[0]}, b.{order[1]}) - 1 AS rk
FROM {left} a JOIN {right} b ON a.o_orderkey = b.o_orderkey {extra} AND a.charge <> b.charge"""


CTES["loose_pairs"] = (
    _pairs("ee", "el", "el", ("pos", "pos"))
    + " UNION ALL "
    + _pairs("mm", "mu", "mu", ("pos", "pos"))
    + " UNION ALL "
    + _pairs("em", "el", "mu", ("pos", "pos"))
)
CTES["tight_pairs"] = (
    _pairs("ee", "tight_el", "tight_el", ("pos", "pos"))
    + " UNION ALL "
    + _pairs("mm", "tight_mu", "tight_mu", ("pos", "pos"))
    + " UNION ALL "
    + _pairs("em", "tight_el", "tight_mu", ("pos", "pos"))
)
CTES["veto"] = """
SELECT o_orderkey, bool_or(m < 12) AS low, coalesce(bool_or(abs(m - 91.1876) <= 10) FILTER (f <> 'em'), false) AS z
FROM loose_pairs GROUP BY o_orderkey"""

_first = ", ".join(
    f"max(CASE WHEN f = '{f}' AND rk = 0 THEN {p}_{c} END) AS {f}_{p}_{c}"
    for f in ("ee", "mm", "em")
    for p in "ab"
    for c in ("pt", "eta", "phi", "mass", "charge", "conept")
)
CTES["tight_wide"] = f"""
SELECT o_orderkey, {', '.join(f"count_if(f = '{f}') AS n_{f}" for f in ('ee', 'mm', 'em'))}, {_first}
FROM tight_pairs GROUP BY o_orderkey"""

_lep0 = ", ".join(f"max(CASE WHEN tpos = {i} THEN {c} END) AS {{p}}{i}_{c}" for i in (0, 1) for c in ("pt", "eta", "phi", "conept"))
CTES["te_wide"] = f"SELECT o_orderkey, count(*) AS n_te, {_lep0.format(p='te')} FROM tight_el GROUP BY o_orderkey"
CTES["tm_wide"] = f"SELECT o_orderkey, count(*) AS n_tm, {_lep0.format(p='tm')} FROM tight_mu GROUP BY o_orderkey"
CTES["tau_wide"] = "SELECT o_orderkey, count(*) AS n_tau FROM tau GROUP BY o_orderkey"

_FATC = ("pt", "eta", "phi", "s1pt", "s1eta", "s1phi", "s1mass", "s2pt", "s2eta", "s2phi", "s2mass")
for _ch in ("dl", "sl"):
    _jets = ", ".join(f"max(CASE WHEN pos = {i} THEN {c} END) AS j{i}_{c}" for i in (0, 1) for c in ("pt", "eta", "phi"))
    CTES[f"j_{_ch}"] = f"SELECT o_orderkey, count(*) AS n_j, {_jets} FROM ak4_{_ch} GROUP BY o_orderkey"
    _b = ", ".join(f"max(CASE WHEN bpos = 0 THEN {c} END) AS b0_{c}" for c in ("pt", "eta", "phi"))
    CTES[f"bj_{_ch}"] = f"SELECT o_orderkey, count(*) AS n_b, {_b} FROM b4_{_ch} GROUP BY o_orderkey"
    _f = ", ".join(f"max(CASE WHEN pos = 0 THEN {c} END) AS f0_{c}" for c in _FATC)
    CTES[f"fj_{_ch}"] = f"SELECT o_orderkey, count(*) AS n_f, {_f} FROM ak8_{_ch} GROUP BY o_orderkey"
    _g = ", ".join(f"max(CASE WHEN bpos = 0 THEN {c} END) AS g0_{c}" for c in _FATC)
    CTES[f"bf_{_ch}"] = f"SELECT o_orderkey, count(*) AS n_g, {_g} FROM b8_{_ch} GROUP BY o_orderkey"
    CTES[f"aw_{_ch}"] = f"SELECT o_orderkey, count(*) AS n_a FROM away_{_ch} GROUP BY o_orderkey"
    _zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_te", "n_tm", "n_tau", "n_j", "n_b", "n_f", "n_g", "n_a", "n_ee", "n_mm", "n_em"))
    CTES[f"wide_{_ch}"] = f"""
SELECT * REPLACE ({_zero}), NOT coalesce(low, false) AS ok_low, NOT coalesce(z, false) AS ok_z
FROM ev LEFT JOIN te_wide USING ({KEY}) LEFT JOIN tm_wide USING ({KEY}) LEFT JOIN tau_wide USING ({KEY})
  LEFT JOIN j_{_ch} USING ({KEY}) LEFT JOIN bj_{_ch} USING ({KEY}) LEFT JOIN fj_{_ch} USING ({KEY})
  LEFT JOIN bf_{_ch} USING ({KEY}) LEFT JOIN aw_{_ch} USING ({KEY}) LEFT JOIN veto USING ({KEY})
  LEFT JOIN tight_wide USING ({KEY})"""


def _hard(f: str) -> str:
    a, b = f"{f}_a_conept", f"{f}_b_conept"
    return f"coalesce({a} > 15 AND {b} > 15 AND ({a} > 25 OR {b} > 25), false)"


def _only(f: str) -> str:
    return " AND ".join(f"n_{g} = {int(g == f)}" for g in ("ee", "mm", "em"))


_FL = {"ee": ("ee", "elelptSel", "OSoutZelelSel"), "mumu": ("mm", "mumuptSel", "OSoutZmumuSel"),
       "emu": ("em", "elmuptSel", "OSoutZelmuSel")}
DL_TREE: list[tuple[str, int, str]] = [("noSel", 0, "true")]
for _n, (_f2, _p, _o) in _FL.items():
    _hardcut = _hard(_f2)
    _off = f"{_hardcut} AND ok_low AND ok_z"
    _one = f"{_off} AND {_only(_f2)}"
    DL_TREE += [(_p, 1, _hardcut), (_o, 2, _off), (f"dileptonCut_{_n}", 3, _one),
                (f"DL_boosted_{_n}", 4, f"{_one} AND n_g >= 1"),
                (f"DL_resolved_{_n}", 4, f"{_one} AND n_j >= 2 AND n_b >= 1 AND n_f = 0")]
_start = "ok_low AND ok_z AND n_tau = 0"
_res, _boo = f"{_start} AND n_j >= 3 AND n_b >= 1 AND n_g = 0", f"{_start} AND n_g >= 1 AND n_a >= 1"
_e1 = "coalesce(te0_conept > 32, false) AND n_te = 1 AND n_tm = 0"
_m1 = "coalesce(tm0_conept > 25, false) AND n_te = 0 AND n_tm = 1"
SL_TREE: list[tuple[str, int, str]] = [("noSel", 0, "true"), ("OSoutZsel", 1, _start)]
for _n, _c in (("SL_resolved", _res), ("SL_boosted", _boo)):
    SL_TREE += [(_n, 2, _c), (f"{_n}_e", 3, f"{_c} AND {_e1}"), (f"{_n}_mu", 3, f"{_c} AND {_m1}")]

for _ch, _tree in (("dl", DL_TREE), ("sl", SL_TREE)):
    CTES[f"sel_{_ch}"] = f"SELECT *, {', '.join(f'({c}) AS sel_{n}' for n, _, c in _tree)} FROM wide_{_ch}"

NEEDS = {
    "ev": ("hdr", "raw"), "items": ("raw",), "jet": ("raw",), "mu_all": ("raw", "jet"), "mu": ("mu_all",),
    "el_all": ("raw", "jet"), "el_loose": ("el_all",), "el": ("el_loose", "mu"), "fake_mu": ("mu",), "fake_el": ("el",),
    "tight_mu": ("mu",), "tight_el": ("el",), "tau": ("raw", "fake_el", "fake_mu"), "lead_wide": ("fake_el", "fake_mu"),
    "leads_dl": ("lead_wide",), "leads_sl": ("lead_wide",), "sub": ("raw",), "fat": ("raw", "sub"),
    "loose_pairs": ("el", "mu"), "tight_pairs": ("tight_el", "tight_mu"), "veto": ("loose_pairs",),
    "tight_wide": ("tight_pairs",), "te_wide": ("tight_el",), "tm_wide": ("tight_mu",), "tau_wide": ("tau",),
}
for _ch in ("dl", "sl"):
    NEEDS |= {
        f"ak4_{_ch}": ("jet", f"leads_{_ch}"), f"b4_{_ch}": (f"ak4_{_ch}",), f"ak8_{_ch}": ("fat", f"leads_{_ch}"),
        f"b8_{_ch}": (f"ak8_{_ch}",), f"away_{_ch}": (f"ak4_{_ch}", f"b8_{_ch}"), f"j_{_ch}": (f"ak4_{_ch}",),
        f"bj_{_ch}": (f"b4_{_ch}",), f"fj_{_ch}": (f"ak8_{_ch}",), f"bf_{_ch}": (f"b8_{_ch}",),
        f"aw_{_ch}": (f"away_{_ch}",),
        f"wide_{_ch}": ("ev", "te_wide", "tm_wide", "tau_wide", f"j_{_ch}", f"bj_{_ch}", f"fj_{_ch}", f"bf_{_ch}",
                        f"aw_{_ch}", "veto", "tight_wide"),
        f"sel_{_ch}": (f"wide_{_ch}",),
    }


_JET_SIDE = ("ak4", "b4", "ak8", "b8", "away", "j", "bj", "fj", "bf", "aw", "wide", "sel")


def with_jets(channel: str, suffix: str, jet: str, fat: str, ev: str, needs: tuple[str, ...] = ()) -> str:
    """Add a channel's expressions for other ``jet``, ``fat`` and ``ev`` rows; returns the name of the last, its events."""
    names = ["jet", "fat", "ev", *[f"{p}_{channel}" for p in _JET_SIDE]]
    swap = re.compile(rf"\b({'|'.join(names)})\b(?=\s|$)")
    for name, sql in (("jet", jet), ("fat", fat), ("ev", ev)):
        CTES[name + suffix], NEEDS[name + suffix] = sql, (name, *needs)
    for name in names[3:]:
        CTES[name + suffix] = swap.sub(lambda m: m[0] + suffix, CTES[name])
        NEEDS[name + suffix] = tuple(n + suffix if n in names else n for n in NEEDS[name])
    return names[-1] + suffix


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """``body`` preceded by the named expressions and all they build on; ``extra`` adds query-specific ones."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body

CTES["ml"] = """
SELECT h.*, h.sample AS process, o.o_totalprice / 1000.0 AS pt, o.o_totalprice / 100000.0 - 2.5::DOUBLE AS phi,
  ((o.o_custkey * 7 + o.o_orderkey) % 500 + CASE WHEN o.o_orderpriority = '2-HIGH' THEN 250 ELSE 0 END + 1) / 752.0::DOUBLE AS score,
  CAST(1 + o.o_custkey % 5 AS DOUBLE) AS w_roc, CAST(1 + o.o_orderkey % 3 AS DOUBLE) AS w_sig,
  CASE WHEN contains(h.sample, 'HH') THEN 'HH' ELSE 'background' END AS tag
FROM hdr h JOIN orders o USING (o_orderkey)"""
NEEDS["ml"] = ("hdr",)
