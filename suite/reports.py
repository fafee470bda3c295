"""Queries for histograms and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventspark.functions import coll, kin
from eventspark.operators import hist, report
from eventspark.plans import fixture as fx
from suite.physics import (
    CATALOG_SQL,
    DL_FINAL,
    SCALES_SQL,
    SCORE_SQL,
    dl_channel,
    promising,
    scale_table,
    score_expr,
    sl_channel,
)
from suite.registry import query
from suite.sqlparts import binned, dr, invm, with_ctes

CONTENT_SQL = (
    "round(sum(weight), 4) + 0.0 AS sumw, round(sum(weight * weight), 4) + 0.0 AS sumw2, count(*) AS n"
)


def rounded(df, columns=("sumw", "sumw2"), digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _opposite(a, b):
    return a["charge"] != b["charge"]


@query(
    "hist1d",
    with_ctes(
        f"""SELECT sample, {binned('m', 60, 0.0, 300.0)} AS bin, {CONTENT_SQL} FROM first JOIN ev USING (o_orderkey)
            GROUP BY 1, 2""",
        "ev",
        "items",
        first=f"""SELECT a.o_orderkey, {invm('a.', 'b.')} AS m
            FROM items a JOIN items b ON a.o_orderkey = b.o_orderkey AND a.idx < b.idx
            WHERE a.kind = 'electron' AND b.kind = 'electron' AND a.charge <> b.charge
            QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY a.idx, b.idx) = 1""",
    ),
)
def hist1d(spark, d):
    """Weighted mass of the first opposite-charge electron pair, per sample."""
    df = fx.items(spark, d).withColumn("electrons", fx.of_kind("electron"))
    pair = coll.at(coll.pairs(F.col("electrons"), _opposite), 0)
    events = df.select("sample", "weight", pair.alias("pair"))
    mass = kin.inv_mass(F.col("pair.l1"), F.col("pair.l2"))
    return rounded(hist.fill(events, mass, 60, 0.0, 300.0, F.col("weight"), ["sample"]))


# --- the whole plot catalogue ----------------------------------------------------------------------------------

_P = {"ee": "ee", "mumu": "mm", "emu": "em"}


def _lead(p: str, which: str, c: str) -> str:
    a, b = f"{p}_a_{c}", f"{p}_b_{c}"
    if p != "em":
        return a if which == "lead" else b
    first, second = (a, b) if which == "lead" else (b, a)
    return f"CASE WHEN em_a_pt >= em_b_pt THEN {first} ELSE {second} END"


def _plot_sql() -> list[tuple[str, str, str, str, int, float, float]]:
    """(name, table, selection, expression, n, lo, hi) of all 156 plots, written from the wide event table."""
    out = []
    for fl, p in _P.items():
        a, b = f"{p}_a_", f"{p}_b_"
        mass, charge = invm(a, b), f"({a}charge + {b}charge)"
        r = {
            w: lambda other, w=w: dr("l_", other).replace("l_eta", f"({_lead(p, w, 'eta')})").replace(
                "l_phi", f"({_lead(p, w, 'phi')})"
            )
            for w in ("lead", "sub")
        }
        boosted = [
            ("nfatJet", "n_f", 10, 0.0, 10.0),
            ("fatJet_pt", "f0_pt", 100, 200.0, 800.0),
            ("subjet1_pt", "f0_s1pt", 50, 0.0, 500.0),
            ("subjet2_pt", "f0_s2pt", 50, 0.0, 500.0),
            ("fatJet_eta", "f0_eta", 30, -3.0, 3.0),
            ("InvM", mass, 60, 0.0, 300.0),
            ("totalCharge", charge, 5, -2.5, 2.5),
            ("InvM_jj", invm("g0_s1", "g0_s2"), 100, 0.0, 200.0),
            ("leadingLepton_pt", _lead(p, "lead", "pt"), 100, 0.0, 300.0),
            ("subleadingLepton_pt", _lead(p, "sub", "pt"), 100, 0.0, 300.0),
            ("leadingLepton_eta", _lead(p, "lead", "eta"), 30, -3.0, 3.0),
            ("subleadingLepton_eta", _lead(p, "sub", "eta"), 30, -3.0, 3.0),
            ("DR_leptons", dr(a, b), 35, 0.0, 7.0),
            ("DR_leadingleptonANDak8bjet", r["lead"]("f0_"), 35, 0.0, 7.0),
            ("DR_subleadingleptonANDak8bjet", r["sub"]("f0_"), 35, 0.0, 7.0),
            ("nElectrons", "n_te", 3, 0.0, 3.0),
            ("nMuons", "n_tm", 3, 0.0, 3.0),
        ]
        resolved = [
            ("nAK4bJets", "n_b", 10, 0.0, 10.0),
            ("ak4BJet_pt", "b0_pt", 100, 0.0, 500.0),
            ("ak4BJet_eta", "b0_eta", 30, -3.0, 3.0),
            ("nak4Jets", "n_j", 15, 0.0, 15.0),
            ("leadingJet_pt", "j0_pt", 100, 0.0, 500.0),
            ("leadingJet_eta", "j0_eta", 30, -3.0, 3.0),
            ("subleadingJet_pt", "j1_pt", 100, 0.0, 500.0),
            ("subleadingJet_eta", "j1_eta", 30, -3.0, 3.0),
            ("DR_jets", dr("j0_", "j1_"), 35, 0.0, 7.0),
            ("InvM", mass, 100, 0.0, 300.0),
            ("totalCharge", charge, 5, -2.5, 2.5),
            ("leadingLepton_pt", _lead(p, "lead", "pt"), 100, 0.0, 300.0),
            ("subleadingLepton_pt", _lead(p, "sub", "pt"), 50, 0.0, 200.0),
            ("leadingLepton_eta", _lead(p, "lead", "eta"), 30, -3.0, 3.0),
            ("subleadingLepton_eta", _lead(p, "sub", "eta"), 30, -3.0, 3.0),
            ("DR_leptons", dr(a, b), 35, 0.0, 7.0),
            ("DR_leadingleptonANDak4bjet", r["lead"]("b0_"), 35, 0.0, 7.0),
            ("DR_subleadingleptonANDak4bjet", r["sub"]("b0_"), 35, 0.0, 7.0),
            ("nElectrons", "n_te", 3, 0.0, 3.0),
            ("nMuons", "n_tm", 3, 0.0, 3.0),
        ]
        for fam, plots in (("DL_boosted", boosted), ("DL_resolved", resolved)):
            out += [(f"{fam}_{v}_{fl}", "sel_dl", f"sel_{fam}_{fl}", e, n, lo, hi) for v, e, n, lo, hi in plots]
    out.append(("dnn_score", "sel_dl", "sel_DL_resolved_ee", SCORE_SQL, 40, 0.0, 1.0))
    for i, (lo, hi) in enumerate(((0.1, 0.6), (0.6, 0.8), (0.8, 0.92), (0.92, 1.0)), 1):
        flag = f"sel_DL_resolved_ee AND {SCORE_SQL} > {lo} AND {SCORE_SQL} < {hi}"
        out.append((f"DL_resolved_InvM_ee_DNNcat{i}", "sel_dl", flag, invm("ee_a_", "ee_b_"), 100, 0.0, 300.0))
    for suffix, lep in (("e", "te0_"), ("mu", "tm0_")):
        boosted = [
            ("nfatJet", "n_g", 10, 0.0, 10.0),
            ("fatJet_pt", "g0_pt", 400, 200.0, 1000.0),
            ("subjet1_pt", "g0_s1pt", 50, 0.0, 500.0),
            ("subjet2_pt", "g0_s2pt", 50, 0.0, 500.0),
            ("fatJet_eta", "g0_eta", 30, -3.0, 3.0),
            ("subjet1_eta", "g0_s1eta", 30, -3.0, 3.0),
            ("subjet2_eta", "g0_s2eta", 30, -3.0, 3.0),
            ("InvM_jj", invm("g0_s1", "g0_s2"), 100, 0.0, 200.0),
            ("lepton_pt", f"{lep}pt", 100, 0.0, 300.0),
            ("lepton_eta", f"{lep}eta", 30, -3.0, 3.0),
            ("DR_leptonANDak8bjet", dr(lep, "f0_"), 35, 0.0, 7.0),
        ]
        resolved = [
            ("nJets", "n_b", 15, 0.0, 15.0),
            ("leadingJet_pt", "b0_pt", 100, 0.0, 500.0),
            ("leadingJet_eta", "b0_eta", 30, -3.0, 3.0),
            ("subleadingJet_pt", "j1_pt", 100, 0.0, 500.0),
            ("subleadingJet_eta", "j1_eta", 30, -3.0, 3.0),
            ("DR_jets", dr("j0_", "j1_"), 100, 0.0, 10.0),
            ("DR_leptonANDak4bjet", dr(lep, "b0_"), 35, 0.0, 7.0),
            ("lepton_pt", f"{lep}pt", 100, 0.0, 300.0),
            ("lepton_eta", f"{lep}eta", 30, -3.0, 3.0),
        ]
        for fam, plots in (("SL_boosted", boosted), ("SL_resolved", resolved)):
            out += [(f"{fam}_{v}_{suffix}", "sel_sl", f"sel_{fam}_{suffix}", e, n, lo, hi) for v, e, n, lo, hi in plots]
    return out


PLOT_SQL = _plot_sql()


def fill_sql(by: str, plots=None, source: str | None = None, content: str = CONTENT_SQL) -> str:
    """Contents of ``plots``, from the table each names or from ``source``."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS plot, {by}, {binned(expr, n, lo, hi)} AS bin, {content} FROM {source or cte} "
        f"WHERE ({flag}) AND ({expr}) IS NOT NULL GROUP BY ALL"
        for name, cte, flag, expr, n, lo, hi in plots or PLOT_SQL
    )


@query("hist_many", with_ctes(fill_sql("sample"), "sel_dl", "sel_sl"))
def hist_many(spark, d):
    """All 156 histograms of both channels per sample, one pass over the events for both, then one per channel over those
    with its leptons."""
    w = F.col("weight")
    found = promising(spark, d, "DL", "SL")
    dl = dl_channel(spark, d, score_expr(), found).histograms(w)
    return rounded(dl.unionByName(sl_channel(spark, d, found).histograms(w)))


# --- reports on a scored histogram -----------------------------------------------------------------------------

_SCORE_HIST = f"SELECT sample, era, type, {binned('score', 40, 0.0, 1.0)} AS bin, sum(weight) AS sumw, " \
    "sum(weight * weight) AS sumw2, count(*) AS n FROM ml GROUP BY 1, 2, 3, 4"
_GROUPED = """
SELECT s.grp, s.type, h.bin, sum(h.sumw * s.scale) AS sumw, sum(h.sumw2 * s.scale * s.scale) AS sumw2, sum(h.n)::BIGINT AS n
FROM sh h JOIN scales s USING (sample) GROUP BY ALL"""
_REPORT = {"cat": CATALOG_SQL, "scales": SCALES_SQL, "sh": _SCORE_HIST, "grouped": _GROUPED}


def score_hist_by_sample(spark, d):
    return hist.fill(fx.ml_rows(spark, d), F.col("score"), 40, 0.0, 1.0, F.col("weight"), ["sample", "era", "type"])


def grouped_score(spark, d):
    per_sample = score_hist_by_sample(spark, d).drop("type").withColumn("plot", F.lit("score"))
    return report.by_group(per_sample, scale_table(spark, d), ["plot"])


@query(
    "stack_groups",
    with_ctes(
        """SELECT g.grp, r.rank::INTEGER AS rank, g.bin, round(g.sumw, 4) + 0.0 AS sumw,
             round(sum(g.sumw) OVER (PARTITION BY g.bin ORDER BY r.rank), 4) + 0.0 AS stacked
           FROM (SELECT * FROM grouped WHERE type <> 'data') g JOIN
             (SELECT grp, row_number() OVER (ORDER BY sum(sumw), grp) AS rank FROM grouped WHERE type <> 'data' GROUP BY grp) r
             USING (grp)""",
        "ml",
        **_REPORT,
    ),
)
def stack_groups(spark, d):
    stacked = report.stack(grouped_score(spark, d), ["plot"])
    return rounded(stacked, ("sumw", "stacked")).select("grp", "rank", "bin", "sumw", "stacked")


@query(
    "hist_overflow",
    with_ctes(
        f"""SELECT sample, least(greatest(bin, 1), 20) AS bin, round(sum(sumw), 4) + 0.0 AS sumw,
              round(sum(sumw2), 4) + 0.0 AS sumw2, sum(n)::BIGINT AS n
            FROM (SELECT sample, {binned('pt', 20, 50.0, 300.0)} AS bin, sum(weight) AS sumw, sum(weight * weight) AS sumw2,
                    count(*) AS n FROM ml GROUP BY 1, 2) GROUP BY 1, 2""",
        "ml",
    ),
)
def hist_overflow(spark, d):
    h = hist.fill(fx.ml_rows(spark, d), F.col("pt"), 20, 50.0, 300.0, F.col("weight"), ["sample"])
    return rounded(hist.fold(h, 20, ["sample"]))


@query(
    "data_mc_ratio",
    with_ctes(
        """SELECT bin, round(data, 4) + 0.0 AS data, round(mc, 4) + 0.0 AS mc, round(data / mc, 4) + 0.0 AS ratio,
             round(sqrt(dw2) / mc, 4) + 0.0 AS ratio_err, round(sqrt(mw2) / abs(mc), 4) + 0.0 AS mc_rel_err
           FROM (SELECT bin, coalesce(sum(sumw) FILTER (type = 'data'), 0) AS data,
                   coalesce(sum(sumw) FILTER (type <> 'data'), 0) AS mc,
                   coalesce(sum(sumw2) FILTER (type = 'data'), 0) AS dw2,
                   coalesce(sum(sumw2) FILTER (type <> 'data'), 0) AS mw2 FROM grouped GROUP BY bin)""",
        "ml",
        **_REPORT,
    ),
)
def data_mc_ratio(spark, d):
    out = report.ratio(grouped_score(spark, d), ["plot"]).drop("plot")
    return rounded(out, ("data", "mc", "ratio", "ratio_err", "mc_rel_err"))


@query(
    "blinding",
    with_ctes(
        """SELECT sample, bin, CASE WHEN hidden THEN NULL ELSE round(sumw, 4) + 0.0 END AS sumw,
             CASE WHEN hidden THEN NULL ELSE n END AS n
           FROM (SELECT *, type = 'data' AND (bin - 1) * 0.025 < 0.999 AND bin * 0.025 > 0.25 AS hidden FROM sh)""",
        "ml",
        sh=_SCORE_HIST,
    ),
)
def blinding(spark, d):
    hidden = report.blind(score_hist_by_sample(spark, d), 40, 0.0, 1.0, (0.25, 0.999))
    return rounded(hidden, ("sumw",)).select("sample", "bin", "sumw", "n")


_YIELD_GROUPS = ["Data", "TTbar", "DY", "VV", "ggHH__2022", "ggHH__2022EE"]


@query(
    "yields_table",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{n}' AS selection, "
            + ", ".join(
                f"round(coalesce(sum(weight * scale) FILTER (sel_{n} AND grp = '{g.lower()}'), 0), 4) + 0.0 AS \"{g.lower()}\""
                for g in _YIELD_GROUPS
            )
            + " FROM sel_dl JOIN scales USING (sample)"
            for n in DL_FINAL
        ),
        "sel_dl",
        cat=CATALOG_SQL,
        scales=SCALES_SQL,
    ),
)
def yields_table(spark, d):
    flow = dl_channel(spark, d).cutflow(F.col("weight")).filter(F.col("selection").isin(*DL_FINAL))
    return rounded(
        report.yields(flow, scale_table(spark, d), _YIELD_GROUPS), [g.lower() for g in _YIELD_GROUPS]
    )


@query(
    "era_combine",
    with_ctes(
        f"""SELECT type, bin, round(sum(sumw), 4) + 0.0 AS sumw, round(sum(sumw2), 4) + 0.0 AS sumw2, sum(n)::BIGINT AS n
            FROM ({_SCORE_HIST}) GROUP BY type, bin""",
        "ml",
    ),
)
def era_combine(spark, d):
    return rounded(report.combine_eras(score_hist_by_sample(spark, d), ["type"]))
