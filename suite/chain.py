"""The whole analysis as one query, and object variations carried through objects and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventspark.operators import events, hist, mlprep, model, report, scoring, syst, weights
from eventspark.operators.checkpoints import pinned
from eventspark.operators.selection import with_flags
from eventspark.plans import analysis
from eventspark.plans import fixture as fx
from eventspark.sources import skim
from suite.physics import (
    CATALOG_SQL,
    DL_FLAGS,
    JEC_BINS,
    SCALES_SQL,
    SL_FLAGS,
    TOP,
    VARIED,
    bins_sql,
    flow_sql,
    jec_table,
    met_sql,
    promising,
    scale_table,
    sl_channel,
)
from suite.registry import query
from suite.reports import PLOT_SQL, fill_sql, rounded
from suite.sqlparts import CTES, NEEDS, with_ctes, with_jets

#: Certified blocks of some of the runs.
CERTIFIED = {355_100 + run: [(0, 20), (25, 40 + run)] for run in range(20) if run % 7 != 3}
BTAG_BINS = [
    weights.FactorBin(flavour, pt, pt + 10.0, y, y + 0.25, 0.95 + 0.001 * pt + 0.07 * y + shift)
    for flavour, shift in (("b", 0.0), ("light", 0.03))
    for pt in range(20, 120, 10)
    for y in (0.0, 0.25, 0.5, 0.75)
]
BITS = {"Muon": "trig_a", "EGamma": "trig_b", "MuonEG": "trig_c"}
MET_SQL = ("met", "sel_dl", "sel_noSel", "met_pt", 50, 0.0, 100.0)
RESOLVED = [MET_SQL, *[p for p in PLOT_SQL if p[0].startswith("DL_resolved_") and "DNN" not in p[0]]]

_RANGES = ", ".join(f"({run}, {lo}, {hi})" for run, spans in CERTIFIED.items() for lo, hi in spans)
_CHAIN_EV = """
SELECT e.* REPLACE (CASE WHEN e.type <> 'data' THEN weight ELSE 1.0::DOUBLE END AS weight, m.met_pt AS met_pt)
FROM ev e JOIN met_chain m USING (o_orderkey)
WHERE CASE WHEN e.type <> 'data' THEN trig_a OR trig_b OR trig_c
  ELSE EXISTS (SELECT 1 FROM certified r WHERE r.run = e.run AND e.lumi BETWEEN r.lo AND r.hi)
    AND CASE split_part(e.sample, '_Run', 1) WHEN 'Muon' THEN trig_a WHEN 'EGamma' THEN trig_b AND NOT trig_a
        WHEN 'MuonEG' THEN trig_c AND NOT trig_a AND NOT trig_b END END"""
_CHAIN_FAT = """
SELECT f.* REPLACE (f.pt * f.f AS pt, f.mass * f.f AS mass, f.s1pt * a.f AS s1pt, f.s1mass * a.f AS s1mass,
  f.s2pt * c.f AS s2pt, f.s2mass * c.f AS s2mass)
FROM fat_f f LEFT JOIN sub_f a ON a.o_orderkey = f.o_orderkey AND a.sidx = f.i1
LEFT JOIN sub_f c ON c.o_orderkey = f.o_orderkey AND c.sidx = f.i2"""
CTES |= {
    "met_chain": met_sql("ev", "j.f", "jet_f"),
    "certified": f"SELECT * FROM (VALUES {_RANGES}) t(run, lo, hi)",
    "btag_bins": bins_sql(BTAG_BINS),
    "top": TOP,
}
NEEDS |= {"met_chain": ("ev", "jet_f"), "top": ("ev", "raw")}
for _ch in ("dl", "sl"):
    _sel = with_jets(
        _ch, f"_chain_{_ch}", "SELECT * REPLACE (pt * f AS pt, mass * f AS mass) FROM jet_f", _CHAIN_FAT, _CHAIN_EV,
        ("jet_f", "fat_f", "sub_f", "met_chain", "certified"),
    )
    CTES[f"chain_{_ch}"] = f"""
SELECT s.* REPLACE (CASE WHEN type = 'data' THEN s.weight ELSE s.weight * coalesce(b.w, 1.0::DOUBLE) * t.top_w END AS weight)
FROM {_sel} s JOIN top t USING (o_orderkey) LEFT JOIN (
  SELECT o_orderkey, product(coalesce(b.f, 1.0::DOUBLE)) AS w FROM ak4_{_ch}_chain_{_ch} j LEFT JOIN btag_bins b
    ON b.k = CASE WHEN j.jet_id = 6 THEN 'b' ELSE 'light' END
      AND j.pt >= b.x0 AND j.pt < b.x1 AND j.btag >= b.y0 AND j.btag < b.y1
  GROUP BY o_orderkey) b USING (o_orderkey)"""
    NEEDS[f"chain_{_ch}"] = (_sel, "top", "btag_bins")


def chain(spark, d, name):
    """A channel from raw events to its full weight ``event_weight``."""
    df = analysis.prepared(
        fx.collisions(spark, d),
        events.lumi_ranges(spark, CERTIFIED),
        {pd: [F.col(bit)] for pd, bit in BITS.items()},
        jec_table(spark),
        JEC_BINS,
    )
    flavour = lambda x: F.when(x["jetId"] == 6, "b").otherwise("light")
    return analysis.channel(df, name).weighted("event_weight", analysis.simulation_weight(BTAG_BINS, flavour))


@query(
    "chain_cutflow",
    with_ctes(
        f"SELECT 'DL' AS channel, * FROM ({flow_sql('chain_dl', DL_FLAGS, 3)}) UNION ALL "
        f"SELECT 'SL', * FROM ({flow_sql('chain_sl', SL_FLAGS, 3)})",
        "chain_dl",
        "chain_sl",
    ),
)
def chain_cutflow(spark, d):
    """Certified runs, triggers, generator weights, corrections, objects, factors and selections of both channels."""
    flows = [
        chain(spark, d, name).cutflow(F.col("event_weight")).withColumn("channel", F.lit(name)) for name in ("DL", "SL")
    ]
    return rounded(flows[0].unionByName(flows[1]), digits=3)


def resolved(channel):
    met = hist.Plot("met", "sel_noSel", F.col("met_pt"), 50, 0.0, 100.0)
    return [met, *[p for p in channel.plots if p.name.startswith("DL_resolved_")]]


@query(
    "chain_stack",
    with_ctes(
        """SELECT plot, grp, rank::INTEGER AS rank, bin, round(sumw, 3) + 0.0 AS sumw,
             round(sum(sumw) OVER (PARTITION BY plot, bin ORDER BY rank), 3) + 0.0 AS stacked
           FROM grouped JOIN (SELECT plot, grp, row_number() OVER (PARTITION BY plot ORDER BY sum(sumw), grp) AS rank
                              FROM grouped GROUP BY plot, grp) USING (plot, grp)""",
        "chain_dl",
        cat=CATALOG_SQL,
        scales=SCALES_SQL,
        filled=fill_sql("sample", RESOLVED, "chain_dl", "sum(weight) AS sumw"),
        grouped="""SELECT plot, grp, bin, sum(h.sumw * scale) AS sumw FROM filled h JOIN scales USING (sample)
                   WHERE type <> 'data' GROUP BY plot, grp, bin""",
    ),
)
def chain_stack(spark, d):
    """Stacks of the resolved two-lepton plots after the whole chain, scaled to the luminosity."""
    dl = chain(spark, d, "DL")
    filled = hist_of(dl, "event_weight", ("sample",))
    stacked = report.stack(report.by_group(filled, scale_table(spark, d), ["plot"]), ["plot"])
    return rounded(stacked, ("sumw", "stacked"), 3).select("plot", "grp", "rank", "bin", "sumw", "stacked")


def hist_of(channel, weight, by):
    return hist.fill_many(channel.events, resolved(channel), F.col(weight), by)


_VARIANTS = {"nominal": "sel_dl"}
for _name, _f in VARIED.items():
    CTES[f"met_{_name}"], NEEDS[f"met_{_name}"] = met_sql("ev", f"{_f!r}::DOUBLE"), ("ev", "jet")
    _VARIANTS[_name] = with_jets(
        "dl",
        f"_{_name}",
        f"SELECT * REPLACE (pt * {_f!r}::DOUBLE AS pt, mass * {_f!r}::DOUBLE AS mass) FROM jet",
        "SELECT * REPLACE (" + ", ".join(f"{c} * {_f!r}::DOUBLE AS {c}" for c in ("pt", "mass", "s1pt", "s1mass", "s2pt", "s2mass")) + ") FROM fat",
        f"SELECT e.* REPLACE (m.met_pt AS met_pt) FROM ev e JOIN met_{_name} m USING (o_orderkey) WHERE type <> 'data'",
        (f"met_{_name}",),
    )


@query(
    "syst_hist",
    with_ctes(
        " UNION ALL ".join(fill_sql(f"sample, '{v}' AS variation", RESOLVED, cte) for v, cte in _VARIANTS.items()),
        *_VARIANTS.values(),
    ),
)
def syst_hist(spark, d):
    """Resolved two-lepton histograms for jets as they are, up and down; leptons are built once."""
    vary = lambda df: syst.object_variations(
        df, VARIED, ["Jet", "FatJet", "SubJet"], F.col("type") != "data", met=("met_pt", "met_phi"), met_source="Jet",
        needed=F.col(analysis.PASSED),
    )
    stored = lambda df: fx.with_collections(df, "Tau", "FatJet", "SubJet")
    dl = analysis.channel(fx.leptons_first(spark, d), "DL", vary=vary, last=True, stored=stored)
    return rounded(hist_of(dl, "weight", ("sample", "variation")))


_SCORED = "sel_SL_resolved_e AND weight > 0"


@query(
    "scored_channel",
    with_ctes(
        f"""SELECT count(*) AS n, round(sum(weight * CASE WHEN contains(sample, 'HH') THEN 1.0 ELSE 0.0 END), 3) + 0.0 AS true_weight,
              round(sum(weight * CASE WHEN contains(sample, 'HH') THEN 1.0 ELSE 0.0 END), 3) + 0.0 AS scored_weight, true AS once
            FROM sel_sl WHERE {_SCORED}""",
        "sel_sl",
    ),
)
def scored_channel(spark, d):
    """Skim, train, score inside the analysis and categorise: a converged linear model with a free intercept gives the skimmed
    events their weight in the class, and an event is in one category at most. The intercept is converged on its own."""
    sl = sl_channel(spark, d, promising(spark, d, "SL"))
    table = sl.skim(F.col("weight")).withColumn("label", F.col("sample").contains("HH").cast("double"))
    features = list(skim.sl_features())
    skimmed = pinned(mlprep.drop_nonpositive(table))
    fitted = model.train(skimmed, features, "label", "weight", kind="logistic", iterations=300, tol=1e-12, l2=1e-3)
    shift = scoring.balancing(skimmed, scoring.margin(fitted), F.col("label"), F.col("weight"))
    df = sl.events.withColumn("score", scoring.of_pipeline(fitted, skim.sl_features(), shift))
    parent = next(s for s in sl.selections if s.name == "SL_resolved_e")
    chosen = analysis.categories(parent, F.col("score"))
    df = with_flags(df, chosen)
    found = [F.when(F.col(c.flag), 1).otherwise(0) for c in chosen]
    values = {"w": F.col("weight"), "p": F.col("score"), "in_category": sum(found[1:], found[0])}
    rows = skim.rows(df, F.col(parent.flag), values, ("sample",)).filter("w > 0")
    label = F.col("sample").contains("HH").cast("double")
    return rows.agg(
        F.count("*").alias("n"),
        (F.round(F.sum(F.col("w") * label), 3) + 0.0).alias("true_weight"),
        (F.round(F.sum(F.col("w") * F.col("p")), 3) + 0.0).alias("scored_weight"),
        (F.max("in_category") <= 1).alias("once"),
    )
