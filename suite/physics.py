"""Queries for object definitions, selections, weights and systematics on the collision-like event frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.functions import coll
from eventspark.operators import crowded_objects, norm, objects, selection, syst, weights
from eventspark.operators.corrections import Binning, Category, Formula, evaluate
from eventspark.plans import analysis
from eventspark.plans import fixture as fx
from eventspark.sources import catalog, skim
from suite.either import either
from suite.registry import query
from suite.sqlparts import CTES, DL_TREE, NEEDS, SL_TREE, with_ctes

KEYS = ("o_orderkey",)
LEPTONS = ("Muon", "Electron", "Jet")


def r4(c):
    return F.round(c, 4)


def _levels(df, levels):
    """(level, position in the collection, item) rows of several collections from one pass."""
    one = lambda name, column: F.transform(
        F.col(column),
        lambda x, i: F.struct(
            F.lit(name).alias("level"), i.alias("pos"), x["idx"].alias("idx"), x["pt"].alias("pt")
        ),
    )
    every = F.concat(*[one(name, column) for name, column in levels.items()])
    return df.select(*KEYS, F.inline(every))


def _crowd_levels(crowd, levels):
    one = lambda name, column: crowd[column].positions().select(
        *KEYS, F.lit(name).alias("level"), "pos", "item.idx", "item.pt"
    )
    return reduce(DataFrame.unionByName, [one(name, column) for name, column in levels.items()])


def _objects(spark, d, names, nested, crowd, levels):
    """Levels of collections made by ``nested`` from events and by ``crowd`` from crowded ones."""
    return either(
        spark, d, fx.collisions, lambda ev: _levels(nested(ev), levels), lambda c: _crowd_levels(crowd(c), levels), names
    )


# --- objects ---------------------------------------------------------------------------------------------------

_OBJ = "SELECT '{lvl}' AS level, o_orderkey, CAST({pos} AS INTEGER) AS pos, CAST(idx AS INTEGER) AS idx, pt FROM {cte}"


@query(
    "obj_conept",
    with_ctes(
        """SELECT 'muon' AS flavour, o_orderkey, CAST(idx AS INTEGER) AS idx, conept FROM mu_all
           UNION ALL SELECT 'electron', o_orderkey, CAST(idx AS INTEGER), conept FROM el_all""",
        "mu_all",
        "el_all",
    ),
)
def obj_conept(spark, d):
    value = lambda flavour, conept: lambda x: F.struct(
        F.lit(flavour).alias("flavour"), x["idx"].alias("idx"), conept(x).alias("conept")
    )
    kinds = {"Muon": value("muon", objects.muon_conept), "Electron": value("electron", objects.electron_conept)}
    every = F.concat(*[F.transform(name, of) for name, of in kinds.items()])
    rows = lambda c: [c[name].rows.select(*KEYS, of(F.col("item")).alias("x")) for name, of in kinds.items()]
    return either(
        spark,
        d,
        fx.collisions,
        lambda ev: ev.select(*KEYS, F.inline(every)),
        lambda c: reduce(DataFrame.unionByName, rows(c)).select(*KEYS, "x.*"),
        tuple(kinds),
    )


@query(
    "obj_muons",
    with_ctes(
        " UNION ALL ".join(
            _OBJ.format(lvl=lvl, pos=pos, cte=cte)
            for lvl, pos, cte in (("loose", "pos", "mu"), ("fake", "fpos", "fake_mu"), ("tight", "tpos", "tight_mu"))
        ),
        "mu",
        "fake_mu",
        "tight_mu",
    ),
)
def obj_muons(spark, d):
    levels = {"loose": "muons", "fake": "fake_muons", "tight": "tight_muons"}
    return _objects(spark, d, ("Muon", "Jet"), objects.muons, crowded_objects.muons, levels)


@query(
    "obj_electrons",
    with_ctes(
        " UNION ALL ".join(
            _OBJ.format(lvl=lvl, pos=pos, cte=cte)
            for lvl, pos, cte in (
                ("loose", "lpos", "el_loose"),
                ("clean", "pos", "el"),
                ("fake", "fpos", "fake_el"),
                ("tight", "tpos", "tight_el"),
            )
        ),
        "el",
        "fake_el",
        "tight_el",
    ),
)
def obj_electrons(spark, d):
    levels = {"loose": "electrons", "clean": "clean_electrons", "fake": "fake_electrons", "tight": "tight_electrons"}
    return _objects(spark, d, LEPTONS, _leptons, _crowd_leptons, levels)


def _leptons(df):
    return objects.electrons(objects.muons(df))


def _crowd_leptons(crowd):
    return crowded_objects.electrons(crowded_objects.muons(crowd))


@query(
    "obj_taus",
    with_ctes("SELECT o_orderkey, CAST(idx AS INTEGER) AS idx, pt FROM tau", "tau"),
)
def obj_taus(spark, d):
    return either(
        spark,
        d,
        fx.collisions,
        lambda ev: coll.rows(objects.taus(_leptons(ev)), "taus", *KEYS).select(*KEYS, "idx", "pt"),
        lambda c: crowded_objects.taus(_crowd_leptons(c))["taus"].rows.select(*KEYS, "item.idx", "item.pt"),
        (*LEPTONS, "Tau"),
    )


def _with_jets(df, channel):
    return objects.jets(objects.lead_leptons(_leptons(df), channel))


def _with_fat_jets(df, channel):
    return objects.fat_jets(_with_jets(df, channel), channel)


def _crowd_jets(crowd, channel, fat=False):
    found = _crowd_leptons(crowd)
    lead = crowded_objects.lead_leptons(found, channel)
    found = crowded_objects.jets(found, lead)
    return crowded_objects.fat_jets(found, lead, channel) if fat else found


@query(
    "obj_jets",
    with_ctes(
        " UNION ALL ".join(
            [
                _OBJ.format(lvl="dl_jet", pos="pos", cte="ak4_dl"),
                "SELECT 'dl_btag', o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey "
                "ORDER BY btag DESC, idx) - 1 AS INTEGER), idx, pt FROM ak4_dl",
                _OBJ.format(lvl="dl_b", pos="bpos", cte="b4_dl"),
            ]
        ),
        "b4_dl",
    ),
)
def obj_jets(spark, d):
    levels = {"dl_jet": "ak4_jets", "dl_btag": "ak4_jets_by_btag", "dl_b": "ak4_bjets"}
    return _objects(spark, d, LEPTONS, lambda ev: _with_jets(ev, "DL"), lambda c: _crowd_jets(c, "DL"), levels)


@query(
    "obj_fatjets",
    with_ctes(
        " UNION ALL ".join(
            [
                _OBJ.format(lvl="sl_fat", pos="pos", cte="ak8_sl"),
                _OBJ.format(lvl="sl_fat_b", pos="bpos", cte="b8_sl"),
                "SELECT 'sl_away', o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) "
                "- 1 AS INTEGER), idx, pt FROM away_sl",
            ]
        ),
        "away_sl",
    ),
)
def obj_fatjets(spark, d):
    levels = {"sl_fat": "ak8_jets", "sl_fat_b": "ak8_bjets", "sl_away": "ak4_away"}
    names = (*LEPTONS, "FatJet", "SubJet")
    return _objects(
        spark, d, names, lambda ev: _with_fat_jets(ev, "SL"), lambda c: _crowd_jets(c, "SL", fat=True), levels
    )


@query(
    "clean_from_fatjet",
    with_ctes("SELECT o_orderkey, idx, pt FROM away_dl", "away_dl"),
)
def clean_from_fatjet(spark, d):
    """Small jets farther than 1.2 from the leading b-tagged fat jet; none when there is no such fat jet."""
    return either(
        spark,
        d,
        fx.collisions,
        lambda ev: coll.rows(_with_fat_jets(ev, "DL"), "ak4_away", *KEYS).select(*KEYS, "idx", "pt"),
        lambda c: _crowd_jets(c, "DL", fat=True)["ak4_away"].rows.select(*KEYS, "item.idx", "item.pt"),
        (*LEPTONS, "FatJet", "SubJet"),
    )


# --- selections ------------------------------------------------------------------------------------------------


def score_expr():
    """Stand-in for a classifier output: a function of the leading tight electron."""
    pt = coll.at(F.col("tight_electrons"), 0)["pt"]
    return F.coalesce(pt / (pt + 10.0), F.lit(0.0))


SCORE_SQL = "coalesce(te0_pt / (te0_pt + 10.0), 0.0)"


def promising(spark, d, *names):
    """Events that can be in the last selections of the channels, stored once."""
    df = fx.leptons_first(spark, d, without=fx.crowded_orders(spark, d), having=analysis.candidates(names))
    return analysis.promising(df, names, stored=lambda kept: fx.with_collections(kept, "Tau", "FatJet", "SubJet").drop("items"))


def _channel(spark, d, name, score=None, events=None):
    """With ``events`` (of :func:`promising`) only the last selections of these."""
    keys = fx.crowded_orders(spark, d)
    more = None if keys is None else crowded_objects.summary(fx.crowd_of_collisions(spark, d, keys), name)
    df = fx.collisions(spark, d, without=keys) if events is None else events
    return analysis.channel(df, name, score, more=more, last=events is not None)


def dl_channel(spark, d, score=None, events=None):
    return _channel(spark, d, "DL", score, events)


def sl_channel(spark, d, events=None):
    return _channel(spark, d, "SL", events=events)


def _leptons_only(spark, d, *columns):
    """Keys and columns the two-lepton selections read."""
    return either(
        spark,
        d,
        fx.collisions,
        lambda ev: selection.dl_columns(_leptons(ev)).select(*KEYS, *columns),
        lambda c: _crowd_selection(_crowd_leptons(c)).select(*KEYS, *columns),
        LEPTONS,
    )


def _crowd_selection(found):
    return found.joined(crowded_objects.vetoes(found), *crowded_objects.lepton_pairs(found))


@query(
    "dl_pt_cut",
    with_ctes(
        "SELECT o_orderkey, "
        + ", ".join(f"({cut}) AS {name}" for name, _, cut in DL_TREE if name in ("elelptSel", "mumuptSel", "elmuptSel"))
        + " FROM wide_dl",
        "wide_dl",
    ),
)
def dl_pt_cut(spark, d):
    cuts = {"elelptSel": "first_ee", "mumuptSel": "first_mm", "elmuptSel": "first_em"}
    return _leptons_only(
        spark, d, *[F.coalesce(selection.pair_conept_cut(F.col(c)), F.lit(False)).alias(n) for n, c in cuts.items()]
    )


@query("low_mll_veto", with_ctes("SELECT o_orderkey, ok_low AS keep FROM wide_dl", "wide_dl"))
def low_mll_veto(spark, d):
    return _leptons_only(spark, d, F.col("ok_low").alias("keep"))


@query("z_veto", with_ctes("SELECT o_orderkey, ok_z AS keep FROM wide_dl", "wide_dl"))
def z_veto(spark, d):
    return _leptons_only(spark, d, F.col("ok_z").alias("keep"))


@query(
    "pair_multiplicity",
    with_ctes(
        """SELECT o_orderkey, n_ee::INTEGER AS n_ee, n_mm::INTEGER AS n_mm, n_em::INTEGER AS n_em,
             n_ee = 1 AND n_mm = 0 AND n_em = 0 AS only_ee FROM wide_dl""",
        "wide_dl",
    ),
)
def pair_multiplicity(spark, d):
    df = _leptons_only(spark, d, "n_ee", "n_mm", "n_em")
    return df.withColumn("only_ee", (F.col("n_ee") == 1) & (F.col("n_mm") == 0) & (F.col("n_em") == 0))


def _passing(channel, names):
    flags = [f"sel_{n}" for n in names]
    any_flag = F.greatest(*[F.col(f) for f in flags])
    return skim.rows(channel.events, any_flag, {f: F.col(f) for f in flags}, KEYS)


def _passing_sql(ch, names):
    flags = [f"sel_{n}" for n in names]
    return with_ctes(
        f"SELECT o_orderkey, {', '.join(flags)} FROM sel_{ch} WHERE {' OR '.join(flags)}", f"sel_{ch}"
    )


DL_FINAL = [n for n, depth, _ in DL_TREE if depth == 4]
SL_FINAL = [n for n, depth, _ in SL_TREE if depth >= 2]


@query("sel_dl", _passing_sql("dl", DL_FINAL))
def sel_dl(spark, d):
    return _passing(dl_channel(spark, d), DL_FINAL)


@query("sel_sl", _passing_sql("sl", SL_FINAL))
def sel_sl(spark, d):
    return _passing(sl_channel(spark, d), SL_FINAL)


CATEGORY_TREE = [
    (f"DNNcat{i}", 5, f"sel_DL_resolved_ee AND {SCORE_SQL} > {lo} AND {SCORE_SQL} < {hi}")
    for i, (lo, hi) in enumerate(((0.1, 0.6), (0.6, 0.8), (0.8, 0.92), (0.92, 1.0)), 1)
]


def flow_sql(cte, tree, digits=4):
    return " UNION ALL ".join(
        f"SELECT sample, '{name}' AS selection, {depth} AS depth, count(*) FILTER ({flag}) AS n, "
        f"round(coalesce(sum(weight) FILTER ({flag}), 0), {digits}) + 0.0 AS sumw, "
        f"round(coalesce(sum(weight * weight) FILTER ({flag}), 0), {digits}) + 0.0 AS sumw2 FROM {cte} GROUP BY sample"
        for name, depth, flag in tree
    )


DL_FLAGS, SL_FLAGS = ([(n, depth, f"sel_{n}") for n, depth, _ in tree] for tree in (DL_TREE, SL_TREE))


@query("cutflow", with_ctes(flow_sql("sel_dl", DL_FLAGS + CATEGORY_TREE), "sel_dl"))
def cutflow(spark, d):
    flow = dl_channel(spark, d, score_expr()).cutflow(F.col("weight"))
    return flow.withColumns({"sumw": r4(F.col("sumw")), "sumw2": r4(F.col("sumw2"))})


# --- skims -----------------------------------------------------------------------------------------------------

_FEATURES = {"ak4bjet1": "b0", "ak4jet1": "j0", "ak4jet2": "j1", "leadingLepton": "te0", "subleadingLepton": "te1"}


def _skim_sql(ch, flag, names):
    cols = ", ".join(
        f"{_FEATURES[n]}_{c} AS {n}_{c}" for n in names for c in ("pt", "eta", "phi")
    )
    return f"SELECT o_orderkey, sample, weight, {cols} FROM sel_{ch} WHERE {flag}"


_DL_SKIM = _skim_sql("dl", "sel_DL_resolved_ee", list(_FEATURES))


@query("skim_dl_ee", with_ctes(_DL_SKIM, "sel_dl"))
def skim_dl_ee(spark, d):
    return dl_channel(spark, d).skim(F.col("weight"), (*KEYS, "sample"))


@query("skim_sl_e", with_ctes(_skim_sql("sl", "sel_SL_resolved_e", list(_FEATURES)[:4]), "sel_sl"))
def skim_sl_e(spark, d):
    return sl_channel(spark, d).skim(F.col("weight"), (*KEYS, "sample"))


def _sql_value(x):
    return "NULL" if x is None else (f"'{x}'" if isinstance(x, str) else repr(x))


CATALOG_SQL = (
    "SELECT sample, era, type, grp, CAST(xs AS DOUBLE) AS xs, CAST(br AS DOUBLE) AS br, "
    "CASE era WHEN '2022' THEN 8077.0::DOUBLE ELSE 21129.0::DOUBLE END AS lumi FROM (VALUES "
    + ", ".join("(" + ", ".join(_sql_value(x) for x in row) + ")" for row in fx.SAMPLES)
    + ") t(sample, era, type, grp, xs, br)"
)
SCALES_SQL = """
SELECT c.sample, lower(coalesce(grp, c.sample)) AS grp, coalesce(grp, c.sample) AS process, lower(c.type) AS type, sumw,
  CASE WHEN lower(c.type) = 'data' THEN 1.0::DOUBLE ELSE lumi * xs * coalesce(br, 1.0) / nullif(sumw, 0) END AS scale
FROM cat c LEFT JOIN (SELECT sample, sum(weight) AS sumw FROM hdr GROUP BY sample) s ON s.sample = c.sample"""


def scale_table(spark, d):
    sums = norm.weight_sums(fx.headers(spark, d), F.col("weight"))
    return norm.scales(fx.catalog(spark), sums)


@query(
    "lumi_scale",
    with_ctes(
        "SELECT sample, round(sumw, 4) + 0.0 AS sumw, round(scale, 6) + 0.0 AS scale FROM scales", "hdr",
        cat=CATALOG_SQL, scales=SCALES_SQL,
    ),
)
def lumi_scale(spark, d):
    s = scale_table(spark, d)
    return s.select("sample", r4(F.col("sumw")).alias("sumw"), F.round("scale", 6).alias("scale"))


@query(
    "skim_scaled",
    with_ctes(
        f"""SELECT k.o_orderkey, s.process, round(k.weight * s.scale, 5) + 0.0 AS weight, k."leadingLepton_pt"
            FROM ({_DL_SKIM}) k JOIN scales s USING (sample)""",
        "sel_dl",
        cat=CATALOG_SQL,
        scales=SCALES_SQL,
    ),
)
def skim_scaled(spark, d):
    rows = skim_dl_ee(spark, d)
    merged = skim.merge(rows, scale_table(spark, d), len(fx.SAMPLES))
    return merged.select(*KEYS, "process", F.round("weight", 5).alias("weight"), "leadingLepton_pt")


# --- weights and systematics -----------------------------------------------------------------------------------


@query(
    "weight_gen",
    with_ctes("SELECT o_orderkey, CASE WHEN type <> 'data' THEN weight ELSE 1.0::DOUBLE END AS w FROM hdr", "hdr"),
)
def weight_gen(spark, d):
    return fx.headers(spark, d).select(
        "o_orderkey", weights.gen(F.col("type") != "data", F.col("weight")).alias("w")
    )


TOP = """
SELECT e.o_orderkey, e.sample, e.weight,
  CASE WHEN starts_with(e.sample, 'TT') AND t.pt IS NOT NULL AND a.pt IS NOT NULL THEN sqrt(
    (0.103::DOUBLE * exp(-0.0118::DOUBLE * t.pt) - 0.000134::DOUBLE * t.pt + 0.973::DOUBLE)
    * (0.103::DOUBLE * exp(-0.0118::DOUBLE * a.pt) - 0.000134::DOUBLE * a.pt + 0.973::DOUBLE)) ELSE 1.0::DOUBLE END AS top_w
FROM ev e
LEFT JOIN (SELECT o_orderkey, q * 6 AS pt FROM raw WHERE pk % 3 <> 0 AND pk % 2 = 1 AND rf = 'A' AND charge = 1
           QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY idx) = 1) t USING (o_orderkey)
LEFT JOIN (SELECT o_orderkey, q * 6 AS pt FROM raw WHERE pk % 3 <> 0 AND pk % 2 = 1 AND rf = 'A' AND charge = -1
           QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY idx) = 1) a USING (o_orderkey)"""


@query(
    "weight_curve",
    with_ctes("SELECT o_orderkey, sample, round(top_w, 6) + 0.0 AS w FROM top", "ev", top=TOP),
)
def weight_curve(spark, d):
    w = weights.top_pt(F.col("GenPart"), F.col("sample"))
    return fx.collisions(spark, d, ("GenPart",)).select(*KEYS, "sample", F.round(w, 6).alias("w"))


@query(
    "syst_weight",
    with_ctes(
        """SELECT sample, 'nominal' AS variation, round(sum(weight * top_w), 4) + 0.0 AS sumw FROM top GROUP BY sample
           UNION ALL SELECT sample, 'noTopPt', round(sum(weight), 4) + 0.0 FROM top GROUP BY sample""",
        "ev",
        top=TOP,
    ),
)
def syst_weight(spark, d):
    df = fx.collisions(spark, d, ("GenPart",)).select(
        "sample", "weight", weights.top_pt(F.col("GenPart"), F.col("sample")).alias("top_w")
    )
    varied = syst.weight_variations(df, F.col("weight") * F.col("top_w"), {"noTopPt": F.col("weight")})
    return varied.groupBy("sample", "variation").agg(r4(F.sum("weight")).alias("sumw"))


#: 320 bins; the edges of the second variable avoid the values it takes.
SF_BINS = [
    weights.FactorBin(kind, 2.5 * i, 2.5 * i + 2.5, y, y + 0.25, 0.9 + 0.0123457 * i / 4 + 0.0217391 * y + shift)
    for kind, shift in (("jet", 0.0), ("muon", 0.05))
    for i in range(20)
    for y in (0.06, 0.31, 0.56, 0.81, 1.06, 1.31, 1.56, 1.81)
]


def bins_sql(bins):
    rows = ", ".join("(" + ", ".join(_sql_value(v) for v in b) + ")" for b in bins)
    return (
        "SELECT k, x0::DOUBLE AS x0, x1::DOUBLE AS x1, y0::DOUBLE AS y0, y1::DOUBLE AS y1, f::DOUBLE AS f "
        f"FROM (VALUES {rows}) t(k, x0, x1, y0, y1, f)"
    )


@query(
    "weight_lookup",
    with_ctes(
        """SELECT e.o_orderkey, round(coalesce(product(coalesce(f, 1.0::DOUBLE)), 1.0::DOUBLE), 6) + 0.0 AS w
           FROM ev e LEFT JOIN (
             SELECT i.o_orderkey, CAST(b.f AS DOUBLE) AS f FROM items i JOIN bins b
               ON i.kind = b.k AND i.pt >= b.x0 AND i.pt < b.x1 AND abs(i.eta) >= b.y0 AND abs(i.eta) < b.y1) m
             USING (o_orderkey) GROUP BY e.o_orderkey""",
        "ev",
        "items",
        bins=bins_sql(SF_BINS),
    ),
)
def weight_lookup(spark, d):
    factor = lambda x: weights.binned_factor(SF_BINS, x["kind"], x["pt"], F.abs(x["eta"]))
    w = weights.lookup_product(F.col("items"), factor)
    return fx.items(spark, d).select(*KEYS, F.round(w, 6).alias("w"))


JEC_FACTORS = {tag: 1.0 + 0.01 * i for i, tag in enumerate(sorted(set(weights.JEC_TAGS.values())))}
_JEC_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{e}', '{r}', '{t}', {JEC_FACTORS[t]!r}::DOUBLE)" for (e, r), t in weights.JEC_TAGS.items()
) + ") t(era, run_era, jec_tag, jec_factor)"
_EV_JEC = """
SELECT e.*, j.jec_tag, j.jec_factor FROM (SELECT *, CASE WHEN regexp_matches(sample, 'Run20..([A-Z]?)')
  THEN regexp_extract(sample, 'Run20..([A-Z]?)', 1) ELSE 'MC' END AS run_era FROM ev) e
LEFT JOIN jec j ON j.era = e.era AND j.run_era = e.run_era"""


def _jec_bins(shift):
    """Residual corrections of one kind of jet: every tag, 4 bins of eta and 5 of pt."""
    eta, pt = (-2.61, -1.31, 0.01, 1.31, 2.61), (0.0, 15.0, 30.0, 60.0, 120.0, 400.0)
    return [
        weights.FactorBin(tag, eta[i], eta[i + 1], pt[j], pt[j + 1], 1.0 + shift + 0.004 * t + 0.013 * i - 0.007 * j)
        for t, tag in enumerate(sorted(JEC_FACTORS))
        for i in range(4)
        for j in range(5)
    ]


JEC_BINS = {"Jet": _jec_bins(0.0), "FatJet": _jec_bins(0.02), "SubJet": _jec_bins(-0.01)}


def _item_factor(source: str, kind: str) -> str:
    return f"""SELECT j.*, e.jec_tag, e.jec_factor * coalesce(b.f, 1.0::DOUBLE) AS f FROM {source} j JOIN evj e USING (o_orderkey)
LEFT JOIN jec_{kind} b ON b.k = e.jec_tag AND j.eta >= b.x0 AND j.eta < b.x1 AND j.pt >= b.y0 AND j.pt < b.y1"""


CTES |= {"jec": _JEC_SQL, "evj": _EV_JEC, **{f"jec_{k}": bins_sql(b) for k, b in JEC_BINS.items()}}
CTES |= {"jet_f": _item_factor("jet", "Jet"), "fat_f": _item_factor("fat", "FatJet"), "sub_f": _item_factor("sub", "SubJet")}
NEEDS |= {"evj": ("ev", "jec"), "jet_f": ("jet", "evj", "jec_Jet"), "fat_f": ("fat", "evj", "jec_FatJet")}
NEEDS |= {"sub_f": ("sub", "evj", "jec_SubJet")}


def jec_table(spark):
    return weights.jec_table(spark, JEC_FACTORS)


def _corrected(spark, d, names):
    df = fx.collisions(spark, d, names).withColumn("run_era", catalog.run_era(F.col("sample")))
    df = weights.with_jec(df, jec_table(spark))
    return df.withColumns({f"{c}_corr": weights.corrected(F.col(c), JEC_BINS[c]) for c in names})


@query(
    "jet_scale",
    with_ctes(
        " UNION ALL ".join(
            f"""SELECT o_orderkey, '{name}' AS collection, CAST({idx} AS INTEGER) AS idx, jec_tag,
                  round(pt * f, 6) + 0.0 AS pt, round(mass * f, 6) + 0.0 AS mass FROM {cte}"""
            for name, cte, idx in (("Jet", "jet_f", "idx"), ("FatJet", "fat_f", "idx"), ("SubJet", "sub_f", "sidx"))
        ),
        "jet_f",
        "fat_f",
        "sub_f",
    ),
)
def jet_scale(spark, d):
    """Small, fat and sub-jets with the factors of the event's tag and of their (eta, pt) bin."""
    df = _corrected(spark, d, tuple(JEC_BINS))
    item = lambda name: lambda x: F.struct(
        F.lit(name).alias("collection"), x["idx"].alias("idx"), F.round(x["pt"], 6).alias("pt"), F.round(x["mass"], 6).alias("mass")
    )
    every = F.concat(*[F.transform(f"{c}_corr", item(c)) for c in JEC_BINS])
    return df.select(*KEYS, "jec_tag", F.inline(every))


def met_sql(source: str, factor: str, jets: str = "jet") -> str:
    return f"""SELECT o_orderkey, sqrt(px * px + py * py) AS met_pt, atan2(py, px) AS met_phi FROM (
      SELECT e.o_orderkey, any_value(e.met_pt) * cos(any_value(e.met_phi))
          - coalesce(sum(j.pt * ({factor} - 1) * cos(j.phi)), 0) AS px,
        any_value(e.met_pt) * sin(any_value(e.met_phi)) - coalesce(sum(j.pt * ({factor} - 1) * sin(j.phi)), 0) AS py
      FROM {source} e LEFT JOIN {jets} j USING (o_orderkey) GROUP BY e.o_orderkey)"""


@query(
    "met_shift",
    with_ctes(
        "SELECT o_orderkey, round(met_pt, 7) + 0.0 AS met_pt, round(met_phi, 7) + 0.0 AS met_phi FROM met",
        "jet_f",
        met=met_sql("ev", "j.f", "jet_f"),
    ),
)
def met_shift(spark, d):
    pt, phi = weights.met_shift(F.col("met_pt"), F.col("met_phi"), F.col("Jet"), F.col("Jet_corr"))
    return _corrected(spark, d, ("Jet",)).select(
        *KEYS, F.round(pt, 7).alias("met_pt"), F.round(phi, 7).alias("met_phi")
    )


VARIED = {"jesTotalup": 1.1, "jesTotaldown": 0.9}


@query(
    "syst_object",
    with_ctes(
        """SELECT e.sample, v.variation, sum(n)::BIGINT AS n_jets, round(sum(met), 6) + 0.0 AS met FROM (
             SELECT e.o_orderkey, e.sample, v.variation, v.f, count(*) FILTER (j.pt * v.f >= 25) AS n
             FROM ev e JOIN var v ON e.type <> 'data' OR v.variation = 'nominal'
             LEFT JOIN jet j ON j.o_orderkey = e.o_orderkey GROUP BY ALL) v
           JOIN (SELECT o_orderkey, 'nominal' AS variation, met_pt AS met FROM ev
                 UNION ALL SELECT o_orderkey, 'jesTotalup', met_pt FROM metup
                 UNION ALL SELECT o_orderkey, 'jesTotaldown', met_pt FROM metdown) m
             USING (o_orderkey, variation)
           JOIN ev e USING (o_orderkey) GROUP BY e.sample, v.variation""",
        "ev",
        "jet",
        var="SELECT * FROM (VALUES ('nominal', 1.0::DOUBLE), ('jesTotalup', 1.1::DOUBLE), ('jesTotaldown', 0.9::DOUBLE)) t(variation, f)",
        metup=met_sql("ev", "1.1::DOUBLE"),
        metdown=met_sql("ev", "0.9::DOUBLE"),
    ),
)
def syst_object(spark, d):
    df = fx.collisions(spark, d, ("Jet",))
    varied = syst.object_variations(
        df, VARIED, ["Jet"], F.col("type") != "data", met=("met_pt", "met_phi"), met_source="Jet"
    )
    hard = coll.n(coll.select(F.col("Jet"), lambda x: x["pt"] >= 25))
    per_event = varied.select("sample", "variation", hard.alias("n"), "met_pt")
    return per_event.groupBy("sample", "variation").agg(
        F.sum("n").alias("n_jets"), F.round(F.sum("met_pt"), 6).alias("met")
    )


# --- nested correction tables ----------------------------------------------------------------------------------


def _log_rise(x, p):
    return p[0] + p[1] * F.log(x["pt"])


def _product(x, p):
    return p[0] * (1 + p[1] * x["pt"] * x["btag"])


_FORMULA_SQL = {_log_rise: "({0} + {1} * ln(pt))", _product: "({0} * (1 + {1} * pt * btag))"}
_PT_EDGES = (5.0, 12.0, 20.0, 31.0, 45.0)


def _by_pt(base, beyond):
    cells = [Formula((_log_rise, _product)[i % 2], (base + 0.01 * i, 0.002 * (i + 1))) for i in range(4)]
    return Binning("pt", _PT_EDGES, cells, beyond)


#: Kind, then a binning of eta of its own, then of pt, then a formula or a number.
NESTED_TABLE = Category(
    "kind",
    {
        "electron": Binning("eta", (-2.5, -1.0, 0.0, 1.0, 2.5), [_by_pt(0.9 + 0.02 * i, "clamp") for i in range(4)], 0.5),
        "muon": Binning("eta", (-1.5, 0.0, 1.5), [_by_pt(1.1, None), 1.25], "clamp"),
    },
    default=Binning("btag", (0.0, 0.4, 0.8), [0.97, _by_pt(0.8, 1.5)], None),
)


def table_sql(node):
    """Nested CASE expressions for a table."""
    if node is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(node, Category):
        cases = " ".join(f"WHEN {node.input} = '{k}' THEN {table_sql(v)}" for k, v in node.of.items())
        return f"CASE {cases} ELSE {table_sql(node.default)} END"
    if isinstance(node, Binning):
        v = node.input
        cells = zip(node.edges, node.edges[1:], node.of, strict=False)
        cases = " ".join(f"WHEN {v} >= {lo!r} AND {v} < {hi!r} THEN {table_sql(n)}" for lo, hi, n in cells)
        if node.beyond == "clamp":
            ends = f"WHEN {v} < {node.edges[0]!r} THEN {table_sql(node.of[0])} ELSE {table_sql(node.of[-1])}"
        else:
            ends = f"ELSE {table_sql(node.beyond)}"
        return f"CASE {cases} {ends} END"
    if isinstance(node, Formula):
        return _FORMULA_SQL[node.fn].format(*[f"{p!r}::DOUBLE" for p in node.parameters])
    return f"{float(node)!r}::DOUBLE"


@query(
    "nested_corrections",
    with_ctes(f"SELECT o_orderkey, idx, round({table_sql(NESTED_TABLE)} + 1e-9, 6) + 0.0 AS factor FROM items", "items"),
)
def nested_corrections(spark, d):
    """Three levels, binnings that differ between branches, and two formulas."""
    inputs = lambda x: {n: x[n] for n in ("kind", "eta", "pt", "btag")}
    rounded = lambda x: (F.round(evaluate(NESTED_TABLE, inputs(x)) + 1e-9, 6) + 0.0).alias("factor")
    found = F.transform("items", lambda x: F.struct(x["idx"].alias("idx"), rounded(x)))
    return either(
        spark,
        d,
        fx.item_lists,
        lambda ev: ev.select(*KEYS, F.inline(found)),
        lambda c: c["items"].rows.select(*KEYS, "item.idx", rounded(F.col("item"))),
    )


@query(
    "nested_weight",
    with_ctes(
        f"""SELECT e.o_orderkey, round(coalesce(w, 1.0) + 1e-9, 6) + 0.0 AS w FROM ev e LEFT JOIN (
              SELECT o_orderkey, product(coalesce({table_sql(NESTED_TABLE)}, 1.0)) AS w FROM items GROUP BY o_orderkey) i
            USING (o_orderkey)""",
        "ev",
        "items",
    ),
)
def nested_weight(spark, d):
    """The product of an event's factors; an item without one counts as 1. (No value ends in a half after the shift.)"""
    inputs = lambda x: {n: x[n] for n in ("kind", "eta", "pt", "btag")}
    factor = lambda x: F.coalesce(evaluate(NESTED_TABLE, inputs(x)), F.lit(1.0))
    w = weights.lookup_product(F.col("items"), factor)
    return fx.items(spark, d).select(*KEYS, (F.round(w + 1e-9, 6) + 0.0).alias("w"))
