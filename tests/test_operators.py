import math

import pyarrow as pa
import pytest
from builders import column, events, jet, top
from pyspark.sql import functions as F

from eventspark.operators import events as ev
from eventspark.operators import hist, nest, norm, report, syst, weights
from eventspark.sources import catalog, events_io, skim


def frame(spark, **columns):
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))


# --- nesting ---------------------------------------------------------------------------------------------------


def _items(spark):
    """Key 1 holds most rows, a third of them identical; key 2 is ordinary."""
    rows = [(1, i % 7, float(i)) for i in range(400)] + [(1, 3, 99.0)] * 200 + [(2, 1, 5.0), (2, 0, 6.0)]
    return spark.createDataFrame(rows, "k long, a int, v double").repartition(5)


def test_a_key_is_one_event_whatever_its_size(spark):
    items = _items(spark)
    heads = spark.createDataFrame([(1, "x"), (2, "y"), (4, "none")], "h long, tag string")
    out = nest.nest(heads, "h", items, "k", ["a", "v"], ["a", "v"]).collect()
    plain = [(r["k"], r["a"], r["v"]) for r in items.collect()]
    expected = {k: sorted((a, v) for kk, a, v in plain if kk == k) for k in (1, 2, 4)}
    assert {r["h"]: [(i["a"], i["v"]) for i in r["items"]] for r in out} == expected
    assert sorted((r["h"], r["tag"]) for r in out) == [(1, "x"), (2, "y"), (4, "none")]


def test_items_alone(spark):
    out = nest.nest_items(_items(spark).filter("k = 2"), "k", ["a", "v"], ["v"]).collect()
    assert [[i["a"] for i in r["items"]] for r in out] == [[0, 1]]


def test_only_keys_with_enough_items_are_nested(spark):
    """A kept key keeps all its items, whichever of the sums it reaches."""
    items = spark.createDataFrame([(1, 1), (1, 9), (2, 5), (2, 6), (3, 1), (4, None), (4, 7)], "k long, a int").repartition(3)
    above = lambda low: F.coalesce((F.col("a") > low).cast("int"), F.lit(0))
    having = [(above(4), 2), (above(8), 1)]
    out = nest.nest_items(items, "k", ["a"], ["a"], having).collect()
    assert {r["k"]: [i["a"] for i in r["items"]] for r in out} == {1: [1, 9], 2: [5, 6]}
    heads = spark.createDataFrame([(1,), (3,), (5,)], "h long")
    assert [r["h"] for r in nest.nest(heads, "h", items, "k", ["a"], ["a"], having).collect()] == [1]


# --- events ----------------------------------------------------------------------------------------------------


def test_certified_ranges_are_inclusive_and_never_repeat_events(spark):
    df = frame(spark, run=[1, 1, 1, 1, 2, 9], luminosityBlock=[10, 20, 21, 15, 15, 15])
    ranges = ev.lumi_ranges(spark, {"1": [[10, 20], [12, 18]], "9": [[1, 100]]})
    kept = ev.certified(df, ranges, run_range=(1, 5)).orderBy("luminosityBlock").collect()
    assert [(r["run"], r["luminosityBlock"]) for r in kept] == [(1, 10), (1, 15), (1, 20)]


def test_missing_trigger_columns_are_skipped(spark):
    df = frame(spark, HLT_IsoMu24=[True, False], HLT_Ele32_WPTight_Gsf=[False, False])
    bits, missing = ev.trigger_cols(df, ["IsoMu24", "IsoMu27"])
    assert len(bits) == 1 and missing == ["IsoMu27"]
    by = ev.triggers_by_dataset(df)
    assert {k: len(v) for k, v in by.items()} == {"Muon": 1, "EGamma": 1, "MuonEG": 0, "SingleMuon": 1, "DoubleMuon": 0}
    assert [r[0] for r in df.select(ev.trigger_any(by)).collect()] == [True, False]
    nested = df.select(F.struct(F.col("HLT_IsoMu24").alias("IsoMu24")).alias("HLT"))
    assert len(ev.trigger_cols(nested, ["IsoMu24"])[0]) == 1


def test_data_trigger_keeps_an_event_in_one_dataset_only(spark):
    df = frame(
        spark,
        sample=["Muon_Run2022C", "EGamma_Run2022C", "MuonEG_Run2022C", "EGamma_Run2022C", "MuonEG_Run2022C", "Other_Run2022C"],
        m=[True, True, False, False, False, True],
        e=[True, True, True, True, False, True],
        x=[True, True, True, False, True, True],
    )
    bits = {"Muon": [F.col("m")], "EGamma": [F.col("e")], "MuonEG": [F.col("x")]}
    keep = ev.trigger_primary(ev.primary_dataset(F.col("sample")), bits)
    assert [r[0] for r in df.select(keep).collect()] == [True, False, False, True, True, False]
    mixed = ev.trigger(df, F.col("sample") != "Other_Run2022C", F.col("sample"), bits)
    assert mixed.count() == 4


# --- weights ---------------------------------------------------------------------------------------------------


def test_top_pt_weight(spark):
    rows = [[top(pt=100.0), top(pt=200.0, pdgId=-6)], [top()], [top(), top(pdgId=-6, statusFlags=1)], []]
    df = events(spark, *rows)
    w = lambda pt: 0.103 * math.exp(-0.0118 * pt) - 0.000134 * pt + 0.973
    got = column(df, weights.top_pt(F.col("GenPart"), F.lit("TTto2L2Nu")))
    assert got == pytest.approx([math.sqrt(w(100.0) * w(200.0)), 1.0, 1.0, 1.0])
    assert column(df, weights.top_pt(F.col("GenPart"), F.lit("WW"))) == [1.0] * 4


def test_binned_factor_product(spark):
    bins = [weights.FactorBin("b", 0, 50, 0, 2.5, 1.1), weights.FactorBin("b", 50, 100, 0, 2.5, 0.5)]
    df = events(spark, [jet(pt=49.9), jet(pt=50.0), jet(pt=100.0)], [])
    factor = lambda x: weights.binned_factor(bins, F.lit("b"), x["pt"], F.abs(x["eta"]))
    assert column(df, weights.lookup_product(F.col("Jet"), factor)) == pytest.approx([0.55, 1.0])


def test_binned_factor_equals_a_search_of_all_bins(spark):
    """Edges, gaps, overlaps, items outside, NaN and NULL."""
    bins = [
        weights.FactorBin("b", x, x + 7.0, y, y + 0.5, 1 + x / 100 + y) for x in (0.0, 7.0, 21.0) for y in (0.0, 0.5, 1.5)
    ] + [weights.FactorBin("b", 5.0, 25.0, 0.25, 2.25, 3.0), weights.FactorBin("l", 0.0, 50.0, 0.0, 3.0, 0.5)]
    values = [(f, x / 2, y / 4) for f in ("b", "l", "c") for x in range(-2, 60) for y in range(-1, 12)]
    values += [("b", float("nan"), 0.3), ("b", None, 0.3), (None, 1.0, 0.3)]
    df = spark.createDataFrame(values, "f string, x double, y double")
    got = df.select("f", "x", "y", weights.binned_factor(bins, F.col("f"), F.col("x"), F.col("y")).alias("w")).collect()
    for r in got:
        hit = [
            b.factor for b in bins
            if r.f == b.flavour and r.x is not None and b.x_low <= r.x < b.x_high and b.y_low <= r.y < b.y_high
        ]
        assert r.w == (hit[0] if hit else 1.0), r


def test_certified_asks_only_data(spark):
    df = frame(spark, type=["data", "data", "mc", "data"], run=[1, 1, 9, 2], luminosityBlock=[5, 50, 50, 5])
    ranges = ev.lumi_ranges(spark, {1: [(0, 10)], 3: [(0, 99)]})
    kept = ev.certified(df, ranges, only=F.col("type") == "data")
    assert kept.columns == df.columns
    assert sorted((r["type"], r["run"], r["luminosityBlock"]) for r in kept.collect()) == [("data", 1, 5), ("mc", 9, 50)]


def test_corrections_need_every_tag(spark):
    with pytest.raises(ValueError, match="RunF"):
        weights.corrected(F.col("Jet"), [weights.FactorBin(t, -5, 5, 0, 1e4, 1.0) for t in weights.JEC_TAGS.values() if "RunF" not in t])


def test_met_follows_the_jets(spark):
    df = events(spark, [jet(pt=100.0, phi=0.0)], [])
    after = weights.scale_items(F.col("Jet"), lambda _: F.lit(1.1))
    pt, phi = weights.met_shift(F.lit(30.0), F.lit(0.0), F.col("Jet"), after)
    assert column(df, pt) == pytest.approx([20.0, 30.0])
    assert column(df, phi) == pytest.approx([0.0, 0.0])


def test_jec_tags(spark):
    factors = {tag: 1.0 for tag in weights.JEC_TAGS.values()}
    df = frame(spark, era=["2022", "2022EE"], run_era=["C", "MC"])
    got = {(r["era"], r["run_era"]): r["jec_tag"] for r in weights.with_jec(df, weights.jec_table(spark, factors)).collect()}
    assert got[("2022", "C")].endswith("RunCD_V2_DATA") and got[("2022EE", "MC")].endswith("V2_MC")


def test_object_variations_leave_data_nominal(spark):
    df = events(spark, [jet(pt=100.0)], [jet(pt=100.0)], scalars={"mc": [True, False], "mp": [10.0, 10.0], "mf": [0.0, 0.0]})
    out = syst.object_variations(df, {"up": 1.1, "jerdown": 0.9}, ["Jet"], F.col("mc"), ("mp", "mf"), "Jet")
    rows = {(r["event"], r["variation"]): (r["Jet"][0]["pt"], r["mp"]) for r in out.collect()}
    assert set(rows) == {(0, "nominal"), (0, "up"), (0, "jerdown"), (1, "nominal")}
    assert rows[(0, "up")] == pytest.approx((110.0, 0.0)) and rows[(0, "jerdown")] == pytest.approx((90.0, 10.0))


def test_weight_variations(spark):
    df = frame(spark, w=[2.0], t=[0.5])
    out = syst.weight_variations(df, F.col("w") * F.col("t"), {"noTopPt": F.col("w")})
    assert {r["variation"]: r["weight"] for r in out.collect()} == {"nominal": 1.0, "noTopPt": 2.0}


def test_scales(spark):
    table = catalog.sample_table(
        spark,
        {
            "mc": {"era": "2022", "type": "mc", "group": "DY", "cross-section": 2.0, "branching-ratio": 0.5},
            "data": {"era": "2022", "type": "data", "group": "data"},
            "empty": {"era": "2022", "type": "mc", "cross-section": 2.0},
        },
    )
    sums = norm.weight_sums(frame(spark, sample=["mc", "mc", "data"], w=[3.0, 1.0, 1.0]), F.col("w"))
    got = {r["sample"]: r["scale"] for r in norm.scales(table, sums).collect()}
    assert got == {"mc": 8077.0 / 4.0, "data": 1.0, "empty": None}


# --- histograms and reports ------------------------------------------------------------------------------------


def test_bin_edges(spark):
    values = [-0.1, 0.0, 0.99, 1.0, 9.99, 10.0, math.nan, None]
    df = frame(spark, v=values)
    got = [r[0] for r in df.select(hist.bin_index(F.col("v"), 10, 0.0, 10.0)).collect()]
    assert got == [0, 1, 1, 2, 10, 11, 11, None]
    h = hist.fill(df, F.col("v"), 10, 0.0, 10.0, F.lit(2.0)).collect()
    assert {r["bin"]: (r["sumw"], r["sumw2"], r["n"]) for r in h} == {
        0: (2.0, 4.0, 1), 1: (4.0, 8.0, 2), 2: (2.0, 4.0, 1), 10: (2.0, 4.0, 1), 11: (4.0, 8.0, 2)
    }
    folded = {r["bin"]: r["n"] for r in hist.fold(hist.fill(df, F.col("v"), 10, 0.0, 10.0, F.lit(1.0)), 10, []).collect()}
    assert folded == {1: 3, 2: 1, 10: 3}


def test_many_equals_one_by_one(spark):
    df = frame(spark, x=[0.5, 1.5, None, math.nan], y=[5, 6, 7, 8], keep=[True, True, True, False], w=[1.0, 2.0, 3.0, 4.0])
    plots = [hist.Plot("x", "keep", F.col("x"), 4, 0.0, 2.0), hist.Plot("y", "keep", F.col("y"), 3, 5.0, 8.0)]
    got = {(r["plot"], r["bin"]): (r["sumw"], r["n"]) for r in hist.fill_many(df, plots, F.col("w")).collect()}
    want = {}
    for p in plots:
        for r in hist.fill(df.filter("keep"), p.var, p.n, p.lo, p.hi, F.col("w")).collect():
            want[(p.name, r["bin"])] = (r["sumw"], r["n"])
    assert got == want


def test_adaptive_open_and_closed(spark):
    df = frame(spark, v=[0.0, 5.0, 10.0], g=["a", "a", "a"])
    for closed, total in ((False, 2), (True, 3)):
        h = hist.adaptive(df, "v", 50, F.lit(1.0), ["g"], closed)
        assert h.agg(F.sum("n")).first()[0] == total


def test_adaptive_leaves_nan_and_null_out(spark):
    df = frame(spark, v=[0.0, 5.0, 10.0, math.nan, None], g=["a"] * 5)
    bins = {r["bin"]: r["n"] for r in hist.adaptive(df, "v", 2, F.lit(1.0), ["g"], True).collect()}
    assert bins == {1: 1, 2: 2}


def test_cumulative_ends_at_one(spark):
    df = frame(spark, v=[0.0, 1.0, 2.0, 3.0, 4.0], g=["a", "a", "b", "b", "b"])
    h = hist.every_bin(hist.adaptive(df, "v", 4, F.lit(1.0), ["g"], True), 4, ["g"])
    rows = hist.cumulative(h, ["g"]).collect()
    assert all(r["cum_left"] == pytest.approx(1.0) for r in rows if r["bin"] == 4)
    assert all(r["cum_right"] == pytest.approx(1.0) for r in rows if r["bin"] == 1)


def test_stack_orders_by_yield_and_accumulates(spark):
    g = frame(spark, plot=["p"] * 5, grp=["big", "small", "big", "small", "data"], type=["mc"] * 4 + ["data"],
              bin=[1, 1, 2, 2, 1], sumw=[10.0, 1.0, 20.0, 2.0, 11.0], sumw2=[1.0] * 5, n=[1] * 5)
    rows = {(r["grp"], r["bin"]): (r["rank"], r["stacked"]) for r in report.stack(g, ["plot"]).collect()}
    assert rows == {("small", 1): (1, 1.0), ("big", 1): (2, 11.0), ("small", 2): (1, 2.0), ("big", 2): (2, 22.0)}


def test_ratio_and_blinding(spark):
    g = frame(spark, grp=["d", "m"], type=["data", "mc"], bin=[1, 1], sumw=[6.0, 4.0], sumw2=[6.0, 4.0], n=[6, 4])
    r = report.ratio(g, []).first()
    assert (r["ratio"], r["ratio_err"], r["mc_rel_err"]) == pytest.approx((1.5, math.sqrt(6) / 4, 0.5))
    h = frame(spark, type=["Data"] * 4 + ["mc"], bin=[1, 2, 3, 4, 2], sumw=[1.0] * 5, sumw2=[1.0] * 5, n=[1] * 5)
    hidden = [x["sumw"] for x in report.blind(h, 4, 0.0, 4.0, (1.5, 2.0)).collect()]
    assert hidden == [1.0, None, 1.0, 1.0, 1.0]


def test_groups_match_without_case(spark):
    table = catalog.sample_table(
        spark,
        {"a": {"era": "2022", "type": "data", "group": "data"}, "b": {"era": "2022", "type": "data", "group": "Data"},
         "c": {"era": "2022", "type": "signal"}},
    ).withColumn("scale", F.lit(1.0))
    h = frame(spark, sample=["a", "b", "c"], bin=[1, 1, 1], sumw=[1.0] * 3, sumw2=[1.0] * 3, n=[1] * 3)
    got = {r["grp"]: r["n"] for r in report.by_group(h, table, []).collect()}
    assert got == {"data": 2, "c": 1}


# --- sources ---------------------------------------------------------------------------------------------------

TEMPLATES = {
    "TT": {"dbs": {"2022": ["a", "b"], "2022EE": "c"}, "type": "mc", "group": "TTbar"},
    "TTup": {"dbs": {"2022": "u"}, "type": "mc", "syst": ["up", "TT"]},
    "Muon_Run2022C": {"era": "2022", "db": "m", "type": "data"},
    "Muon_Run2022F": {"era": "2022EE", "db": "m", "type": "data"},
}


EXPANDED = {
    "TT__2022": ("2022", ["a", "b"], None, "mc"),
    "TT__2022__up": ("2022", ["u"], ["up", "TTup__2022"], "mc"),
    "Muon_Run2022C": ("2022", ["m"], None, "data"),
    "Muon_Run2022F": ("2022EE", ["m"], None, "data"),
}


def test_expand_table(spark):
    rows = [
        (
            name,
            {e: [d] if isinstance(d, str) else d for e, d in t["dbs"].items()} if "dbs" in t else None,
            [t["db"]] if "db" in t else None,
            t.get("era"),
            t.get("syst"),
            t["type"],
        )
        for name, t in TEMPLATES.items()
    ]
    schema = "name string, dbs map<string,array<string>>, db array<string>, era string, syst array<string>, type string"
    got = catalog.expand(spark.createDataFrame(rows, schema), ["2022"]).collect()
    assert {r["name"]: (r["era"], r["db"], r["syst"], r["type"]) for r in got} == EXPANDED


@pytest.mark.parametrize(
    "name,era", [("Muon_Run2022C", "C"), ("EGamma_Run2022", ""), ("TTto2L2Nu__2022", "MC"), ("X_Run2018D_v1", "D")]
)
def test_run_era(spark, name, era):
    assert spark.range(1).select(catalog.run_era(F.lit(name))).first()[0] == era


def test_read_events_unions_samples_and_caps_files(spark, tmp_path):
    for i in range(2):
        frame(spark, run=[i, 100], Muon_pt=[[1.0], []]).coalesce(1).write.parquet(str(tmp_path / f"a{i}"))
    frame(spark, run=[5], HLT_X=[True]).coalesce(1).write.parquet(str(tmp_path / "b"))
    samples = {
        "A": {"paths": [str(tmp_path / "a0"), str(tmp_path / "a1")], "era": 2022, "type": "data", "run_range": [0, 50]},
        "B": {"paths": [str(tmp_path / "b")], "era": 2022, "type": "mc"},
    }
    rows = events_io.read_events(spark, samples).collect()
    assert sorted((r["sample"], r["run"], r["HLT_X"]) for r in rows) == [("A", 0, None), ("A", 1, None), ("B", 5, True)]
    assert events_io.read_events(spark, samples, max_files=1).filter("sample = 'A'").count() == 1


def test_zip_reads_only_the_listed_arrays(spark, tmp_path):
    path = str(tmp_path / "e")
    frame(spark, event=[1], Jet_pt=[[1.0, 2.0]], Jet_eta=[[0.0, 0.1]], Jet_other=[[9.0, 9.0]]).write.parquet(path)
    df = events_io.zip_collections(spark.read.parquet(path), {"Jet": ("pt", "eta")}).select("event", "Jet")
    assert [i.asDict() for i in df.first()["Jet"]] == [
        {"pt": 1.0, "eta": 0.0, "idx": 0}, {"pt": 2.0, "eta": 0.1, "idx": 1}
    ]
    assert "Jet_other" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        events_io.zip_collections(spark.read.parquet(path), {"Jet": ("pt", "mass")})


def test_skim_write_is_kept_unless_overwritten(spark, tmp_path):
    path = str(tmp_path / "skim")
    skim.write(frame(spark, x=[1]), path)
    skim.write(frame(spark, x=[2]), path)
    assert [r["x"] for r in skim.read(spark, path).collect()] == [1]
    skim.write(frame(spark, x=[2]), path, overwrite=True)
    assert [r["x"] for r in skim.read(spark, path).collect()] == [2]


def test_skim_merge(spark):
    scales = frame(spark, sample=["s", "d"], grp=["G", None], type=["mc", "data"], scale=[2.0, 1.0])
    rows = frame(spark, sample=["s", "d"], weight=[1.5, 1.0])
    merged = {r["process"]: r["weight"] for r in skim.merge(rows, scales, 2).collect()}
    assert merged == {"G": 3.0, "d": 1.0}
    assert skim.merge(rows, scales, 2, include_data=False).count() == 1


# --- nothing is lost silently -------------------------------------------------------------------------------------


def test_a_column_of_only_one_file_of_a_sample_is_kept(spark, tmp_path):
    frame(spark, run=[1]).coalesce(1).write.parquet(str(tmp_path / "main"))
    frame(spark, run=[2], HLT_X=[True]).coalesce(1).write.parquet(str(tmp_path / "ext"))
    for paths in (["main", "ext"], ["ext", "main"]):
        got = events_io.read_sample(spark, "s", [str(tmp_path / p) for p in paths]).collect()
        assert sorted((r["run"], r["HLT_X"]) for r in got) == [(1, None), (2, True)]


def test_an_unknown_correction_tag_fails_by_name(spark):
    table = weights.jec_table(spark, dict.fromkeys(weights.JEC_TAGS.values(), 1.0))
    with pytest.raises(Exception, match="no jet correction for era 2022 and run Q"):
        weights.with_jec(frame(spark, era=["2022"], run_era=["Q"]), table).collect()


def test_a_sample_missing_from_the_catalogue_fails_by_name(spark):
    listed = frame(spark, sample=["a"], grp=["g"], type=["mc"], scale=[2.0])
    hist_rows = frame(spark, sample=["a", "lost"], bin=[1, 1], sumw=[1.0, 1.0], sumw2=[1.0, 1.0], n=[1, 1])
    flow = frame(spark, sample=["lost"], selection=["s"], sumw=[1.0])
    for made in (
        report.by_group(hist_rows, listed, ()),
        report.yields(flow, listed, ["g"]),
        norm.apply_scale(frame(spark, sample=["lost"], weight=[1.0]), listed, 1),
    ):
        with pytest.raises(Exception, match="no scale for sample lost"):
            made.collect()


def test_a_sample_without_luminosity_fails_by_name(spark):
    listed = frame(spark, sample=["a"], grp=["g"], type=["mc"], scale=pa.array([None], pa.float64()))
    with pytest.raises(Exception, match="no scale for sample a"):
        norm.apply_scale(frame(spark, sample=["a"], weight=[1.0]), listed, 1).collect()
