"""Event frames derived from the order and line-item tables.

One event is one order, whatever its size; its items are the order's lines. The ``items`` frame has one simple
collection; the ``collisions`` frame has the collections the object definitions read. Each frame can leave out crowded
orders, which the ``crowd_of_..`` functions give as rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.functions import coll, ops
from eventspark.operators import crowded
from eventspark.operators import nest as nesting
from eventspark.operators.checkpoints import pinned
from eventspark.operators.crowded_objects import Crowd
from eventspark.sources import catalog as sample_catalog

ITEM_ORDER = ["ln", "pk", "sk", "q", "price"]
ITEM_FIELDS = {
    "ln": "l_linenumber",
    "pk": "l_partkey",
    "sk": "l_suppkey",
    "q": "l_quantity",
    "price": "l_extendedprice",
    "disc": "l_discount",
    "tax": "l_tax",
    "rf": "l_returnflag",
    "ls": "l_linestatus",
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", *[F.col(c).alias(a) for a, c in ITEM_FIELDS.items()]
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-level columns."""
    return table(spark, sf_dir, "orders").select(*_header_columns())


def _early() -> Column:
    return F.col("o_orderdate") < F.lit("1998-05-01").cast("timestamp_ntz")


def _era() -> Column:
    return F.when(_early(), "2022").otherwise("2022EE")


def _sample() -> Column:
    pd = F.element_at(F.array(F.lit("Muon"), F.lit("EGamma"), F.lit("MuonEG")), (F.col("o_custkey") % 3 + 1).cast("int"))
    even = F.col("o_custkey") % 2 == 0
    letter = F.when(_early(), F.when(even, "C").otherwise("D")).otherwise(F.when(even, "F").otherwise("G"))
    return (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(pd, F.lit("_Run2022"), letter))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("ggHH__"), _era()))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("TTbar__"), _era()))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("DY__"), _era()))
        .otherwise(F.concat(F.lit("WW__"), _era()))
    )


def _header_columns() -> list[Column]:
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "data")
        .when(F.col("o_orderpriority") == "2-HIGH", "signal")
        .otherwise("mc")
    )
    sign = F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(1)
    return [
        F.col("o_orderkey"),
        _era().alias("era"),
        _sample().alias("sample"),
        kind.alias("type"),
        (sign * (F.lit(0.5) + (F.col("o_custkey") % 10) / 10.0)).alias("weight"),
        (F.col("o_orderstatus") == "F").alias("trig_a"),
        (F.col("o_orderstatus") == "O").alias("trig_b"),
        (F.col("o_custkey") % 3 == 0).alias("trig_c"),
        (F.col("o_totalprice") / 5000.0).alias("met_pt"),
        ((F.col("o_custkey") % 628) / 100.0 - 3.14).alias("met_phi"),
        (355_100 + F.col("o_custkey") % 20).alias("run"),
        (F.col("o_orderkey") % 64).alias("luminosityBlock"),
    ]


def crowded_orders(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """Keys and sizes of the orders that are not nested."""
    return crowded.crowded_keys(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


def _ordinary(df: DataFrame, key: str, without: DataFrame | None) -> DataFrame:
    return df if without is None else crowded.split(df, key, without, False)


def nested(
    spark: SparkSession, sf_dir: str, without: DataFrame | None = None, having: nesting.Having = ()
) -> DataFrame:
    """Headers with their raw lines as an ordered array ``items``; the orders ``without`` are left out.

    With ``having`` only the orders whose lines reach one of its sums.
    """
    return nesting.nest(
        _ordinary(headers(spark, sf_dir), "o_orderkey", without),
        "o_orderkey",
        _ordinary(raw_items(spark, sf_dir), "l_orderkey", without),
        "l_orderkey",
        ITEM_ORDER,
        list(ITEM_FIELDS),
        having,
    )


def _charge(r: Column) -> Column:
    return F.when(r["ls"] == "O", 1).otherwise(-1)


def _axis(r: Column) -> list[Column]:
    return [((r["disc"] - 0.05) * 50).alias("eta"), ((r["pk"] % 628) / 100.0 - 3.14).alias("phi")]


def _ref(r: Column, at: Column, size: Column) -> Column:
    return F.when((at >= 0) & (at < size), at).otherwise(-1)


def _simple_item(r: Column, i: Column, size: Column) -> Column:
    return F.struct(
        i.alias("idx"),
        F.when(r["rf"] == "R", "electron").when(r["rf"] == "A", "muon").otherwise("jet").alias("kind"),
        r["q"].alias("pt"),
        *_axis(r),
        r["tax"].alias("mass"),
        _charge(r).alias("charge"),
        (r["price"] / 105000.0).alias("btag"),
        r["sk"].alias("mask"),
        _ref(r, r["ln"] - 1, size).alias("ref"),
    )


def _simple_items() -> Column:
    return F.transform("items", lambda r, i: _simple_item(r, i, F.size("items")))


def items(spark: SparkSession, sf_dir: str, without: DataFrame | None = None) -> DataFrame:
    """Events with one collection ``items`` of electrons, muons and jets."""
    return nested(spark, sf_dir, without).withColumn("items", _simple_items())


def item_lists(spark: SparkSession, sf_dir: str, without: DataFrame | None = None) -> DataFrame:
    """The collections alone (``o_orderkey, items``), for queries that need no event-level column."""
    lines = _ordinary(raw_items(spark, sf_dir), "l_orderkey", without)
    lists = nesting.nest_items(lines, "l_orderkey", ITEM_ORDER, list(ITEM_FIELDS))
    return lists.withColumn("items", _simple_items()).withColumnRenamed("l_orderkey", "o_orderkey")


def of_kind(kind: str) -> Column:
    return coll.select(F.col("items"), lambda x: x["kind"] == kind)


# sample, era, type, group, cross-section, branching ratio of the fixture's catalogue
SAMPLES = [
    *[
        (f"{pd}_Run2022{letter}", era, "data", "Data", None, None)
        for pd in ("Muon", "EGamma", "MuonEG")
        for letter, era in (("C", "2022"), ("D", "2022"), ("F", "2022EE"), ("G", "2022EE"))
    ],
    *[
        (f"{name}__{era}", era, kind, group, xs, br)
        for name, kind, group, xs, br in (
            ("ggHH", "signal", None, 0.5, 0.25),
            ("TTbar", "mc", "TTbar", 0.2, None),
            ("DY", "mc", "DY", 0.5, None),
            ("WW", "mc", "VV", 0.1, None),
        )
        for era in ("2022", "2022EE")
    ],
]


def catalog(spark: SparkSession) -> DataFrame:
    samples = {
        s: {"era": e, "type": t, "group": g, "cross-section": x, "branching-ratio": b} for s, e, t, g, x, b in SAMPLES
    }
    return sample_catalog.sample_table(spark, samples)


def ml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat scored rows, one per order: class, weights, a few features and a score with ties."""
    signal = F.col("o_orderpriority") == "2-HIGH"
    mixed = (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 500
    return table(spark, sf_dir, "orders").select(
        *_header_columns(),
        _sample().alias("process"),
        (F.col("o_totalprice") / 1000.0).alias("pt"),
        (F.col("o_totalprice") / 100000.0 - 2.5).alias("leadingLepton_phi"),
        ((mixed + F.when(signal, 250).otherwise(0) + 1) / 752.0).alias("score"),
        (1 + F.col("o_custkey") % 5).cast("double").alias("w_roc"),
        (1 + F.col("o_orderkey") % 3).cast("double").alias("w_sig"),
    )


def _lepton_fields(r: Column, size: Column) -> list[Column]:
    return [
        r["q"].alias("pt"),
        *_axis(r),
        r["tax"].alias("mass"),
        _charge(r).alias("charge"),
        ((r["sk"] % 60) / 1000.0).alias("dxy"),
        ((r["pk"] % 23) / 200.0).alias("dz"),
        (r["sk"] % 10).cast("double").alias("sip3d"),
        ((r["pk"] % 9) / 20.0).alias("miniPFRelIso_all"),
        ((r["sk"] % 12) / 10.0).alias("jetRelIso"),
        F.when(r["pk"] % 4 == 0, _ref(r, r["ln"] - 1, size)).otherwise(-1).alias("jetIdx"),
    ]


def _muon(r: Column, size: Column) -> Column:
    return F.struct(
        *_lepton_fields(r, size),
        (_charge(r) * -13).alias("pdgId"),
        (1 - (r["pk"] % 101) / 150.0).alias("mvaTTH"),
        (r["pk"] % 20 != 0).alias("looseId"),
        (r["pk"] % 5 != 0).alias("mediumId"),
    )


def _electron(r: Column, size: Column) -> Column:
    return F.struct(
        *_lepton_fields(r, size),
        (_charge(r) * -11).alias("pdgId"),
        (1 - (r["pk"] % 101) / 120.0).alias("mvaTTH"),
        F.when(r["ln"] == 7, 2).when(r["ln"] == 3, 1).otherwise(0).alias("lostHits"),
        ((r["sk"] % 5 - 2) / 100.0).alias("deltaEtaSC"),
        ((r["pk"] % 8) / 1000.0 + 0.005).alias("sieie"),
        ((r["sk"] % 11) / 100.0 + 0.005).alias("hoe"),
        ((r["pk"] % 6) / 100.0 - 0.045).alias("eInvMinusPInv"),
        (r["sk"] % 25 != 0).alias("convVeto"),
        (r["pk"] % 3 != 0).alias("mvaNoIso_WP90"),
    )


def _jet_id(r: Column) -> Column:
    return F.when(r["sk"] % 8 == 0, F.lit(1).cast("long")).otherwise(2 + 4 * (r["pk"] % 2))


def _jet(r: Column, size: Column) -> Column:
    return F.struct(
        (r["q"] * 2).alias("pt"),
        *_axis(r),
        (r["tax"] * 100).alias("mass"),
        _jet_id(r).alias("jetId"),
        (r["price"] / 105000.0).alias("btagDeepFlavB"),
    )


def _fat_jet(r: Column, size: Column) -> Column:
    return F.struct(
        (r["q"] * 10).alias("pt"),
        *_axis(r),
        r["q"].alias("mass"),
        _jet_id(r).alias("jetId"),
        (r["price"] / 500.0).alias("msoftdrop"),
        ((r["pk"] % 10) / 10.0).alias("tau1"),
        ((r["sk"] % 8) / 12.0).alias("tau2"),
        (r["price"] / 105000.0).alias("btagDeepB"),
        _ref(r, r["ln"] - 5, size).alias("subJet1Idx"),
        _ref(r, r["ln"] - 4, size).alias("subJet2Idx"),
    )


def _sub_jet(r: Column, size: Column) -> Column:
    return F.struct(
        (r["q"] * 4).alias("pt"),
        *_axis(r),
        (r["tax"] * 50).alias("mass"),
        (1 - r["price"] / 105000.0).alias("btagDeepB"),
    )


def _tau(r: Column, size: Column) -> Column:
    mode = F.element_at(F.array(*[F.lit(m) for m in (0, 1, 2, 5, 6, 10, 11)]), r["ln"])
    return F.struct(
        r["q"].alias("pt"),
        *_axis(r),
        r["tax"].alias("mass"),
        ((r["sk"] % 60) / 1000.0).alias("dxy"),
        ((r["pk"] % 23) / 100.0).alias("dz"),
        (r["sk"] % 10 != 0).alias("idDecayModeOldDMs"),
        mode.alias("decayMode"),
        ((r["sk"] + r["pk"]) % 32).alias("idDeepTau2017v2p1VSjet"),
        F.when(r["ln"] == 4, 2).otherwise(3).alias("idDeepTau2017v2p1VSe"),
        (1 + r["sk"] % 3).alias("idDeepTau2017v2p1VSmu"),
    )


def _gen_part(r: Column, size: Column) -> Column:
    return F.struct(
        (r["q"] * 6).alias("pt"),
        F.when(r["rf"] == "A", _charge(r) * 6).otherwise(21).alias("pdgId"),
        (8192 * (r["pk"] % 2) + r["sk"] % 4096).alias("statusFlags"),
    )


# collection -> (item expression, lines that enter it)
COLLECTIONS = {
    "Muon": (_muon, lambda r: r["rf"] == "A"),
    "Electron": (_electron, lambda r: r["rf"] == "R"),
    "Jet": (_jet, None),
    "FatJet": (_fat_jet, lambda r: r["ln"] >= 5),
    "SubJet": (_sub_jet, None),
    "Tau": (_tau, lambda r: r["pk"] % 7 == 0),
    "GenPart": (_gen_part, lambda r: r["pk"] % 3 != 0),
}


def collisions(
    spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(COLLECTIONS), without: DataFrame | None = None
) -> DataFrame:
    """Events with the collections the object definitions read; ``idx`` is the position in each collection."""
    return with_collections(nested(spark, sf_dir, without), *names).drop("items")


def leptons_first(
    spark: SparkSession,
    sf_dir: str,
    without: DataFrame | None = None,
    having: Sequence[tuple[Mapping[str, coll.Predicate], int]] = (),
) -> DataFrame:
    """:func:`collisions` with what leptons are defined by; :func:`with_collections` adds the other collections later.

    With ``having``, pairs of conditions by collection and a least number, only events that for one of the pairs have so
    many items that fulfil the condition of their collection. It must not read ``idx`` or cross references: it is tested on
    the lines, before they are nested.
    """
    enough = [(_matches(conditions), least) for conditions, least in having]
    return with_collections(nested(spark, sf_dir, without, enough), "Muon", "Electron", "Jet")


def _matches(conditions: Mapping[str, coll.Predicate]) -> Column:
    """How many items of the collections a line makes that fulfil the condition of their collection."""
    line = {f: F.col(f) for f in ITEM_FIELDS}  # a struct would be repeated in the plan with every use

    def holds(name: str, pred: coll.Predicate) -> Column:
        make, keep = COLLECTIONS[name]
        found = pred(make(line, F.lit(0)))
        return ops.passed(found if keep is None else keep(line) & found).cast("int")

    first, *more = [holds(name, pred) for name, pred in conditions.items()]
    return sum(more, first)


def with_collections(df: DataFrame, *names: str) -> DataFrame:
    """Collections of the lines ``items``, which stay; all missing ones without ``names``. They are NULL where ``items`` is."""

    def build(name: str) -> Column:
        make, keep = COLLECTIONS[name]
        lines = F.col("items") if keep is None else F.filter("items", keep)
        return F.transform(lines, lambda r, i: make(r, F.size("items")).withField("idx", i))

    return df.withColumns({n: build(n) for n in names or COLLECTIONS if n not in df.columns})


def _crowded_lines(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    return crowded.split(raw_items(spark, sf_dir), "l_orderkey", keys, True).withColumnRenamed("l_orderkey", "o_orderkey")


def _line_order() -> Column:
    return F.struct(*ITEM_ORDER, *[f for f in ITEM_FIELDS if f not in ITEM_ORDER])


def crowd_of_lists(spark: SparkSession, sf_dir: str, keys: DataFrame) -> Crowd:
    """What :func:`item_lists` has, for the orders ``keys``, as rows."""
    found = crowded.items_of(_crowded_lines(spark, sf_dir, keys), "o_orderkey", _line_order(), _simple_item).pinned()
    return Crowd(keys.select(F.col(keys.columns[0]).alias("o_orderkey")), {"items": found})


def _with_headers(spark: SparkSession, sf_dir: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    heads = pinned(crowded.split(headers(spark, sf_dir), "o_orderkey", keys, True))
    return heads, heads.select("o_orderkey")


def crowd_of_items(spark: SparkSession, sf_dir: str, keys: DataFrame) -> Crowd:
    """What :func:`items` has, for the orders ``keys``, as rows."""
    heads, own = _with_headers(spark, sf_dir, keys)
    return Crowd(heads, crowd_of_lists(spark, sf_dir, own).collections)


def crowd_of_collisions(
    spark: SparkSession, sf_dir: str, keys: DataFrame, names: tuple[str, ...] = tuple(COLLECTIONS)
) -> Crowd:
    """What :func:`collisions` has, for the orders ``keys``, as rows."""
    heads, own = _with_headers(spark, sf_dir, keys)
    whole = lambda r, i, size: r.withField("idx", i).withField("size", size)
    lines = crowded.items_of(_crowded_lines(spark, sf_dir, own), "o_orderkey", _line_order(), whole).pinned()

    def build(name: str) -> crowded.Items:
        make, keep = COLLECTIONS[name]
        chosen = lines if keep is None else crowded.renumbered(lines.select(keep))
        return chosen.mapped(lambda r: make(r, r["size"]).withField("idx", r["idx"]))

    return Crowd(heads, {n: build(n) for n in names})