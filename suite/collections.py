"""Queries for sources, predicates and in-event collection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventspark.functions import coll, kin, ops
from eventspark.operators import events, mlprep
from eventspark.operators.selection import Selection, with_flags
from eventspark.plans import fixture as fx
from eventspark.sources import catalog, events_io
from suite.either import either
from suite.registry import query
from suite.sqlparts import dr, invm, with_ctes

KEYS = ("o_orderkey",)


def r4(c):
    return F.round(c, 4)


# --- sources ---------------------------------------------------------------------------------------------------


@query(
    "sample_expand",
    """
WITH t AS (SELECT o_orderpriority AS name, CAST(year(o_orderdate) AS VARCHAR) AS era,
             list_sort(list(DISTINCT o_orderstatus)) AS db FROM orders GROUP BY 1, 2)
SELECT CASE WHEN name LIKE '5%' THEN '4-NOT SPECIFIED__' || era || '__low' ELSE name || '__' || era END AS name,
  era, array_to_string(db, ',') AS db, CASE WHEN name LIKE '5%' THEN name || '__' || era END AS replaces
FROM t WHERE name NOT LIKE '1%' AND era IN ('1996', '1997', '1998')
UNION ALL
SELECT name, NULL, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ','), NULL
FROM (SELECT o_orderpriority AS name, o_orderstatus FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY name
""",
)
def sample_expand(spark, d):
    """Templates built from the order table: one per priority, datasets (statuses) listed per year."""
    orders = fx.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("name"), F.year("o_orderdate").cast("string").alias("era"), "o_orderstatus"
    )
    statuses = F.array_sort(F.collect_set("o_orderstatus"))
    plain = F.col("name").startswith("1")
    per_era = orders.filter(~plain).groupBy("name", "era").agg(statuses.alias("db"))
    dbs = per_era.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("era", "db"))).alias("dbs"))
    syst = F.when(F.col("name").startswith("5"), F.array(F.lit("low"), F.lit("4-NOT SPECIFIED")))
    templates = dbs.withColumn("syst", syst).unionByName(
        orders.filter(plain).groupBy("name").agg(statuses.alias("db")), allowMissingColumns=True
    )
    out = catalog.expand(templates.withColumn("era", F.lit(None).cast("string")), ["1996", "1997", "1998"])
    return out.select("name", "era", F.array_join("db", ",").alias("db"), F.get("syst", F.lit(1)).alias("replaces"))


@query(
    "scan_union",
    """
SELECT 'main' AS sample, '2022' AS era, 'mc' AS type, o_orderkey, NULL AS c_custkey FROM orders
UNION ALL SELECT 'main', '2022', 'mc', o_orderkey, NULL FROM orders
UNION ALL SELECT 'other', '2022EE', 'data', NULL, c_custkey FROM customer
""",
)
def scan_union(spark, d):
    """A sample of two files (main and extension) and one with other columns."""
    main, other = f"{d}/orders.parquet", f"{d}/customer.parquet"
    samples = {
        "main": {"paths": [main, main], "era": "2022", "type": "mc"},
        "other": {"paths": [other], "era": "2022EE", "type": "data"},
    }
    return events_io.read_events(spark, samples).select("sample", "era", "type", "o_orderkey", "c_custkey")


@query(
    "lumi_certified",
    """
WITH ranges AS (
  SELECT r AS run, 0 AS lo, 600 AS hi FROM range(150) t(r) WHERE r % 7 <> 0
  UNION ALL SELECT r, 550, 700 + r FROM range(150) t(r) WHERE r % 7 <> 0)
SELECT event_id, user_id AS run, hour(ts) * 60 + minute(ts) AS "luminosityBlock" FROM events e
WHERE user_id BETWEEN 10 AND 140
  AND EXISTS (SELECT 1 FROM ranges g WHERE g.run = e.user_id AND hour(e.ts) * 60 + minute(e.ts) BETWEEN g.lo AND g.hi)
""",
)
def lumi_certified(spark, d):
    rows = fx.table(spark, d, "events").select(
        "event_id",
        F.col("user_id").alias("run"),
        (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("luminosityBlock"),
    )
    certified = {str(r): [[0, 600], [550, 700 + r]] for r in range(150) if r % 7}
    return events.certified(rows, events.lumi_ranges(spark, certified), run_range=(10, 140))


@query(
    "run_era",
    with_ctes(
        """SELECT sample, CASE WHEN regexp_matches(sample, 'Run20..([A-Z]?)') THEN regexp_extract(sample, 'Run20..([A-Z]?)', 1)
           ELSE 'MC' END AS run_era, count(*) AS n FROM hdr GROUP BY sample""",
        "hdr",
    ),
)
def run_era(spark, d):
    counts = fx.headers(spark, d).groupBy("sample").agg(F.count("*").alias("n"))
    return counts.select("sample", catalog.run_era(F.col("sample")).alias("run_era"), "n")


@query(
    "class_tag",
    with_ctes("SELECT process, tag, count(*) AS n FROM ml GROUP BY process, tag", "ml"),
)
def class_tag(spark, d):
    return mlprep.add_tag(fx.ml_rows(spark, d)).groupBy("process", "tag").agg(F.count("*").alias("n"))


# --- item-level functions --------------------------------------------------------------------------------------


@query(
    "bit_test",
    with_ctes(
        """SELECT o_orderkey, idx, (mask >> 0) & 1 = 1 AS bit0, (mask >> 3) & 1 = 1 AS bit3,
                  (mask >> 6) & 1 = 1 AS bit6 FROM items""",
        "items",
    ),
)
def bit_test(spark, d):
    bits = lambda x: [ops.bit(x["mask"], b).alias(f"bit{b}") for b in (0, 3, 6)]
    return either(
        spark,
        d,
        fx.item_lists,
        lambda ev: coll.rows(ev, "items", *KEYS).select(*KEYS, "idx", *bits({"mask": F.col("mask")})),
        lambda c: c["items"].rows.select(*KEYS, "item.idx", *bits(F.col("item"))),
    )


@query(
    "delta_r",
    with_ctes(
        f"""SELECT b.o_orderkey, b.idx, round({dr('a.', 'b.')}, 4) + 0.0 AS dr
            FROM items a JOIN items b ON a.o_orderkey = b.o_orderkey AND a.idx = 0 AND b.idx > 0""",
        "items",
    ),
)
def delta_r(spark, d):
    """Distance of every item to the first one of its event."""
    return _to_first(spark, d, lambda a, b: r4(kin.delta_r(a, b)).alias("dr"))


def _to_first(spark, d, value):
    def finish(rows):
        return rows.filter(F.col("item.idx") > 0).select(*KEYS, "item.idx", value(F.col("first"), F.col("item")))

    first = coll.at(F.col("items"), 0)
    return either(
        spark,
        d,
        fx.item_lists,
        lambda ev: finish(ev.select(*KEYS, first.alias("first"), F.explode("items").alias("item"))),
        lambda c: finish(c["items"].with_event(c["items"].first("first")).rows),
    )


@query(
    "inv_mass",
    with_ctes(
        f"""SELECT b.o_orderkey, b.idx, round({invm('a.', 'b.')}, 3) + 0.0 AS m
            FROM items a JOIN items b ON a.o_orderkey = b.o_orderkey AND a.idx = 0 AND b.idx > 0""",
        "items",
    ),
)
def inv_mass(spark, d):
    return _to_first(spark, d, lambda a, b: F.round(kin.inv_mass(a, b), 3).alias("m"))


@query(
    "pair_charge",
    with_ctes(
        """SELECT o_orderkey, sum(charge)::INTEGER AS total_charge FROM items WHERE idx < 2
           GROUP BY o_orderkey HAVING count(*) = 2""",
        "items",
    ),
)
def pair_charge(spark, d):
    def finish(rows, items):
        total = kin.total_charge(coll.at(F.col(items), 0), coll.at(F.col(items), 1))
        return rows.select(*KEYS, total.alias("total_charge")).filter(F.col("total_charge").isNotNull())

    return either(
        spark, d, fx.item_lists, lambda ev: finish(ev, "items"), lambda c: finish(c["items"].heads("heads"), "heads")
    )


@query(
    "lead_sublead",
    with_ctes(
        """SELECT e.o_orderkey, CASE WHEN e.pt >= m.pt THEN e.pt ELSE m.pt END AS lead_pt,
             CASE WHEN e.pt >= m.pt THEN m.pt ELSE e.pt END AS sub_pt,
             round(CASE WHEN e.pt >= m.pt THEN e.eta ELSE m.eta END, 4) + 0.0 AS lead_eta, e.pt >= m.pt AS electron_leads
           FROM (SELECT * FROM items WHERE kind = 'electron'
                 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY idx) = 1) e
           JOIN (SELECT * FROM items WHERE kind = 'muon'
                 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY idx) = 1) m
             ON e.o_orderkey = m.o_orderkey""",
        "items",
    ),
)
def lead_sublead(spark, d):
    def finish(rows):
        lead, sub = ops.lead_sub(F.col("e"), F.col("m"))
        out = rows.select(*KEYS, "e", "m", lead.alias("lead"), sub.alias("sub"))
        return out.filter(F.col("e").isNotNull() & F.col("m").isNotNull()).select(
            *KEYS,
            F.col("lead.pt").alias("lead_pt"),
            F.col("sub.pt").alias("sub_pt"),
            r4(F.col("lead.eta")).alias("lead_eta"),
            (F.col("e.pt") >= F.col("m.pt")).alias("electron_leads"),
        )

    return either(
        spark,
        d,
        fx.item_lists,
        lambda ev: finish(
            ev.select(*KEYS, coll.at(fx.of_kind("electron"), 0).alias("e"), coll.at(fx.of_kind("muon"), 0).alias("m"))
        ),
        lambda c: finish(c.joined(_kind(c, "electron").first("e"), _kind(c, "muon").first("m"))),
    )


def _kind(crowd, kind):
    return crowd["items"].select(lambda x: x["kind"] == kind)


# --- collections -----------------------------------------------------------------------------------------------


@query(
    "coll_select",
    with_ctes("SELECT o_orderkey, idx, pt FROM items WHERE pt >= 25 AND abs(eta) <= 2.4", "items"),
)
def coll_select(spark, d):
    cut = lambda x: (x["pt"] >= 25) & (F.abs(x["eta"]) <= 2.4)
    return either(
        spark,
        d,
        fx.item_lists,
        lambda ev: ev.select(*KEYS, F.inline(coll.select(F.col("items"), cut))).select(*KEYS, "idx", "pt"),
        lambda c: c["items"].select(cut).rows.select(*KEYS, "item.idx", "item.pt"),
    )


@query(
    "coll_map",
    with_ctes(
        """SELECT o_orderkey, idx, CASE WHEN kind = 'muon' AND btag < 0.5 THEN pt
             WHEN kind = 'jet' THEN pt * 2 ELSE 0.9 * pt * (1 + btag) END AS conept FROM items""",
        "items",
    ),
)
def coll_map(spark, d):
    value = lambda x: ops.multi_switch(
        ((x["kind"] == "muon") & (x["btag"] < 0.5), x["pt"]),
        (x["kind"] == "jet", x["pt"] * 2),
        default=0.9 * x["pt"] * (1 + x["btag"]),
    )
    mapped = coll.with_field(F.col("items"), "conept", value)
    return either(
        spark,
        d,
        fx.item_lists,
        lambda ev: ev.select(*KEYS, F.inline(mapped)).select(*KEYS, "idx", "conept"),
        lambda c: c["items"].mapped(lambda x: x.withField("conept", value(x))).rows.select(*KEYS, "item.idx", "item.conept"),
    )


@query(
    "coll_sort",
    with_ctes(
        """SELECT o_orderkey, idx, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY pt DESC, idx) - 1
             AS INTEGER) AS pos FROM items""",
        "items",
    ),
)
def coll_sort(spark, d):
    by_pt = lambda x: x["pt"]
    ordered = F.posexplode(coll.sort(F.col("items"), by_pt, desc=True)).alias("pos", "item")
    finish = lambda rows: rows.select(*KEYS, "item.idx", "pos")
    return either(
        spark,
        d,
        fx.item_lists,
        lambda ev: finish(ev.select(*KEYS, ordered)),
        lambda c: finish(c["items"].sort(by_pt, desc=True).positions()),
    )


@query(
    "coll_any",
    with_ctes(
        """SELECT e.o_orderkey, EXISTS (SELECT 1 FROM items i WHERE i.o_orderkey = e.o_orderkey AND i.pt > 45) AS has_hard FROM ev e""",
        "ev",
        "items",
    ),
)
def coll_any(spark, d):
    hard = lambda x: x["pt"] > 45
    n = F.coalesce("n", F.lit(0))
    return either(
        spark,
        d,
        fx.items,
        lambda ev: ev.select(*KEYS, coll.any_(F.col("items"), hard).alias("has_hard")),
        lambda c: c.joined(c["items"].counts(n=hard(F.col("item")))).select(*KEYS, (n > 0).alias("has_hard")),
    )


@query(
    "coll_size",
    with_ctes(
        """SELECT e.o_orderkey, (count(*) FILTER (kind = 'electron'))::INTEGER AS n_el, (count(*) FILTER (kind = 'muon'))::INTEGER AS n_mu,
             (count(*) FILTER (kind = 'jet'))::INTEGER AS n_jet
           FROM ev e LEFT JOIN items USING (o_orderkey) GROUP BY e.o_orderkey""",
        "ev",
        "items",
    ),
)
def coll_size(spark, d):
    kinds = {"n_el": "electron", "n_mu": "muon", "n_jet": "jet"}
    counted = lambda c: c["items"].counts(**{n: F.col("item.kind") == k for n, k in kinds.items()})
    return either(
        spark,
        d,
        fx.items,
        lambda ev: ev.select(*KEYS, *[coll.n(fx.of_kind(k)).alias(a) for a, k in kinds.items()]),
        lambda c: c.joined(counted(c)).select(*KEYS, *[F.coalesce(n, F.lit(0)).cast("int").alias(n) for n in kinds]),
    )


@query(
    "coll_at",
    with_ctes(
        """SELECT e.o_orderkey, i.pt AS third_pt FROM ev e LEFT JOIN (SELECT * FROM items WHERE idx = 2) i
           USING (o_orderkey)""",
        "ev",
        "items",
    ),
)
def coll_at(spark, d):
    def third(c):
        found = c["items"].positions().filter("pos = 2").select(*KEYS, F.col("item.pt").alias("third_pt"))
        return c.joined(found).select(*KEYS, "third_pt")

    return either(
        spark, d, fx.items, lambda ev: ev.select(*KEYS, coll.at(F.col("items"), 2)["pt"].alias("third_pt")), third
    )


def _pair_rows(pairs):
    return pairs.select(
        *KEYS,
        F.col("l1.idx").alias("i"),
        F.col("l2.idx").alias("j"),
        F.round(kin.inv_mass(F.col("l1"), F.col("l2")), 3).alias("m"),
    )


def _opposite(a, b):
    return a["charge"] != b["charge"]


@query(
    "os_pairs_same",
    with_ctes(
        f"""SELECT a.o_orderkey, a.idx AS i, b.idx AS j, round({invm('a.', 'b.')}, 3) + 0.0 AS m
            FROM items a JOIN items b ON a.o_orderkey = b.o_orderkey AND a.idx < b.idx
            WHERE a.kind = 'electron' AND b.kind = 'electron' AND a.charge <> b.charge""",
        "items",
    ),
)
def os_pairs_same(spark, d):
    def nested(ev):
        lists = ev.withColumn("electrons", fx.of_kind("electron"))
        return _pair_rows(lists.select(*KEYS, F.inline(coll.pairs(F.col("electrons"), _opposite))))

    return either(spark, d, fx.item_lists, nested, lambda c: _pair_rows(_kind(c, "electron").pairs(None, _opposite)))


@query(
    "os_pairs_cross",
    with_ctes(
        f"""SELECT a.o_orderkey, a.idx AS i, b.idx AS j, round({invm('a.', 'b.')}, 3) + 0.0 AS m
            FROM items a JOIN items b ON a.o_orderkey = b.o_orderkey
            WHERE a.kind = 'electron' AND b.kind = 'muon' AND a.charge <> b.charge""",
        "items",
    ),
)
def os_pairs_cross(spark, d):
    def nested(ev):
        lists = ev.withColumns({"e": fx.of_kind("electron"), "m": fx.of_kind("muon")})
        return _pair_rows(lists.select(*KEYS, F.inline(coll.cross(F.col("e"), F.col("m"), _opposite))))

    return either(
        spark, d, fx.item_lists, nested, lambda c: _pair_rows(_kind(c, "electron").pairs(_kind(c, "muon"), _opposite))
    )


@query(
    "coll_follow",
    with_ctes(
        """SELECT a.o_orderkey, a.idx, b.idx AS ref_idx, b.pt AS ref_pt
           FROM items a LEFT JOIN items b ON a.o_orderkey = b.o_orderkey AND a.ref = b.idx""",
        "items",
    ),
)
def coll_follow(spark, d):
    followed = F.transform(
        "items",
        lambda x: F.struct(
            x["idx"].alias("idx"),
            coll.follow(F.col("items"), x["ref"])["idx"].alias("ref_idx"),
            coll.follow(F.col("items"), x["ref"])["pt"].alias("ref_pt"),
        ),
    )
    there = lambda c: c["items"].follow(c["items"], "ref", "there").rows
    return either(
        spark,
        d,
        fx.item_lists,
        lambda ev: ev.select(*KEYS, F.inline(followed)),
        lambda c: there(c).select(
            *KEYS, "item.idx", F.col("there.idx").alias("ref_idx"), F.col("there.pt").alias("ref_pt")
        ),
    )


@query(
    "overlap_removal",
    with_ctes(
        f"""SELECT o_orderkey, idx, pt FROM items j WHERE kind = 'jet' AND NOT EXISTS (
              SELECT 1 FROM items l WHERE l.o_orderkey = j.o_orderkey AND l.kind <> 'jet'
              AND {dr('j.', 'l.')} <= 1.5)""",
        "items",
    ),
)
def overlap_removal(spark, d):
    def nested(ev):
        lists = ev.withColumns(
            {"jets": fx.of_kind("jet"), "leptons": coll.select(F.col("items"), lambda x: x["kind"] != "jet")}
        )
        kept = coll.clean(F.col("jets"), F.col("leptons"), 1.5)
        return lists.select(*KEYS, F.inline(kept)).select(*KEYS, "idx", "pt")

    def crowd(c):
        kept = _kind(c, "jet").clean(c["items"].select(lambda x: x["kind"] != "jet"), 1.5)
        return kept.rows.select(*KEYS, "item.idx", "item.pt")

    return either(spark, d, fx.item_lists, nested, crowd)


_RANKED = """SELECT o_orderkey, eta, phi, pt, CASE kind WHEN 'electron' THEN 'e' ELSE 'm' END AS f,
  row_number() OVER (PARTITION BY o_orderkey, kind ORDER BY pt DESC, idx) - 1 AS p
FROM items WHERE kind <> 'jet'"""
_WIDE = (
    "SELECT o_orderkey, count_if(f = 'e') AS ne, count_if(f = 'm') AS nm, "
    + ", ".join(
        f"max(CASE WHEN f = '{f}' AND p = {p} THEN {c} END) AS {f}{p}{c}"
        for f in "em"
        for p in (0, 1)
        for c in ("pt", "eta", "phi")
    )
    + " FROM ranked GROUP BY o_orderkey"
)


def _far(*names: str) -> str:
    return " AND ".join(f"{dr('j.', 'w.' + n)} >= 1.0" for n in names)


_CLEAN = """SELECT j.o_orderkey, j.idx FROM items j LEFT JOIN wide w USING (o_orderkey)
WHERE j.kind = 'jet' AND CASE {cases} ELSE true END"""


def _clean_rows(spark, d, leading):
    def nested(ev):
        lepton = lambda kind: coll.sort(
            coll.with_field(fx.of_kind(kind), "conept", lambda x: x["pt"]), lambda x: x["conept"], desc=True
        )
        lists = ev.withColumns({"e": lepton("electron"), "m": lepton("muon"), "jets": fx.of_kind("jet")})
        lists = lists.withColumn("leads", leading(F.col("e"), F.col("m")))
        kept = coll.keep_apart(F.col("jets"), F.col("leads"), 1.0)
        return lists.select(*KEYS, F.inline(kept)).select(*KEYS, "idx")

    def crowd(c):
        lepton = lambda kind: (
            _kind(c, kind).mapped(lambda x: x.withField("conept", x["pt"])).sort(lambda x: x["conept"], desc=True)
        )
        heads = c.joined(lepton("electron").heads("e"), lepton("muon").heads("m"))
        leads = heads.select(*KEYS, leading(F.col("e"), F.col("m")).alias("leads"))
        return _kind(c, "jet").keep_apart(leads, "leads", 1.0).rows.select(*KEYS, "item.idx")

    return either(spark, d, fx.item_lists, nested, crowd)


@query(
    "clean_lead1",
    with_ctes(
        _CLEAN.format(
            cases=f"WHEN ne >= 1 AND nm = 0 THEN {_far('e0')} WHEN ne = 0 AND nm >= 1 THEN {_far('m0')} "
            f"WHEN ne >= 1 AND nm >= 1 AND e0pt >= m0pt THEN {_far('e0')} WHEN ne >= 1 AND nm >= 1 THEN {_far('m0')}"
        ),
        "items",
        ranked=_RANKED,
        wide=_WIDE,
    ),
)
def clean_lead1(spark, d):
    return _clean_rows(spark, d, coll.leading_one)


@query(
    "clean_lead2",
    with_ctes(
        _CLEAN.format(
            cases=f"""WHEN ne >= 2 AND nm = 0 THEN {_far('e0', 'e1')} WHEN ne = 0 AND nm >= 2 THEN {_far('m0', 'm1')}
            WHEN ne = 1 AND nm = 1 THEN {_far('e0', 'm0')}
            WHEN ne >= 1 AND nm >= 1 AND e0pt > m0pt THEN
              CASE WHEN ne >= 2 AND e1pt > m0pt THEN {_far('e0', 'e1')} ELSE {_far('e0', 'm0')} END
            WHEN ne >= 1 AND nm >= 1 THEN
              CASE WHEN nm >= 2 AND m1pt > e0pt THEN {_far('m0', 'm1')} ELSE {_far('m0', 'e0')} END"""
        ),
        "items",
        ranked=_RANKED,
        wide=_WIDE,
    ),
)
def clean_lead2(spark, d):
    return _clean_rows(spark, d, coll.leading_two)


# --- event-level cuts ------------------------------------------------------------------------------------------


@query(
    "trigger_mc",
    with_ctes("SELECT o_orderkey, sample FROM hdr WHERE type <> 'data' AND (trig_a OR trig_b OR trig_c)", "hdr"),
)
def trigger_mc(spark, d):
    mc = fx.headers(spark, d).filter(F.col("type") != "data")
    return mc.filter(events.trigger_any(_bits())).select("o_orderkey", "sample")


def _bits():
    return {"Muon": [F.col("trig_a")], "EGamma": [F.col("trig_b")], "MuonEG": [F.col("trig_c")]}


@query(
    "trigger_pd",
    with_ctes(
        """SELECT o_orderkey, sample FROM hdr WHERE type = 'data' AND CASE split_part(sample, '_Run', 1)
             WHEN 'Muon' THEN trig_a WHEN 'EGamma' THEN trig_b AND NOT trig_a
             WHEN 'MuonEG' THEN trig_c AND NOT trig_a AND NOT trig_b END""",
        "hdr",
    ),
)
def trigger_pd(spark, d):
    data = fx.headers(spark, d).filter(F.col("type") == "data")
    own = events.primary_dataset(F.col("sample"))
    return data.filter(events.trigger_primary(own, _bits())).select("o_orderkey", "sample")


@query(
    "refine_chain",
    with_ctes(
        """SELECT o_orderkey, trig AS sel_trigger, trig AND heavy AS sel_heavy, trig AND heavy AND early AS sel_early,
             round(weight * 0.5 * CASE WHEN early THEN 1.25 ELSE 1.0 END, 4) + 0.0 AS weight
           FROM (SELECT o_orderkey, weight, trig_a OR trig_b AS trig, met_pt > 20 AS heavy, era = '2022' AS early FROM hdr)""",
        "hdr",
    ),
)
def refine_chain(spark, d):
    base = Selection("noSel").refine("genWeight", weight=F.col("weight"))
    trig = base.refine("trigger", cut=F.col("trig_a") | F.col("trig_b"), weight=F.lit(0.5))
    heavy = trig.refine("heavy", cut=[F.col("met_pt") > 20])
    early = heavy.refine("early", cut=F.col("era") == "2022", weight=F.when(F.col("era") == "2022", 1.25).otherwise(1.0))
    df = with_flags(fx.headers(spark, d), [early])
    return df.select(
        "o_orderkey", "sel_trigger", "sel_heavy", "sel_early", r4(early.total_weight()).alias("weight")
    )
