"""Events too large to be nested: the plan over rows gives what the plan over arrays gives."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from eventspark.functions import coll
from eventspark.operators import crowded
from eventspark.plans import fixture as fx
from suite import load
from test_suite import DIR, TABLES, canonical  # noqa: I001

REGISTRY = load()
COLLECTIONS = (
    "bit_test delta_r inv_mass pair_charge lead_sublead coll_select coll_map coll_sort coll_any coll_size coll_at "
    "os_pairs_same os_pairs_cross coll_follow overlap_removal clean_lead1 clean_lead2"
).split()
OBJECTS = "obj_conept obj_muons obj_electrons obj_taus obj_jets obj_fatjets clean_from_fatjet".split()
SELECTIONS = "dl_pt_cut low_mll_veto z_veto pair_multiplicity sel_dl sel_sl hist_many".split()


def matches(spark, folder, names):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name in names:
        df = REGISTRY.QUERIES[name](spark, folder)
        rows, rel = [tuple(r) for r in df.collect()], con.sql(REGISTRY.ORACLES[name])
        assert canonical(rows, df.columns) == canonical(rel.fetchall(), rel.columns), name


@pytest.mark.parametrize(("name", "limit"), [*((n, 4) for n in COLLECTIONS + OBJECTS), ("os_pairs_same", 0), ("clean_lead2", 0)])
def test_queries_over_rows(spark, monkeypatch, name, limit):
    """All events by rows, or those of five and more items, in chunks of two."""
    monkeypatch.setattr(crowded, "LIMIT", limit)
    monkeypatch.setattr(crowded, "CHUNK", 2)
    matches(spark, DIR, [name])


@pytest.mark.parametrize("name", SELECTIONS)
def test_selections_over_rows(spark, monkeypatch, name):
    monkeypatch.setattr(crowded, "LIMIT", 4)
    monkeypatch.setattr(crowded, "CHUNK", 3)
    matches(spark, DIR, [name])


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """Orders of 10,000, 300 and 3 items made from given lines; two items are alike in every field."""
    folder = tmp_path_factory.mktemp("large")
    r = random.Random(8)
    lines = pq.read_table(f"{DIR}/lineitem.parquet").to_pylist()
    orders = pq.read_table(f"{DIR}/orders.parquet")
    heads = orders.slice(0, 4)
    keys = heads.column("o_orderkey").to_pylist()
    made = []
    for key, n in zip(keys, (10_000, 300, 3), strict=False):
        own = [{**r.choice(lines), "l_orderkey": key, "l_linenumber": r.randint(1, 7)} for _ in range(n)]
        own[1] = own[0]
        made += own
    schema = pq.read_schema(f"{DIR}/lineitem.parquet")
    pq.write_table(pa.Table.from_pylist(made, schema), f"{folder}/lineitem.parquet")
    pq.write_table(heads, f"{folder}/orders.parquet")
    return str(folder), keys


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("name", ["coll_sort", "coll_size", "coll_at", "coll_follow", "os_pairs_same", "overlap_removal",
                                  "obj_electrons", "obj_jets", "pair_multiplicity", "sel_sl"])
def test_large_events_give_the_same_on_both_plans(spark, monkeypatch, large, name):
    folder, keys = large
    results = []
    for limit in (100_000, 4096, 100):
        monkeypatch.setattr(crowded, "LIMIT", limit)
        df = REGISTRY.QUERIES[name](spark, folder)
        if name == "os_pairs_same":
            # 10,000 items have millions of pairs: their number and a sum stand for them
            df = df.groupBy("o_orderkey").agg(F.count("*"), F.sum("i"), F.sum("j"), F.sum(F.hash("i", "j", "m").cast("long")))
        results.append(plain(df.collect()))
    assert results[0] == results[1] == results[2] and (results[0] or name.startswith("sel"))


def test_no_task_holds_a_large_event(spark, monkeypatch, large):
    folder, keys = large
    monkeypatch.setattr(crowded, "LIMIT", 4096)
    monkeypatch.setattr(crowded, "CHUNK", 512)
    found = fx.crowded_orders(spark, folder)
    assert [tuple(r) for r in found.collect()] == [(keys[0], 10_000)]
    crowd = fx.crowd_of_lists(spark, folder, found)
    items = crowd["items"]
    assert items.rows.count() == 10_000 and items.rows.select("item.idx").distinct().count() == 10_000
    # rows of one chunk, or of a pair of chunks, meet; never those of the event
    pairs = items._deal("l1", "_a", "_b").groupBy("_a", "_b").count()
    assert pairs.agg(F.max("count")).first()[0] <= 512
    assert fx.item_lists(spark, folder, without=found).count() == 2


def test_positions_cross_partitions(spark):
    rows = [(k, i % 13, i) for k, n in ((1, 500), (2, 3), (3, 200)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k long, v int, i int").repartition(7).withColumn("at", F.struct("v", "i"))
    got = {(r.k, r.i): r.pos for r in crowded.numbered(frame, "k", "at", "pos").collect()}
    for k in (1, 2, 3):
        order = sorted((v, i) for kk, v, i in rows if kk == k)
        assert [got[k, i] for _, i in order] == list(range(len(order)))


def test_heads_have_the_length_and_first_items_of_the_collection(spark):
    rows = [(1, i, (i * 7) % 10) for i in range(10)] + [(2, 0, 5)]
    frame = spark.createDataFrame(rows, "k long, idx int, v int")
    frame = frame.select("k", F.lit(10).alias("size"), F.struct("v").alias("at"), F.struct("idx", "v").alias("item"))
    got = {r.k: r for r in crowded.Items(frame, "k").heads("h").select("k", F.size("h").alias("n"), coll.at(F.col("h"), 0)["v"].alias("a"),
           coll.at(F.col("h"), 1)["v"].alias("b"), coll.at(F.col("h"), 2).isNull().alias("c")).collect()}
    assert tuple(got[1]) == (1, 10, 0, 1, True) and tuple(got[2]) == (2, 1, 5, None, True)
