import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventspark.operators import mlprep, model, prefix, roc


def frame(spark, **columns):
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    n = 3000
    y = (rng.random(n) < 0.3).astype(int)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 3)
    score[: n // 3] = 0.5  # one score holds a third of the rows
    pdf = pd.DataFrame({"y": y, "score": score, "w": rng.integers(1, 6, n).astype(float), "v": rng.integers(1, 4, n).astype(float)})
    return pdf, spark.createDataFrame(pa.Table.from_pandas(pdf)).repartition(6)


def brute_curve(pdf):
    g = pdf.assign(p=pdf.w * pdf.y, q=pdf.w * (1 - pdf.y)).groupby("score")[["p", "q"]].sum().sort_index(ascending=False)
    return g.index.to_numpy(), g.p.to_numpy(), g.q.to_numpy()


@pytest.mark.parametrize("slices", [2, 7, 200])
def test_curve_matches_brute_force_for_any_slicing(scored, slices):
    pdf, df = scored
    t, p, q = brute_curve(pdf)
    rows = roc.curve(df, F.col("y"), F.col("score"), F.col("w"), slices=slices).orderBy(F.desc("threshold")).collect()
    assert [r["threshold"] for r in rows] == list(t)
    assert [r["tp"] for r in rows] == list(p.cumsum()) and [r["fp"] for r in rows] == list(q.cumsum())
    assert [r["rank"] for r in rows] == list(range(1, len(t) + 1))
    assert rows[-1]["tpr"] == 1.0 and rows[-1]["fpr"] == 1.0


def test_area_is_the_rank_statistic(scored):
    pdf, df = scored
    s, w, y = pdf.score.to_numpy(), pdf.w.to_numpy(), pdf.y.to_numpy()
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    pair_w = w[y == 1][:, None] * w[y == 0][None, :]
    expected = (pair_w * ((a > b) + 0.5 * (a == b))).sum() / pair_w.sum()
    got = roc.auc(roc.curve(df, F.col("y"), F.col("score"), F.col("w"))).first()["auc"]
    assert got == pytest.approx(expected, rel=1e-12)


def kept_points(p, q):
    n = len(p)
    return [i for i in range(n) if i in (0, n - 1) or (p[i] != p[i + 1] or q[i] != q[i + 1])]


def test_corners_and_significance(scored):
    pdf, df = scored
    t, p, q = brute_curve(pdf)
    keep = kept_points(p, q)
    points = roc.curve(df, F.col("y"), F.col("score"), F.col("w"), sig_weight=F.col("v"), drop_intermediate=True)
    got = sorted((r["threshold"] for r in points.collect()), reverse=True)
    assert got == [t[i] for i in keep]
    step = max(1, (len(keep) + 1) // 100)
    wanted = [t[i] for k, i in enumerate(keep, 1) if k % step == 0]
    sig = {r["threshold"]: r for r in roc.significance(points).collect()}
    assert sorted(sig, reverse=True) == wanted
    for x in wanted:
        above = pdf[pdf.score > x]
        s, b = above.v[above.y == 1].sum(), above.v[above.y == 0].sum()
        z = math.sqrt(2 * ((s + b) * math.log(1 + s / b) - s)) if s > 0 and b > 0 else 0.0
        assert (sig[x]["s_above"], sig[x]["b_above"]) == (s, b)
        assert sig[x]["z"] == pytest.approx(z)
    best = roc.best_working_point(roc.significance(points)).first()
    top = max(r["z"] for r in sig.values())
    assert best["z"] == top and best["threshold"] == max(x for x, r in sig.items() if r["z"] == top)


def test_short_curve_keeps_every_threshold(spark):
    df = frame(spark, y=[1, 0, 1, 0], s=[0.9, 0.8, 0.7, 0.7], w=[1.0, 2.0, 1.0, 5.0])
    sig = roc.significance(roc.curve(df, F.col("y"), F.col("s"), F.col("w")))
    assert sig.count() == 3


def test_significance_per_curve(spark):
    df = frame(spark, g=["a"] * 4 + ["b"] * 3, y=[1, 0, 1, 0, 0, 1, 0], s=[0.9, 0.8, 0.7, 0.7, 0.6, 0.5, 0.4], w=[1.0] * 7)
    points = roc.curve(df, F.col("y"), F.col("s"), F.col("w"), by=["g"])
    got = {tuple(r)[:2]: r["z"] for r in roc.significance(points, by=["g"]).collect()}
    assert len(got) == 6
    for g in ("a", "b"):
        alone = roc.significance(roc.curve(df.filter(F.col("g") == g), F.col("y"), F.col("s"), F.col("w")))
        assert {r["threshold"]: r["z"] for r in alone.collect()} == {t: z for (k, t), z in got.items() if k == g}


def test_one_class_only(spark):
    df = frame(spark, y=[1, 1], s=[0.9, 0.8], w=[1.0, 2.0])
    row = roc.curve(df, F.col("y"), F.col("s"), F.col("w")).orderBy("threshold").first()
    assert row["fpr"] is None and row["tpr"] == 1.0
    assert roc.auc(roc.curve(df, F.col("y"), F.col("s"), F.col("w"))).first()["auc"] is None


def test_curves_by_class(scored):
    pdf, df = scored
    renamed = df.select(F.when(F.col("y") == 1, "a").otherwise("b").alias("tag"), F.col("score").alias("p"), "w")
    both = roc.one_vs_rest(renamed, F.col("tag"), {"a": F.col("p"), "b": -F.col("p")})
    areas = {r["class"]: r["auc"] for r in roc.auc(roc.curve(both, F.col("y"), F.col("score"), F.col("w"), by=["class"]), ["class"]).collect()}
    assert areas["a"] == pytest.approx(areas["b"], rel=1e-12)


def test_pairwise_rows(spark):
    df = frame(spark, k=["a", "b", "c", "x"], v=[1, 2, 3, 4])
    got = sorted(tuple(r) for r in roc.pairwise(df, F.col("k"), ["a", "b", "c"]).select("k", "class_a", "class_b", "y").collect())
    assert got == [("a", "a", "b", 1), ("a", "a", "c", 1), ("b", "a", "b", 0), ("b", "b", "c", 1), ("c", "a", "c", 0), ("c", "b", "c", 0)]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_exact_quantile(scored, q):
    pdf, df = scored
    assert prefix.exact_quantile(df, "score", q).first()[0] == pytest.approx(pdf.score.quantile(q), abs=1e-12)


def test_balance_gives_each_class_the_row_count(spark):
    df = frame(spark, tag=["a", "a", "b", "b", "b"], weight=[1.0, 3.0, 2.0, 2.0, 6.0])
    sums = {r["tag"]: r["s"] for r in mlprep.balance(df, ["a", "b"]).groupBy("tag").agg(F.sum("training_weight").alias("s")).collect()}
    assert sums == pytest.approx({"a": 5.0, "b": 5.0})


def test_zero_weight_is_dropped(spark):
    df = frame(spark, weight=[1.0, 0.0, -1.0])
    assert mlprep.drop_nonpositive(df).count() == 1
    assert mlprep.count_nonpositive(df).first()[:] == (3, 1)


def test_check_classes(spark):
    df = frame(spark, tag=["HH", "background"])
    mlprep.check_classes(df, ["HH", "background"])
    with pytest.raises(ValueError, match="other"):
        mlprep.check_classes(df, ["HH", "other"])


def test_parity_split_is_a_partition(spark):
    phi = list(np.random.default_rng(1).uniform(-math.pi, math.pi, 500))
    df = frame(spark, leadingLepton_phi=phi)
    x = np.abs(np.array(phi)) * 1e5
    even = (((x - np.floor(x)) * 10).astype(int) % 2 == 0).sum()
    train, test = mlprep.parity_split(df, split="even")
    assert (train.count(), test.count()) == (500 - even, even)
    train, test = mlprep.parity_split(df, split="odd")
    assert (train.count(), test.count()) == (even, 500 - even)


def test_validation_split_is_repeatable(spark):
    df = spark.range(4000)
    a, b = (mlprep.val_split(d, ["id"]).filter("is_val") for d in (df, df.repartition(7)))
    assert a.count() == b.count() and 1000 < a.count() < 1400
    assert a.join(b, "id").count() == a.count()


def test_tail_repetition_keeps_the_total(spark):
    w = [1.0] * 50 + [2.5, 4.0, 7.0]
    df = frame(spark, training_weight=w)
    out = mlprep.repeat_tail(df, 0.9)
    q = pd.Series(w).quantile(0.9)
    assert out.agg(F.sum("training_weight")).first()[0] == pytest.approx(sum(w))
    assert out.count() == sum(max(1, int(x / q)) if x >= q else 1 for x in w)


def test_batch_check_draws_full_batches(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("tag"), F.lit(2.0).alias("weight"))
    rows = {r["tag"]: r for r in mlprep.batch_check(df, 100, ["id"], batches=10).collect()}
    assert rows["a"]["mean_rows"] + rows["b"]["mean_rows"] == 100
    assert rows["a"]["mean_weight"] + rows["b"]["mean_weight"] == pytest.approx(200.0)


def test_normalised_features_have_mean_zero_and_unit_variance(spark):
    df = frame(spark, a=list(np.random.default_rng(2).normal(5, 3, 400)), b=list(range(400)))
    stats = {r["feature"]: r for r in mlprep.feature_stats(mlprep.normalise(df, df, ["a", "b"]), ["a", "b"]).collect()}
    for r in stats.values():
        assert r["mean"] == pytest.approx(0.0, abs=1e-9) and r["variance"] == pytest.approx(1.0)


def test_discriminant_is_null_without_background(spark):
    d = mlprep.discriminant([F.col("p")], [F.col("q")])
    got = [r[0] for r in frame(spark, p=[0.5, 1.0, 0.0], q=[0.5, 0.0, 1.0]).select(d).collect()]
    assert got == [0.0, None, None]


def test_weight_hist_counts_every_row(spark):
    df = frame(spark, tag=["a"] * 4 + ["b"] * 3, weight=[1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 5.0])
    got = {}
    for r in mlprep.weight_hist(df, ["a", "b"], 10).collect():
        got[r["tag"]] = got.get(r["tag"], 0) + r["n"]
    assert got == {"a": 4, "b": 3}


def test_models(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(0, 1, (n, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    df = frame(spark, a=list(x[:, 0]), b=list(x[:, 1]), y=list(y), w=list(rng.uniform(0.5, 2, n)), i=list(range(n)))
    df = mlprep.val_split(df, ["i"])
    fitted = model.train(df, ["a", "b"], "y", "w", kind="gbt", validation="is_val", iterations=8)
    scored = model.score(fitted, df)
    area = roc.auc(roc.curve(scored, F.col("y"), F.col("score"), F.col("w"))).first()["auc"]
    assert area > 0.9 and scored.columns == [*df.columns, "score"]
    model.save(fitted, str(tmp_path / "m"))
    again = model.score(model.load(str(tmp_path / "m")), df)
    assert again.join(scored.withColumnRenamed("score", "s"), "i").filter("abs(score - s) > 1e-9").count() == 0
    losses = [r["loss"] for r in model.history(spark, fitted, df.filter("is_val")).orderBy("iteration").collect()]
    assert len(losses) > 1 and losses[-1] < losses[0]
    linear = model.train(df, ["a", "b"], "y", "w", kind="logistic", iterations=10)
    assert model.history(spark, linear).count() > 1
    picked = model.score_by_parity(fitted, linear, df, F.col("i") % 2 == 0)
    even, odd = model.score(fitted, df).filter("i = 10").first(), model.score(linear, df).filter("i = 11").first()
    got = {r["i"]: r["score"] for r in picked.filter("i in (10, 11)").collect()}
    assert got == pytest.approx({10: even["score"], 11: odd["score"]})
    with pytest.raises(ValueError):
        model.train(df, ["a"], "y", "w", kind="other")
