"""Training loop, network and scores as columns against NumPy and Spark ML."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspark.operators import model, network, scoring


def rows(spark, n=400, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 2, 9]
    y = (x[:, 0] + 0.3 * (x[:, 1] - 2) + r.normal(size=n) * 0.5 > 0).astype(float)
    w = r.uniform(0.2, 2, n)
    data = [(*map(float, a), float(b), float(c), i % 4 == 0) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(data, "a double, b double, c double, y double, w double, held boolean"), data


def plain_schedule(losses, rate, plateau, patience, factor=0.1, delta=1e-3, least=1e-8):
    """Rates used in each epoch, epochs that were the best, and the number of epochs run."""
    best, wait, waited, rates, bests = np.inf, 0, 0, [], []
    for epoch, loss in enumerate(losses):
        rates.append(rate)
        if loss < best - delta:
            best, wait, waited = loss, 0, 0
            bests.append(epoch)
        else:
            wait += 1
            waited += 1
            if wait == plateau:
                rate, wait = max(rate * factor, least), 0
            if waited == patience:
                return rates, bests
    return rates, bests


@pytest.mark.parametrize("seed", range(6))
def test_schedule_equals_a_plain_loop(seed):
    r = np.random.default_rng(seed)
    losses = np.maximum(1 / (1 + np.arange(80)), 0.05) + r.normal(0, 0.01, 80)
    plan = network.Schedule(rate=0.1, plateau=3, patience=9)
    rates, bests = [], []
    for epoch, loss in enumerate(losses):
        rates.append(plan.rate)
        better, ends = plan.after(loss)
        if better:
            bests.append(epoch)
        if ends:
            break
    assert (rates, bests) == plain_schedule(losses, 0.1, 3, 9)
    assert len(rates) < 80 and rates[-1] < 0.1


def test_gradient_is_the_slope_of_the_loss():
    r = np.random.default_rng(0)
    layers = network.started([3, 5, 4, 1], 2)
    x, y, w = r.normal(size=(20, 3)), r.integers(0, 2, 20).astype(float), r.uniform(0, 2, 20)
    loss, slope = network.gradient(x, y, w, layers)
    at = network.flat(layers)
    for i in range(0, len(at), 5):
        up, down = at.copy(), at.copy()
        up[i], down[i] = up[i] + 1e-6, down[i] - 1e-6
        change = network.gradient(x, y, w, network.shaped(up, layers))[0] - network.gradient(x, y, w, network.shaped(down, layers))[0]
        assert change / 2e-6 == pytest.approx(slope[i], rel=1e-4, abs=1e-5)
    z = network.margins(x, layers)[-1][:, 0]
    p = 1 / (1 + np.exp(-z))
    assert loss == pytest.approx(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


@pytest.fixture(scope="module")
def fitted(spark):
    df, data = rows(spark)
    net = network.fit(df, ["a", "b", "c"], "y", "w", F.col("held"), hidden=(6, 4), epochs=6, steps=1, l2=0.01, seed=5,
                      schedule=network.Schedule(rate=0.02, plateau=2, patience=5), balance=False)
    return df, data, net


def test_training_equals_numpy(spark, fitted):
    """One batch an epoch: the same steps as full-batch Adam on one machine."""
    _, data, net = fitted
    a = np.array([d[:5] for d in data])
    held = np.array([d[5] for d in data])
    train, val = a[~held], a[held]
    mean, dev = train[:, :3].mean(axis=0), train[:, :3].std(axis=0)
    norm = lambda m: (m[:, :3] - mean) / dev
    layers = network.started([3, 6, 4, 1], 5)
    values, first, second, rate = network.flat(layers), 0, 0, 0.02
    is_weight = np.concatenate([np.full(p.size, i == 0) for pair in layers for i, p in enumerate(pair)])
    losses, val_losses = [], []
    for t in range(1, 7):
        loss, slope = network.gradient(norm(train), train[:, 3], train[:, 4], network.shaped(values, layers))
        losses.append(loss / len(train))
        g = slope / len(train) + 0.02 * values * is_weight
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        values = values - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-7)
        val_losses.append(network.gradient(norm(val), val[:, 3], val[:, 4], network.shaped(values, layers))[0] / len(val))
    table = net.history(spark).orderBy("epoch").collect()
    assert [r.loss for r in table] == pytest.approx(losses, rel=1e-9)
    assert [r.val_loss for r in table] == pytest.approx(val_losses, rel=1e-9)
    assert [r.rate for r in table] == plain_schedule(val_losses, 0.02, 2, 5)[0] and [r.steps for r in table] == [1, 2, 3, 4, 5, 6]
    assert network.flat(net.layers) == pytest.approx(values, rel=1e-8) and table[-1].best


def test_network_scores_as_a_column(spark, fitted, capsys):
    df, data, net = fitted
    scored = df.select("a", net.score().alias("p"))
    x = (np.array([d[:3] for d in data]) - net.mean) / net.deviation
    want = dict(zip([d[0] for d in data], 1 / (1 + np.exp(-network.margins(x, net.layers)[-1][:, 0])), strict=True))
    assert all(r.p == pytest.approx(want[r.a], abs=1e-12) for r in scored.collect())
    scored.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_balanced_network_gives_its_rows_their_weight(spark):
    df, _ = rows(spark, 200)
    net = network.fit(df, ["a", "b", "c"], "y", "w", F.col("held"), hidden=(4,), epochs=2, steps=2)
    true, scored = df.filter("not held").agg(F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * net.score())).first()
    assert scored == pytest.approx(true, rel=1e-8)


def test_constant_inputs_nulls_and_no_rows(spark):
    df, _ = rows(spark, 60)
    odd = df.withColumns({"c": F.lit(2.0), "a": F.when(F.col("w") > 0.3, F.col("a"))})
    net = network.fit(odd, ["a", "c"], "y", "w", F.lit(False), hidden=(), epochs=1, steps=3)
    assert net.deviation[1] == 1 and len(net.epochs) == 1
    with pytest.raises(ValueError, match="no rows"):
        network.fit(df.limit(0), ["a"], "y", "w", F.lit(False))


@pytest.mark.parametrize("kind", ["gbt", "logistic"])
def test_spark_models_score_as_columns(spark, kind, capsys):
    df, _ = rows(spark, 300)
    made = model.train(df, ["a", "b", "c"], "y", "w", kind=kind, validation="held", iterations=8)
    both = model.score(made, df).withColumn("own", scoring.of_pipeline(made))
    assert both.filter(F.abs(F.col("own") - F.col("score")) > 1e-9).count() == 0 and both.count() == 300
    df.select(scoring.of_pipeline(made)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan


def test_size_of_a_compiled_model_is_bounded():
    with pytest.raises(ValueError, match="too many"):
        scoring.logit([F.lit(1.0)], [0.0], [1.0], [([[0.0] * 150_000], [0.0] * 150_000)])


def test_training_reads_its_rows_once(spark):
    """Normalisation and every fit work on stored rows; what made the rows runs once."""
    read = spark.sparkContext.accumulator(0)

    def counted(i):
        read.add(1)
        return (float(i % 7), float(i % 5), float(i % 3 == 0), 1.0)

    rows = spark.createDataFrame(spark.sparkContext.range(60, numSlices=2).map(counted), "a double, b double, y double, w double")
    model.train(rows, ["a", "b"], "y", "w", kind="logistic", iterations=5)
    assert read.value == 60


def test_balanced_linear_model_gives_its_rows_their_weight(spark):
    """Also where the optimiser has stopped early."""
    df, _ = rows(spark, 200)
    made = model.train(df, ["a", "b", "c"], "y", "w", kind="logistic", iterations=1)
    shift = scoring.balancing(df, scoring.margin(made), F.col("y"), F.col("w"))
    true, left, scored = df.agg(
        F.sum(F.col("w") * F.col("y")),
        F.sum(F.col("w") * scoring.of_pipeline(made)),
        F.sum(F.col("w") * scoring.of_pipeline(made, shift=shift)),
    ).first()
    assert abs(left - true) > 1e-6 * true and scored == pytest.approx(true, rel=1e-9)
