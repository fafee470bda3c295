"""A weighted two-class neural network trained data-parallel.

Rows are stored once with the number of their mini-batch. A step sends the weights out, every task computes the gradient of
its rows of one batch over Arrow batches, and the sums come back as one row per parameter, whatever the number of rows or
tasks. The driver holds the parameters, Adam's two moments and the best parameters so far. After each epoch the validation
loss drives the schedule: the rate falls on a plateau, training stops when patience ends, the best parameters win.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.operators import scoring
from eventspark.operators.checkpoints import pinned
from eventspark.operators.workers import importable

Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Schedule:
    """Learning rate and stop, decided by a series of validation losses.

    A loss counts as better if it is lower than the best by more than ``min_delta``. After ``plateau`` epochs without a
    better one the rate is multiplied by ``factor`` (not below ``least``), and the wait begins anew; after ``patience``
    epochs without a better one training ends.
    """

    rate: float = 1e-3
    min_delta: float = 1e-3
    plateau: int = 8
    factor: float = 0.1
    least: float = 1e-8
    patience: int = 20
    best: float = float("inf")
    _wait: int = 0
    _waited: int = 0

    def after(self, loss: float) -> tuple[bool, bool]:
        """Take the loss of an epoch: whether it is the best so far, and whether training ends."""
        better = loss < self.best - self.min_delta
        if better:
            self.best, self._wait, self._waited = loss, 0, 0
            return True, False
        self._wait, self._waited = self._wait + 1, self._waited + 1
        if self._wait >= self.plateau:
            self.rate, self._wait = max(self.rate * self.factor, self.least), 0
        return False, self._waited >= self.patience


def started(sizes: Sequence[int], seed: int) -> Layers:
    """Weights drawn for rectified layers, and zero offsets."""
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def margins(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    """Inputs and outputs of every layer; the last is the logit."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if i == len(layers) - 1 else np.maximum(z, 0))
    return out


def gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, layers: Layers) -> tuple[float, np.ndarray]:
    """Summed weighted cross-entropy of some rows and its gradient as one vector."""
    out = margins(x, layers)
    z = out[-1][:, 0]
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    back = (weight * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y))[:, None]
    parts: list[np.ndarray] = []
    for i in reversed(range(len(layers))):
        parts[:0] = [(out[i].T @ back).ravel(), back.sum(axis=0)]
        back = (back @ layers[i][0].T) * (out[i] > 0) if i else back
    return loss, np.concatenate(parts)


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([x.ravel() for pair in layers for x in pair])


def shaped(values: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


@dataclass
class Adam:
    """Moments of bounded size: two numbers per parameter."""

    size: int
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-7
    step: int = 0
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.first, self.second = np.zeros(self.size), np.zeros(self.size)

    def move(self, values: np.ndarray, slope: np.ndarray, rate: float) -> np.ndarray:
        self.step += 1
        self.first = self.beta1 * self.first + (1 - self.beta1) * slope
        self.second = self.beta2 * self.second + (1 - self.beta2) * slope**2
        one, two = self.first / (1 - self.beta1**self.step), self.second / (1 - self.beta2**self.step)
        return values - rate * one / (np.sqrt(two) + self.eps)


@dataclass(frozen=True)
class Network:
    """Fitted parameters with the normalisation of their inputs, and what happened in every epoch."""

    features: tuple[str, ...]
    mean: np.ndarray
    deviation: np.ndarray
    layers: Layers
    epochs: tuple[dict, ...] = ()

    def score(self, columns: Mapping[str, Column] | None = None) -> Column:
        """Probability of class 1 as a column over the features (or over ``columns`` by feature name): no Python worker."""
        x = [columns[f] if columns else F.col(f) for f in self.features]
        return scoring.dense(x, self.mean.tolist(), self.deviation.tolist(), [(w.tolist(), b.tolist()) for w, b in self.layers])

    def history(self, spark: SparkSession) -> DataFrame:
        """One row per epoch: ``epoch, steps, rate, loss, val_loss, best``; losses are weighted means over the rows."""
        kind = "epoch int, steps int, rate double, loss double, val_loss double, best boolean"
        return spark.createDataFrame([tuple(e.values()) for e in self.epochs], kind)


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x, batch.column("y").to_numpy(), batch.column("w").to_numpy()


def _sums(rows: DataFrame, network: Network, with_slope: bool) -> np.ndarray:
    """``[rows, loss, gradient ..]`` summed over ``rows (x, y, w)``: one row per parameter reaches the driver."""
    layers, width = network.layers, len(network.features)
    mean, deviation = network.mean, network.deviation
    size = 2 + (sum(w.size + b.size for w, b in layers) if with_slope else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                x, y, w = _matrix(batch, width)
                loss, slope = gradient((x - mean) / deviation, y, w, layers)
                total += np.concatenate([[len(y), loss], slope[: size - 2]])
                some = True
        if some:
            yield pa.RecordBatch.from_pydict({"at": np.arange(size, dtype=np.int32), "value": total})

    found = rows.select("x", "y", "w").mapInArrow(run, "at int, value double")
    out = np.zeros(size)
    for r in found.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def _balanced(rows: DataFrame, network: Network, rounds: int = 12) -> Network:
    """The network with the last offset at which the scored weight of ``rows`` is the weight of their class 1 (Newton)."""
    z = scoring.logit([F.get("x", F.lit(i)) for i in range(len(network.features))], network.mean.tolist(),
                      network.deviation.tolist(), [(w.tolist(), b.tolist()) for w, b in network.layers])
    shift = scoring.balancing(rows, z, F.col("y"), F.col("w"), rounds)
    layers = [*network.layers[:-1], (network.layers[-1][0], network.layers[-1][1] + shift)]
    return replace(network, layers=layers)


def fit(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    weight: str,
    validation: Column,
    hidden: Sequence[int] = (64, 64, 64),
    epochs: int = 200,
    steps: int = 8,
    l2: float = 1e-6,
    schedule: Schedule | None = None,
    seed: int = 1,
    balance: bool = True,
) -> Network:
    """Train on the rows that are not ``validation``, watched on those that are.

    ``steps`` mini-batches make an epoch; a row's batch follows from its values. The loss of a step is the weighted
    cross-entropy divided by the number of rows, plus ``l2`` times the squared weights. Inputs are normalised with the mean
    and deviation of the training rows (a constant input gets deviation 1). With ``balance`` the last offset is finally set so
    that the training rows score their weight in class 1. Without validation rows the training loss is watched. Rows with a
    null feature, label or weight are left out. There is no batch normalisation.
    """
    importable(df.sparkSession)
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(
        x.alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), validation.alias("held")
    ).na.drop()
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull()))
    rows = pinned(rows.withColumn("batch", F.pmod(F.xxhash64("x", "y", "w"), F.lit(steps))))
    train, held = rows.filter("not held"), rows.filter("held")
    numbers = [f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(len(features))]
    first = train.agg(*numbers, F.count("*")).first()
    if not first[-1]:
        raise ValueError("no rows to train on")
    k = len(features)
    mean, deviation = np.array(first[:k], dtype=float), np.array(first[k : 2 * k], dtype=float)
    deviation[deviation == 0] = 1
    network = Network(tuple(features), mean, deviation, started([k, *hidden, 1], seed))
    watched = train if held.isEmpty() else held
    schedule = schedule or Schedule()
    values, best = flat(network.layers), network.layers
    adam, done = Adam(len(values)), []
    penalty = np.concatenate([np.full(x.size, i == 0, dtype=float) for pair in network.layers for i, x in enumerate(pair)])
    for epoch in range(epochs):
        count, loss = 0.0, 0.0
        for step in range(steps):
            sums = _sums(train.filter(F.col("batch") == step), replace(network, layers=shaped(values, network.layers)), True)
            if not sums[0]:
                continue
            count, loss = count + sums[0], loss + sums[1]
            values = adam.move(values, sums[2:] / sums[0] + 2 * l2 * penalty * values, schedule.rate)
        now = shaped(values, network.layers)
        seen = _sums(watched, replace(network, layers=now), False)
        rate = schedule.rate
        better, ends = schedule.after(seen[1] / seen[0])
        best = now if better else best
        done.append(
            {
                "epoch": epoch,
                "steps": adam.step,
                "rate": rate,
                "loss": float(loss / count),
                "val_loss": float(seen[1] / seen[0]),
                "best": bool(better),
            }
        )
        if ends:
            break
    fitted = replace(network, layers=best, epochs=tuple(done))
    return _balanced(train, fitted) if balance else fitted
