"""Weighted two-class training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.operators.checkpoints import ensure_checkpoint_dir, pinned


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    weight: str,
    kind: str = "gbt",
    validation: str | None = None,
    iterations: int = 20,
    l2: float = 1e-6,
    seed: int = 1,
    tol: float = 1e-6,
) -> PipelineModel:
    """Fit normalisation and classifier on ``df`` with row weights.

    ``gbt`` stops early on the rows flagged by ``validation`` and keeps the best number of trees; ``logistic`` is a
    regularised linear model (its intercept is not), iterated until it changes by less than ``tol``. Normalisation is fitted on the training rows only.
    The columns it needs are stored once: every fit reads its rows several times.
    """
    df = pinned(df.select(*dict.fromkeys([*features, label, weight, *([] if validation is None else [validation])])))
    assemble = VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="error")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    common = {"featuresCol": "features", "labelCol": label, "weightCol": weight}
    if kind == "gbt":
        ensure_checkpoint_dir(df.sparkSession)
        clf = GBTClassifier(**common, maxIter=iterations, maxDepth=4, stepSize=0.2, seed=seed, validationTol=0.001)
        if validation is not None:
            clf = clf.setValidationIndicatorCol(validation)
    elif kind == "logistic":
        clf = LogisticRegression(**common, maxIter=iterations, regParam=l2, tol=tol)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    fitted_on = df if validation is None else df.filter(~F.col(validation))
    prepare = Pipeline(stages=[assemble, scale]).fit(fitted_on)
    rows = prepare.transform(df if kind == "gbt" else fitted_on)
    return PipelineModel(stages=[*prepare.stages, clf.fit(rows)])


def score(model: PipelineModel, df: DataFrame, column: str = "score") -> DataFrame:
    """Probability of class 1 per row; helper columns of the model are dropped."""
    out = model.transform(df).withColumn(column, vector_to_array("probability")[1])
    return out.select(*[c for c in df.columns if c != column], column)


def score_by_parity(even: PipelineModel, odd: PipelineModel, df: DataFrame, is_even: Column, column: str = "score") -> DataFrame:
    """Score each row with the model that was not trained on its parity."""
    both = score(odd, score(even, df.withColumn("_even", is_even), "_on_even"), "_on_odd")
    return both.withColumn(column, F.when(F.col("_even"), F.col("_on_even")).otherwise(F.col("_on_odd"))).drop(
        "_even", "_on_even", "_on_odd"
    )


def history(spark: SparkSession, model: PipelineModel, validation: DataFrame | None = None) -> DataFrame:
    """Loss per iteration (``iteration, loss``); boosted trees are evaluated on ``validation``."""
    last = model.stages[-1]
    if hasattr(last, "evaluateEachIteration"):
        if validation is None:
            raise ValueError("a boosted model needs rows to evaluate its iterations on")
        losses = last.evaluateEachIteration(PipelineModel(stages=model.stages[:-1]).transform(validation))
    else:
        losses = list(last.summary.objectiveHistory)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "iteration int, loss double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
