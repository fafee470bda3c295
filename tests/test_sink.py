"""Skims per sample: what a stopped run has left is completed, what is finished stays."""

import os

import pytest
from pyspark.sql import functions as F

from eventspark.sources import skim


def rows(spark, shift=0.0):
    data = [(s, float(i) + shift) for s in ("a", "b:1", "c") for i in range(6)]
    return spark.createDataFrame(data, "sample string, v double").repartition(3)


def found(spark, path):
    return {r.sample: (r.n, r.s) for r in spark.read.parquet(path).groupBy("sample").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}


def state(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_stopped_write_is_completed_and_finished_samples_stay(spark, tmp_path):
    path = f"{tmp_path}/skim"
    names = ["a", "b:1", "c", "none"]
    assert skim.write_samples(rows(spark).filter("sample <> 'c'"), path, names[:2]) == names[:2]
    before = state(path)
    # a write of "c" that died: rows of a half, no mark
    rows(spark).filter("sample = 'c' and v < 2").drop("sample").write.parquet(f"{path}/sample=c")
    os.remove(f"{path}/sample=c/_SUCCESS")
    assert skim.write_samples(rows(spark, 100.0), path, names) == ["c", "none"]
    assert found(spark, path) == {"a": (6, 15.0), "b:1": (6, 15.0), "c": (6, 615.0)}
    assert before.items() <= state(path).items()
    assert skim.write_samples(rows(spark), path, names) == []
    assert skim.write_samples(rows(spark, 1.0), path, names, overwrite=["a"], together=1) == ["a"]
    assert found(spark, path) == {"a": (6, 21.0), "b:1": (6, 15.0), "c": (6, 615.0)}


def test_a_job_that_fails_leaves_no_mark(spark, tmp_path):
    path = f"{tmp_path}/skim"
    bad = rows(spark).withColumn("v", F.when(F.col("sample") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        skim.write_samples(bad, path, ["a", "c"], together=1)
    assert skim.write_samples(rows(spark), path, ["a", "c"]) == ["c"]
    assert found(spark, path) == {"a": (6, 15.0), "c": (6, 15.0)}


def test_a_half_written_skim_is_not_taken_for_a_finished_one(spark, tmp_path):
    path = f"{tmp_path}/one"
    rows(spark).filter("v < 2").write.parquet(path)
    os.remove(f"{path}/_SUCCESS")
    skim.write(rows(spark), path)
    assert spark.read.parquet(path).count() == 18
    skim.write(rows(spark).limit(1), path)
    assert spark.read.parquet(path).count() == 18
    skim.write(rows(spark).limit(1), path, overwrite=True)
    assert spark.read.parquet(path).count() == 1
