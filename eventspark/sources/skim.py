"""Flat tables of selected events ("skims")."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.functions import coll
from eventspark.operators import norm


def rows(df: DataFrame, flag: Column, exprs: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Named expressions for the events passing ``flag``.

    A generator emits zero or one row per event. A filter would be pushed below the object layer and evaluate its
    array expressions a second time.
    """
    flat = F.struct(*[c.alias(k) for k, c in exprs.items()])
    return df.select(*keep, F.inline(F.when(flag, F.array(flat))))


def _features(items: Mapping[str, Column]) -> dict[str, Column]:
    return {f"{name}_{part}": item[part] for name, item in items.items() for part in ("pt", "eta", "phi")}


def _jets() -> dict[str, Column]:
    small = F.col("ak4_jets")
    return {"ak4bjet1": coll.at(F.col("ak4_bjets"), 0), "ak4jet1": coll.at(small, 0), "ak4jet2": coll.at(small, 1)}


def dl_features() -> dict[str, Column]:
    """15 classifier inputs of the two-electron resolved selection."""
    lep = F.col("tight_electrons")
    return _features({**_jets(), "leadingLepton": coll.at(lep, 0), "subleadingLepton": coll.at(lep, 1)})


def sl_features() -> dict[str, Column]:
    """12 classifier inputs of the one-electron resolved selection."""
    return _features({**_jets(), "leadingLepton": coll.at(F.col("tight_electrons"), 0)})


def merge(df: DataFrame, scales: DataFrame, n_samples: int, include_data: bool = True) -> DataFrame:
    """Scaled weights and the process (group, or the sample itself when ungrouped) of every skim row."""
    info = scales.select("sample", "scale", F.coalesce("grp", "sample").alias("process"), F.lower("type").alias("_type"))
    small = F.broadcast(info) if n_samples <= norm.MAX_BROADCAST_ROWS else info
    joined = df.join(small, "sample", "left")
    scaled = joined.withColumn("weight", F.col("weight") * norm.known_scale()).drop("scale")
    if not include_data:
        scaled = scaled.filter(F.col("_type") != "data")
    return scaled.drop("_type", "sample")


def write(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write parquet; a finished skim is left alone unless ``overwrite``, a half-written one is written anew."""
    if overwrite or not _finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a write into ``path`` has been committed: its mark is the last file that appears."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_samples(
    df: DataFrame, path: str, samples: Sequence[str], by: str = "sample", overwrite: Sequence[str] = (), together: int = 32
) -> list[str]:
    """Write the rows of each sample into a folder ``<by>=<name>`` of its own and return the samples written.

    A sample whose folder bears the mark of a finished write is left untouched, unless named in ``overwrite``; all others,
    half-written ones included, are written anew. A run that was stopped is completed by the same call, and reads only the
    samples it still has to write if ``df`` lets the filter through. ``together`` samples share one pass over the events, with
    a mark for each after their commit; a sample without rows gets its mark too.
    """
    spark = df.sparkSession
    missing = [s for s in samples if s in overwrite or not _finished(spark, f"{path}/{by}={_folder(s)}")]
    for i in range(0, len(missing), together):
        some = missing[i : i + together]
        for s in some:
            _unmark(spark, f"{path}/{by}={_folder(s)}")
        rows = df.filter(F.col(by).isin(*some))
        # replaces the folders of the samples that have rows, and no other
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
        for s in some:
            _mark(spark, f"{path}/{by}={_folder(s)}")
    return missing


def _folder(value: str) -> str:
    """A partition folder's name for a value, as the writer escapes it."""
    odd = set('"#%\'*/:=?\\\x7f{[]^') | {chr(i) for i in range(1, 32)}
    return "".join(f"%{ord(c):02X}" if c in odd else c for c in value)


def _unmark(spark: SparkSession, folder: str) -> None:
    """Remove the mark and what an earlier write has left, so that a sample without rows has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _mark(spark: SparkSession, folder: str) -> None:
    mark = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
