"""Where Python workers find this package, and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
_LOCAL: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (an installed package needs nothing)."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where everything runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    return _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="eventspark-llm-"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: later readers see the same rows, no
    executor's loss undoes the work, and the optimiser knows the size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` whose last reader has ended; whatever is lazily read from them must not follow."""
    for table in tables:
        spark, path = table.sparkSession, table.stored_at
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of ``frames`` has it, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
