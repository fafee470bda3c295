"""Event filters: certified run ranges and trigger decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventspark.functions import ops
from eventspark.operators.literal import literal_table

# Trigger paths per primary dataset, in the order used to remove duplicates.
TRIGGERS: dict[str, tuple[str, ...]] = {
    "Muon": ("IsoMu24", "IsoMu27", "Mu17_TrkIsoVVL_Mu8_TrkIsoVVL_DZ_Mass3p8"),
    "EGamma": ("Ele32_WPTight_Gsf", "Ele23_Ele12_CaloIdL_TrackIdL_IsoVL"),
    "MuonEG": ("Mu8_TrkIsoVVL_Ele23_CaloIdL_TrackIdL_IsoVL_DZ",),
    "SingleMuon": ("IsoMu24", "IsoMu27"),
    "DoubleMuon": ("Mu17_TrkIsoVVL_Mu8_TrkIsoVVL_DZ_Mass3p8",),
}

LUMI_SCHEMA = pa.schema([("run", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def lumi_ranges(spark: SparkSession, certified: Mapping[str, Sequence[Sequence[int]]]) -> DataFrame:
    """Certified list ``{run: [[first, last], ...]}`` as a table of inclusive ranges."""
    rows = [(int(run), int(lo), int(hi)) for run, spans in certified.items() for lo, hi in spans]
    return literal_table(spark, LUMI_SCHEMA, rows)


def certified(
    df: DataFrame,
    ranges: DataFrame,
    run_range: tuple[int, int] | None = None,
    run: str = "run",
    lumi: str = "luminosityBlock",
    only: Column | None = None,
) -> DataFrame:
    """Keep events whose run lies in ``run_range`` and whose (run, lumi block) is certified.

    With ``only`` (data) both ask nothing of the other events. A semi join on the run with the block range as residual condition: overlapping ranges never repeat an event, and
    the run range is a plain filter that reaches the scan.
    """
    r = ranges.select(F.col("run").alias("_run"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    if only is None:
        if run_range is not None:
            df = df.filter(F.col(run).between(*run_range))
        return df.join(r, (df[run] == r["_run"]) & df[lumi].between(r["_lo"], r["_hi"]), "left_semi")
    # names of their own: an outer name that the ranges have, too, would be taken from them
    named = df.withColumns({"_of_run": F.col(run), "_of_lumi": F.col(lumi)})
    span = F.col("_of_lumi").outer().between(F.col("_lo"), F.col("_hi"))
    listed = r.where((F.col("_run") == F.col("_of_run").outer()) & span).exists()
    if run_range is not None:
        listed = listed & F.col(run).between(*run_range)
    return named.filter(~ops.passed(only) | listed).drop("_of_run", "_of_lumi")


def trigger_cols(df: DataFrame, names: Sequence[str], group: str = "HLT") -> tuple[list[Column], list[str]]:
    """Trigger bits present in ``df`` and the names that are missing.

    A bit is a field of the struct column ``group`` or a flat column ``<group>_<name>``.
    """
    struct = df.schema[group].dataType if group in df.columns else None
    fields = set(struct.fieldNames()) if isinstance(struct, T.StructType) else set()
    found, missing = [], []
    for name in names:
        if name in fields:
            found.append(F.col(group)[name])
        elif f"{group}_{name}" in df.columns:
            found.append(F.col(f"{group}_{name}"))
        else:
            missing.append(name)
    return found, missing


def triggers_by_dataset(
    df: DataFrame, triggers: Mapping[str, Sequence[str]] = TRIGGERS, group: str = "HLT"
) -> dict[str, list[Column]]:
    """Available bits per primary dataset; absent paths are skipped."""
    return {pd: trigger_cols(df, names, group)[0] for pd, names in triggers.items()}


def trigger_any(bits: Mapping[str, Sequence[Column]]) -> Column:
    """Simulation: any path of any primary dataset fired."""
    return ops.passed(ops.any_of(*[b for group in bits.values() for b in group]))


def primary_dataset(sample: Column) -> Column:
    """Part of a data sample's name before ``_Run``."""
    return F.regexp_extract(sample, r"^(.*?)_Run", 1)


def trigger_primary(pd: Column, bits: Mapping[str, Sequence[Column]]) -> Column:
    """Data: a path of the event's own dataset fired and none of a dataset listed before it."""
    out = F.lit(False)
    earlier: list[Column] = []
    for name, own in bits.items():
        fired = ops.passed(ops.any_of(*own))
        keep = fired if not earlier else fired & ~ops.any_of(*earlier)
        out = F.when(pd == name, keep).otherwise(out)
        earlier.append(fired)
    return out


def trigger(df: DataFrame, is_data: Column, sample: Column, bits: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Trigger requirement for a frame that mixes data and simulation."""
    keep = F.when(is_data, trigger_primary(primary_dataset(sample), bits)).otherwise(trigger_any(bits))
    return df.filter(keep)
