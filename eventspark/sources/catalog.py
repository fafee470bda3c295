"""Sample catalogue: templates, eras, run letters and cross-sections."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.operators.literal import literal_table

# Recorded luminosity in pb^-1 per era.
LUMINOSITY = {"2022": 8077.0, "2022EE": 21129.0}

# Process groups in legend order.
GROUPS = ("Data", "TTbar", "DY", "WJets", "VV", "TW")

SAMPLE_SCHEMA = pa.schema(
    [
        ("sample", pa.string()),
        ("era", pa.string()),
        ("type", pa.string()),
        ("grp", pa.string()),
        ("paths", pa.list_(pa.string())),
        ("luminosity", pa.float64()),
        ("cross_section", pa.float64()),
        ("branching_ratio", pa.float64()),
        ("run_min", pa.int64()),
        ("run_max", pa.int64()),
    ]
)


def expand(templates: DataFrame, eras: Sequence[str] | None = None) -> DataFrame:
    """One sample per era from templates that list datasets per era.

    ``templates`` has ``name``, ``dbs`` (map era -> datasets, NULL for a plain sample), ``db`` and ``era`` (plain
    samples) and ``syst`` (array [variation, nominal name] or NULL). Plain samples pass through whatever their era.
    Other columns are carried along.
    """
    rest = [c for c in templates.columns if c not in ("name", "dbs", "db", "era", "syst")]
    per_era = templates.filter(F.col("dbs").isNotNull()).select("name", "syst", *rest, F.explode("dbs").alias("era", "db"))
    if eras is not None:
        per_era = per_era.filter(F.col("era").isin(*[str(e) for e in eras]))
    era_name = F.concat_ws("__", "name", "era")
    variation, nominal = F.get("syst", F.lit(0)), F.get("syst", F.lit(1))
    named = per_era.select(
        F.when(F.col("syst").isNull(), era_name).otherwise(F.concat_ws("__", nominal, "era", variation)).alias("name"),
        "era",
        "db",
        F.when(F.col("syst").isNotNull(), F.array(variation, era_name)).alias("syst"),
        *rest,
    )
    plain = templates.filter(F.col("dbs").isNull()).select("name", "era", "db", "syst", *rest)
    return named.unionByName(plain)


def run_era(sample: Column) -> Column:
    """Run letter of a data sample (possibly empty), ``MC`` when the name has no run part."""
    pattern = r"Run20..([A-Z]?)"
    return F.when(sample.rlike(pattern), F.regexp_extract(sample, pattern, 1)).otherwise("MC")


def _listed(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def sample_table(spark: SparkSession, samples: Mapping[str, Mapping], luminosity: Mapping[str, float] = LUMINOSITY) -> DataFrame:
    """Catalogue table from already expanded samples (the keys used by sample files: era, type, group, ...)."""
    rows = []
    for name, s in samples.items():
        run_min, run_max = s.get("run_range", (None, None))
        era = str(s["era"])
        number = lambda key: None if s.get(key) is None else float(s[key])  # noqa: B023,E731
        rows.append(
            (
                name,
                era,
                s["type"],
                s.get("group"),
                _listed(s.get("files", s.get("db", []))),
                luminosity.get(era),
                number("cross-section"),
                number("branching-ratio"),
                run_min,
                run_max,
            )
        )
    return literal_table(spark, SAMPLE_SCHEMA, rows)
