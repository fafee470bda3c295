"""Reading event samples stored as parallel arrays and turning them into collections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields the analysis reads, per stored collection (``<collection>_<field>`` columns).
FIELDS: dict[str, tuple[str, ...]] = {
    "Muon": ("pt", "eta", "phi", "mass", "charge", "pdgId", "dxy", "dz", "sip3d", "miniPFRelIso_all", "mvaTTH",
             "jetRelIso", "jetIdx", "looseId", "mediumId"),
    "Electron": ("pt", "eta", "phi", "mass", "charge", "pdgId", "dxy", "dz", "sip3d", "miniPFRelIso_all", "lostHits",
                 "deltaEtaSC", "sieie", "hoe", "eInvMinusPInv", "mvaTTH", "jetRelIso", "jetIdx", "convVeto",
                 "mvaNoIso_WP90"),
    "Jet": ("pt", "eta", "phi", "mass", "jetId", "btagDeepFlavB"),
    "FatJet": ("pt", "eta", "phi", "mass", "jetId", "msoftdrop", "tau1", "tau2", "btagDeepB", "subJet1Idx",
               "subJet2Idx"),
    "SubJet": ("pt", "eta", "phi", "mass", "btagDeepB"),
    "Tau": ("pt", "eta", "phi", "mass", "dxy", "dz", "idDecayModeOldDMs", "decayMode", "idDeepTau2017v2p1VSjet",
            "idDeepTau2017v2p1VSe", "idDeepTau2017v2p1VSmu"),
    "GenPart": ("pt", "pdgId", "statusFlags"),
}


def zip_collections(df: DataFrame, fields: Mapping[str, Sequence[str]] = FIELDS) -> DataFrame:
    """Replace the arrays ``<name>_<field>`` by one ``array<struct>`` column ``<name>`` with ``idx``.

    Only the listed arrays are read from the file. Single-precision fields become doubles. Collections the file does
    not have (simulation-only ones in data) are skipped.
    """
    have = {c.lower(): c for c in df.columns}
    out = {}
    for name, wanted in fields.items():
        present = [f for f in wanted if f"{name}_{f}".lower() in have]
        if not present:
            continue
        missing = [f for f in wanted if f not in present]
        if missing:
            raise ValueError(f"collection {name} lacks {missing}")
        arrays = []
        for f in wanted:
            column = F.col(f"{name}_{f}")
            if df.schema[f"{name}_{f}"].dataType.simpleString() == "array<float>":
                column = column.cast("array<double>")
            arrays.append(column.alias(f))
        out[name] = F.transform(F.arrays_zip(*arrays), lambda x, i: x.withField("idx", i))
    used = {f"{name}_{f}" for name in out for f in fields[name]}
    return df.select(*[c for c in df.columns if c not in used], *[v.alias(k) for k, v in out.items()])


def read_sample(spark: SparkSession, name: str, paths: Sequence[str], max_files: int | None = None) -> DataFrame:
    """All files of one sample (main dataset and extensions), tagged with the sample name.

    The columns are those of all files together; where a file lacks one, it is NULL.
    """
    chosen = list(paths)[:max_files] if max_files is not None else list(paths)
    return spark.read.option("mergeSchema", "true").parquet(*chosen).withColumn("sample", F.lit(name))


def read_events(spark: SparkSession, samples: Mapping[str, Mapping], max_files: int | None = None) -> DataFrame:
    """Union of all samples; columns a sample lacks (triggers, simulation-only arrays) are NULL.

    ``samples`` maps a name to ``{"paths": [...], "era": ..., "type": ...}``. A data sample's ``run_range`` becomes a
    filter next to its scan.
    """
    frames = []
    for name, s in samples.items():
        df = read_sample(spark, name, s["paths"], max_files)
        df = df.withColumns({"era": F.lit(str(s["era"])), "type": F.lit(s["type"])})
        if s.get("run_range") is not None:
            df = df.filter(F.col("run").between(*s["run_range"]))
        frames.append(df)
    return union_all(frames)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
