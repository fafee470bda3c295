"""Documents to packed training sequences in five stages; each works on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.llm import line_dedup, minhash_forest, packing, quality_rules, weak_quality
from eventspark.llm.queries import WORD_BPE
from eventspark.llm.session import fresh, stored

#: Documents of the pipeline are near copies from this Jaccard similarity of their five-word shingles on (percent).
NEAR = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Ids of documents to leave out that are broadcast at most; more are joined by a shuffle.
BROADCAST = 100_000


def _only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents whose verdict is ``kept``; doc_id identifies a document (rows without one are judged together)."""
    name = fresh("doc_id_of", docs)
    judged = verdicts.groupBy(F.col("doc_id").alias(name)).agg(F.bool_or("kept").alias("kept"))
    judged = stored(judged)
    gone = judged.filter("not kept").select(name)
    same = F.col("doc_id").eqNullSafe(F.col(name))
    if gone.count() <= BROADCAST:
        return docs.join(F.broadcast(gone), same, "left_anti")
    return docs.join(judged.filter("kept").select(name), same, "left_semi")


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, weak_quality.classify(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines, and ``n_chars`` of the new text; a document all of whose lines go stays, empty.

    Exact and near copies of a document are one page of its site, so that a text is not boilerplate for being copied;
    which of them stays is for the next stage. Rows without a doc_id are one page where their texts are equal.
    """
    found = minhash_forest.near_duplicates(docs, percent=NEAR).filter("doc_id is not null")
    found = found.select("doc_id", F.col("component_id").alias("copy_of"))
    cleaned = line_dedup.without_boilerplate(docs, copies=found)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, minhash_forest.near_duplicates(docs, percent=NEAR))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rule_stage),
    ("quality_classifier", classifier_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, the tokenizer and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
