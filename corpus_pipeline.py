"""A corpus pipeline: five stages over documents, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import kept_now, release, settle
from skein.llm.decontaminate import drop_contaminated
from skein.llm.exact_dedup import drop_exact_copies
from skein.llm.mixing import mix
from skein.llm.simhash import JACCARD, drop_near_copies
from skein.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; the model learns from the labels of docs."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return drop_near_copies(docs, jaccard=JACCARD)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any span of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of the documents taken."""
    return mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = kept_now()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name)
            release(spark, before, but=docs)  # the stage is done; its table alone is read on
    return docs
