"""From raw documents to packed training sequences: five stages, each working on all that the one before kept.

The first two drop the documents that they reject, the third leaves one document of each group of near duplicates, the fourth takes secrets
out of the texts, the last packs. Every stage's result is written and read again, so an executor's loss costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import jaccard_join, packing, quality_classifier, quality_rules, secrets
from faultline.llm.catalog import vocabulary
from faultline.session import materialize, work_folder

CAPACITY, END_ID = 4096, 1


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.3 or more."""
    features = materialize(quality_classifier.with_statistics(docs), "statistics")
    sample = materialize(quality_classifier.labelled_sample(features, _labels(spark, sf_dir)), "fit")
    return quality_classifier.keep_good(docs, quality_classifier.fit(sample))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, quality_rules.ratios(docs, quality_rules.trusted_keys(_labels(spark, sf_dir))))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links join: five words a shingle, 80 % alike."""
    return jaccard_join.keep_one(docs, words_each=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    ledger = secrets.Ledger(spark, work_folder(spark, "ledger"))
    secrets.update(docs, ledger)
    return secrets.redact(docs, ledger.findings(secrets.RULE_VERSION))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    pieces = packing.pieces_of(docs, vocabulary("word_bpe_49k.json"), END_ID, CAPACITY)
    return packing.pack(materialize(pieces, "pieces"), CAPACITY)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("n-gram Jaccard join", deduplicate),
    ("secret scans", redact),
    ("best-fit packing", pack),
]
#: The classifier's fit and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES: dict[str, str] = {}
