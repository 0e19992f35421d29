"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next one.

Every stage but the last returns the columns of ``documents``, whatever their names. Rows keep their id; where the mix takes
a document more than once, its row is repeated. Stages judge rows by id and text: a null text is an empty one, a null id
is an id, and rows that repeat both are one row to the near-duplicate stage and to the mix, which keep one of them. An
empty table goes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, decontam, mixing, neardup, quality, queries
from sparkloom.llm import token_ids as ids


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go: null, empty and short texts among them. Ties and repeated rows are judged alone."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; rows that repeat it once. Texts without words stay."""
    return common.keep_rows(docs, neardup.near_duplicates(docs).where("kept"), once=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each judged by its own text; null and empty texts hold no words and stay, as all do for an empty benchmark."""
    return common.keep_rows(docs, decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark")).where("NOT contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, none or twice at most; a null source is a source, documents without words come once."""
    return mixing.mixed_rows(docs, mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is written as token-id files; a row per document, null ids first, tells its place in them."""
    return ids.token_files(docs, queries.tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix_sources", mix_sources), ("token_ids", token_ids)]

#: Near-duplicate components, entropy balancing and BPE ids are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
