"""Corpus pipeline: quality classifier, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm.common import fresh, keep
from stratus.llm.mixing import mix_sources, mixture
from stratus.llm.packing import pack_documents
from stratus.llm.quality import score, train
from stratus.llm.simhash import drop_near_duplicates


def _vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the classifier, fitted on the labels of these rows, does not reject.

    Null and empty texts are judged like any other; without labels of both kinds nothing is rejected.
    """
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not machine.trained:
        return docs
    quality_col, clean_col = fresh("_quality", docs.columns), fresh("_clean", docs.columns)
    judged = score(docs, machine, threshold=0.3, score_col=quality_col, predicted_col=clean_col)
    return judged.filter(F.col(clean_col) == 1).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near copies, that of the smallest id (null last)."""
    return drop_near_duplicates(docs, words=3, bits=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it, in the order of the output shards and of the places within them.

    Rows without words, which no target asks for, are left out.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole_row"))
    return mixture(mix_sources(rows, carry=("whole_row",))).select("whole_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences of 2048 tokens."""
    return pack_documents(docs, _vocabulary(), capacity=2048, end_id=0) \
        .select("doc_id", "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

# SQL expresses neither the classifier nor the packing; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
