"""The corpus pipeline: toxic documents go, then boilerplate lines, near duplicates and contaminated documents; the rest is packed."""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import checked_broadcast, discard, saved
from llm.decontaminate import without_contaminated
from llm.line_dedup import drop_boilerplate
from llm.ngram_join import similar_documents
from llm.packing import pack
from llm.toxicity import learn, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes when its toxicity score is at least this: operator 9's decision.
TOXIC = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored as toxic; the lexicon is learnt from the labels of this stage's own input.

    Without labels of both kinds nothing is dropped.  Null and empty texts score low and stay; repeated rows stay or go together; texts are scored whole.
    """
    model = learn(docs, _table(spark, sf_dir, "labels"))
    return score(docs, model).filter(F.col("score") < TOXIC).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that more than a tenth of a source's documents contain; documents stay, n_chars follows the text.

    A null text stays null with a null n_chars; a null source is a source of its own; repeated rows count as pages of their own.
    """
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of documents linked by 5-word shingles with a similarity of 0.8 or more.

    Null and blank texts and rows without doc_id are linked with nothing and stay; rows with one doc_id are one document and stay or go together.
    """
    groups = similar_documents(docs, "text", 5, 80, 100)
    copies = saved(groups.filter("component_id != doc_id").select("doc_id").distinct())
    return docs.join(checked_broadcast(copies), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none, rows without doc_id stay, rows with one doc_id go together."""
    return without_contaminated(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens; a null text is its end token, repeated rows are documents of their own."""
    return pack(docs, path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The lexicon, the components of links and the packing cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each reads what the one before it saved, which is deleted once read.  Columns beyond those of documents are not kept."""
    docs, last = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
