"""The corpus pipeline: documents in, encoded clean documents out.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next stage's docs.

Defined cases. Null and empty texts: scored like any text; a document without a line left goes at the
second stage only if lines of it were cut; one without words is in no near-duplicate group, is never
contaminated and encodes to no ids. Rows without doc_id stay unless a stage rejects them; of a group
of near duplicates one row stays, rows equal in id and text being one; ties go to the smallest id, then
to the smallest text by hash. Long texts pass every stage whole. An empty table, or one without labels,
gives an empty result or an untrained classifier that keeps everything scoring 0.5. Further columns, of
any name, are carried to the last stage, which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.llm import bpe, decontaminate, linededup, neardup, quality
from tremora.llm.registry import quality_network, table, tokenizer_path
from tremora.session import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, trained on the labels table, rejects."""
    scored = quality.with_score(docs, quality_network(spark, docs, sf_dir))
    return scored.where(F.col("score") >= quality.THRESHOLD).select(docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of repeated line runs; a document of which nothing is left goes."""
    cut = linededup.dedup_lines(docs)
    return cut.where("n_removed < n_lines").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group: five words, similarity 0.8."""
    return neardup.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which ten words of a benchmark item follow each other."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, with the digests of a round trip."""
    return bpe.digests(bpe.encode_and_decode(docs.select("doc_id", "text"), tokenizer_path()))


STAGES = [
    ("quality", keep_quality),
    ("linededup", cut_repeated_lines),
    ("neardup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode_texts),
]

#: Several stages (a trained classifier, hashing, merges) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
