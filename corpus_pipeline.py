"""The corpus pipeline: quality, lines, near duplicates, contamination and the final mix, in that order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_BYTES, Staged, set_aside, small_batches
from tidemark.llm.decontaminate import remove_contaminated
from tidemark.llm.line_dedup import ADDED, dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import keep_good
from tidemark.llm.simhash import drop_near_duplicates
from tidemark.staging import scratch


def bounded(step):
    """``step`` with the batches that its texts go to Python in bounded by bytes; what it returns may run later."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return step(spark, docs, sf_dir)

    return run


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; learned from labels outside fold 0.

    Null and empty texts are scored from an all-zero vector; without labels an untaught network scores.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@bounded
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three or more documents share; ``n_chars`` follows the text.

    A null text stays null; a text of shared lines only becomes empty; rows without doc_id keep all lines.
    """
    base, back = set_aside(docs, ADDED)
    out = dedup_lines(base)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return back(out)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (five-word shingles, 0.8).

    Texts without words are one group; rows without doc_id stay; of rows that repeat a doc_id one stays.
    """
    return drop_near_duplicates(docs)


@bounded
def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words (or all of a shorter item) of the benchmark.

    Null and empty texts stay; an empty benchmark leaves all.
    """
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies and taken words.

    Null and empty texts have no words and are not taken; null sources are one source, last in order.
    """
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", contamination),
    ("mix", mix),
]

#: The classifier, fingerprints and the rounding are beyond SQL; tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage has staged goes when the next one's rows are written."""
    docs, before, batches = spark.read.parquet(f"{sf_dir}/documents.parquet"), None, spark.conf.get(BATCH_BYTES)
    try:
        for name, step in STAGES:
            with scratch() as keep:
                now = keep(Staged(step(spark, docs, sf_dir), name.replace(" ", "-")))
            if before:
                before.drop()
            docs, before = now.df, now
    finally:
        spark.conf.set(BATCH_BYTES, batches)
    return docs
