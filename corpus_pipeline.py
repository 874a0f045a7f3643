"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage
gets it as written and read again. All stages but the last keep the columns of
``documents``.

All stages take null and empty texts, texts of any length, null and repeated ids,
repeated rows and empty tables; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, linededup, mixing, neardup, toxicity
from tessera.sources.workdir import removed, swept, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Each row is judged by its own text, so repeated rows fare alike and ids do not
    matter; a probability equal to the threshold rejects. Without labels all stay.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a site repeats on too many of its pages go; n_chars follows the text.

    No row goes. Equal texts of a site count as one page; a null source is a site of
    its own, a null text stays null with its n_chars, a text may end up empty.
    """
    out = linededup.drop_boilerplate(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are at least 0.8 similar stays.

    The one with the smallest id (null last), then text name. Null and empty texts
    are one group. Rows that repeat id and text are one document and stay together;
    rows that share only an id are judged apart.
    """
    return neardup.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A window as long as the item that is at least 0.8 similar counts. Rows are
    judged by id and text together, so a clean row that shares an id stays; null
    and empty texts stay.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents, so that the sources meet their targets.

    A row for each row, with its copies (0 to 2). A null source is a source of its
    own; null and empty texts have size 0; repeated rows are separate documents.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: SQL cannot express the classifiers, the fingerprints or the Newton iterations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again, what it needed goes."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with swept(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.add(docs)
        if last is not None:
            removed(spark, last._scratch)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
