"""The corpus pipeline: five stages from ``documents`` to packed training sequences.

Each stage works on all that its predecessor kept and returns the columns of ``documents``; the last one
returns the places of the pieces in the packed sequences. Between stages the rows are a Parquet table in the
folder that ``spark.checkpoint.dir`` names, so no lost executor sends the job back by more than a stage.

Edge cases of the stages are those of their operators. A document that line dedup leaves without a word goes,
as nothing of it is new; one that was empty before is left to language ID, which can't identify it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm import language, lines, mixing, near_duplicates, packing
from gramloom.llm.common import SPACES, documents, keeps_names, written
from gramloom.llm.queries import public_tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told."""
    return language.with_language(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of lines; documents with nothing left go."""
    return _new_lines(docs)


@keeps_names
def _new_lines(docs: DataFrame) -> DataFrame:
    columns = docs.columns
    keep = F.when((F.col("n_removed") == 0) | (F.btrim("text", F.lit(SPACES)) != ""), F.array(F.lit(1)))
    # A plain filter would be pushed below the columns it reads, and split a text anew for each of its lines.
    out = lines.dedup_lines(docs).select("*", F.explode_outer(keep).alias("_keep")).where(F.col("_keep").isNotNull()).drop("_keep")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, and one of equal rows of it."""
    return near_duplicates.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps and drops documents so that sources meet their target weights."""
    out = mixing.mixed(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack(docs, public_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the language model and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written(docs)
    return docs
