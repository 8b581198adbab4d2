"""Text lines with their number in the file, without leaving the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines (value) with the input split they come from."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    ).where(F.length("value") > 0)


def keep_small(df: DataFrame) -> DataFrame:
    """Persist a small frame that several jobs use.

    The tag makes its plan unique: a later read of the same path, whose content may have
    changed by then, can never be answered from this copy.
    """
    return df.withColumn("_tag", F.lit(uuid.uuid4().hex)).persist().drop("_tag")


def split_offsets(marked: DataFrame, header: Column) -> DataFrame:
    """One row per input split: its data lines, its first monotonic id, the data lines before it, its headers (id, line), and the
    first line of a split at the head of a file."""
    splits = marked.groupBy("_file", "_start").agg(
        F.count_if(~header).alias("_n"), F.min("_mid").alias("_first"),
        F.collect_list(F.when(header, F.struct("_mid", "value"))).alias("_headers"),
        F.min_by(F.when(F.col("_start") == 0, F.col("value")), F.col("_mid")).alias("_line"),
    )
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    return keep_small(splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))


def numbered(lines: DataFrame, number: str = "line_no", header: Column | None = None, first: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Data lines with a dense 0-based number in file order, a one-row frame with their count, and the header lines (``value``).

    Headers are the lines for which ``header`` holds, which get no number, or (``first``) the first line, which has the number 0.

    Lines of one input split stand together in one task, so their rank inside the split is
    a difference of monotonic ids. Only one small row per split (not per line) is sorted
    and broadcast: 100 TB in 128 MB splits make 800,000 such rows. The same rows hold the lines for which ``header`` holds (one or
    few in all), so counts and headers come from one scan, and the data are then read once.
    """
    header = F.lit(False) if header is None else header
    marked = lines.withColumn("_mid", F.monotonically_increasing_id())
    offsets = split_offsets(marked, header)
    keep = [c for c in lines.columns if c not in ("_file", "_start")]
    places = offsets.select("_file", "_start", "_first", "_before", F.transform("_headers", lambda h: h["_mid"]).alias("_above"))
    above = F.size(F.filter("_above", lambda h: h < F.col("_mid")))
    # The mark is made on all lines, so the headers are left out after it.
    placed = marked.join(F.broadcast(places), ["_file", "_start"]).where(~F.array_contains("_above", F.col("_mid"))).select(
        *keep, (F.col("_before") + F.col("_mid") - F.col("_first") - above).alias(number)
    )
    if first:
        at = F.when(F.col("_start") == 0, F.col("_line")).otherwise(F.raise_error(F.lit("the first split of the file has no line")))
        headers = offsets.where("_before = 0 AND _n > 0").select(at.alias("value"))
    else:
        headers = offsets.select(F.explode("_headers").alias("h")).select("h.value")
    return placed, offsets.agg(F.sum("_n").alias("n")), headers
