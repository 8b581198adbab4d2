"""Allele counting and genotype recoding.

Long form: one row per (sample, marker) with two allele strings. Counting combines in
the map stage, so the shuffle carries markers x alleles rows whatever the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The documented code of a missing allele.
MISSING_ALLELE = "0"


def count_alleles(calls: DataFrame) -> DataFrame:
    """(marker, allele, n) from one row per allele; missing alleles are not counted."""
    return (
        calls.where(F.col("allele").isNotNull() & (F.col("allele") != MISSING_ALLELE))
        .groupBy("marker", "allele")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def allele_counts(pairs: DataFrame, marker: str, first: str, second: str) -> DataFrame:
    """(marker, allele, n) over both allele columns."""
    return count_alleles(
        pairs.select(F.col(marker).alias("marker"), F.explode(F.array(first, second)).alias("allele"))
    )


def major_minor(counts: DataFrame) -> DataFrame:
    """(marker, major, minor): the two most frequent alleles, ties in string order.

    ``minor`` is "" where a marker has one allele only.
    """
    rank = Window.partitionBy("marker").orderBy(F.col("n").desc(), F.col("allele"))
    top = counts.withColumn("r", F.row_number().over(rank)).where("r <= 2")
    return top.groupBy("marker").agg(
        F.max(F.when(F.col("r") == 1, F.col("allele"))).alias("major"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("allele"))), F.lit("")).alias("minor"),
    )


def recode(first: Column, second: Column, major: Column, minor: Column) -> Column:
    """0 = two major alleles, 1 = one of each, 2 = two minor; null if another allele is involved."""
    known = lambda a: (a == major) | ((a == minor) & (minor != ""))
    return F.when(
        known(first) & known(second),
        F.when(first != second, F.lit(1.0)).when(first == major, F.lit(0.0)).otherwise(F.lit(2.0)),
    )


def encode_genotypes(pairs: DataFrame, alleles: DataFrame, marker: str, first: str, second: str) -> DataFrame:
    """Add ``genotype`` to every row of ``pairs``.

    ``alleles`` has one row per marker. Its size grows with the markers, so the join strategy
    is left to the optimizer's size estimate; a hot marker is split by adaptive skew handling.
    """
    table = alleles.select(F.col("marker").alias(marker), "major", "minor")
    return pairs.join(table, marker, "left").select(
        *[F.col(f"`{c}`") for c in pairs.columns],
        recode(F.col(first), F.col(second), F.col("major"), F.col("minor")).alias("genotype"),
    )
