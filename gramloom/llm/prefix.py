"""Running sums over an order that spans many partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import written


def prefix_sums(df: DataFrame, by: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with, for each (name, column) of ``values``, the sum of the column over earlier rows of the group.

    Rows are range-sorted by (by, order), so a group of any size spans as many partitions as it needs. Each
    partition sums its own rows; what lies before is a sum of partition totals, of which
    there are no more than partitions and groups together. ``by`` and ``order`` must not be null.
    """
    rows = written(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *by, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values]
    )
    above = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.select("*", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_a_{n}") for n, c in values.items()])
        .join(before, [*by, "_part"])
        .select(*df.columns, *[(F.col(f"_a_{n}") + F.col(f"_b_{n}")).alias(n) for n in values])
    )
