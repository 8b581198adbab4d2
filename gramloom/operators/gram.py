"""Centred cross products (the Gram matrix) of many columns in one pass over tall data.

Everything a linear model needs is in these sums, so a table of any length is read once
and every later fit is algebra on a small matrix. What is added up are centred moments: a part's row
count, means and cross products about its own means. Two parts merge by the difference of their means, so no
origin is needed first and a mean far from zero costs no digits. Two physical forms:

* few columns: built-in co-moment aggregates, all in generated JVM code;
* many columns: each task folds its rows into one numpy matrix, the tasks' matrices are merged row by
  row in two levels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQL_FORM_LIMIT = 5
# A wider partial matrix (512 KB) is not made for each input split, but for as many tasks as shuffles have.
SPLIT_COLUMNS = 256
# Numbers in a block of rows folded at once.
BLOCK_VALUES = 1 << 21
# The matrix lives on the driver: 4096 columns are 128 MB.
MAX_COLUMNS = 4096
MISSING_POLICIES = ("fail", "mean_impute", "drop_samples")


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred cross products of named columns."""

    names: tuple
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def position(self, name) -> int:
        return self.names.index(name)


def apply_missing_policy(df: DataFrame, columns: dict[str, Column], policy: str) -> tuple[DataFrame, bool]:
    """Project the columns as doubles under a missing-value policy (NaN counts as missing).

    Returns the frame and whether the caller still has to check for missing values.
    """
    if policy not in MISSING_POLICIES:
        raise ValueError(f"missing must be one of {MISSING_POLICIES}")
    clean = {name: F.nanvl(col.cast("double"), F.lit(None).cast("double")) for name, col in columns.items()}
    out = df.select(*[col.alias(name) for name, col in clean.items()])
    if policy == "drop_samples":
        return out.dropna(), False
    if policy == "mean_impute":
        means = out.agg(*[F.avg(_q(name)).alias(name) for name in columns]).first()
        return out.select(*[F.coalesce(_q(n), F.lit(means[n])).alias(n) for n in columns]), False
    return out, True


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def gram_frame(df: DataFrame, names) -> DataFrame:
    """One row: n, missing, means and upper-triangle co-moments (JVM form)."""
    t = len(names)
    columns = df.select(*[_q(n).alias(f"c{i}") for i, n in enumerate(names)])
    missing = F.lit(False)
    for i in range(t):
        missing = missing | F.col(f"c{i}").isNull()
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing")]
    aggs += [F.avg(f"c{i}").alias(f"m{i}") for i in range(t)]
    aggs += [F.covar_pop(f"c{i}", f"c{j}").alias(f"g{i}_{j}") for i in range(t) for j in range(i, t)]
    return columns.agg(*aggs)


def _merged(n1, mean1, cross1, n2, mean2, cross2):
    """Moments of two parts together."""
    n, gap = n1 + n2, mean2 - mean1
    return n, mean1 + gap * (n2 / n), cross1 + cross2 + np.outer(gap, gap) * (n1 * n2 / n)


def _partial_moments(batches, pairs):
    """Fold the rows of one task; emit the upper triangle, a row for each column."""
    left = np.array([a for a, _ in pairs], dtype=int)
    right = np.array([b for _, b in pairs], dtype=int)
    sums = None
    for batch in batches:
        total = batch.num_columns + len(pairs)
        step = max(BLOCK_VALUES // total, 256)
        for at in range(0, batch.num_rows, step):
            base = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(at, step).columns])
            block = np.hstack([base, base[:, left] * base[:, right]]) if pairs else base
            mean = block.mean(axis=0)
            block = block - mean
            rest = block.mean(axis=0)  # what rounding left of the mean
            part = len(block), mean + rest, block.T @ block - np.outer(rest, rest) * len(block)
            sums = part if sums is None else _merged(*sums, *part)
    if sums is not None:
        n, mean, cross = sums
        for i in range(len(mean)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([mean[i:]]), pa.array([cross[i, i:]])], ["i", "n", "m", "g"]
            )


PARTIAL_SCHEMA = "i int, n long, m array<double>, g array<double>"


def _merge_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """One column's row of several parts: column i comes first in each array."""
    n, m = pdf["n"].to_numpy(), np.stack(pdf["m"].to_list())
    total = n.sum()
    mean = m[0] + (n[:, None] * (m - m[0])).sum(axis=0) / total
    gap = m - mean
    cross = np.sum(np.stack(pdf["g"].to_list()), axis=0) + ((n * gap[:, 0])[:, None] * gap).sum(axis=0)
    return pd.DataFrame({"i": [pdf["i"].iloc[0]], "n": [total], "m": [mean], "g": [cross]})


def gram_moments(
    df: DataFrame,
    columns: dict[str, Column],
    pairs: list[tuple[str, str]] | None = None,
    missing: str = "fail",
    limit: int = MAX_COLUMNS,
) -> Moments:
    """Moments of ``columns`` and of the products of ``pairs``; pair names are tuples (a, b)."""
    pairs = list(pairs or [])
    base, check = apply_missing_policy(df, columns, missing)
    names = list(columns)
    keys = names + pairs
    if len(keys) > limit:
        raise ValueError(
            f"{len(keys)} terms do not fit the one-pass Gram form (limit {limit}); use the tiled scan"
        )
    if len(keys) <= SQL_FORM_LIMIT:
        wide = base.select(
            *[_q(n).alias(f"v{i}") for i, n in enumerate(names)],
            *[(_q(a) * _q(b)).alias(f"v{len(names) + i}") for i, (a, b) in enumerate(pairs)],
        )
        row = gram_frame(wide, [f"v{i}" for i in range(len(keys))]).first()
        if row["n"] == 0:
            raise ValueError("no rows")
        if check and row["missing"]:
            raise ValueError(f"{row['missing']} rows hold missing values; choose a missing policy")
        t = len(keys)
        cross = np.empty((t, t))
        for i in range(t):
            for j in range(i, t):
                cross[i, j] = cross[j, i] = row[f"g{i}_{j}"] * row["n"]
        return Moments(tuple(keys), int(row["n"]), np.array([row[f"m{i}"] for i in range(t)]), cross)

    at = {n: i for i, n in enumerate(names)}
    index_pairs = [(at[a], at[b]) for a, b in pairs]
    if len(keys) > SPLIT_COLUMNS:
        base = base.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = (
        base.mapInArrow(lambda it: _partial_moments(it, index_pairs), PARTIAL_SCHEMA)
        .withColumn("salt", F.spark_partition_id() % 64)
        .groupBy("i", "salt").applyInPandas(_merge_rows, PARTIAL_SCHEMA)
        .groupBy("i").applyInPandas(_merge_rows, PARTIAL_SCHEMA)
        .orderBy("i")
        .collect()
    )
    if not rows:
        raise ValueError("no rows")
    cross = np.zeros((len(rows), len(rows)))
    for i, r in enumerate(rows):
        cross[i, i:] = cross[i:, i] = r["g"]
    if check and not np.isfinite(cross).all():
        raise ValueError("rows hold missing values; choose a missing policy")
    return Moments(tuple(keys), int(rows[0]["n"]), np.array(rows[0]["m"]), cross)
