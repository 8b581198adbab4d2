"""Reshaping and aligning samples x variables matrices.

Layouts (all doubles):

* ``calls``     long: sample_idx, name, value
* ``features``  packed: name, pos, values  (``values[i]`` belongs to sample i)
* ``samples``   sample, idx
* a wide table: one row per sample, one column per variable
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.operators.tiles import CHUNK, pack_tiles, slice_arrays, tile_slices


def delete_columns(df: DataFrame, indices: list[int]) -> DataFrame:
    """Drop columns by 0-based position."""
    gone = set(indices)
    out_of_range = [i for i in gone if not 0 <= i < len(df.columns)]
    if out_of_range:
        raise IndexError(f"no columns at {sorted(out_of_range)}")
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in gone])


def select_column(df: DataFrame, which: int | str) -> DataFrame:
    """One column, by 0-based position or by name."""
    name = df.columns[which] if isinstance(which, int) else which
    if name not in df.columns:
        raise KeyError(name)
    return df.select(F.col(f"`{name}`"))


def column_catalogue(df: DataFrame, key: str | None = None) -> DataFrame:
    """The variables of a wide table in long form: (name, pos, sample, value).

    The first column holds the sample key unless ``key`` says otherwise. One narrow pass.
    """
    key = key or df.columns[0]
    names = [c for c in df.columns if c != key]
    return df.select(
        F.col(f"`{key}`").alias("sample"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("name"), F.lit(i).alias("pos"), F.col(f"`{n}`").cast("double").alias("value")
                    )
                    for i, n in enumerate(names)
                ]
            )
        ),
    ).select("name", "pos", "sample", "value")


def calls_from_features(features: DataFrame) -> DataFrame:
    """Packed to long: (name, pos, sample_idx, value)."""
    return features.select("name", "pos", F.posexplode("values").alias("sample_idx", "value"))


def transpose_features(features: DataFrame) -> DataFrame:
    """Rows become columns: one packed row per sample, (sample_idx, values) in ``pos`` order."""
    return (
        calls_from_features(features)
        .groupBy("sample_idx")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("values")
        )
    )


def pack_arrays(df: DataFrame, idx: str, array: str, width: int = 256) -> DataFrame:
    """Packed features (pos, values) from one array of all variables per sample.

    Arrays travel as slices and tiles, so no shuffle carries one record per value.
    """
    return pack_tiles(tile_slices(slice_arrays(df, idx, array, width), width, CHUNK), sample_major=True)


def exclude_variables(features: DataFrame, remove: DataFrame) -> DataFrame:
    """Features whose name is not in ``remove(name)``."""
    return features.join(remove.select("name"), "name", "left_anti")


def keep_variables(features: DataFrame, keep: DataFrame) -> DataFrame:
    """Features whose name is in ``keep(name)``."""
    return features.join(keep.select("name"), "name", "left_semi")


def sample_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Samples (sample, idx) that are missing on one side or stand at another place."""
    a = left.select("sample", F.col("idx").alias("left_idx"))
    b = right.select("sample", F.col("idx").alias("right_idx"))
    return a.join(b, "sample", "full_outer").where(~F.col("left_idx").eqNullSafe(F.col("right_idx")))


def require_same_samples(left: DataFrame, right: DataFrame) -> None:
    """Fail unless both sample lists are equal, in order."""
    bad = sample_mismatch(left, right).limit(1).collect()
    if bad:
        raise ValueError(f"sample mismatch between genotype and phenotype, for example {bad[0].asDict()}")


def require_equal_names(left: DataFrame, right: DataFrame) -> None:
    """Fail unless both lists name the same samples, each once, in any order."""
    for side in (left, right):
        twice = side.groupBy("sample").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"sample {twice[0]['sample']!r} is listed twice")
    bad = sample_mismatch(left, right).where("left_idx IS NULL OR right_idx IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"sample mismatch between genotype and phenotype, for example {bad[0].asDict()}")


def align_samples(table: DataFrame, order: DataFrame, key: str = "sample") -> DataFrame:
    """Rows of ``table`` with the place ``idx`` that ``order(sample, idx)`` gives them.

    Both sides must name the same samples. A full outer join finds strangers and aligns in
    the same shuffle; the check runs as part of the job (a stranger raises).
    """
    joined = table.withColumn("_here", F.lit(True)).join(
        order.select(F.col("sample").alias(key), "idx"), key, "full_outer"
    )
    lost = F.col("idx").isNull() | F.col("_here").isNull()
    guard = F.when(
        lost, F.raise_error(F.concat(F.lit("samples do not match between the tables: "), F.col(key).cast("string")))
    ).otherwise(F.col("idx"))
    return joined.select(*[F.col(f"`{c}`") for c in table.columns], guard.cast("long").alias("idx"))


def join_tables(left: DataFrame, right: DataFrame, key: str = "sample") -> DataFrame:
    """Inner join of two wide tables on their sample column."""
    return left.join(right, key, "inner")


def _fingerprints(features: DataFrame) -> DataFrame:
    """128 hash bits and the length stand for a value vector, so that shuffles carry
    a few bytes per variable and not the vector."""
    return features.select(
        "name",
        "pos",
        F.xxhash64("values").alias("h1"),
        F.xxhash64(F.reverse("values"), F.lit(7)).alias("h2"),
        F.size("values").alias("n"),
    )


def duplicate_groups(features: DataFrame) -> DataFrame:
    """Groups of variables with equal value vectors: (kept, duplicate), one row per duplicate.

    A hot group (a third of all columns constant, say) is never collected: the keeper is a
    partial aggregate and the duplicates come from a join on the fingerprint.
    """
    prints = _fingerprints(features)
    keepers = prints.groupBy("h1", "h2", "n").agg(
        F.min(F.struct("pos", "name")).alias("first"), F.count(F.lit(1)).alias("size")
    ).where("size > 1")
    return (
        prints.join(keepers, ["h1", "h2", "n"])
        .where(F.col("pos") != F.col("first.pos"))
        .select(F.col("first.name").alias("kept"), F.col("name").alias("duplicate"))
    )


def dedup_features(features: DataFrame) -> DataFrame:
    """Keep the first of every group of variables with equal value vectors."""
    gone = duplicate_groups(features).select(F.col("duplicate").alias("name"))
    return exclude_variables(features, gone)


def feature_moments(calls: DataFrame, by: list[str], value: Column | None = None) -> DataFrame:
    """Count, sum, mean and sum of squares per variable."""
    v = value if value is not None else F.col("value")
    return calls.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.sum(v * v).alias("sum_squares")
    )
