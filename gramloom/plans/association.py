"""Build sources for the stepwise program from DataFrames."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators.gram import gram_moments
from gramloom.operators.tiles import MAX_BLOCK, MIN_BLOCK, Tiles, tile_features, tile_samples, tile_shape, whole_shape, with_responses
from gramloom.plans.stepwise import GramSource, TiledSource

# The running sums of one block pair stay below this size.
SUMS_BYTES = 384 * 1024 * 1024


def tall_source(
    df: DataFrame, predictors: dict[str, Column], responses: dict[str, Column],
    epistatic: bool = True, missing: str = "fail", collinear: str = "exclude",
) -> GramSource:
    """Many samples, few variables: one pass over ``df``, then no further job."""
    names = list(predictors)
    pairs = list(itertools.combinations(names, 2)) if epistatic else []
    moments = gram_moments(df, {**predictors, **responses}, pairs, missing)
    return GramSource(moments, names + pairs, list(responses), collinear)


def response_moments(responses: DataFrame) -> tuple[list, list, list]:
    """(names, means, centred square sums) of packed responses, in ``pos`` order.

    One row per response comes back. Arrays are folded where they lie.
    """
    zero = F.lit(0.0)
    mean = F.aggregate("values", zero, lambda acc, v: acc + v) / F.size("values")
    rows = (
        responses.select("pos", "name", "values", mean.alias("mean"))
        .select(
            "pos", "name", "mean",
            F.aggregate("values", zero, lambda acc, v: acc + (v - F.col("mean")) * (v - F.col("mean"))).alias("ss"),
        )
        .collect()
    )
    rows.sort(key=lambda r: r["pos"])
    return [r["name"] for r in rows], [r["mean"] for r in rows], [r["ss"] for r in rows]


def _block_limit(n_responses: int) -> int:
    return max(MIN_BLOCK, min(MAX_BLOCK, int(math.sqrt(SUMS_BYTES / 8 / (n_responses + 34)))))


def _tile_shape(spark: SparkSession, n_features: int, n_samples: int, n_responses: int, block: int | None, chunk: int | None):
    """(block, chunk, whether a tile holds all variables)."""
    limit = _block_limit(n_responses)
    whole = whole_shape(spark, n_features, n_samples, limit) if block is None else None
    auto_block, auto_chunk = whole or tile_shape(spark, n_features, n_samples)
    return block or min(auto_block, limit), chunk or auto_chunk, whole is not None


def _placed(tiles: Tiles, y: Tiles, whole: bool) -> tuple[Tiles, Tiles]:
    """Tiles of variables and responses, kept for the run; whole ones hold the responses in their rows."""
    return (with_responses(tiles, y).persist(), y) if whole else (tiles.persist(), y.persist())


def packed_source(
    features: DataFrame, responses: DataFrame, n_features: int, n_samples: int,
    epistatic: bool = True, block: int | None = None, chunk: int | None = None, collinear: str = "exclude",
) -> TiledSource:
    """Packed variables and packed responses (name, pos, values), samples in the same order.

    Call ``source.close()`` when done.
    """
    names, means, squares = response_moments(responses)
    block, chunk, whole = _tile_shape(features.sparkSession, n_features, n_samples, len(names), block, chunk)
    tiles, y = _placed(
        tile_features(features, n_features, n_samples, block, chunk),
        tile_features(responses, len(names), n_samples, max(1, len(names)), chunk), whole,
    )
    return TiledSource(tiles, y, None, names, means, squares, epistatic, collinear=collinear)


def sample_source(
    df: DataFrame, idx: str, array: str, n_features: int, n_samples: int, responses: dict[str, Column],
    index: DataFrame, epistatic: bool = True, block: int | None = None, chunk: int | None = None, collinear: str = "exclude",
) -> TiledSource:
    """One array of all variables per sample row, with responses in the same row."""
    names = list(responses)
    cols = [responses[r].cast("double") for r in names]
    moments = gram_moments(df, dict(zip(names, cols)))
    block, chunk, whole = _tile_shape(df.sparkSession, n_features, n_samples, len(names), block, chunk)
    responses_of = df.select(idx, F.array(*cols).alias("_y"))
    tiles, y = _placed(
        tile_samples(df, idx, array, n_features, n_samples, block, chunk),
        tile_samples(responses_of, idx, "_y", len(names), n_samples, len(names), chunk), whole,
    )
    squares = [moments.cross[i, i] for i in range(len(names))]
    return TiledSource(tiles, y, index, names, moments.mean, squares, epistatic, collinear=collinear)
