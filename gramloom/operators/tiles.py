"""A samples x variables matrix cut into tiles, the unit of work of every wide scan.

A tile holds ``block`` variables x ``chunk`` samples as one flat array<double>. Both
dimensions are cut, so a tile has a bounded size however many variables or samples there
are, and building tiles is one shuffle on (block, chunk) with groups of exactly one tile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BLOCK = 1024
MIN_BLOCK = 16
CHUNK = 4096
# With so many samples for each variable, a tile holds all variables: the partial sums of tasks are then small next to the matrix.
WHOLE_SAMPLES = 256
# Tiles of all variables are dealt over tasks in partitions of this size.
PART_BYTES = 128 * 1024 * 1024


@dataclass(frozen=True)
class Tiles:
    """``df`` has block int, chunk int, positions array<int>, values array<double>.

    ``values`` is variable-major unless ``sample_major``. ``positions`` are the variables'
    global positions; rows of one chunk stand in the same sample order in every tile.
    Tiles made from named features carry ``names`` as well. ``whole``: there is one block, and its rows hold
    the responses of their chunk too (y_positions, y_values; sample-major if ``y_sample_major``).
    """

    df: DataFrame
    n_features: int
    n_samples: int
    block: int
    chunk: int
    sample_major: bool = False
    whole: bool = False
    y_sample_major: bool = False

    @property
    def n_blocks(self) -> int:
        return max(1, math.ceil(self.n_features / self.block))

    @property
    def n_chunks(self) -> int:
        return max(1, math.ceil(self.n_samples / self.chunk))

    def persist(self) -> "Tiles":
        self.df.persist()
        return self

    def unpersist(self) -> None:
        self.df.unpersist()


def as_matrix(values, n_variables: int, sample_major: bool) -> np.ndarray:
    """Variables x samples view of a tile's flat values."""
    flat = np.asarray(values, dtype=float)
    if sample_major:
        return np.ascontiguousarray(flat.reshape(-1, n_variables).T)
    return flat.reshape(n_variables, -1)


def tile_shape(spark: SparkSession, n_features: int, n_samples: int) -> tuple[int, int]:
    """(block, chunk): large enough for matrix products, small enough to give every core a pair of blocks."""
    cores = spark.sparkContext.defaultParallelism
    chunk = min(CHUNK, max(1, n_samples))
    wanted = max(1, math.ceil((math.sqrt(1 + 16 * cores) - 1) / 2))
    block = math.ceil(n_features / wanted)
    return min(MAX_BLOCK, max(MIN_BLOCK, block)), chunk


def whole_shape(spark: SparkSession, n_features: int, n_samples: int, limit: int) -> tuple[int, int] | None:
    """(block, chunk) of tiles of all variables; None where there are more than ``limit`` or few samples for them."""
    if n_features > min(limit, MAX_BLOCK) or n_samples < WHOLE_SAMPLES * n_features:
        return None
    share = math.ceil(n_samples / (4 * spark.sparkContext.defaultParallelism))
    return max(1, n_features), min(CHUNK, max(MIN_BLOCK, share))


def with_responses(tiles: Tiles, responses: Tiles) -> Tiles:
    """Tiles of all variables, next to the responses of the same samples: all that a scan reads of a sample lies in one row."""
    cores = tiles.df.sparkSession.sparkContext.defaultParallelism
    size = tiles.n_features * tiles.n_samples * 8
    parts = min(
        tiles.n_chunks, max(2 * cores, math.ceil(size / PART_BYTES)), max(1, tiles.n_samples // (8 * max(1, tiles.n_features)))
    )
    y = responses.df.select("chunk", F.col("positions").alias("y_positions"), F.col("values").alias("y_values"))
    rows = tiles.df.repartition(parts, "chunk").hint("merge").join(y.repartition(parts, "chunk"), "chunk")
    return replace(tiles, df=rows, whole=True, y_sample_major=responses.sample_major)


def _shape(df, n_features, n_samples, block, chunk):
    auto_block, auto_chunk = tile_shape(df.sparkSession, n_features, n_samples)
    return block or auto_block, chunk or auto_chunk


def tile_features(
    features: DataFrame, n_features: int, n_samples: int, block: int | None = None, chunk: int | None = None
) -> Tiles:
    """Tiles from packed features (pos int, values array<double>); ``pos`` runs from 0 without gaps."""
    block, chunk = _shape(features, n_features, n_samples, block, chunk)
    n_chunks = max(1, math.ceil(n_samples / chunk))
    named = ["name"] if "name" in features.columns else []
    parts = features.select(
        (F.col("pos") / block).cast("int").alias("block"),
        F.col("pos").cast("int").alias("pos"),
        *named,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(n_chunks - 1)), lambda c: F.slice("values", c * chunk + 1, chunk)
            )
        ).alias("chunk", "part"),
    )
    df = (
        parts.groupBy("block", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *named, "part"))).alias("rows"))
        .select(
            "block",
            "chunk",
            F.col("rows.pos").alias("positions"),
            F.flatten("rows.part").alias("values"),
            *[F.col("rows.name").alias("names") for _ in named],
        )
    )
    return Tiles(df, n_features, n_samples, block, chunk)


def slice_arrays(df: DataFrame, idx: str | Column, array: str, width: int) -> DataFrame:
    """(_idx, block, part): one array per sample cut into slices of ``width`` variables."""
    last = F.greatest(F.ceil(F.size(array) / width).cast("int") - 1, F.lit(0))
    return df.select(
        (F.col(idx) if isinstance(idx, str) else idx).alias("_idx"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(F.col(array), b * width + 1, width))
        ).alias("block", "part"),
    )


def tile_slices(slices: DataFrame, block: int, chunk: int) -> DataFrame:
    """Sample-major tile rows from slices (_idx, block, part); a group is one tile."""
    return (
        slices.groupBy("block", F.floor(F.col("_idx") / chunk).cast("int").alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("_idx", "part"))).alias("rows"))
        .select(
            "block",
            "chunk",
            F.sequence(
                F.col("block") * block, F.col("block") * block + F.size(F.col("rows")[0]["part"]) - 1
            ).alias("positions"),
            F.when(
                F.forall("rows", lambda r: F.size(r["part"]) == F.size(F.col("rows")[0]["part"])), F.flatten("rows.part")
            ).otherwise(F.raise_error(F.lit("samples of one tile differ in their number of values"))).cast("array<double>").alias("values"),
        )
    )


def tile_samples(
    df: DataFrame, idx: str, array: str, n_features: int, n_samples: int,
    block: int | None = None, chunk: int | None = None,
) -> Tiles:
    """Tiles from one array of all variables per sample; ``idx`` runs from 0 without gaps."""
    block, chunk = _shape(df, n_features, n_samples, block, chunk)
    tiles = tile_slices(slice_arrays(df, idx, array, block), block, chunk)
    return Tiles(tiles, n_features, n_samples, block, chunk, sample_major=True)


def pack_tiles(tiles: DataFrame, sample_major: bool) -> DataFrame:
    """(pos, values): one packed row per variable. Missing values come out as null."""

    def turn(batches):
        for pdf in batches:
            for c, positions, values in zip(pdf["chunk"], pdf["positions"], pdf["values"]):
                m = as_matrix(values, len(positions), sample_major)
                yield pd.DataFrame({"pos": np.asarray(positions, dtype=np.int32), "chunk": int(c), "part": list(m)})

    parts = tiles.mapInPandas(turn, "pos int, chunk int, part array<double>")
    packed = parts.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("rows"))
    null = F.lit(None).cast("double")
    return packed.select("pos", F.transform(F.flatten("rows.part"), lambda v: F.nanvl(v, null)).alias("values"))


def to_sample_rows(tiles: Tiles) -> DataFrame:
    """(sample_idx, values): the tiles turned to one array of all variables per sample."""
    sample_major, chunk = tiles.sample_major, tiles.chunk

    def turn(batches):
        for pdf in batches:
            for block, c, positions, values in zip(pdf["block"], pdf["chunk"], pdf["positions"], pdf["values"]):
                m = as_matrix(values, len(positions), sample_major)
                n = m.shape[1]
                yield pd.DataFrame(
                    {
                        "sample_idx": np.arange(n, dtype=np.int64) + int(c) * chunk,
                        "block": np.full(n, block, dtype=np.int32),
                        "part": list(np.ascontiguousarray(m.T)),
                    }
                )

    return (
        tiles.df.mapInPandas(turn, "sample_idx long, block int, part array<double>")
        .groupBy("sample_idx")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))), lambda s: s["part"])).alias("values"))
    )
