"""PLINK text pairs: .map (one marker per line) and .ped (one sample per line).

Alleles of a sample travel in slices of ``BLOCK`` markers. Counting combines in the map
stage; recoding works on whole slices, so no shuffle of .ped data carries one row per genotype.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators.alleles import count_alleles, major_minor, recode
from gramloom.operators.tiles import CHUNK, pack_tiles, slice_arrays, tile_slices
from gramloom.sources.lines import keep_small, numbered, text_lines
from gramloom.sources.matrix_files import Matrix

BLOCK = 256


def read_map(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """(chrom, variant, cm, bp, pos)."""
    f = F.split("value", delimiter)
    return numbered(text_lines(spark, path), "pos")[0].select(
        f[0].alias("chrom"), f[1].alias("variant"), F.get(f, F.lit(2)).try_cast("double").alias("cm"),
        F.get(f, F.lit(3)).try_cast("bigint").alias("bp"), F.col("pos").cast("int").alias("pos"),
    )


def read_ped(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """(idx, fid, iid, pat, mat, sex, phen, alleles)."""
    f = F.split("value", delimiter)
    names = ["fid", "iid", "pat", "mat", "sex", "phen"]
    return numbered(text_lines(spark, path), "idx")[0].select(
        F.col("idx").cast("int").alias("idx"),
        *[f[i].alias(n) for i, n in enumerate(names)],
        F.slice(f, F.lit(7), F.greatest(F.size(f) - 6, F.lit(0))).alias("alleles"),
    )


def marker_table(ped: DataFrame, markers: DataFrame) -> DataFrame:
    """(pos, variant, major, minor), one row per line of the .map file.

    Marker i owns the allele fields 2i and 2i+1.
    """
    calls = ped.select(F.posexplode("alleles").alias("place", "allele")).select(
        (F.col("place") / 2).cast("int").alias("marker"), "allele"
    )
    alleles = major_minor(count_alleles(calls))
    return markers.select("pos", "variant").join(
        alleles.withColumnRenamed("marker", "pos"), "pos", "left"
    )


def encode_blocks(ped: DataFrame, table: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_idx, block, part): 0/1/2 per marker of a slice, null where unknown."""
    by_block = (
        table.groupBy((F.col("pos") / block).cast("int").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "major", "minor"))).alias("t"))
        .select("block", F.col("t.major").alias("majors"), F.col("t.minor").alias("minors"))
    )
    slices = slice_arrays(ped, "idx", "alleles", 2 * block)
    coded = F.transform(
        F.sequence(F.lit(0), (F.size("part") / 2).cast("int") - 1),
        lambda i: recode(F.get("part", 2 * i), F.get("part", 2 * i + 1), F.get("majors", i), F.get("minors", i)),
    )
    # The allele table is broadcast where its measured size allows.
    return slices.join(by_block, "block").select("_idx", "block", coded.alias("part"))


def read_pedmap(
    spark: SparkSession, map_path: str, ped_path: str, delimiter: str = " ", sample_sep: str = ""
) -> Matrix:
    """Genotype matrix of a .map/.ped pair.

    The sample name is family id + individual id. The default separator is empty, which can
    make two samples collide; that is an error here.
    """
    ped, markers = read_ped(spark, ped_path, delimiter), read_map(spark, map_path, delimiter)
    markers = keep_small(markers)
    count = markers.agg(F.count(F.lit(1)))
    n_markers = count.first()[0]
    # Every line must have two alleles for each marker of the .map file, or places would shift.
    whole = F.when(F.size("alleles") == 2 * n_markers, F.col("alleles")).otherwise(
        F.raise_error(F.concat(
            F.lit(f"expected {2 * n_markers} alleles in the line of "), F.col("iid"), F.lit(", found "), F.size("alleles").cast("string")
        ))
    )
    ped = ped.withColumn("alleles", whole)
    samples = keep_small(ped.select(F.concat_ws(sample_sep, "fid", "iid").alias("sample"), "idx"))
    twice = samples.groupBy("sample").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"sample name {twice[0]['sample']!r} occurs twice; set sample_sep")
    coded = encode_blocks(ped, marker_table(ped, markers))
    packed = pack_tiles(tile_slices(coded, BLOCK, CHUNK), sample_major=True)
    features = packed.join(markers.select("pos", F.col("variant").alias("name")), "pos")
    return Matrix(samples, features.select("name", "pos", "values"), count)
