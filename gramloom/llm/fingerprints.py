"""Document fingerprints: threshold-scaled sketches of word shingles.

Method. A text's distinct shingles of five words are hashed to 64 bits, and every hash below a fixed
fraction of the hash space is retained. Sketches of parts merge into that of the whole by union, and
as the threshold is the same for all, the share of one sketch within another estimates the share of
one document within another, however unequal their lengths.

A text with fewer than ``LEAST`` hashes below the threshold keeps its ``LEAST`` smallest ones (all, if
it has no more), so that short texts have a fingerprint as well; the union of two such sketches,
cut the same way, still is the sketch of the union. Two sketches are compared below the lower of
the bounds up to which each is complete.

Edge cases: a null text counts as empty; the empty sketch is like another empty one (1) and unlike all
others (0). A text of one to four words is one shingle. Letters are lowered first. Equal texts have equal
sketches, each row its own; an empty table gives no row. Other columns are not read. Memory grows with the longest text (its words as one array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import words, written

K = 5
FRACTION = 1 / 8
LEAST = 16
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def threshold(fraction: float = FRACTION) -> int:
    return LOWEST + int(fraction * (1 << 64))


def with_sketch(df: DataFrame, text: str, name: str, fraction: float = FRACTION) -> DataFrame:
    """``df`` with the sketch of column ``text``: a sorted array of hashes."""
    w, h, s = f"_{name}_words", f"_{name}_hashes", f"_{name}_low"
    shingles = (
        F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(1), F.size(w) - (K - 1)), lambda i: F.xxhash64(F.slice(F.col(w), i, K))))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    low = F.array_distinct(F.filter(h, lambda x: x < threshold(fraction)))
    return (
        df.withColumn(w, words(F.lower(F.col(text))))
        .withColumn(h, shingles)
        .withColumn(s, low)
        .withColumn(
            name,
            F.when(F.size(s) >= LEAST, F.array_sort(s)).otherwise(F.slice(F.array_sort(F.array_distinct(h)), 1, LEAST)),
        )
        .drop(w, h, s)
    )


def _bound(sketch: Column, fraction: float) -> Column:
    """Hashes up to this are all in the sketch, if the text has them."""
    return (
        F.when(F.size(sketch) < LEAST, F.lit(HIGHEST))
        .otherwise(F.greatest(F.lit(threshold(fraction) - 1), F.element_at(sketch, -1)))
    )


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of the smaller text's shingles that the larger one has, 0 to 1.

    The bound of a longer sketch is the threshold itself; its hashes all lie below.
    """
    common = F.least(_bound(a, fraction), _bound(b, fraction))
    below = lambda s: F.filter(s, lambda x: x <= common)
    least = F.least(F.size(below(a)), F.size(below(b)))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when(least == 0, F.lit(0.0))
        .otherwise(F.size(F.array_intersect(below(a), below(b))) / least)
    )


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together."""
    union = F.array_union(a, b)
    low = F.filter(union, lambda x: x < threshold(fraction))
    return F.when(F.size(low) >= LEAST, F.array_sort(low)).otherwise(F.slice(F.array_sort(union), 1, LEAST))


def hexed(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ".")


def _successors(docs: DataFrame) -> DataFrame:
    """(_key, _th, _nkey, _nth): each document and the next by descending key; after the last the first.

    Only keys are sorted. Each range of keys finds the successors within, and the first of the next range.
    """
    places = docs.groupBy("_key", "_th").agg(F.max("n_chars").alias("_n"))
    ranges = written(places.repartitionByRange("_key", "_th").withColumn("_part", F.spark_partition_id()))
    heads = ranges.groupBy("_part").agg(F.max(F.struct("_key", "_th")).alias("_head"))
    down = Window.orderBy("_part")  # one row for each partition of keys
    heads = heads.select(
        "_part",
        F.coalesce(F.lag("_head").over(down), F.max("_head").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_head"),
    )
    within = Window.partitionBy("_part").orderBy(F.desc("_key"), F.desc("_th"))
    return (
        ranges.withColumn("_next", F.lead(F.struct("_key", "_th")).over(within)).join(heads, "_part")
        .withColumn("_next", F.coalesce("_next", "_head"))
        .select("_key", "_th", "_n", F.col("_next._key").alias("_nkey"), F.col("_next._th").alias("_nth"))
    )


def edited_pairs(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Each text's sketch, that of its edited form, and the next document's.

    Edited: the last third of the code points replaced by the first as many of the next document by
    descending doc_id. Rows with the same doc_id and text are one place of that order; rows with
    the same doc_id and other texts follow each other by hash; a null doc_id comes last.
    """
    base = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("_key"),
        F.xxhash64("text").alias("_th"),
    )
    following = _successors(base.select("_key", "_th", F.char_length("text").cast("long").alias("n_chars")))
    # Both joins read one shuffle of the texts (hence ``next_id``, which gives them the same columns), and
    # sketches are made after it. To each document's predecessor goes only as much text as that one replaces.
    heads = with_sketch(
        base.join(following.select(F.col("_nkey").alias("_key"), F.col("_nth").alias("_th"), F.col("_key").alias("_pkey"), F.col("_th").alias("_pth"), "_n"), ["_key", "_th"]),
        "text", "sketch", fraction,
    )
    heads = heads.groupBy(F.col("_pkey").alias("_key"), F.col("_pth").alias("_th")).agg(
        F.max(F.expr("substring(text, 1, int(_n div 3))")).alias("_tail"), F.max("sketch").alias("next_sketch"),
        F.max("doc_id").alias("next_id"),
    )
    out = with_sketch(base.join(heads, ["_key", "_th"]), "text", "sketch", fraction)
    out = out.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 3))"), F.col("_tail"))
    )
    return with_sketch(out, "edited", "edited_sketch", fraction).select(
        "doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch", "next_id"
    )
