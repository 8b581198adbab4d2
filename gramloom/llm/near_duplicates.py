"""One document of each group of near duplicates, with all its columns.

Method. The components of the n-gram Jaccard join (``jaccard``) are the groups. Where doc_id tells rows apart, the row with the smallest one of its
group stays. Otherwise each different doc_id and text gets a number of its own first.

Edge cases: rows of one doc_id with other texts, and rows without doc_id, are documents of their own; of a group those without doc_id come
last, those of one doc_id follow each other by a hash of the text. Of rows with equal doc_id and text the one with the smallest other columns stays. Null
and empty texts are in no group and stay. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import keeps_names, written
from gramloom.llm.jaccard import jaccard_components


@keeps_names
def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) that stay."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if not odd.isEmpty():
        return _drop_keyed(docs)
    classes = jaccard_components(docs)
    first = classes.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("_id"))
    return docs.join(first, F.col("doc_id") == F.col("_id"), "left_semi")


def _drop_keyed(docs: DataFrame) -> DataFrame:
    """The same for rows that doc_id does not tell apart, by a number for each doc_id and text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    hashes = {"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), F.reverse("text"))}
    keys = docs.select("doc_id", *others, *[h.alias(c) for c, h in hashes.items()]).groupBy("doc_id", "_h1", "_h2")
    keys = keys.agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_rest")).withColumnRenamed("doc_id", "_id")
    keys = written(keys.withColumn("_key", F.monotonically_increasing_id()))
    d, k = docs.select("doc_id", "text", *[h.alias(c) for c, h in hashes.items()]).alias("d"), keys.alias("k")
    same = F.col("d.doc_id").eqNullSafe(F.col("k._id")) & (F.col("d._h1") == F.col("k._h1")) & (F.col("d._h2") == F.col("k._h2"))
    keyed = written(d.join(k, same).select("_key", "doc_id", "text", "_rest").dropDuplicates(["_key"]))
    classes = jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_h1", "_h2", "_key")
    first = classes.join(keys, "_key").groupBy("component_id").agg(F.min(place).alias("p")).select(F.col("p._key").alias("_key"))
    kept = keyed.join(first, "_key", "left_semi")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.{c}").alias(c) for c in docs.columns])
