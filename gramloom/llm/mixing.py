"""Mixing sources to target weights, to the word.

Method. Each document gets a hash-random key. Documents are range-sorted by source and key; prefix sums of
their sizes, distributed over the ranges, place each on its source's line of words; and the mix
takes that line up to the source's budget, from its start again for each further epoch. The document at the cut
gives the words up to it, so every source meets its budget exactly.

Targets share the total of all sizes by weight, none above ``MOST`` times its source's size; what is
above is shared among the others by weight. As the limit is linear in size, the sources that reach it are the first ones
in the order of size / weight, and the point where they end is found from prefix sums.

Edge cases: a null text has size 0 and is taken 0 words. A null source is the last source. Equal rows of ``mix``
are separate documents; in ``mixed`` rows with the same doc_id, source and text share one decision.
A source of size 0 has target 0. Columns of ``docs`` are kept; the added names replace them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import keeps_names, words, written
from gramloom.llm.prefix import prefix_sums

WEIGHTS = (5, 2, 1)
#: Epochs of one source at most.
MOST = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_none, _source, source_size, target of each source of ``sizes`` (_none, _source, size)."""
    by = sizes.groupBy("_none", "_source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(by.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1)), ["_all"], ["_none", "_source"], {"_rank": "_one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    whole = 1
    for w in weights:
        whole *= w
    big = "decimal(38,0)"
    # Sources in the order in which they reach the limit; equal ones in any order.
    line = (
        ranked.withColumn("_w", weight.cast("long"))
        .withColumn("_ratio", F.col("source_size").cast(big) * F.expr(f"{whole} div _w").cast(big))
        .withColumn("_limit", F.col("source_size") * MOST)
    )
    line = written(prefix_sums(line, ["_all"], ["_ratio", "_none", "_source"], {"_before": "_limit", "_weights": "_w"}))
    total, weight_sum = line.agg(F.sum("source_size"), F.sum("_w")).first()
    if total is None:
        return line.select("_none", "_source", "source_size", F.lit(0.0).alias("target"))
    fits = (F.lit(total).cast(big) - F.col("_before").cast(big)) * F.col("_w") <= F.col("_limit").cast(big) * (F.lit(weight_sum) - F.col("_weights"))
    first = line.where(fits).agg(F.min(F.struct("_ratio", "_none", "_source", "_before", "_weights"))).first()[0]
    rest, share = total - first["_before"], weight_sum - first["_weights"]
    after = F.struct("_ratio", "_none", "_source") >= F.struct(
        F.lit(first["_ratio"]).cast(line.schema["_ratio"].dataType), F.lit(first["_none"]), F.lit(first["_source"])
    )
    target = F.when(after, (F.lit(rest).cast(big) * F.col("_w")).cast("double") / F.lit(share)).otherwise(F.col("_limit").cast("double"))
    return line.select("_none", "_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, source, _th (hash of the text), size, source_size, target, taken for each row of ``docs``."""
    sizes = docs.select(
        "doc_id", "source", F.xxhash64("text").alias("_th"), F.col("source").isNull().cast("int").alias("_none"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.size(words(F.col("text"))).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")).alias("_key"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"),
    )
    placed = written(prefix_sums(sizes, ["_none", "_source"], ["_key", "_id", "size"], {"_before": "size"}))
    targets = source_targets(placed.select("_none", "_source", "size"), weights)
    out = placed.join(targets, ["_none", "_source"])
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0)
    rest = F.col("_budget") - F.col("_epochs") * F.col("source_size")
    return (
        out.withColumn("_budget", budget).withColumn("_epochs", epochs)
        .withColumn("taken", (F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(rest - F.col("_before"), F.col("size")))).cast("long"))
        .select("doc_id", "source", "_th", "size", "source_size", "target", "taken")
    )


@keeps_names
def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    Where a budget ends within a document, its last copy holds the words up to there, with single blanks between.
    """
    own = mix(docs, weights, seed).where("taken > 0").groupBy(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_th")
    ).agg(F.max("taken").alias("_taken"), F.max("size").alias("_size"))
    d = docs.withColumn("_th", F.xxhash64("text"))
    joined = d.join(
        own.withColumnRenamed("_th", "_oth"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_th") == F.col("_oth")),
    )
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    left = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")
    return copies.withColumn(
        "text", F.when(left >= F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), F.lit(1), left.cast("int")), " "))
    ).select(*docs.columns)


SQL = f"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), c AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} AS r FROM s GROUP BY source
), w AS (
  SELECT source, source_size, CASE {' '.join(f'WHEN r = {i} THEN {w}' for i, w in enumerate(WEIGHTS))} END AS w FROM c
), l AS (
  SELECT *, row_number() OVER (ORDER BY source_size * (10 // w), source IS NULL, source) AS n FROM w
), p AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum({MOST} * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM l
), f AS (
  SELECT n, total - before AS rest, ws FROM p WHERE (total - before) * w <= {MOST} * source_size * ws ORDER BY n LIMIT 1
), t AS (
  SELECT p.source, source_size, CASE WHEN p.n >= f.n THEN (f.rest * w)::DOUBLE / f.ws::DOUBLE
         ELSE ({MOST} * source_size)::DOUBLE END AS target FROM p, f
), d AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('{SEED}:' || s.doc_id), s.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
        + greatest(0, least(budget - (budget // source_size) * source_size - before, size)) ELSE 0 END)::BIGINT AS taken
FROM d
"""
