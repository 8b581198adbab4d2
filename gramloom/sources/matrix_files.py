"""Delimited matrix files as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.sources.lines import keep_small, numbered, text_lines

# Accepted texts of the top-left cell; the first is the one written.
HEADER_LABELS = ("HeaderLine", "Headerline", "Placeholder")
# Values of an array that move together when samples change places.
PLACES = 1 << 16


@dataclass(frozen=True)
class Matrix:
    """``samples`` (sample, idx) and packed ``features`` (name, pos, values); values follow idx.

    ``count`` is a one-row frame with the number of features where a cheaper way than
    counting ``features`` is known.
    """

    samples: DataFrame
    features: DataFrame
    count: DataFrame | None = None

    @cached_property
    def n_samples(self) -> int:
        return self.samples.count()

    @cached_property
    def n_features(self) -> int:
        return self.features.count() if self.count is None else int(self.count.first()[0] or 0)

    @property
    def index(self) -> DataFrame:
        return self.features.select("pos", "name")


def _doubles(fields: Column, is_data: Column) -> Column:
    """All fields but the first as doubles; a field that is no number fails the job.

    The condition stays inside the expression, because the optimizer may move a filter on
    the result below the one that drops the header.
    """
    return F.when(is_data, F.slice(fields, F.lit(2), F.size(fields) - 1).cast("array<double>"))


def read_epiq(spark: SparkSession, path: str) -> Matrix:
    """Tab text, one variable per line, samples in columns.

    The header line may stand anywhere; it is known by its first field.
    """
    lines = text_lines(spark, path)
    is_header = F.substring_index("value", "\t", 1).isin(*HEADER_LABELS)
    fields = F.split("value", "\t")
    data, count, headers = numbered(lines, "pos", is_header)
    samples = headers.select(F.posexplode(F.slice(fields, F.lit(2), F.size(fields) - 1)).alias("idx", "sample"))
    features = data.select(
        fields[0].alias("name"), F.col("pos").cast("int").alias("pos"), _doubles(fields, ~is_header).alias("values")
    )
    return Matrix(keep_small(samples.select("sample", "idx")), features, count)


def read_delimited(
    spark: SparkSession, path: str, delimiter: str = "\t",
    columns_to_delete: tuple = (), columns_are_variants: bool = False,
) -> Matrix:
    """Any delimited matrix whose first line is a header (of any label).

    ``delimiter`` is a regular expression. Columns are deleted by 0-based position before
    the matrix is turned. With ``columns_are_variants`` lines are samples.
    """
    gone = sorted(set(columns_to_delete))
    fields = F.split("value", delimiter)
    if gone:
        fields = F.transform(
            F.filter(
                F.transform(fields, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~s["i"].isin(gone)
            ),
            lambda s: s["x"],
        )
    lines, _, first = numbered(text_lines(spark, path), first=True)
    lines = lines.select("line_no", fields.alias("f"))
    header = first.select(fields.alias("f")).select(F.posexplode(F.slice("f", F.lit(2), F.size("f") - 1)).alias("place", "label"))
    data = lines.where("line_no > 0").select(
        F.col("f")[0].alias("key"), (F.col("line_no") - 1).cast("int").alias("row"),
        _doubles(F.col("f"), F.col("line_no") > 0).alias("values"),
    )
    if not columns_are_variants:
        return Matrix(
            header.select(F.col("label").alias("sample"), F.col("place").alias("idx")),
            data.select(F.col("key").alias("name"), F.col("row").alias("pos"), "values"),
        )
    turned = (
        data.select("row", F.posexplode("values").alias("pos", "v"))
        .groupBy("pos")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "v"))), lambda s: s["v"]).alias("values"))
    )
    names = header.select(F.col("label").alias("name"), F.col("place").alias("pos"))
    return Matrix(
        data.select(F.col("key").alias("sample"), F.col("row").alias("idx")),
        turned.join(names, "pos").select("name", "pos", "values"),
    )


def checked(matrix: Matrix) -> Matrix:
    """Make every feature carry one value per sample, or fail the job that reads it."""
    n = matrix.n_samples
    values = F.when(F.size("values") == n, F.col("values")).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {n} values in "), F.col("name")))
    )
    return Matrix(matrix.samples, matrix.features.select("name", "pos", values.alias("values")), matrix.count)


def _places(matrix: Matrix) -> DataFrame:
    """Places (idx) at which some feature has no value."""
    hole = lambda v, i: F.when(F.nanvl(v, F.lit(None).cast("double")).isNull(), i)
    return matrix.features.select(F.explode(F.array_compact(F.transform("values", hole)).cast("array<int>")).alias("idx")).distinct()


def drop_incomplete(matrices: list[Matrix]) -> list[Matrix]:
    """Matrices of the same samples in the same order, without samples that lack a value in any of them."""
    holes = _places(matrices[0])
    for m in matrices[1:]:
        holes = holes.unionByName(_places(m)).distinct()
    order = _numbered(matrices[0].samples.join(holes, "idx", "left_anti"))
    samples = keep_small(order.select("sample", F.col("new").alias("idx")))
    places = samples.select("sample", F.col("idx").alias("new")).join(matrices[0].samples, "sample").select("new", "idx")
    return [Matrix(samples, _taken(m.features, places), m.count) for m in matrices]


def _chunk(place: str) -> Column:
    return F.call_function("div", F.col(place).cast("long"), F.lit(PLACES).cast("long")).cast("int")


def _numbered(samples: DataFrame) -> DataFrame:
    """``samples`` (sample, idx) with ``new``: their number in the order of idx.

    Numbers within a stretch of places, and a running sum over the stretches' counts (one row for each stretch).
    """
    rows = samples.withColumn("_stretch", _chunk("idx"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_stretch").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_stretch").orderBy("idx")) - 1
    return rows.withColumn("_own", own).join(counts, "_stretch").select("sample", "idx", (F.col("_before") + F.col("_own")).cast("int").alias("new"))


def _taken(features: DataFrame, places: DataFrame) -> DataFrame:
    """Features with the value at place ``idx`` moved to place ``new``; ``places`` has a row for each value that stays.

    Arrays are cut into stretches of ``PLACES`` values. A stretch meets the list of its own moves (one for each stretch that values go to), and
    the pieces are put together by where they go, so no row holds the places of all samples.
    """
    moves = places.groupBy(_chunk("idx").alias("old"), _chunk("new").alias("to")).agg(
        F.collect_list(F.struct((F.col("new") % PLACES).alias("place"), (F.col("idx") % PLACES).alias("at"))).alias("moves")
    )
    last = F.greatest(F.ceil(F.size("values") / PLACES).cast("int") - 1, F.lit(0))
    parts = features.select("name", "pos", F.posexplode(
        F.transform(F.sequence(F.lit(0), last), lambda c: F.slice("values", c * PLACES + 1, PLACES))
    ).alias("old", "part"))
    # A stretch of which nothing stays keeps its feature, with nothing in it.
    moved = parts.join(moves, "old", "left").select(
        "name", "pos", "to", F.transform("moves", lambda m: F.struct(m["place"].alias("place"), F.get("part", m["at"]).alias("v"))).alias("x")
    )
    tiles = moved.groupBy("name", "pos", "to").agg(F.transform(F.sort_array(F.flatten(F.collect_list("x"))), lambda x: x["v"]).alias("part"))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("to", "part"))), lambda x: x["part"]))
    return tiles.groupBy("name", "pos").agg(whole.alias("values"))


def reorder_samples(matrix: Matrix, samples: DataFrame) -> Matrix:
    """``matrix`` with its values in the order of ``samples`` (sample, idx); both must name the same samples."""
    places = samples.select("sample", F.col("idx").alias("new")).join(matrix.samples, "sample").select("new", "idx")
    return Matrix(samples, _taken(matrix.features, places), matrix.count)


def handle_missing(matrix: Matrix, policy: str = "fail") -> Matrix:
    """Missing genotypes (null or NaN) under one of: fail, mean_impute, drop_samples."""
    f = matrix.features.select(
        "name", "pos", F.transform("values", lambda v: F.nanvl(v, F.lit(None).cast("double"))).alias("values")
    )
    if policy == "fail":
        whole = F.when(F.exists("values", lambda v: v.isNull()), F.raise_error(
            F.concat(F.lit("missing values in "), F.col("name"), F.lit("; choose a missing policy"))
        )).otherwise(F.col("values"))
        return Matrix(matrix.samples, f.select("name", "pos", whole.alias("values")), matrix.count)
    if policy == "mean_impute":
        known = f.withColumn("_k", F.filter("values", lambda v: v.isNotNull()))
        mean = F.aggregate("_k", F.lit(0.0), lambda acc, v: acc + v) / F.nullif(F.size("_k"), F.lit(0))
        filled = known.withColumn("_m", mean).select(
            "name", "pos", F.transform("values", lambda v: F.coalesce(v, F.col("_m"))).alias("values")
        )
        return Matrix(matrix.samples, filled, matrix.count)
    if policy == "drop_samples":
        return drop_incomplete([matrix])[0]
    raise ValueError("missing must be fail, mean_impute or drop_samples")
