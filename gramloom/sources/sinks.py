"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions.text import anova_lines
from gramloom.sources.matrix_files import HEADER_LABELS, Matrix


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def require_absent(spark: SparkSession, path: str) -> None:
    """Refuse to start a long run whose output folder is already there."""
    if path_exists(spark, path):
        raise FileExistsError(f"output directory {path!r} already exists")


def epiq_lines(matrix: Matrix) -> DataFrame:
    """(pos, value): the header line at -1, then one line per variable."""
    header = matrix.samples.agg(F.sort_array(F.collect_list(F.struct("idx", "sample"))).alias("s")).select(
        F.lit(-1).alias("pos"), F.concat_ws("\t", F.lit(HEADER_LABELS[0]), F.col("s.sample")).alias("value")
    )
    text = F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("NaN")))
    return header.unionByName(matrix.features.select("pos", F.concat_ws("\t", "name", text).alias("value")))


def write_epiq(matrix: Matrix, path: str, single_file: bool = False) -> None:
    """Tab text in ``pos`` order. ``single_file`` is for small exports."""
    lines = epiq_lines(matrix)
    ordered = lines.coalesce(1).sortWithinPartitions("pos") if single_file else lines.orderBy("pos")
    ordered.select("value").write.mode("errorifexists").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, sep="\t", header=True)


def model_report(anova: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """(phenotype, line_no, line); ``header`` has the same columns and stands above the table."""
    lines = anova_lines(anova)
    if header is None:
        return lines
    return header.unionByName(lines.withColumn("line_no", F.col("line_no") + 1000))


def write_report(lines: DataFrame, path: str) -> None:
    """One folder of text per phenotype; a report has as many lines as its model has terms."""
    (
        lines.repartition("phenotype")
        .sortWithinPartitions("phenotype", "line_no")
        .select("phenotype", "line")
        .write.mode("errorifexists").partitionBy("phenotype").text(path)
    )


def lasso_documents(weights: DataFrame, models: DataFrame) -> DataFrame:
    """(phenotype, weights, intercept); weights is a list of one-entry maps in variable order."""
    packed = weights.groupBy("phenotype").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "name", "weight"))),
            lambda s: F.create_map(s["name"], s["weight"]),
        ).alias("weights")
    )
    return packed.join(models, "phenotype").select("phenotype", "weights", "intercept")


def write_lasso_json(weights: DataFrame, models: DataFrame, path: str) -> None:
    """One JSON folder per phenotype; the phenotype is also a field of the document."""
    docs = lasso_documents(weights, models).withColumn("_folder", F.col("phenotype"))
    docs.repartition("_folder").write.mode("errorifexists").partitionBy("_folder").json(path)
