"""The three programs, file to file: build stepwise models, fit LASSO models, convert formats."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators.matrix import require_equal_names, require_same_samples
from gramloom.operators.ols import Fit, anova_frame, stats_frame, terms_frame
from gramloom.operators.tiles import tile_features, to_sample_rows
from gramloom.plans.association import packed_source
from gramloom.plans.lasso import fit_lasso, kept_places, models_frame, refit, weights_frame
from gramloom.plans.stepwise import DEFAULT_THRESHOLD, StepwiseResult, run_stepwise
from gramloom.sources import Matrix, read_delimited, read_epiq, read_genotypes, read_pedmap
from gramloom.sources.lines import keep_small
from gramloom.sources.matrix_files import checked, drop_incomplete, handle_missing, reorder_samples
from gramloom.sources.sinks import (
    model_report, require_absent, write_epiq, write_lasso_json, write_report,
)

MANIFEST_SCHEMA = (
    "phenotype string, seconds double, genotype_files string, phenotype_file string, "
    "threshold double, epistatic boolean, lasso boolean"
)


def _load(spark, phenotypes, epiq, ped, map, missing, align):
    """Both matrices, of the same samples in the same order, without missing values.

    The sample lists are compared as the files have them, before any sample is dropped. The missing-value policy holds
    for phenotypes as for genotypes; ``drop_samples`` drops a sample that lacks a value in either file.
    """
    if align not in ("fail", "reorder"):
        raise ValueError("align must be fail or reorder")
    genotypes = checked(read_genotypes(spark, epiq, ped, map))
    responses = checked(read_epiq(spark, phenotypes))
    if align == "reorder":
        require_equal_names(genotypes.samples, responses.samples)
        responses = reorder_samples(responses, genotypes.samples)
    else:
        require_same_samples(genotypes.samples, responses.samples)
    if missing == "drop_samples":
        return tuple(drop_incomplete([genotypes, responses]))
    return handle_missing(genotypes, missing), handle_missing(responses, missing)


def _sample_table(genotypes: Matrix, responses: Matrix) -> tuple[DataFrame, list[str]]:
    """(sample_idx, x, y): all variables and all responses of a sample as two arrays."""
    n, m, p = genotypes.n_samples, genotypes.n_features, responses.n_features
    x = to_sample_rows(tile_features(genotypes.features, m, n))
    y = to_sample_rows(tile_features(responses.features, p, n, max(1, p)))
    names = [r["name"] for r in responses.features.select("pos", "name").orderBy("pos").collect()]
    table = x.withColumnRenamed("values", "x").join(y.withColumnRenamed("values", "y"), "sample_idx")
    return table, names


def _response_columns(names):
    return {name: F.get("y", F.lit(i)) for i, name in enumerate(names)}


def stepwise_from_matrices(
    genotypes: Matrix, responses: Matrix, threshold: float = DEFAULT_THRESHOLD, epistatic: bool = True,
    lasso: bool = False, solver: str = "exact",
) -> StepwiseResult:
    """One model per phenotype; ``lasso`` drops zero-weight variables before pairs are formed."""
    n = genotypes.n_samples
    if not lasso:
        source = packed_source(genotypes.features, responses.features, genotypes.n_features, n, epistatic)
        try:
            return run_stepwise(source, threshold)
        finally:
            source.close()
    spark = genotypes.features.sparkSession
    table, names = _sample_table(genotypes, responses)
    index = keep_small(genotypes.index)
    models = fit_lasso(table, "x", _response_columns(names), solver)
    union = sorted({i for m in models for i in m.kept()})
    if not union:
        return StepwiseResult({m.phenotype: None for m in models})
    # One scan serves all phenotypes: the variables that any of them keeps, and for each which are its own.
    dense = spark.createDataFrame([(p, i) for i, p in enumerate(union)], "pos int, dense int")
    features = genotypes.features.join(F.broadcast(dense), "pos").select("name", F.col("dense").alias("pos"), "values")
    source = packed_source(features, responses.features, len(union), n, epistatic)
    try:
        return run_stepwise(source, threshold, variables=kept_places(models, union))
    finally:
        source.close()


# The report's lines, here and below ("No variants ..."), are its format.
def _report_header(spark, seconds, files, phenotype_file, empty, message):
    rows = []
    for name, s in seconds.items():
        for i, (unit, v) in enumerate([("seconds", s), ("minutes", s / 60), ("hours", s / 3600)]):
            rows.append((name, i, f"Calculation time (in {unit}): {v:1.5f}"))
        rows.append((name, 3, f"Genotype File(s): {files}"))
        rows.append((name, 4, f"Phenotype File: {phenotype_file}"))
        if name in empty:
            rows.append((name, 5, message))
    return spark.createDataFrame(rows, "phenotype string, line_no int, line string")


def run_association(
    spark: SparkSession, out: str, phenotypes: str, epiq: str | None = None, ped: str | None = None,
    map: str | None = None, threshold: float = DEFAULT_THRESHOLD, epistatic: bool = True,
    lasso: bool = False, solver: str = "exact", missing: str = "fail", align: str = "fail",
) -> StepwiseResult:
    """Read, check the sample order, build one model per phenotype, write all results under ``out``.

    ``out`` gets: terms, stats, anova (parquet by phenotype), report (text), manifest (timings).
    """
    require_absent(spark, out)
    start = time.monotonic()
    genotypes, responses = _load(spark, phenotypes, epiq, ped, map, missing, align)
    result = stepwise_from_matrices(genotypes, responses, threshold, epistatic, lasso, solver)
    fits = result.models()
    for name, frame in (
        ("terms", terms_frame(spark, fits)), ("stats", stats_frame(spark, fits)), ("anova", anova_frame(spark, fits))
    ):
        frame.repartition("phenotype").write.partitionBy("phenotype").parquet(f"{out}/{name}")
    files = epiq or f"{ped}, {map}"
    seconds = {name: result.seconds.get(name, 0.0) for name in result.fits}
    empty = {name for name, f in result.fits.items() if f is None}
    header = _report_header(
        spark, seconds, files, phenotypes, empty,
        f"No variants could be added to the model at the threshold of {threshold}",
    )
    write_report(model_report(anova_frame(spark, fits), header), f"{out}/report")
    rows = [(name, s, files, phenotypes, threshold, epistatic, lasso) for name, s in seconds.items()]
    rows.append((None, time.monotonic() - start, files, phenotypes, threshold, epistatic, lasso))
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.json(f"{out}/manifest")
    return result


def run_lasso(
    spark: SparkSession, out: str, phenotypes: str, epiq: str | None = None, ped: str | None = None,
    map: str | None = None, solver: str = "exact", missing: str = "fail", align: str = "fail",
) -> list[Fit | None]:
    """Fit one LASSO model per phenotype, save the weights as JSON, then the ANOVA of an OLS refit."""
    require_absent(spark, out)
    genotypes, responses = _load(spark, phenotypes, epiq, ped, map, missing, align)
    table, names = _sample_table(genotypes, responses)
    table = table.persist()  # the fits and the refit read it
    try:
        columns, index = _response_columns(names), keep_small(genotypes.index)
        models = fit_lasso(table, "x", columns, solver)
        write_lasso_json(weights_frame(spark, models, index), models_frame(spark, models), f"{out}/models")
        union = sorted({i for m in models for i in m.kept()})
        found = index.where(F.col("pos").isin(union)).collect() if union else []
        fits = refit(table, "x", columns, models, {r["pos"]: r["name"] for r in found})
    finally:
        table.unpersist()
    done = [f for f in fits if f is not None]
    anova = anova_frame(spark, done)
    anova.repartition("phenotype").write.partitionBy("phenotype").parquet(f"{out}/anova")
    empty = [(m.phenotype, 0, "No variants were kept") for m, f in zip(models, fits) if f is None]
    notes = spark.createDataFrame(empty, "phenotype string, line_no int, line string")
    write_report(model_report(anova, notes), f"{out}/report")
    return fits


def run_convert(
    spark: SparkSession, inputs: list[str], out: str, input_type: str, delimiter: str | None = None,
    columns_are_variants: bool = False, columns_to_delete: tuple = (), single_file: bool = False,
) -> None:
    """Convert a delimited matrix (``custom``) or a .map/.ped pair (``pedmap``) to tab text."""
    if input_type == "custom" and len(inputs) == 1:
        matrix = read_delimited(spark, inputs[0], delimiter or "\t", columns_to_delete, columns_are_variants)
    elif input_type == "pedmap" and len(inputs) == 2:
        maps = [p for p in inputs if p.endswith(".map")]
        peds = [p for p in inputs if p.endswith(".ped")]
        if len(maps) != 1 or len(peds) != 1:
            raise ValueError("pedmap needs one .map and one .ped file")
        matrix = read_pedmap(spark, maps[0], peds[0], delimiter or " ")
    else:
        raise ValueError("give one input for custom, two for pedmap")
    write_epiq(matrix, out, single_file)
