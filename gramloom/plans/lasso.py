"""LASSO fits per response at any width, and the programs built on them.

``exact`` minimises |y - X w - b|**2 / 2n + penalty * |w|_1 by active sets. Each round is one pass over the rows for all
responses: with the residuals of the models so far it gives every variable's correlation with them. A model is
optimal when no variable outside it has a correlation beyond the penalty; as long as some have, the strongest join its active
set, whose cross products are one more aggregation and whose problem is solved by coordinate descent on the driver. So the driver
holds what belongs to active variables only, and the last pass proves the optimum for all others.

The duality gap of a round bounds how far each correlation can still move, so variables that can't enter any model any more are
known for sure (gap-safe screening). Once few are left, the rows are written anew with only these.

``sgd`` repeats the rule of 100 gradient steps. A step needs X'X w and X'y only: one aggregation serves all steps of narrow
tables, wide ones take a pass over the rows for each step.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.operators.gram import gram_moments
from gramloom.operators.ols import Fit, fit_moments
from gramloom.plans.association import sample_source
from gramloom.plans.stepwise import DEFAULT_THRESHOLD, StepwiseResult, run_stepwise
from gramloom.sources.shared import written

DEFAULT_PENALTY = 0.01
SGD_ITERATIONS = 100
SGD_TOLERANCE = 1e-3
# Up to this many variables the gradient steps use one matrix of cross products (8 MB).
SGD_GRAM_COLUMNS = 1024
# A correlation beyond the penalty by this share is a violation.
OPTIMAL = 1e-7
# Variables that join an active set in a round: at least these, or as many as it has.
JOIN = 64
# Active variables of all responses together: their cross products (2 GB) are on the driver.
MOST_ACTIVE = 16384
# Variables of a row of partial sums, and values of the rows read at once.
SLICE, ROW_VALUES = 4096, 1 << 21
# The rows are written anew when screening leaves this share of the variables or less, of which there are at most so many.
NARROW, MOST_NARROW = 0.5, 200_000


@dataclass(frozen=True)
class LassoModel:
    """``active``: weight of each variable, by place, that has one other than zero; all others of ``width`` are zero.

    ``rounds``: passes over the rows; ``screened``: variables that were known not to enter before the last pass; ``excess``: the largest
    correlation of a variable outside the model, less the penalty (not above zero, up to OPTIMAL, at the optimum).
    """

    phenotype: str
    active: dict
    intercept: float
    width: int
    rounds: int = 0
    screened: int = 0
    excess: float = math.nan

    @property
    def weights(self) -> np.ndarray:
        out = np.zeros(self.width)
        out[list(self.active)] = list(self.active.values())
        return out

    def kept(self) -> list[int]:
        return sorted(self.active)


@dataclass
class _State:
    """A response's model while it is fitted."""

    name: str
    active: list = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    done: bool = False
    excess: float = math.nan


def fit_lasso(
    df: DataFrame, array: str, responses: dict[str, Column], solver: str = "exact",
    penalty: float = DEFAULT_PENALTY, tolerance: float = 1e-12,
) -> list[LassoModel]:
    """One LASSO model per response; ``array`` holds all variables of a sample.

    ``exact``: with intercept, to the optimum; a constant variable correlates with no residual and gets no weight.
    ``sgd``: no intercept, 100 full-batch gradient steps at most, as the reference runs it.
    The two keep different variables.
    """
    if solver not in ("exact", "sgd"):
        raise ValueError("solver must be exact or sgd")
    names = list(responses)
    table = df.select(
        F.col(array).cast("array<double>").alias("x"), *[responses[r].cast("double").alias(f"y{i}") for i, r in enumerate(names)]
    ).persist()
    try:
        sizes = table.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), *[F.avg(f"y{i}") for i in range(len(names))]).first()
        n, narrow, width, means = sizes[0], sizes[1], sizes[2], np.array(sizes[3:], dtype=float)
        if not n:
            raise ValueError("no rows")
        if narrow != width:
            raise ValueError("samples differ in their number of variables")
        return (_exact(table, names, n, width, means, penalty, tolerance) if solver == "exact" else _sgd(table, names, n, width, penalty))
    finally:
        table.unpersist()


# ---- a pass over the rows


def _correlations(table: DataFrame, n_responses: int, weights: list[tuple[list, np.ndarray, float]]) -> tuple[DataFrame, np.ndarray]:
    """X'r / n for the residuals r of each response, and the residuals' square sums.

    The frame has slice int, n long, c array<double> (responses one after the other), mean, m2 array<double> (of each variable; of the
    squares about the mean). ``weights``: (places, weights, intercept) of each response.
    """
    used = sorted({p for places, _, _ in weights for p in places})
    at = {p: i for i, p in enumerate(used)}
    coefficients = np.zeros((len(used), n_responses))
    for r, (places, w, _) in enumerate(weights):
        coefficients[[at[p] for p in places], r] = w
    intercepts = np.array([b for _, _, b in weights])

    def run(batches):
        sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays, y = batch.column(0), np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(n_responses)])
            x = arrays.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step = max(ROW_VALUES // x.shape[1], 16)
            for a in range(0, len(x), step):
                part, left = x[a : a + step], y[a : a + step] - intercepts
                if used:
                    left = left - part[:, used] @ coefficients
                mean = part.mean(axis=0)
                new = [len(part), left.T @ part, mean, ((part - mean) ** 2).sum(axis=0), (left**2).sum(axis=0)]
                if sums is None:
                    sums = new
                else:
                    n, gap = sums[0] + new[0], new[2] - sums[2]
                    sums[3] += new[3] + gap * gap * (sums[0] * new[0] / n)
                    sums[2] += gap * (new[0] / n)
                    sums[1] += new[1]
                    sums[4] += new[4]
                    sums[0] = n
        if sums is None:
            return
        if not np.isfinite(sums[1]).all():
            raise ValueError("rows hold missing values; choose a missing policy")
        n, c, mean, m2, rss = sums
        empty = np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n]), pa.array([rss]), pa.array([empty]), pa.array([empty])], names)
        for k in range(0, c.shape[1], SLICE):
            cut = slice(k, k + SLICE)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // SLICE], pa.int32()), pa.array([n]), pa.array([c[:, cut].ravel()]), pa.array([mean[cut]]), pa.array([m2[cut]])], names
            )

    names = ["slice", "n", "c", "mean", "m2"]
    schema = "slice int, n long, c array<double>, mean array<double>, m2 array<double>"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean = pdf["n"].to_numpy(), np.stack(pdf["mean"].to_list())
        total = n.sum()
        at = mean[0] + (n[:, None] * (mean - mean[0])).sum(axis=0) / total
        m2 = np.sum(np.stack(pdf["m2"].to_list()), axis=0) + (n[:, None] * (mean - at) ** 2).sum(axis=0)
        c = np.sum(np.stack(pdf["c"].to_list()), axis=0)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "n": [total], "c": [c], "mean": [at], "m2": [m2]})

    partial = table.mapInArrow(run, schema).withColumn("salt", F.spark_partition_id() % 64)
    sums = partial.groupBy("slice", "salt").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    # As many rows as the width has slices; read several times.
    sums = sums.persist()
    rss = np.array(sums.where("slice < 0").first()["c"])
    return sums, rss


def _by_variable(sums: DataFrame, n: int, n_responses: int) -> DataFrame:
    """pos, norm (of the centred variable) and c0, c1, ...: a row for each variable."""
    m = F.size("mean")
    columns = [F.transform(F.slice("c", m * r + 1, m), lambda v: v / n).alias(f"c{r}") for r in range(n_responses)]
    zipped = sums.where("slice >= 0").select("slice", F.posexplode(F.arrays_zip(F.transform("m2", F.sqrt).alias("norm"), *columns)).alias("i", "z"))
    return zipped.select((F.col("slice") * SLICE + F.col("i")).alias("pos"), "z.*")


# ---- exact


def _descend_on(gram: np.ndarray, target: np.ndarray, w: np.ndarray, penalty: float, tolerance: float) -> np.ndarray:
    """Coordinate descent on w'Gw / 2 - w't + penalty * |w|_1 for a small G."""
    w, diagonal = w.copy(), np.diag(gram)
    left = target - gram @ w
    scale = np.sqrt(max(diagonal.max(initial=0.0), 1e-300))
    live = np.flatnonzero(diagonal > 1e-14 * diagonal.max(initial=0.0))
    for sweep in range(100_000):
        moved = 0.0
        # All coordinates every tenth sweep, between them those that are in use.
        for j in live if sweep % 10 == 0 else live[w[live] != 0]:
            rho = left[j] + diagonal[j] * w[j]
            new = math.copysign(max(abs(rho) - penalty, 0.0), rho) / diagonal[j]
            if new != w[j]:
                left -= gram[j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * math.sqrt(diagonal[j]))
                w[j] = new
        if moved <= tolerance * max(scale * np.abs(w).max(initial=0.0), 1e-300) and sweep % 10 == 0:
            break
    return w


def _exact(table, names, n, width, means, penalty, tolerance):
    states = [_State(name, intercept=float(m)) for name, m in zip(names, means, strict=True)]
    squares, places, screened, rounds = None, None, 0, 0  # places: of the columns of a narrowed table
    narrowed = None
    while True:
        rounds += 1
        # A response that is done needs no residual any more, but its place in the pass stays.
        sums, rss = _correlations(narrowed or table, len(names), [(_local(s.active, places), s.weights, s.intercept) for s in states])
        if squares is None:
            squares = rss  # with no variable in: the square sums of the centred responses
        by_variable = _by_variable(sums, n, len(names))
        top = by_variable.agg(*[F.max(F.abs(f"c{r}")) for r in range(len(names))]).first()
        wanted = []
        for r, s in enumerate(states):
            if s.done:
                continue
            mine = _local(s.active, places)
            outside = by_variable.where(F.abs(f"c{r}") > penalty * (1 + OPTIMAL))
            if mine:
                outside = outside.where(~F.col("pos").isin(mine))
            # At most as many as the set has, the strongest first.
            found = outside.select("pos", F.abs(f"c{r}").alias("c")).orderBy(F.col("c").desc(), "pos").limit(max(JOIN, len(s.active))).collect()
            if found:
                wanted.append((r, [row["pos"] if places is None else places[row["pos"]] for row in found]))
            else:
                s.done = True
                beyond = by_variable.where(~F.col("pos").isin(mine)) if mine else by_variable
                s.excess = (beyond.agg(F.max(F.abs(f"c{r}"))).first()[0] or 0.0) - penalty
        if wanted:
            safe = _safe_test(states, n, rss, squares, top, penalty)
            left = by_variable.where(safe) if places is None else None
            kept = left.count() if left is not None else len(places)
            screened = width - kept
            if places is None and kept <= NARROW * width and kept <= MOST_NARROW:
                places = sorted(row["pos"] for row in left.select("pos").collect())
                places = sorted({*places, *(p for s in states for p in s.active), *(p for _, new in wanted for p in new)})
                narrowed = written(table.select(_chosen("x", places).alias("x"), *[f"y{i}" for i in range(len(names))]))
        sums.unpersist()
        if not wanted:
            break
        for r, new in wanted:
            states[r].active = [*states[r].active, *new]
            states[r].weights = np.append(states[r].weights, np.zeros(len(new)))
        _solve(narrowed or table, states, [r for r, _ in wanted], places, penalty, tolerance)
    return [
        LassoModel(s.name, {p: float(w) for p, w in zip(s.active, s.weights, strict=True) if w != 0.0}, s.intercept, width, rounds, screened, s.excess)
        for s in states
    ]


def _local(active: list, places: list | None) -> list:
    """Places of active variables among the columns of a narrowed table."""
    if places is None:
        return list(active)
    return np.searchsorted(places, active).tolist()


def _chosen(array: str, places: list) -> Column:
    return F.transform(F.array(*[F.lit(int(p)) for p in places]), lambda i: F.get(array, i))


def _safe_test(states, n, rss, squares, top, penalty) -> Column:
    """True for variables that may still be in some response's optimum (or are in its model).

    The residuals, scaled until no correlation is beyond the penalty, are a point of the dual problem; the duality gap bounds how far the dual optimum is
    from it, and so every correlation there.
    """
    may = F.lit(False)
    for r, s in enumerate(states):
        if s.done:
            continue
        scale = min(1.0, penalty / top[r]) if top[r] else 1.0
        primal = rss[r] / (2 * n) + penalty * np.abs(s.weights).sum()
        # |y|^2 - |y - scale * residual|^2, with y'residual from the square sums.
        fitted = _fitted_square(s, rss[r], squares[r], n, penalty)
        dual = (2 * scale * fitted - scale * scale * rss[r]) / (2 * n)
        radius = math.sqrt(2 * max(primal - dual, 1e-12 * primal) / n) / penalty
        may = may | (F.abs(f"c{r}") * (scale / penalty) + F.col("norm") * radius >= 1.0 - 1e-9)
    return may


def _fitted_square(s: _State, rss: float, square: float, n: int, penalty: float) -> float:
    """y'r of the centred response and the residual: r'r plus the fit's w'X'r, which the optimality on the active set makes n * penalty * |w|_1."""
    return rss + n * penalty * float(np.abs(s.weights).sum())


def _solve(table, states, todo, places, penalty, tolerance) -> None:
    """Solves each response's problem on its active set, from one aggregation over the union of these."""
    union = sorted({p for r in todo for p in states[r].active})
    if len(union) + len(todo) > MOST_ACTIVE:
        raise ValueError(f"{len(union)} variables are active; a larger penalty keeps fewer")
    local = _local(union, places)
    columns = {f"x{p}": F.get("x", F.lit(i)) for p, i in zip(union, local, strict=True)}
    moments = gram_moments(table, {**columns, **{f"y{r}": F.col(f"y{r}") for r in todo}}, limit=MOST_ACTIVE)
    at = {p: i for i, p in enumerate(union)}
    for k, r in enumerate(todo):
        s, y = states[r], len(union) + k
        own = [at[p] for p in s.active]
        gram = moments.cross[np.ix_(own, own)] / moments.n
        s.weights = _descend_on(gram, moments.cross[own, y] / moments.n, s.weights, penalty, tolerance)
        s.intercept = float(moments.mean[y] - moments.mean[own] @ s.weights)


# ---- sgd


def _sgd(table, names, n, width, penalty):
    """Full-batch gradient steps, without intercept."""
    out = []
    if width + len(names) <= SGD_GRAM_COLUMNS:
        x = {f"x{i}": F.get("x", F.lit(i)) for i in range(width)}
        m = gram_moments(table, {**x, **{f"y{i}": F.col(f"y{i}") for i in range(len(names))}})
        raw = m.cross / m.n + np.outer(m.mean, m.mean)
        for i, name in enumerate(names):
            gram, target = raw[:width, :width], raw[:width, width + i]
            out.append((name, _descend(lambda w, g=gram, t=target: g @ w - t, width, penalty)))
    else:
        for i, name in enumerate(names):
            out.append((name, _descend(_gradient(table.select("x", F.col(f"y{i}").alias("y0")), n, width), width, penalty)))
    return [LassoModel(name, {int(p): float(w[p]) for p in np.flatnonzero(w)}, 0.0, width) for name, w in out]


def _gradient(table: DataFrame, n: int, width: int) -> Callable[[np.ndarray], np.ndarray]:
    """The gradient at w by a pass over the rows; w and the gradient have a number for each variable."""

    def at(w: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(w)
        sums, _ = _correlations(table, 1, [(places.tolist(), w[places], 0.0)])
        out = np.zeros(width)
        for row in sums.where("slice >= 0").toLocalIterator():
            out[row["slice"] * SLICE : row["slice"] * SLICE + len(row["c"])] = row["c"]
        sums.unpersist()
        return -out / n

    return at


def _descend(gradient, width, penalty):
    """Step size 1/sqrt(step), then soft threshold; ends when a step moves the weights by
    less than SGD_TOLERANCE of their norm."""
    w = np.zeros(width)
    for step in range(1, SGD_ITERATIONS + 1):
        size = 1.0 / np.sqrt(step)
        moved = w - size * gradient(w)
        new = np.sign(moved) * np.maximum(np.abs(moved) - size * penalty, 0.0)
        small = step > 1 and np.linalg.norm(new - w) < SGD_TOLERANCE * max(np.linalg.norm(new), 1.0)
        w = new
        if small:
            break
    return w


# ---- results


def weights_frame(spark: SparkSession, models: list[LassoModel], index: DataFrame) -> DataFrame:
    """(phenotype, pos, name, weight); ``index`` has (pos, name). Only weights other than zero come from the driver."""
    rows = [(m.phenotype, p, w) for m in models for p, w in m.active.items()]
    known = spark.createDataFrame(rows, "phenotype string, pos int, weight double")
    every = index.select("pos", "name", F.explode(F.array(*[F.lit(m.phenotype) for m in models])).alias("phenotype"))
    return every.join(known, ["phenotype", "pos"], "left").select("phenotype", "pos", "name", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def models_frame(spark: SparkSession, models: list[LassoModel]) -> DataFrame:
    return spark.createDataFrame([(m.phenotype, m.intercept) for m in models], "phenotype string, intercept double")


def lasso_keep(weights: DataFrame) -> DataFrame:
    return weights.where("weight != 0")


def lasso_remove(weights: DataFrame) -> DataFrame:
    return weights.where("weight = 0")


def refit(df: DataFrame, array: str, responses: dict[str, Column], models: list[LassoModel], names: list[str]) -> list[Fit | None]:
    """OLS of each response on its kept variables; None where nothing was kept.

    One Gram pass over the union of all kept variables serves every response.
    """
    union = sorted({i for m in models for i in m.kept()})
    if not union:
        return [None] * len(models)
    columns = {f"x{i}": F.get(array, F.lit(i)).cast("double") for i in union}
    moments = gram_moments(df, {**columns, **{f"y{i}": responses[m.phenotype] for i, m in enumerate(models)}})
    fits = []
    for i, m in enumerate(models):
        if not m.kept():
            fits.append(None)
            continue
        f = fit_moments(moments, f"y{i}", [f"x{j}" for j in m.kept()])
        fits.append(
            Fit(m.phenotype, tuple(names[j] for j in m.kept()), f.n, f.beta, f.se, f.t, f.p, f.rss, f.ss_model, f.type3)
        )
    return fits


def lasso_then_stepwise(
    df: DataFrame, idx: str, array: str, n_samples: int, responses: dict[str, Column], names: list[str],
    solver: str = "exact", penalty: float = DEFAULT_PENALTY, threshold: float = DEFAULT_THRESHOLD,
    epistatic: bool = True, models: list[LassoModel] | None = None,
) -> StepwiseResult:
    """Drop zero-weight variables per response before pairs are formed, then build the model."""
    spark = df.sparkSession
    models = models or fit_lasso(df, array, responses, solver, penalty)
    union = sorted({i for m in models for i in m.kept()})
    if not union:
        return StepwiseResult({m.phenotype: None for m in models})
    # One table of what any response keeps; each response may take its own variables only.
    narrowed = df.select(
        F.col(idx).alias("_idx"), _chosen(array, union).alias("_x"),
        *[responses[m.phenotype].cast("double").alias(f"_y{i}") for i, m in enumerate(models)],
    )
    index = spark.createDataFrame([(k, names[i]) for k, i in enumerate(union)], "pos int, name string")
    columns = {m.phenotype: F.col(f"_y{i}") for i, m in enumerate(models)}
    source = sample_source(narrowed, "_idx", "_x", len(union), n_samples, columns, index, epistatic)
    try:
        return run_stepwise(source, threshold, variables=kept_places(models, union))
    finally:
        source.close()


def kept_places(models: list[LassoModel], union: list[int]) -> dict[str, list[int]]:
    """Where each response's variables stand among those that any response keeps."""
    at = {p: k for k, p in enumerate(union)}
    return {m.phenotype: [at[p] for p in m.kept()] for m in models}
