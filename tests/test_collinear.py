"""Rank-deficient designs under both rules, and moments of values far from zero."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, packed
from gramloom.functions.tails import t_tail
from gramloom.operators import gram, ols
from gramloom.plans.association import packed_source, tall_source
from gramloom.plans.stepwise import run_stepwise


def centred(columns):
    d = np.array(columns, dtype=float)
    return d.mean(1), (d - d.mean(1, keepdims=True)) @ (d - d.mean(1, keepdims=True)).T


def by_pinv(xs, y):
    """Coefficients (intercept last), standard errors, residual squares: the textbook pseudo-inverse of X'X."""
    x = np.column_stack([*xs, np.ones(len(y))])
    inverse = np.linalg.pinv(x.T @ x, rcond=1e-10, hermitian=True)
    beta = inverse @ x.T @ y
    rss = ((y - x @ beta) ** 2).sum()
    return beta, np.sqrt(np.maximum(np.diag(inverse), 0) * rss / (len(y) - x.shape[1])), rss


def design(seed, n=60):
    """Codes 0, 1, 2 with copies, constants and a sum of two others."""
    r = np.random.default_rng(seed)
    a, b, c = r.integers(0, 3, (3, n)).astype(float)
    columns = {"a": a, "one": np.ones(n), "a2": a, "b": b, "three": np.full(n, 3.0), "ab": a + b, "c": c, "zero": np.zeros(n)}
    return columns, 1.5 + a - 0.7 * b + r.normal(size=n)


@pytest.mark.parametrize("names", ["a a2", "a one", "one three", "a b ab one", "zero a", "a a2 ab b c one three", "c"])
def test_fit_is_the_pseudo_inverse(names):
    columns, y = design(3)
    xs = [columns[k] for k in names.split()]
    mean, cross = centred([*xs, y])
    k = len(xs)
    fit = ols.fit_cross("y", names.split(), len(y), mean[:k], mean[k], cross[:k, :k], cross[:k, k], cross[k, k], "pinv")
    beta, se, rss = by_pinv(xs, y)
    assert fit.beta == pytest.approx(beta, abs=1e-9)
    assert fit.se == pytest.approx(np.where(se < 1e-9, ols.ZERO_ERROR, se), rel=1e-7)
    assert fit.rss == pytest.approx(rss)
    for j in range(k):
        without = by_pinv(xs[:j] + xs[j + 1 :], y)[2]
        assert fit.type3[j] == pytest.approx(without - rss, abs=1e-7)


def test_unknown_rule(cement_frame):
    with pytest.raises(ValueError, match="collinear"):
        tall_source(cement_frame, {"x1": F.col("x1")}, {"y": F.col("y")}, collinear="drop")


def stepwise_by_pinv(columns, y, threshold):
    """The loop, with a regression for every candidate."""
    added, skipped, trace, seen = [], [], [], set()
    while True:
        scored = []
        for name in columns:
            if name not in added and name not in skipped:
                beta, se, _ = by_pinv([columns[k] for k in [*added, name]], y)
                t = beta[len(added)] / (se[len(added)] if se[len(added)] > 1e-9 else ols.ZERO_ERROR)
                scored.append((float(f"{abs(t):.9e}"), name, len(y) - len(added) - 2))
        if not scored:
            return trace
        top = max(s[0] for s in scored)
        t, name, df = next(s for s in scored if s[0] >= top * (1 - 1e-8))
        if not float(t_tail(t, df)) < threshold:
            return [*trace, ("stop", name)]
        trace.append(("enter", name))
        added, skipped = [*added, name], []
        beta, se, _ = by_pinv([columns[k] for k in added], y)
        p = t_tail(beta[:-1] / np.where(se[:-1] > 1e-9, se[:-1], ols.ZERO_ERROR), len(y) - len(added) - 1)
        skipped = [k for k, q in zip(added, p, strict=True) if q >= threshold]
        trace += [("leave", k) for k in skipped]
        added = [k for k in added if k not in skipped]
        state = (frozenset(added), frozenset(skipped))
        if state in seen:
            return [*trace, ("cycle", name)]
        seen.add(state)


@pytest.mark.parametrize("seed", [3, 8])
def test_stepwise_by_pseudo_inverse(spark, seed):
    columns, y = design(seed)
    want = stepwise_by_pinv(columns, y, 0.05)
    assert ("enter", "one") in want[:1]  # the constant shares the intercept's direction
    names = list(columns)
    rows = [tuple(float(columns[k][i]) for k in names) + (float(y[i]),) for i in range(len(y))]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in [*names, "y"])).repartition(4)
    tall = run_stepwise(tall_source(df, {k: F.col(k) for k in names}, {"y": F.col("y")}, epistatic=False, collinear="pinv"))
    assert [(e, t) for _, _, e, t, *_ in tall.trace] == want
    source = packed_source(packed(spark, columns), packed(spark, {"y": y}), len(names), len(y), False, 3, 16, "pinv")
    try:
        tiled = run_stepwise(source)
    finally:
        source.close()
    assert [(e, t) for _, _, e, t, *_ in tiled.trace] == want
    a, b = tall.fits["y"], tiled.fits["y"]
    assert a.terms == b.terms and a.beta == pytest.approx(b.beta, abs=1e-8) and a.se == pytest.approx(b.se, rel=1e-6)


@pytest.mark.parametrize("limit", [gram.SQL_FORM_LIMIT, 0])
def test_moments_far_from_zero(spark, monkeypatch, limit):
    """Mean a hundred million times the spread: both forms keep seven digits of a one-pass result."""
    monkeypatch.setattr(gram, "SQL_FORM_LIMIT", limit)
    r = np.random.default_rng(5)
    near = r.integers(-40, 41, (3, 4000)).astype(float)
    far = near + np.array([[4e9], [-2e9], [0.0]])
    df = spark.createDataFrame([tuple(map(float, x)) for x in far.T], "u double, v double, w double").repartition(7)
    m = gram.gram_moments(df, {k: F.col(k) for k in "uvw"})
    mean, cross = centred(near)
    assert m.n == 4000 and m.mean == pytest.approx(mean + [4e9, -2e9, 0.0], rel=1e-15)
    assert m.cross == pytest.approx(cross, rel=1e-7, abs=1e-5 * 4000)
    assert np.diag(m.cross) == pytest.approx(np.diag(cross), rel=1e-7)


def test_moments_do_not_depend_on_the_parts(spark, monkeypatch):
    monkeypatch.setattr(gram, "SQL_FORM_LIMIT", 0)
    monkeypatch.setattr(gram, "BLOCK_VALUES", 1)
    r = np.random.default_rng(6)
    data = r.normal(1e6, 1.0, (900, 4))
    rows = [tuple(map(float, x)) for x in data]
    mean, cross = centred(data.T)
    for parts in (1, 3, 100):
        m = gram.gram_moments(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(parts), {k: F.col(k) for k in "abcd"})
        assert m.cross == pytest.approx(cross, rel=1e-9, abs=1e-7)


def test_data_are_read_once(spark):
    """A single aggregation in the plan's only job: no pass for an origin."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("moments", "")
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    gram.gram_moments(df, {"q": F.col("l_quantity"), "d": F.col("l_discount")})
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("moments")]
    spark.sparkContext.setJobGroup("", "")
    assert sum(tracker.getStageInfo(s) is not None and tracker.getStageInfo(s).numCompletedTasks > 0 for j in jobs for s in j.stageIds) <= 3


@pytest.mark.parametrize("shift", [0.0, 5e6, 1e9])
def test_a_shifted_predictor_still_enters(spark, shift):
    r = np.random.default_rng(7)
    x = r.integers(0, 64, 400).astype(float)
    y = 0.3 * x + r.normal(size=400) * 12
    df = spark.createDataFrame([(float(a + shift), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    result = run_stepwise(tall_source(df, {"x": F.col("x")}, {"y": F.col("y")}, epistatic=False))
    beta, se, _ = by_pinv([x], y)
    assert result.fits["y"].t[0] == pytest.approx(beta[0] / se[0], rel=1e-7)
