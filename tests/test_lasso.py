import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramloom.plans import lasso


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, size=(80, 6)) / 2.0
    x[:, 3] = 1.0
    y = x[:, 0] - 0.5 * x[:, 2] + 0.1 * rng.normal(size=80)
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(80)]
    return x, y, spark.createDataFrame(rows, "idx int, x array<double>, y double").repartition(3).persist()


def objective_optimum(x, y, penalty, steps=20000):
    xc, yc = x - x.mean(0), y - y.mean()
    g, b = xc.T @ xc / len(y), xc.T @ yc / len(y)
    step = 1 / np.linalg.eigvalsh(g).max()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        m = w - step * (g @ w - b)
        w = np.sign(m) * np.maximum(abs(m) - step * penalty, 0)
    return w


def test_exact_reaches_the_optimum_and_leaves_constants_out(table):
    x, y, df = table
    model = lasso.fit_lasso(df, "x", {"y": F.col("y")}, "exact", 0.02)[0]
    assert model.weights == pytest.approx(objective_optimum(x, y, 0.02), abs=1e-5)
    assert model.weights[3] == 0.0
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ model.weights, abs=1e-6)


@pytest.mark.parametrize("most", [1024, 0])
def test_descent_equals_mllib(table, monkeypatch, most):
    """With the matrix of cross products, and with a pass over the rows for each step."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.regression import LabeledPoint, LassoWithSGD

    x, y, df = table
    monkeypatch.setattr(lasso, "SGD_GRAM_COLUMNS", most)
    ours = lasso.fit_lasso(df, "x", {"y": F.col("y")}, "sgd")[0]
    points = df.sparkSession.sparkContext.parallelize([LabeledPoint(b, Vectors.dense(a)) for a, b in zip(x, y, strict=True)])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        theirs = LassoWithSGD.train(points, iterations=lasso.SGD_ITERATIONS, regParam=0.01)
    assert ours.weights == pytest.approx(theirs.weights.toArray(), abs=1e-12)
    assert ours.intercept == theirs.intercept == 0.0


def wide_table(spark, n, m, seed, parts=3):
    """Codes 0, 1, 2 far from zero for some variables, with constants and copies; two responses."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, m)).astype(float)
    x[:, 7], x[:, 11], x[:, 20] = 4.0, x[:, 3], x[:, 20] + 1e6
    y = 2 * x[:, 3] - x[:, 5] + 0.5 * x[:, 20] + rng.normal(size=n)
    z = x[:, 30:36].sum(1) + rng.normal(size=n)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), float(z[i])) for i in range(n)]
    return x, y, z, spark.createDataFrame(rows, "idx int, x array<double>, y double, z double").repartition(parts)


def is_optimal(x, y, model, penalty):
    xc, yc = x - x.mean(0), y - y.mean()
    c = xc.T @ (yc - xc @ model.weights) / len(y)
    inside = model.kept()
    assert c[inside] == pytest.approx(penalty * np.sign(model.weights[inside]), abs=1e-8)
    outside = np.setdiff1d(np.arange(x.shape[1]), inside)
    assert np.abs(c[outside]).max() <= penalty * (1 + 1e-6)
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ model.weights, abs=1e-6)


def test_exact_at_six_thousand_variables(spark):
    """More variables than any matrix on the driver is made of; the optimum is proved, and most variables are screened out."""
    x, y, z, df = wide_table(spark, 150, 6000, 4)
    models = lasso.fit_lasso(df, "x", {"y": F.col("y"), "z": F.col("z")}, "exact", 0.3)
    is_optimal(x, y, models[0], 0.3)
    is_optimal(x, z, models[1], 0.3)
    assert models[0].width == 6000 and 0 < len(models[0].kept()) < 150
    assert models[0].rounds < 20 and models[0].excess <= 0.3 * 1e-6
    assert 7 not in models[0].active


@pytest.mark.parametrize(("join", "rows", "width"), [(1, 1 << 21, 4096), (64, 1, 7), (3, 50, 5)])
def test_shapes_do_not_matter(spark, monkeypatch, join, rows, width):
    x, y, z, df = wide_table(spark, 120, 40, 5, 5)
    monkeypatch.setattr(lasso, "JOIN", join)
    monkeypatch.setattr(lasso, "ROW_VALUES", rows)
    monkeypatch.setattr(lasso, "SLICE", width)
    models = lasso.fit_lasso(df, "x", {"y": F.col("y"), "z": F.col("z")}, "exact", 0.4)
    is_optimal(x, y, models[0], 0.4)
    is_optimal(x, z, models[1], 0.4)
    assert models[0].screened > 0  # the rows are written anew with what is left


def test_screening_is_safe(spark, monkeypatch):
    """No variable that screening takes out is in the optimum, at any penalty."""
    x, y, _, df = wide_table(spark, 100, 60, 6)
    monkeypatch.setattr(lasso, "NARROW", 1.0)
    monkeypatch.setattr(lasso, "JOIN", 1)
    top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / 100
    for share in (0.95, 0.5, 0.2):
        is_optimal(x, y, lasso.fit_lasso(df, "x", {"y": F.col("y")}, "exact", share * top)[0], share * top)


def test_awkward_rows(spark):
    schema = "x array<double>, y double"
    with pytest.raises(ValueError, match="no rows"):
        lasso.fit_lasso(spark.createDataFrame([], schema), "x", {"y": F.col("y")})
    uneven = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0], 2.0)], schema)
    with pytest.raises(ValueError, match="differ"):
        lasso.fit_lasso(uneven, "x", {"y": F.col("y")})
    missing = spark.createDataFrame([([1.0, None], 1.0), ([1.0, 2.0], 2.0)], schema)
    with pytest.raises(Exception, match="missing"):
        lasso.fit_lasso(missing, "x", {"y": F.col("y")})
    constant = spark.createDataFrame([([1.0, 2.0], 3.0)] * 4, schema)
    assert lasso.fit_lasso(constant, "x", {"y": F.col("y")})[0].kept() == []


def test_one_scan_for_all_screened_responses(spark, monkeypatch):
    """Each response takes terms of its own variables only, as in a run of its own, and an iteration is one scan."""
    from gramloom.plans import stepwise

    x, y, z, df = wide_table(spark, 150, 40, 9)
    names = [f"v{i}" for i in range(40)]
    columns = {"y": F.col("y"), "z": F.col("z")}
    models = lasso.fit_lasso(df, "x", columns, "exact", 0.1)
    assert models[0].kept() != models[1].kept()
    scans = []
    monkeypatch.setattr(stepwise, "scan", lambda layout, w, p, k, states, scan=stepwise.scan: scans.append(len(states)) or scan(layout, w, p, k, states))
    both = lasso.lasso_then_stepwise(df, "idx", "x", 150, columns, names, threshold=0.001, models=models)
    iterations = max(t[1] for t in both.trace)
    assert len(scans) == iterations and scans[0] == 2
    for m in models:
        alone = lasso.lasso_then_stepwise(df, "idx", "x", 150, {m.phenotype: columns[m.phenotype]}, names, threshold=0.001, models=[m])
        a, b = both.fits[m.phenotype], alone.fits[m.phenotype]
        assert a.terms == b.terms and a.t == pytest.approx(b.t)
        kept = {names[i] for i in m.kept()}
        assert {v for t in a.terms for v in (t if isinstance(t, tuple) else (t,))} <= kept


def test_all_zero_weights_give_no_model(table):
    _, _, df = table
    responses = {"y": F.col("y")}
    models = lasso.fit_lasso(df, "x", responses, "exact", 100.0)
    assert models[0].kept() == []
    assert lasso.refit(df, "x", responses, models, list("abcdef")) == [None]
    r = lasso.lasso_then_stepwise(df, "idx", "x", 80, responses, list("abcdef"), models=models)
    assert r.fits == {"y": None}


def test_screen_then_stepwise_equals_stepwise_on_the_kept(table):
    from test_stepwise import brute_force

    x, y, df = table
    names = list("abcdef")
    models = lasso.fit_lasso(df, "x", {"y": F.col("y")}, "exact", 0.02)
    kept = [names[i] for i in models[0].kept()]
    r = lasso.lasso_then_stepwise(df, "idx", "x", 80, {"y": F.col("y")}, names, threshold=0.01, models=models)
    want = brute_force({n: x[:, i] for i, n in enumerate(names)}, y, kept, 0.01)
    assert [t if isinstance(t, tuple) else (t,) for t in r.fits["y"].terms] == want
