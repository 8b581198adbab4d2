"""Inputs that the file programs must refuse or treat as promised."""

import numpy as np
import pytest

from gramloom.operators.terms import pairwise_terms
from gramloom.plans.association import packed_source, tall_source
from gramloom.plans.programs import run_association
from gramloom.plans.stepwise import run_stepwise
from gramloom.sources import read_pedmap
from pyspark.sql import functions as F


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def table(samples, rows):
    return "HeaderLine\t" + "\t".join(samples) + "\n" + "".join(f"{k}\t" + "\t".join(map(str, v)) + "\n" for k, v in rows.items())


@pytest.fixture
def study():
    rng = np.random.default_rng(3)
    x = {f"v{i}": rng.integers(0, 3, 30).astype(float) for i in range(4)}
    y = 3 * x["v1"] + 0.2 * rng.normal(size=30)
    return [f"p{i}" for i in range(30)], x, y


def test_order_of_samples(spark, tmp_path, study):
    samples, x, y = study
    g = put(tmp_path, "g", table(samples, x))
    turned = put(tmp_path, "r", table(samples[::-1], {"y": y[::-1]}))
    with pytest.raises(ValueError, match="sample mismatch"):
        run_association(spark, str(tmp_path / "o1"), turned, epiq=g, missing="drop_samples", epistatic=False)
    fit = run_association(spark, str(tmp_path / "o2"), turned, epiq=g, align="reorder", epistatic=False).fits["y"]
    assert fit.terms[0] == "v1" and abs(fit.beta[0] - 3) < 0.2


def test_missing_phenotypes(spark, tmp_path, study):
    samples, x, y = study
    holed = dict(x, v0=[float("nan") if i == 4 else v for i, v in enumerate(x["v0"])])
    z = y.copy()
    z[7] = np.nan
    g, p = put(tmp_path, "g", table(samples, holed)), put(tmp_path, "p", table(samples, {"y": z}))
    with pytest.raises(Exception, match="missing values in"):
        run_association(spark, str(tmp_path / "o1"), p, epiq=g, epistatic=False)
    fit = run_association(spark, str(tmp_path / "o2"), p, epiq=g, missing="drop_samples", epistatic=False).fits["y"]
    keep = [i for i in range(30) if i not in (4, 7)]
    g2 = put(tmp_path, "g2", table([samples[i] for i in keep], {k: [v[i] for i in keep] for k, v in x.items()}))
    p2 = put(tmp_path, "p2", table([samples[i] for i in keep], {"y": y[keep]}))
    same = run_association(spark, str(tmp_path / "o3"), p2, epiq=g2, epistatic=False).fits["y"]
    assert fit.terms == same.terms and np.allclose(fit.beta, same.beta) and fit.n == 28
    assert run_association(spark, str(tmp_path / "o4"), p, epiq=g, missing="mean_impute", epistatic=False).fits["y"].terms[0] == "v1"


@pytest.mark.parametrize(
    "ped, markers",
    [("f a 0 0 1 1 A A C C\nf b 0 0 1 1 A C\n", 2), ("f a 0 0 1 1 A A C C\n", 1), ("f a 0 0 1 1 A A\n", 3)],
)
def test_uneven_ped(spark, tmp_path, ped, markers):
    mp = put(tmp_path, "m.map", "".join(f"1 m{i} 0 {i}\n" for i in range(markers)))
    with pytest.raises(Exception, match="alleles in the line"):
        read_pedmap(spark, mp, put(tmp_path, "m.ped", ped)).features.collect()


def test_positions_need_not_start_at_zero(spark):
    index = spark.createDataFrame([(f"v{i}", i) for i in range(1, 257)], "name string, pos int")
    assert pairwise_terms(index, 256).count() == 256 * 255 // 2


def test_a_far_mean_hides_no_predictor(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    rows = [(float(a + 20000), float(3 * a + 0.1 * e), 7.0) for a, e in zip(x, rng.normal(size=200))]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    result = run_stepwise(tall_source(df, {"x": F.col("x"), "c": F.col("c")}, {"y": F.col("y")}, epistatic=False))
    assert "x" in result.fits["y"].terms and "c" not in result.fits["y"].terms


def test_seeded_start_in_tiles(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (4, 60)).astype(float)
    y = 2 * x[0] + x[2] + 0.1 * rng.normal(size=60)
    features = spark.createDataFrame([(f"v{i}", i, r.tolist()) for i, r in enumerate(x)], "name string, pos int, values array<double>")
    responses = spark.createDataFrame([("y", 0, y.tolist())], "name string, pos int, values array<double>")
    source = packed_source(features, responses, 4, 60, False)
    fit = run_stepwise(source, added=[(0,)]).fits["y"]
    plain = run_stepwise(packed_source(features, responses, 4, 60, False)).fits["y"]
    assert {"v0", "v2"} <= set(fit.terms) == set(plain.terms)
    by = dict(zip(plain.terms, plain.beta))  # the intercept comes last
    assert np.allclose([by[t] for t in fit.terms], fit.beta[:-1])
