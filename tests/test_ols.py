import numpy as np
import pytest
from pyspark.sql import functions as F

from gramloom.functions import f_tail, t_pvalue, t_tail
from gramloom.functions.text import anova_lines, coefficient_lines
from gramloom.operators import ols
from gramloom.operators.gram import SQL_FORM_LIMIT, gram_moments

X1 = [27, 24, 9, 13, 10, 7, 1, 23, 14, 26, 3, 15, 24, 15, 13, 21, 17, 1, 18, 17, 22, 14, 7, 5, 12, 22, 26, 19, 13, 6]
X2 = [23, 4, 19, 19, 3, 17, 13, 23, 4, 14, 15, 15, 18, 23, 23, 18, 23, 5, 7, 12, 2, 30, 12, 12, 15, 18, 17, 22, 6, 13]
X3 = [3, 16, 19, 9, 20, 17, 20, 21, 14, 4, 5, 15, 8, 30, 12, 19, 23, 2, 1, 21, 2, 14, 22, 23, 25, 8, 7, 2, 6, 29]


@pytest.fixture(scope="module")
def thirty(spark):
    rows = [tuple(float(v) for v in r) for r in zip(X1, X2, X3, range(1, 31))]
    return spark.createDataFrame(rows, "X1 double, X2 double, X3 double, y double")


def fit(df, *names):
    m = gram_moments(df, {n: F.col(n) for n in (*names, "y")})
    return ols.fit_moments(m, "y", list(names))


def test_simple_regression_agrees_with_r(thirty):
    f = fit(thirty, "X1")
    s = ols.fit_statistics(f)
    # R's results, to be matched.
    assert f.beta == pytest.approx([-0.05273, 16.28041], abs=1e-5)
    assert f.se == pytest.approx([0.21663, 3.59851], abs=1e-5)
    assert f.t == pytest.approx([-0.243, 4.524], abs=1e-3)
    assert f.p == pytest.approx([0.809462, 0.000102], abs=1e-6)
    assert s["r2"] == pytest.approx(0.002112, abs=1e-6)
    assert s["adj_r2"] == pytest.approx(-0.03353, abs=1e-5)
    assert s["log_likelihood"] == pytest.approx(-107.2821, abs=1e-4)
    assert (s["aic"], s["bic"]) == (pytest.approx(220.5642, abs=1e-4), pytest.approx(224.7678, abs=1e-4))
    assert (s["rss"], s["sst"]) == (pytest.approx(2242.75, abs=1e-2), pytest.approx(2247.50, abs=1e-2))
    assert (s["f"], s["p"]) == (pytest.approx(0.05925, abs=1e-5), pytest.approx(0.8095, abs=1e-4))


def test_multiple_regression_agrees_with_r(thirty):
    f = fit(thirty, "X1", "X2", "X3")
    s = ols.fit_statistics(f)
    assert f.beta == pytest.approx([-0.062707, -0.001349, -0.027493, 16.830240], abs=1e-6)
    assert f.se == pytest.approx([0.246841, 0.252293, 0.217198, 5.898178], abs=1e-6)
    assert f.t == pytest.approx([-0.254, -0.005, -0.127, 2.853], abs=1e-3)
    assert f.p == pytest.approx([0.80146, 0.99577, 0.90025, 0.00837], abs=1e-5)
    assert (s["r2"], s["adj_r2"]) == (pytest.approx(0.00278, abs=1e-5), pytest.approx(-0.1123, abs=1e-4))
    assert s["log_likelihood"] == pytest.approx(-107.2721, abs=1e-4)
    assert (s["aic"], s["bic"]) == (pytest.approx(224.5441, abs=1e-4), pytest.approx(231.5501, abs=1e-4))
    assert (s["f"], s["p"]) == (pytest.approx(0.02416, abs=1e-5), pytest.approx(0.9948, abs=1e-4))


def test_anova_of_cement_model(spark, cement_frame):
    f = fit(cement_frame, "x2", "x1")
    rows = {r.source: r for r in ols.anova_frame(spark, [f]).collect()}
    assert rows["x2"].ss == pytest.approx(691.6805, abs=1e-4) and rows["x2"].f == pytest.approx(120.23625, abs=1e-5)
    assert rows["x1"].ss == pytest.approx(603.3621, abs=1e-4) and rows["x1"].p == pytest.approx(5.055e-05, rel=1e-3)
    assert rows["Error"].df == 6 and rows["Error"].f is None and rows["Error"].ms == pytest.approx(5.7527, abs=1e-4)
    assert rows["Total"].df == 8 and rows["Total"].ms == pytest.approx(1195.35) and rows["Total"].p == pytest.approx(3.009e-06, rel=1e-3)


def test_report_text(spark, cement_frame):
    f = fit(cement_frame, "x2", "x1")
    lines = [r.line for r in anova_lines(ols.anova_frame(spark, [f])).orderBy("line_no").collect()]
    assert lines == [
        "ANOVA table:",
        "-\tdf\tSS\tMS\tF",
        "x2\t1\t691.6805\t691.6805\t120.23625\t0.00003\t",
        "x1\t1\t603.3621\t603.3621\t104.88369\t0.00005\t",
        "Error\t6\t34.5161\t5.7527\t-\t-",
        "Total\t8\t2390.7000\t1195.3500\t204.79017\t0.00000\t",
    ]
    table = [r.line for r in coefficient_lines(ols.terms_frame(spark, [f])).orderBy("line_no").collect()]
    assert table[0] == "The Response variable: y"
    assert table[1].split() == ["Name", "Estimate", "Std.", "Error", "t", "value", "Pr(>|t|)"]
    assert table[2] == "x2             0.659138     0.060112    10.965   0.000034"
    assert len({len(x) for x in table[1:]}) == 1


def test_rank_deficient_design_uses_drop_one_sums():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 40))
    y = a + b + rng.normal(size=40)
    d = np.array([a, a, b, np.ones(40), y])
    c = (d - d.mean(1, keepdims=True)) @ (d - d.mean(1, keepdims=True)).T
    f = ols.fit_cross("y", ("a", "a2", "b", "one"), 40, d[:4].mean(1), y.mean(), c[:4, :4], c[:4, 4], c[4, 4])
    assert f.type3[[0, 1, 3]] == pytest.approx([0, 0, 0], abs=1e-8)
    assert f.beta[0] == pytest.approx(f.beta[1]) and f.beta[3] == pytest.approx(0)
    assert f.type3[2] > 1


def test_both_gram_forms_agree(spark):
    rng = np.random.default_rng(2)
    names = [f"v{i}" for i in range(SQL_FORM_LIMIT + 3)]
    data = rng.normal(5.0, 1.0, size=(200, len(names)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{n} double" for n in names)).repartition(7)
    wide = gram_moments(df, {n: F.col(n) for n in names})
    few = gram_moments(df, {n: F.col(n) for n in names[:4]}, [("v0", "v2")])
    assert wide.n == few.n == 200
    assert wide.cross[:4, :4] == pytest.approx(few.cross[:4, :4], rel=1e-10, abs=1e-9)
    want = np.cov(data.T, bias=True) * 200
    assert wide.cross == pytest.approx(want, rel=1e-9, abs=1e-8)
    product = data[:, 0] * data[:, 2]
    assert few.cross[4, 4] == pytest.approx(((product - product.mean()) ** 2).sum(), rel=1e-10)


def test_missing_value_policies(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (float("nan"), 1.0), (5.0, 4.0)], "x double, y double")
    cols = {"x": F.col("x"), "y": F.col("y")}
    with pytest.raises(ValueError, match="missing"):
        gram_moments(df, cols)
    assert gram_moments(df, cols, missing="drop_samples").n == 3
    m = gram_moments(df, cols, missing="mean_impute")
    assert m.n == 5 and m.mean == pytest.approx([2.75, 3.0])


def test_tails(spark):
    assert t_tail([0.0, 12.706204736, 2.570581836], [3, 1, 5]) == pytest.approx([1.0, 0.05, 0.05], rel=1e-8)
    assert t_tail(1.959963985, 1e9) == pytest.approx(0.05, rel=1e-6)
    assert 0 < t_tail(60.0, 200) < 1e-120
    assert f_tail([4.964602744, 3.708264820], [1, 3], [10, 10]) == pytest.approx([0.05, 0.05], rel=1e-8)
    assert np.isnan(t_tail(1.0, 0))
    row = spark.createDataFrame([(2.0, 10), (None, 10)], "t double, df int").select(t_pvalue(F.col("t"), F.col("df")).alias("p")).collect()
    assert row[0].p == pytest.approx(float(t_tail(2.0, 10))) and row[1].p is None
