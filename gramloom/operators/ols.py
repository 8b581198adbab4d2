"""Ordinary least squares on moments: coefficients, fit statistics, Type-III ANOVA.

The inputs are k-sized (k = terms of one model); the N-sized work was done by the Gram
pass or by the tiled scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gramloom.functions.tails import f_tail, t_tail
from gramloom.operators.gram import Moments

# Stands in for a standard error of exactly zero, as the reference does.
ZERO_ERROR = 1e-6
# A column whose part outside the model is smaller than this share of its own
# square sum carries no information of its own.
COLLINEAR = 1e-8
RANK_CUTOFF = 1e-12
# Square sums about the mean that rounding leaves of a constant, as a share of n * mean**2: of centred moments, and of raw sums.
CENTRED_NOISE, RAW_NOISE = 1e-28, 1e-13
# exclude: a dependent candidate is no candidate. pinv: it shares its direction with what it depends on, as the pseudo-inverse
# of X'X has it (the solution of least norm).
COLLINEAR_RULES = ("exclude", "pinv")

TERM_SCHEMA = (
    "phenotype string, row int, term string, a string, b string, estimate double, "
    "std_error double, t double, p double"
)
STATS_SCHEMA = (
    "phenotype string, n long, k int, df_model int, df_error long, ss_model double, rss double, sst double, "
    "ms_model double, ms_error double, rse double, r2 double, adj_r2 double, f double, p double, "
    "log_likelihood double, aic double, bic double"
)
ANOVA_SCHEMA = "phenotype string, row int, source string, df long, ss double, ms double, f double, p double"


def term_label(term) -> str:
    """Display name: a variable, or both names of a pair joined by an underscore."""
    return f"{term[0]}_{term[1]}" if isinstance(term, tuple) else term


@dataclass(frozen=True)
class Fit:
    """One fitted model; arrays follow ``terms``, the intercept comes last."""

    response: str
    terms: tuple
    n: int
    beta: np.ndarray
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    rss: float
    ss_model: float
    type3: np.ndarray

    @property
    def k(self) -> int:
        return len(self.terms) + 1

    @property
    def df_error(self) -> int:
        return self.n - self.k


def _explained(corr, xy, keep) -> float:
    part = xy[keep]
    return float(part @ np.linalg.pinv(corr[np.ix_(keep, keep)], rcond=RANK_CUTOFF, hermitian=True) @ part)


@dataclass(frozen=True)
class NormalInverse:
    """The pseudo-inverse of X'X, X with a last column of ones, by its independent columns.

    ``whitening`` (rank x k): whitening' whitening inverts the centred products of the independent columns, zero elsewhere.
    ``projector``: onto the directions that X'X has. ``inverse``: the pseudo-inverse, (k + 1) x (k + 1).
    """

    independent: np.ndarray
    whitening: np.ndarray
    projector: np.ndarray
    inverse: np.ndarray


def normal_inverse(n: int, mean: np.ndarray, sxx: np.ndarray, noise: float = CENTRED_NOISE) -> NormalInverse:
    """Pivoted Cholesky factorisation of the centred products, scaled to unit diagonal.

    A column is independent while the part of it outside those before it, and outside the constant, is more than ``COLLINEAR`` of
    its square sum. Each other column gives one null vector of X'X; the pseudo-inverse is any inverse on the independent
    columns, projected off the null vectors on both sides.
    """
    k = len(mean)
    squares = np.diag(sxx).copy()
    varies = squares > noise * (squares + n * mean * mean)
    scale = np.where(varies, np.sqrt(np.maximum(squares, 0.0)), 1.0)
    corr = sxx / np.outer(scale, scale)
    left, rows, order = np.where(varies, 1.0, 0.0), np.zeros((0, k)), []
    while k and left.max() > COLLINEAR:
        j = int(np.argmax(left > left.max() - 1e-12))  # of equal ones the first
        row = (corr[j] - rows[:, j] @ rows) / math.sqrt(left[j])
        rows = np.vstack([rows, row])
        left = np.where(varies, left - row * row, 0.0)
        order.append(j)
        left[order] = 0.0
    order = np.array(order, dtype=int)
    whitening = np.zeros((len(order), k))
    if len(order):
        whitening[:, order] = np.linalg.solve(rows[:, order].T, np.diag(1.0 / scale[order]))
    inner = whitening.T @ whitening
    plain = np.zeros((k + 1, k + 1))
    plain[:k, :k] = inner
    plain[:k, k] = plain[k, :k] = -inner @ mean
    plain[k, k] = 1.0 / n + mean @ inner @ mean
    dependent = np.setdiff1d(np.arange(k), order)
    share = inner @ sxx[:, dependent]  # of the independent columns in each dependent one
    nulls = np.vstack([-share, mean @ share - mean[dependent]])
    nulls[dependent, np.arange(len(dependent))] += 1.0
    q, _ = np.linalg.qr(nulls) if len(dependent) else (np.zeros((k + 1, 0)), None)
    projector = np.eye(k + 1) - q @ q.T
    return NormalInverse(order, whitening, projector, projector @ plain @ projector)


def _fit_pinv(response, terms, n, mean_x, mean_y, sxx, sxy, syy, noise) -> Fit:
    k = len(terms)
    solved = normal_inverse(n, mean_x, sxx, noise)
    inner = solved.whitening.T @ solved.whitening
    slopes = inner @ sxy
    ss_model = float(slopes @ sxy)
    rss, df = max(float(syy) - ss_model, 0.0), n - k - 1
    beta = solved.projector @ np.concatenate([slopes, [mean_y - slopes @ mean_x]])
    se = np.sqrt(np.maximum(np.diag(solved.inverse), 0.0) * (rss / df if df > 0 else math.nan))
    se = np.where(se == 0.0, ZERO_ERROR, se)
    t = beta / se
    type3 = np.zeros(k)
    for j in range(k):
        keep = np.arange(k) != j
        w = normal_inverse(n, mean_x[keep], sxx[np.ix_(keep, keep)], noise).whitening @ sxy[keep]
        type3[j] = max(ss_model - float(w @ w), 0.0)
    return Fit(response, tuple(terms), int(n), beta, se, t, t_tail(t, df), rss, ss_model, type3)


def fit_cross(response, terms, n, mean_x, mean_y, sxx, sxy, syy, collinear: str = "exclude", noise: float = CENTRED_NOISE) -> Fit:
    """Fit from centred cross products. A rank-deficient design goes through the
    pseudo-inverse: of the scaled centred products, or (``collinear="pinv"``) of X'X itself, ones included."""
    if collinear not in COLLINEAR_RULES:
        raise ValueError(f"collinear must be one of {COLLINEAR_RULES}")
    if collinear == "pinv":
        return _fit_pinv(response, terms, n, mean_x, mean_y, sxx, sxy, syy, noise)
    k = len(terms)
    scale = np.sqrt(np.diag(sxx)) if k else np.zeros(0)
    scale = np.where(scale > 0, scale, 1.0)
    corr = sxx / np.outer(scale, scale)
    inv = np.linalg.pinv(corr, rcond=RANK_CUTOFF, hermitian=True) / np.outer(scale, scale) if k else corr
    deficient = k > 0 and np.linalg.matrix_rank(corr, tol=RANK_CUTOFF * k, hermitian=True) < k
    beta = inv @ sxy
    ss_model = float(beta @ sxy)
    rss = max(float(syy) - ss_model, 0.0)
    df = n - k - 1
    mse = rss / df if df > 0 else math.nan
    var = np.concatenate([np.diag(inv) * mse, [mse * (1.0 / n + mean_x @ inv @ mean_x)]])
    se = np.sqrt(np.maximum(var, 0.0))
    se = np.where(se == 0.0, ZERO_ERROR, se)
    full = np.concatenate([beta, [mean_y - beta @ mean_x]])
    t = full / se
    diag = np.diag(inv)
    if deficient:
        # the closed form needs full rank; drop each term in turn instead
        type3 = np.array([ss_model - _explained(corr, sxy / scale, np.arange(k) != j) for j in range(k)])
    else:
        type3 = beta**2 / diag if k else np.zeros(0)
    return Fit(response, tuple(terms), int(n), full, se, t, t_tail(t, df), rss, ss_model, type3)


def fit_moments(m: Moments, response, terms, collinear: str = "exclude") -> Fit:
    """Fit ``response`` on ``terms`` from a Gram pass that holds them all."""
    idx = [m.position(t) for t in terms]
    y = m.position(response)
    return fit_cross(
        response, terms, m.n, m.mean[idx], m.mean[y], m.cross[np.ix_(idx, idx)], m.cross[idx, y], m.cross[y, y], collinear
    )


def term_rows(fit: Fit, phenotype: str | None = None) -> list[tuple]:
    rows = []
    for i, term in enumerate([*fit.terms, "(Intercept)"]):
        a, b = term if isinstance(term, tuple) else (term, None)
        rows.append(
            (phenotype or fit.response, i, term_label(term), a, b, float(fit.beta[i]), float(fit.se[i]),
             float(fit.t[i]), float(fit.p[i]))
        )
    return rows


def fit_statistics(fit: Fit) -> dict:
    n, k = fit.n, fit.k
    sst = fit.rss + fit.ss_model
    df_error, df_model = n - k, k - 1
    nan = math.nan
    ms_model = fit.ss_model / df_model if df_model else nan
    ms_error = fit.rss / df_error if df_error > 0 else nan
    f = ms_model / ms_error if ms_error and not math.isnan(ms_error) else (math.inf if ms_error == 0 else nan)
    log_l = -n / 2.0 * (math.log(2 * math.pi) + 1 + math.log(fit.rss / n)) if fit.rss > 0 else math.inf
    return {
        "n": n,
        "k": k,
        "df_model": df_model,
        "df_error": df_error,
        "ss_model": fit.ss_model,
        "rss": fit.rss,
        "sst": sst,
        "ms_model": ms_model,
        "ms_error": ms_error,
        "rse": math.sqrt(ms_error) if ms_error >= 0 else nan,
        "r2": 1 - fit.rss / sst if sst > 0 else nan,
        "adj_r2": 1 - ms_error / (sst / (n - 1)) if sst > 0 else nan,
        "f": f,
        "p": float(f_tail(f, df_model, df_error)),
        "log_likelihood": log_l,
        "aic": -2 * log_l + 2 * (k + 1),
        "bic": -2 * log_l + math.log(n) * (k + 1),
    }


def anova_rows(fit: Fit, phenotype: str | None = None) -> list[tuple]:
    """Type-III rows: what the model loses when one term is left out, then Error and Total.

    The mean square of Total divides by the model's degrees of freedom (the reference's rule).
    """
    name = phenotype or fit.response
    if not fit.terms:
        return []
    stats = fit_statistics(fit)
    mse = stats["ms_error"]
    rows = []
    with np.errstate(divide="ignore", invalid="ignore"):
        f = fit.type3 / mse
    p = f_tail(f, 1, stats["df_error"])
    for i, term in enumerate(fit.terms):
        ss = float(fit.type3[i])
        rows.append((name, i, term_label(term), 1, ss, ss, float(f[i]), float(p[i])))
    k = len(fit.terms)
    rows.append((name, k, "Error", stats["df_error"], fit.rss, mse, None, None))
    rows.append((name, k + 1, "Total", fit.n - 1, stats["sst"], stats["sst"] / stats["df_model"], stats["f"], stats["p"]))
    return rows


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def terms_frame(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    return _frame(spark, [r for f in fits for r in term_rows(f)], TERM_SCHEMA)


def stats_frame(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in STATS_SCHEMA.split(",")][1:]
    return _frame(spark, [(f.response, *[fit_statistics(f)[c] for c in names]) for f in fits], STATS_SCHEMA)


def anova_frame(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    return _frame(spark, [r for f in fits for r in anova_rows(f)], ANOVA_SCHEMA)
