"""Forward/backward stepwise model building on p-values.

One loop serves two physical forms. A *source* answers the only large question, "which
candidate fits best next to each current model?", with one Spark job for all responses
(tiled form) or from a Gram matrix made by one job in all (tall form). The rest is k-sized.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions.numeric import rank_key
from gramloom.functions.tails import t_tail
from gramloom.operators.gram import Moments
from gramloom.operators.ols import CENTRED_NOISE, COLLINEAR_RULES, RAW_NOISE, Fit, fit_cross, normal_inverse, term_label
from gramloom.operators.scan import KEEP_LAYOUT_BYTES, Layout, ModelState, best_candidate, centred_t, scan, side_columns
from gramloom.operators.tiles import Tiles

DEFAULT_THRESHOLD = 0.05
TRACE_SCHEMA = "phenotype string, iteration int, event string, term string, a string, b string, t double, p double"


class CrossProducts:
    """Means and centred cross products of the responses and of every term met so far."""

    def __init__(self, n: int, response_means, response_squares, collinear: str = "exclude", noise: float = CENTRED_NOISE):
        if collinear not in COLLINEAR_RULES:
            raise ValueError(f"collinear must be one of {COLLINEAR_RULES}")
        self.n, self.collinear, self.noise = n, collinear, noise
        self.y_mean = list(response_means)
        self.y_square = list(response_squares)
        self.mean: dict = {}
        self.product: dict = {}

    def learn(self, term, mean: float, square: float, with_responses: dict, with_terms: dict) -> None:
        self.mean[term] = mean
        self.product[term, term] = square
        for r, v in with_responses.items():
            self.product[term, ("response", r)] = v
        for other, v in with_terms.items():
            self.product[term, other] = self.product[other, term] = v

    def blocks(self, response: int, terms):
        sxx = np.array([[self.product[a, b] for b in terms] for a in terms]).reshape(len(terms), len(terms))
        sxy = np.array([self.product[a, ("response", response)] for a in terms])
        mean = np.array([self.mean[a] for a in terms])
        return mean, sxx, sxy

    def fit(self, response: int, name: str, terms) -> Fit:
        mean, sxx, sxy = self.blocks(response, terms)
        return fit_cross(name, terms, self.n, mean, self.y_mean[response], sxx, sxy, self.y_square[response], self.collinear, self.noise)

    def state(self, response: int, terms, columns, blocked, allowed, variables=None) -> ModelState:
        mean, sxx, sxy = self.blocks(response, terms)
        rule = {}
        if self.collinear == "pinv":
            solved = normal_inverse(self.n, mean, sxx, self.noise)
            whitening = solved.whitening
            slopes = whitening.T @ (whitening @ sxy)
            beta = solved.projector @ np.concatenate([slopes, [self.y_mean[response] - slopes @ mean]])
            rule = {"means": mean, "beta": beta, "inverse": solved.inverse}
        elif terms:
            scale = np.sqrt(np.diag(sxx))
            lower = np.linalg.cholesky(sxx / np.outer(scale, scale))
            whitening = np.linalg.solve(lower, np.diag(1.0 / scale))
        else:
            whitening = np.zeros((0, 0))
        coefficients = whitening.T @ (whitening @ sxy)
        rss = max(self.y_square[response] - float(coefficients @ sxy), 0.0)
        return ModelState(
            response, tuple(columns), whitening, coefficients, rss, self.n - len(terms) - 2,
            frozenset(blocked), None if allowed is None else frozenset(allowed),
            None if variables is None else tuple(variables), **rule,
        )


class GramSource:
    """Candidates are rows of a Gram matrix on the driver (size checked where it is built)."""

    def __init__(self, moments: Moments, predictors: list, responses: list, collinear: str = "exclude"):
        self.m = moments
        self.names = list(responses)
        self.terms = list(predictors)
        self.n_terms = len(self.terms)
        y = [moments.position(r) for r in responses]
        self.at = {t: moments.position(t) for t in self.terms}
        order = {name: i for i, name in enumerate(dict.fromkeys(n for t in self.terms for n in self._parts(t)))}
        self.rank = {t: (len(self._parts(t)) - 1, *[order[p] for p in self._parts(t)]) for t in self.terms}
        self.cross = CrossProducts(moments.n, moments.mean[y], np.diag(moments.cross)[y], collinear)
        for t in self.terms:
            self._learn(t)

    def terms_of(self, k: int) -> int:
        """At most so many terms have k variables."""
        return k * (k + 1) // 2

    @staticmethod
    def _parts(term):
        return term if isinstance(term, tuple) else (term,)

    def _learn(self, term):
        i = self.at[term]
        c = self.m.cross
        self.cross.learn(
            term, self.m.mean[i], c[i, i],
            {r: c[i, self.m.position(name)] for r, name in enumerate(self.names)},
            {o: c[i, self.at[o]] for o in self.terms if o in self.cross.mean},
        )

    def best(self, requests: dict) -> dict:
        out = {}
        idx = np.array([self.at[t] for t in self.terms])
        y = [self.m.position(name) for name in self.names]
        squares, mean = np.diag(self.m.cross)[idx], self.m.mean[idx]
        noise = CENTRED_NOISE * self.m.n * mean * mean
        for r, (terms, blocked, allowed, variables) in requests.items():
            state = self.cross.state(r, terms, range(len(terms)), (), None)
            zw = np.concatenate([self.m.cross[np.ix_(y, idx)], self.m.cross[np.ix_([self.at[t] for t in terms], idx)]])
            t = centred_t(squares, noise, mean, zw, len(y), state)
            own = None if variables is None else set(variables)
            usable = np.array([
                c not in blocked and (allowed is None or c in allowed) and (own is None or own.issuperset(self._parts(c))) for c in self.terms
            ])
            ok = usable & ~np.isnan(t)
            if ok.any():
                key = np.where(ok, rank_key(t), -1.0)
                i = min(np.flatnonzero(key == key.max()), key=lambda j: self.rank[self.terms[j]])
                out[r] = (self.terms[i], float(t[i]))
        return out

    def learn(self, terms) -> None:
        """All candidates are known from the start."""

    def labels(self, terms) -> dict:
        return {t: t for t in terms}

    def close(self) -> None:
        pass


class TiledSource:
    """Candidates live in tiles on the executors; one scan job per iteration."""

    def __init__(
        self, tiles: Tiles, responses: Tiles, index: DataFrame | None, response_names: list[str],
        response_means, response_squares, epistatic: bool = True, keep_bytes: int = KEEP_LAYOUT_BYTES,
        collinear: str = "exclude",
    ):
        self.tiles, self.responses, self.index = tiles, responses, index
        self.layout = Layout(tiles, epistatic, keep_bytes=keep_bytes)
        self.names = list(response_names)
        self.epistatic = epistatic
        self.n_terms = self.terms_of(tiles.n_features)
        self.cross = CrossProducts(tiles.n_samples, response_means, response_squares, collinear, RAW_NOISE)

    def terms_of(self, k: int) -> int:
        return k + (k * (k - 1) // 2 if self.epistatic else 0)

    def learn(self, terms) -> None:
        """Means and cross products of terms that no scan has found, by one pass over their columns."""
        terms = [t for t in dict.fromkeys(terms) if t not in self.cross.mean]
        if not terms:
            return
        p, k = len(self.names), len(terms)
        width = p + k
        columns = side_columns(self.tiles, self.responses, self.cross.y_mean, terms, [0.0] * k).frame()

        def products(batches):
            total = np.zeros((width, width + 1))
            for pdf in batches:
                for w in pdf["weights"]:
                    w = np.asarray(w, dtype=float).reshape(width, -1)
                    total += np.concatenate([w @ w.T, w.sum(axis=1)[:, None]], axis=1)
            yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})

        sums = columns.mapInPandas(products, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
        total = np.zeros(width * (width + 1))
        for row in sums.collect():  # responses and seeds squared
            total[row["place"]] = row["value"]
        total = total.reshape(width, width + 1)
        mean = total[:, -1] / self.tiles.n_samples
        centred = total[:, :-1] - self.tiles.n_samples * np.outer(mean, mean)
        for i, term in enumerate(terms):
            self.cross.learn(
                term, mean[p + i], centred[p + i, p + i], {r: centred[p + i, r] for r in range(p)},
                {other: centred[p + i, p + j] for j, other in enumerate(terms[:i])},
            )

    def best(self, requests: dict) -> dict:
        union = list(dict.fromkeys(t for terms, *_ in requests.values() for t in terms))
        column = {t: i for i, t in enumerate(union)}
        states = [
            self.cross.state(r, terms, [column[t] for t in terms], *rest) for r, (terms, *rest) in requests.items()
        ]
        weights = side_columns(
            self.tiles, self.responses, self.cross.y_mean, union, [self.cross.mean[t] for t in union]
        )
        scanned = scan(self.layout, weights, len(self.names), len(union), states)
        out = {}
        n, p = self.tiles.n_samples, len(self.names)
        for row in best_candidate(scanned).collect():  # one row per response
            term = (row["pos_a"],) if row["pos_b"] is None else (row["pos_a"], row["pos_b"])
            s = row["stats"]
            self.cross.learn(
                term, s[1] / n, s[0] - s[1] * s[1] / n,
                {r: s[2 + r] for r in range(p)},
                {t: s[2 + p + column[t]] for t in union if t != term},
            )
            out[row["response"]] = (term, row["t"])
        return out

    def close(self) -> None:
        self.layout.unpersist()
        self.tiles.unpersist()
        self.responses.unpersist()

    def labels(self, terms) -> dict:
        wanted = sorted({p for t in terms for p in t})
        if not wanted:
            return {}
        if "names" in self.tiles.df.columns:  # kept tiles, so the source is not read again
            blocks = sorted({p // self.tiles.block for p in wanted})
            index = self.tiles.df.where((F.col("chunk") == 0) & F.col("block").isin(blocks)).select(
                F.inline(F.arrays_zip(F.col("positions").alias("pos"), F.col("names").alias("name")))
            )
        else:
            index = self.index
        rows = index.where(F.col("pos").isin(wanted)).select("pos", "name").collect()
        name = {r["pos"]: r["name"] for r in rows}
        return {t: name[t[0]] if len(t) == 1 else (name[t[0]], name[t[1]]) for t in terms}


@dataclass
class StepwiseResult:
    """``fits[name]`` is None where no term could be added."""

    fits: dict = field(default_factory=dict)
    trace: list = field(default_factory=list)
    seconds: dict = field(default_factory=dict)

    def models(self) -> list[Fit]:
        return [f for f in self.fits.values() if f is not None]

    def trace_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.trace, TRACE_SCHEMA)


@dataclass
class _Progress:
    added: list
    skipped: list
    allowed: set | None
    n_terms: int
    best: Fit | None = None
    seen: set = field(default_factory=set)
    variables: list | None = None

    def left(self) -> int:
        return self.n_terms - len(self.added) - len(self.skipped)


def run_stepwise(
    source,
    threshold: float = DEFAULT_THRESHOLD,
    added: list | None = None,
    skipped: list | None = None,
    candidates: list | None = None,
    variables: dict | None = None,
) -> StepwiseResult:
    """Build one model per response.

    Per iteration: the candidate with the smallest p-value next to the model enters if
    p < threshold, else the previous model is final. Only after that gate do terms skipped
    before become candidates again. Terms of the new model with p >= threshold then leave
    together and sit out one scan. ``added``/``skipped``/``candidates`` seed the start. ``variables``: of each
    response, those whose terms it may take (places of a tiled source, names of a tall one); all share one scan an iteration.
    """
    result = StepwiseResult()
    start = time.monotonic()
    n = source.cross.n
    source.learn([*(added or []), *(skipped or [])])
    todo: dict[int, _Progress] = {}
    for r in range(len(source.names)):
        seeds = (list(added or []), list(skipped or []))
        allowed = None if candidates is None else set(candidates) | set(seeds[0]) | set(seeds[1])
        own = None if variables is None else list(variables[source.names[r]])
        n_terms = source.terms_of(len(own)) if own is not None else source.n_terms
        todo[r] = _Progress(*seeds, allowed, n_terms if allowed is None else min(n_terms, len(allowed)), variables=own)
    events = []

    def finish(r):
        result.fits[r] = todo[r].best
        result.seconds[source.names[r]] = time.monotonic() - start
        del todo[r]

    for iteration in count(1):  # ends: a state that comes back is a cycle
        for r in [r for r, p in todo.items() if p.left() < 1 or n - len(p.added) - 2 < 1]:
            finish(r)
        if not todo:
            break
        winners = source.best({r: (p.added, set(p.added) | set(p.skipped), p.allowed, p.variables) for r, p in todo.items()})
        for r in list(todo):
            p = todo[r]
            if r not in winners:
                finish(r)
                continue
            term, t = winners[r]
            p_value = float(t_tail(t, n - len(p.added) - 2))
            if not p_value < threshold:
                events.append((r, iteration, "stop", term, t, p_value))
                finish(r)
                continue
            events.append((r, iteration, "enter", term, t, p_value))
            p.skipped = []
            p.added = [*p.added, term]
            fit = source.cross.fit(r, source.names[r], p.added)
            weak = [(x, fit.t[i], fit.p[i]) for i, x in enumerate(fit.terms) if fit.p[i] >= threshold]
            for x, tx, px in weak:
                events.append((r, iteration, "leave", x, float(tx), float(px)))
            if weak:
                gone = {x for x, _, _ in weak}
                p.skipped = [x for x, _, _ in weak]
                p.added = [x for x in p.added if x not in gone]
                fit = source.cross.fit(r, source.names[r], p.added)
            p.best = fit
            mark = (frozenset(p.added), frozenset(p.skipped))
            if mark in p.seen:
                events.append((r, iteration, "cycle", term, t, p_value))
                finish(r)
                continue
            p.seen.add(mark)
    used = {term for _, _, _, term, _, _ in events} | {t for f in result.fits.values() if f for t in f.terms}
    label = source.labels(used)
    ordered = {}
    for r, name in enumerate(source.names):
        f = result.fits[r]
        ordered[name] = f and Fit(name, tuple(label[t] for t in f.terms), *[
            getattr(f, k) for k in ("n", "beta", "se", "t", "p", "rss", "ss_model", "type3")
        ])
    result.fits = ordered
    for r, iteration, event, term, t, p_value in events:
        named = label[term]
        a, b = named if isinstance(named, tuple) else (named, None)
        result.trace.append((source.names[r], iteration, event, term_label(named), a, b, t, p_value))
    return result
