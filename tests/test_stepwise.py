import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import packed
from gramloom.plans.association import packed_source, tall_source
from gramloom.plans.stepwise import run_stepwise


def cols(*names):
    return {n: F.col(n) for n in names}


def p_of(fit, name):
    return dict(zip([*fit.terms, "int"], fit.p))[name]


def test_cement_two_predictors(cement_frame):
    r = run_stepwise(tall_source(cement_frame, cols("x1", "x2", "x3"), cols("y"), epistatic=False))
    fit = r.fits["y"]
    assert fit.terms == ("x2", "x1")
    assert p_of(fit, "x1") == pytest.approx(5.0549442535e-05, rel=1e-9)
    assert p_of(fit, "x2") == pytest.approx(3.4170261157e-05, rel=1e-9)
    assert p_of(fit, "int") == pytest.approx(9.5248948818e-07, rel=1e-9)
    assert fit.beta == pytest.approx([0.65914, 1.43143, 53.02180], abs=1e-5)
    assert r.trace[0][6:] == (pytest.approx(4.3858020, abs=1e-6), pytest.approx(0.00321, abs=1e-5))
    assert r.trace[1][6] == pytest.approx(10.2412738, abs=1e-6)


def test_weak_term_leaves_and_model_is_refitted(cement_frame):
    source = tall_source(cement_frame, cols("x1", "x3"), cols("y"), epistatic=False)
    r = run_stepwise(source, added=["x3"], candidates=["x1"])
    fit = r.fits["y"]
    assert fit.terms == ("x1",)
    assert p_of(fit, "x1") == pytest.approx(0.00515, abs=1e-5)
    assert p_of(fit, "int") == pytest.approx(1.6e-06, abs=1e-5)
    assert fit.beta == pytest.approx([2.1223, 78.5724], abs=1e-4)
    leave = [e for e in r.trace if e[2] == "leave"]
    assert leave[0][3] == "x3" and leave[0][7] == pytest.approx(0.6205, abs=1e-4)


def test_skipped_term_returns(cement_frame):
    source = tall_source(cement_frame, cols("x1", "x2"), cols("y"), epistatic=False)
    fit = run_stepwise(source, candidates=["x1"], skipped=["x2"]).fits["y"]
    assert set(fit.terms) == {"x1", "x2"}
    assert p_of(fit, "x1") == pytest.approx(5.05e-05, abs=1e-5)


def test_seeded_start_in_tiled_form(spark, cement):
    x = packed(spark, {k: cement[k] for k in ("x1", "x2", "x3")})
    y = packed(spark, {"y": cement["y"]})
    source = packed_source(x, y, 3, 9, epistatic=False)
    first = run_stepwise(source).fits["y"]
    assert first.terms == ("x2", "x1")
    fit = run_stepwise(source, candidates=[(0,)], skipped=[(1,)]).fits["y"]
    assert set(fit.terms) == {"x1", "x2"}
    source.close()


def brute_force(x, y, names, threshold, pairs=True):
    """Full regressions by lstsq, one per candidate: the rule, spelled out."""
    from gramloom.functions.tails import t_tail

    terms = {(n,): x[n] for n in names}
    if pairs:
        terms |= {(a, b): x[a] * x[b] for a, b in itertools.combinations(names, 2)}
    n = len(y)

    def fit(model):
        d = np.column_stack([*[terms[t] for t in model], np.ones(n)])
        inv = np.linalg.inv(d.T @ d)
        beta = inv @ d.T @ y
        rss = ((y - d @ beta) ** 2).sum()
        df = n - d.shape[1]
        t = beta / np.sqrt(np.diag(inv) * rss / df)
        return t, t_tail(t, df)

    added, skipped = [], []
    while True:
        left = [t for t in terms if t not in added and t not in skipped]
        scored = [(abs(fit([*added, z])[0][-2]), z) for z in left]
        if not scored:
            return added
        best = max(scored, key=lambda s: s[0])[1]
        t, p = fit([*added, best])
        if p[-2] >= threshold:
            return added
        skipped = []
        added = [*added, best]
        weak = [z for z, pz in zip(added, p) if pz >= threshold]
        added = [z for z in added if z not in weak]
        skipped = weak


@pytest.mark.parametrize("block,chunk,parts", [(None, None, None), (3, 17, None), (5, 10, 4), (20, 60, 1)])
def test_tiled_form_equals_brute_force(spark, block, chunk, parts):
    rng = np.random.default_rng(11)
    names = [f"v{i}" for i in range(12)]
    x = {n: rng.normal(size=60) for n in names}
    ys = {
        "y1": x["v1"] * x["v7"] * 2 + x["v3"] + 0.3 * rng.normal(size=60),
        "y2": x["v2"] - x["v10"] * x["v11"] + 0.5 * rng.normal(size=60),
        "y3": rng.normal(size=60),
    }
    source = packed_source(packed(spark, x), packed(spark, ys), 12, 60, True, block, chunk)
    if parts:
        from gramloom.operators.scan import Layout

        source.layout.unpersist()
        source.layout = Layout(source.tiles, True, parts)
    r = run_stepwise(source, 0.01)
    for name, y in ys.items():
        want = brute_force(x, y, names, 0.01)
        got = r.fits[name].terms if r.fits[name] else ()
        assert [t if isinstance(t, tuple) else (t,) for t in got] == want
    source.close()


def test_layout_without_reuse_gives_the_same(spark, monkeypatch):
    import gramloom.operators.scan as scan_module
    from gramloom.operators.scan import Layout

    rng = np.random.default_rng(3)
    x = {f"v{i}": rng.normal(size=40) for i in range(9)}
    y = {"y": x["v1"] * x["v4"] + 0.2 * rng.normal(size=40)}
    source = packed_source(packed(spark, x), packed(spark, y), 9, 40, True, 3, 11)
    a = run_stepwise(source, 0.01)
    source.layout.unpersist()
    source.layout = Layout(source.tiles, True, keep_bytes=0)
    b = run_stepwise(source, 0.01)
    monkeypatch.setattr(scan_module, "BROADCAST_BYTES", 0)
    c = run_stepwise(source, 0.01)
    assert a.trace and [e[:6] for e in a.trace] == [e[:6] for e in b.trace] == [e[:6] for e in c.trace]
    source.close()


def test_constant_and_duplicate_columns_are_left_out(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=30)
    x = {"one": np.ones(30), "a": a, "a_again": a, "zero": np.zeros(30)}
    source = packed_source(packed(spark, x), packed(spark, {"y": a + 0.1 * rng.normal(size=30)}), 4, 30, False)
    r = run_stepwise(source, 0.05)
    assert r.fits["y"].terms == ("a",)  # the tie goes to the lower position, the copy then adds nothing
    source.close()


def test_no_model_and_no_candidates(spark):
    x = packed(spark, {"zero": np.zeros(12), "one": np.ones(12)})
    source = packed_source(x, packed(spark, {"y": np.arange(12.0)}), 2, 12)
    r = run_stepwise(source)
    assert r.fits["y"] is None and r.trace == []
    source.close()


def test_stops_before_degrees_of_freedom_run_out(spark):
    rng = np.random.default_rng(9)
    x = {f"v{i}": rng.normal(size=6) for i in range(8)}
    source = packed_source(packed(spark, x), packed(spark, {"y": rng.normal(size=6)}), 8, 6, False)
    r = run_stepwise(source, 0.999999)
    assert r.fits["y"].df_error >= 1
    source.close()


@pytest.mark.parametrize("epistatic", [True, False])
def test_many_samples_are_scanned_without_a_broadcast(spark, epistatic):
    from gramloom.operators.scan import scan, side_columns

    rng = np.random.default_rng(21)
    n, names = 2000, [f"v{i}" for i in range(7)]
    x = {k: 3 + rng.normal(size=n) for k in names}
    ys = {"y1": x["v1"] * x["v5"] + x["v3"] + rng.normal(size=n), "y2": x["v2"] + rng.normal(size=n)}
    packs = packed(spark, x), packed(spark, ys), len(names), n, epistatic
    whole, blocks = packed_source(*packs), packed_source(*packs, 3, 256)
    a, b = run_stepwise(whole, 0.01), run_stepwise(blocks, 0.01)
    assert len(a.trace) > 4 and [e[:6] for e in a.trace] == [e[:6] for e in b.trace]
    for one, other in zip(a.models(), b.models(), strict=True):
        assert np.allclose(one.beta, other.beta, rtol=1e-9) and np.allclose(one.t, other.t, rtol=1e-8)
    term = (3,)
    whole.best({r: ([], set(), {term}, None) for r in range(2)})  # learn its sums
    cross = whole.cross
    states = [cross.state(r, [term], [0], {term}, None) for r in range(2)]
    weights = side_columns(whole.tiles, whole.responses, cross.y_mean, [term], [cross.mean[term]])
    plan = scan(whole.layout, weights, 2, 1, states)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    seeded = [run_stepwise(s, 0.01, added=[term, (1, 5)] if epistatic else [term]) for s in (whole, blocks)]
    assert [e[:6] for e in seeded[0].trace] == [e[:6] for e in seeded[1].trace]
    whole.close()
    blocks.close()
