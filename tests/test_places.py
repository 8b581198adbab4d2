"""Samples that change places or go: by stretches of values, against numpy."""

import numpy as np
import pytest

from conftest import packed
from gramloom.sources import Matrix, matrix_files


def matrix(spark, values, samples):
    frame = spark.createDataFrame([(s, i) for i, s in enumerate(samples)], "sample string, idx int").repartition(3)
    return Matrix(frame, packed(spark, {f"v{k}": row for k, row in enumerate(values)}).repartition(3))


def rows(m):
    names = [r.sample for r in m.samples.orderBy("idx").collect()]
    assert [r.idx for r in m.samples.orderBy("idx").collect()] == list(range(len(names)))
    return names, {r.pos: (r.name, r["values"]) for r in m.features.collect()}


@pytest.mark.parametrize("places", [1, 3, 7, 1 << 16])
def test_reorder(spark, monkeypatch, places):
    monkeypatch.setattr(matrix_files, "PLACES", places)
    rng = np.random.default_rng(places)
    values, samples = rng.normal(size=(4, 20)), [f"s{i}" for i in range(20)]
    order = rng.permutation(20)
    wanted = spark.createDataFrame([(samples[i], k) for k, i in enumerate(order)], "sample string, idx int")
    names, got = rows(matrix_files.reorder_samples(matrix(spark, values, samples), wanted))
    assert names == [samples[i] for i in order]
    assert {p: v for p, (_, v) in got.items()} == {p: values[p][order].tolist() for p in range(4)}
    assert {p: n for p, (n, _) in got.items()} == {p: f"v{p}" for p in range(4)}


@pytest.mark.parametrize("places", [1, 4, 1 << 16])
def test_drop_incomplete(spark, monkeypatch, places):
    monkeypatch.setattr(matrix_files, "PLACES", places)
    rng = np.random.default_rng(places)
    values, more, samples = rng.normal(size=(3, 30)), rng.normal(size=(2, 30)), [f"s{i}" for i in range(30)]
    values[0, [0, 4, 5, 6, 7]], values[2, 29], more[1, [4, 12]] = np.nan, np.nan, np.nan
    left = [i for i in range(30) if i not in (0, 4, 5, 6, 7, 12, 29)]
    for m, x in zip(matrix_files.drop_incomplete([matrix(spark, values, samples), matrix(spark, more, samples)]), (values, more), strict=True):
        names, got = rows(m)
        assert names == [samples[i] for i in left]
        assert {p: v for p, (_, v) in got.items()} == {p: x[p][left].tolist() for p in range(len(x))}
        plan = m.features._jdf.queryExecution().optimizedPlan().toString()
        assert "Cross" not in plan


def test_nothing_left(spark):
    empty = matrix_files.drop_incomplete([matrix(spark, np.full((2, 3), np.nan), ["a", "b", "c"])])[0]
    assert empty.samples.count() == 0
    assert {r.name: r["values"] for r in empty.features.collect()} == {"v0": [], "v1": []}
