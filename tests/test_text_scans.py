"""Text files are scanned once for counts and headers, and once for the data."""

import os

import pytest

from gramloom.sources import read_delimited, read_epiq


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


@pytest.mark.parametrize("split", ["24b", "64b", "128m"])
@pytest.mark.parametrize("header_at", [0, 3, 7])
def test_epiq_header_anywhere(spark, tmp_path, split, header_at):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = [f"v{i}\t{i}.5\t{i}.25\t-{i}" for i in range(7)]
        lines.insert(header_at, "HeaderLine\ta\tb\tc")
        lines.insert(2, "")
        m = read_epiq(spark, write(tmp_path, "m.epiq", lines))
        assert {(r.name, r.pos): list(r["values"]) for r in m.features.collect()} == {(f"v{i}", i): [i + 0.5, i + 0.25, -float(i)] for i in range(7)}
        assert [(r.sample, r.idx) for r in m.samples.orderBy("idx").collect()] == [("a", 0), ("b", 1), ("c", 2)]
        assert m.n_features == 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split", ["30b", "128m"])
def test_delimited_header_is_the_first_line(spark, tmp_path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = write(tmp_path, "m.tsv", ["name,s1,s2", *[f"v{i},{i},{2 * i}" for i in range(9)]])
        m = read_delimited(spark, path, ",")
        assert {(r.name, r.pos): list(r["values"]) for r in m.features.collect()} == {(f"v{i}", i): [i, 2 * i] for i in range(9)}
        assert [r.sample for r in m.samples.orderBy("idx").collect()] == ["s1", "s2"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header_and_count_come_from_one_scan(spark, tmp_path):
    """Once either is known, the other needs the file no more."""
    path = write(tmp_path, "m.epiq", ["HeaderLine\ta\tb", "v0\t1\t2", "v1\t3\t4"])
    m = read_epiq(spark, path)
    assert m.n_features == 2
    os.remove(path)
    assert [r.sample for r in m.samples.orderBy("idx").collect()] == ["a", "b"]


def test_data_are_scanned_once(spark, tmp_path):
    path = write(tmp_path, "m.epiq", ["HeaderLine\ta\tb", "v0\t1\t2", "v1\t3\t4"])
    m = read_epiq(spark, path)
    assert m.n_features == 2  # the counts are kept now
    plan = m.features._jdf.queryExecution().executedPlan().toString()
    outside = plan.split("InMemoryRelation")[0]
    assert outside.count("Scan text") == 1
