import json
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import packed
from gramloom.operators import matrix
from gramloom.plans.programs import run_association, run_convert, run_lasso
from gramloom.sources import Matrix, read_delimited, read_epiq, read_genotypes, read_pedmap
from gramloom.sources.matrix_files import checked, handle_missing
from gramloom.sources.sinks import require_absent, write_epiq


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def as_dict(m):
    return {r.name: list(r["values"]) for r in m.features.orderBy("pos").collect()}


def sample_list(m):
    return [r.sample for r in m.samples.orderBy("idx").collect()]


def test_epiq_with_header_anywhere(spark, tmp_path):
    path = put(tmp_path, "a.epiq", "A_1\t1\t0.5\nHeaderline\ts:1\ts:2\nB\t2.0\t1e-3\n")
    m = read_epiq(spark, path)
    assert sample_list(m) == ["s:1", "s:2"]
    assert as_dict(m) == {"A_1": [1.0, 0.5], "B": [2.0, 0.001]}


def test_epiq_bad_number_and_ragged_line_fail(spark, tmp_path):
    bad = put(tmp_path, "bad.epiq", "HeaderLine\ts1\ts2\nA\t1\tx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_epiq(spark, bad).features.collect()
    ragged = put(tmp_path, "ragged.epiq", "HeaderLine\ts1\ts2\nA\t1\n")
    with pytest.raises(Exception, match="expected 2 values in A"):
        checked(read_epiq(spark, ragged)).features.collect()


def test_positions_follow_the_file_over_many_splits(spark, tmp_path):
    lines = ["HeaderLine\ts1"] + [f"v{i}\t{i}" for i in range(5000)]
    path = put(tmp_path, "long.epiq", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        f = read_epiq(spark, path).features
        assert f.rdd.getNumPartitions() > 3
        rows = f.select("pos", F.get("values", F.lit(0)).alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r.pos == int(r.v) for r in rows)


def test_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "sample string, idx int")
    m = Matrix(samples, packed(spark, {"x_y": [0.1, 1 / 3, 2.0], "z": [1e300, -0.5, 0.0]}))
    out = str(tmp_path / "rt")
    write_epiq(m, out)
    back = read_epiq(spark, out)
    assert as_dict(back) == as_dict(m) and sample_list(back) == ["a", "b", "c"]


@pytest.mark.parametrize("turned", [False, True])
def test_delimited(spark, tmp_path, turned):
    path = put(tmp_path, "t.txt", "Any;;junk;;p;;q\nr1;;x;;1;;2\nr2;;y;;3;;4\n")
    m = read_delimited(spark, path, ";;", (1,), columns_are_variants=turned)
    if turned:
        assert as_dict(m) == {"p": [1, 3], "q": [2, 4]} and sample_list(m) == ["r1", "r2"]
    else:
        assert as_dict(m) == {"r1": [1, 2], "r2": [3, 4]} and sample_list(m) == ["p", "q"]


PED = (
    "f1 i1 0 0 1 1.0 A A G T C C\n"
    "f2 i2 0 0 1 1.0 A C 0 0 C C\n"
    "f3 i3 0 0 1 1.0 C C G G C C\n"
    "f4 i4 0 0 1 1.0 A A G X C C\n"
)
MAP = "1 m1 0.0 10\n1 m2 0.1 20\n2 m3 0.2 30\n"


def test_pedmap(spark, tmp_path):
    ped, mp = put(tmp_path, "d.ped", PED), put(tmp_path, "d.map", MAP)
    m = read_pedmap(spark, mp, ped)
    assert sample_list(m) == ["f1i1", "f2i2", "f3i3", "f4i4"]
    # heterozygote, minor homozygote, missing call, third allele, one-allele marker
    assert as_dict(m) == {"m1": [0, 1, 2, 0], "m2": [1, None, 0, None], "m3": [0, 0, 0, 0]}
    assert as_dict(read_genotypes(spark, ped=ped, map=mp)) == as_dict(m)
    with pytest.raises(ValueError):
        read_genotypes(spark, epiq="x", ped=ped, map=mp)


def test_colliding_sample_names(spark, tmp_path):
    ped = put(tmp_path, "c.ped", "a bc 0 0 1 1 A A\nab c 0 0 1 1 A A\n")
    mp = put(tmp_path, "c.map", "1 m1 0 1\n")
    with pytest.raises(ValueError, match="abc"):
        read_pedmap(spark, mp, ped)
    assert sample_list(read_pedmap(spark, mp, ped, sample_sep="/")) == ["a/bc", "ab/c"]


def test_missing_policies(spark):
    samples = spark.createDataFrame([(f"s{i}", i) for i in range(4)], "sample string, idx int")
    feats = spark.createDataFrame(
        [("a", 0, [1.0, None, 3.0, 2.0]), ("b", 1, [0.0, 1.0, 1.0, float("nan")])], "name string, pos int, values array<double>"
    )
    m = Matrix(samples, feats)
    with pytest.raises(Exception, match="missing values in"):
        handle_missing(m).features.collect()
    assert as_dict(handle_missing(m, "mean_impute")) == {"a": [1, 2, 3, 2], "b": [0, 1, 1, pytest.approx(2 / 3)]}
    dropped = handle_missing(m, "drop_samples")
    assert as_dict(dropped) == {"a": [1, 3], "b": [0, 1]} and sample_list(dropped) == ["s0", "s2"]


def matrices(tmp_path, n=40):
    rng = np.random.default_rng(4)
    x = {f"S_{i}": rng.integers(0, 3, n).astype(float) for i in range(6)}
    y = {"tall": 2 * x["S_1"] * x["S_4"] + x["S_2"] + 0.3 * rng.normal(size=n), "noise": rng.normal(size=n)}
    text = lambda d: "HeaderLine\t" + "\t".join(f"p{i}" for i in range(n)) + "\n" + "".join(
        k + "\t" + "\t".join(map(str, v)) + "\n" for k, v in d.items()
    )
    return put(tmp_path, "g.epiq", text(x)), put(tmp_path, "p.epiq", text(y))


def test_association_program(spark, tmp_path):
    g, p = matrices(tmp_path)
    out = str(tmp_path / "out")
    r = run_association(spark, out, p, epiq=g, threshold=1e-6)
    assert ("S_1", "S_4") in r.fits["tall"].terms and r.fits["noise"] is None
    report = spark.read.text(out + "/report").collect()
    lines = {r.phenotype: [x.value for x in report if x.phenotype == r.phenotype] for r in report}
    assert "ANOVA table:" in lines["tall"] and any(x.startswith("S_1_S_4\t1\t") for x in lines["tall"])
    assert lines["noise"][-1] == "No variants could be added to the model at the threshold of 1e-06"
    assert any(x.startswith("Calculation time (in minutes): ") for x in lines["noise"])
    anova = spark.read.parquet(out + "/anova")
    assert {r.source for r in anova.collect()} >= {"Error", "Total", "S_1_S_4"}
    with pytest.raises(FileExistsError):
        run_association(spark, out, p, epiq=g)


def test_association_with_lasso_screen(spark, tmp_path):
    g, p = matrices(tmp_path)
    r = run_association(spark, str(tmp_path / "lo"), p, epiq=g, threshold=1e-6, lasso=True)
    assert ("S_1", "S_4") in r.fits["tall"].terms


def test_sample_order_is_checked(spark, tmp_path):
    g, _ = matrices(tmp_path)
    bad = put(tmp_path, "bad.epiq", "HeaderLine\t" + "\t".join(f"p{i}" for i in reversed(range(40))) + "\ny\t" + "\t".join("1" * 40) + "\n")
    with pytest.raises(ValueError, match="sample mismatch"):
        run_association(spark, str(tmp_path / "o2"), bad, epiq=g)


def test_lasso_program(spark, tmp_path):
    g, p = matrices(tmp_path)
    out = str(tmp_path / "lasso")
    fits = run_lasso(spark, out, p, epiq=g)
    docs = [json.loads(r.value) for r in spark.read.text(out + "/models").collect()]
    tall = next(d for d in docs if d["phenotype"] == "tall")
    kept = [k for w in tall["weights"] for k, v in w.items() if v != 0]
    assert [f for f in fits if f and f.response == "tall"][0].terms == tuple(kept)
    assert spark.read.parquet(out + "/anova").where("phenotype = 'tall'").count() == len(kept) + 2


def test_convert_program(spark, tmp_path):
    src = put(tmp_path, "in.tsv", "Placeholder\ta\tb\ns1\t1\t2\ns2\t3\t4\n")
    out = str(tmp_path / "conv")
    run_convert(spark, [src], out, "custom", columns_are_variants=True, single_file=True)
    parts = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(parts) == 1
    assert open(os.path.join(out, parts[0])).read() == "HeaderLine\ts1\ts2\na\t1.0\t3.0\nb\t2.0\t4.0\n"
    with pytest.raises(ValueError):
        run_convert(spark, [src, src], str(tmp_path / uuid.uuid4().hex), "custom")
    with pytest.raises(FileExistsError):
        require_absent(spark, out)


def test_align_and_mismatch(spark):
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sample string, v double")
    order = spark.createDataFrame([("b", 0), ("a", 1)], "sample string, idx int")
    assert [(r.sample, r.idx) for r in matrix.align_samples(t, order).orderBy("idx").collect()] == [("b", 0), ("a", 1)]
    stranger = spark.createDataFrame([("b", 0), ("c", 1)], "sample string, idx int")
    with pytest.raises(Exception, match="samples do not match"):
        matrix.align_samples(t, stranger).collect()


def test_dedup_of_a_hot_group(spark):
    cols = {f"c{i}": [1.0, 1.0] if i % 3 else [float(i), 0.0] for i in range(30)}
    f = packed(spark, cols)
    kept = {r.name for r in matrix.dedup_features(f).collect()}
    assert kept == {f"c{i}" for i in range(0, 30, 3)} | {"c1"}
    assert matrix.duplicate_groups(f).where("kept = 'c1'").count() == 19
