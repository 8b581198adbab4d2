"""The filter and the source audit against brute force and their SQL."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from gramloom.llm import divergence, filter_audit, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, part int, hash string, rank int"


def awkward(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé中") for _ in range(r.randint(1, 3))) for _ in range(40)]
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 30, 199, 200, 260]))]
        if r.random() < 0.2:
            words = [w.upper() for w in words]
        if r.random() < 0.2:
            words.append(r.choice("#$%&*|"))
        text = r.choice([" ", "\n", "\t  "]).join(words)
        if out and r.random() < 0.3:
            text = r.choice(out)[1]
        text = None if r.random() < 0.04 else text
        out.append((i if r.random() < 0.95 else None, text, r.choice(["en", "en", None, "", "de"]), r.choice(["s1", "s2", "s2", "s3", None, ""]), 1, 2, "x", 3))
    return [*out, *out[:5], (3, "a text of its own", "fr", "alone", 1, 2, "x", 3)]


def same(got, want):
    columns = list(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b), (a[(a != b).any(axis=1)], b[(a != b).any(axis=1)])


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()


def test_removal_steps_are_those_of_running_the_filters():
    for k in (1, 3, 5):
        orders, steps = filter_audit.removal_steps(k)
        assert sorted(orders) == sorted(itertools.permutations(range(k)))
        for m in range(1 << k):
            for o, order in enumerate(orders):
                assert steps[m, o] == next((s for s, f in enumerate(order, 1) if m >> f & 1), k + 1)


def test_audit_of_masks_by_hand(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 0, 1), ("p", 3, 2, 2, 0), ("p", 3, 1, 0, 0), ("q", 2, 4, 0, 4)], "part string, mask int, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(masks, "AB").collect()}
    assert len(got) == 8
    assert got["p", "AB", 1] == (5, 6, 0, 3, 2, 1, 9)
    assert got["p", "AB", 2] == (5, 0, 3, 0, 0, 0, 3)
    assert got["p", "BA", 1] == (8, 3, 0, 0, 2, 0, 3)
    assert got["p", "BA", 2] == (5, 3, 3, 3, 0, 1, 9)
    assert got["q", "AB", 1] == (4, 0, 0, 0, 0, 0, 0)
    assert got["q", "AB", 2] == (0, 4, 0, 4, 0, 4, 8)
    with pytest.raises(ValueError):
        filter_audit.audit(masks, "ABCDEFGHI")


@pytest.mark.parametrize("seed", [1, 2])
def test_filter_audit_on_awkward_rows(spark, seed):
    rows = awkward(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    labels = spark.createDataFrame([(i, i % 3 % 2, (i % 5) // 4) for i in range(60)] + [(3, 1, 1), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit_documents(docs, labels).toPandas()
    same(got, by_sql(filter_audit.SQL, documents=docs.toPandas().astype({"doc_id": "Int64"}), labels=labels.toPandas().astype("Int64")))
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0


def test_words_of_stretches(monkeypatch):
    r = random.Random(2)
    for stretch in (1, 3, 7, 50):
        monkeypatch.setattr(filter_audit, "STRETCH", stretch)
        for _ in range(60):
            data = "".join(r.choice("ab \n\x1cé") for _ in range(r.randint(0, 60))).encode()
            assert filter_audit._words(data) == (len(data.split()), len(set(data.split())))


def test_terms_of_stretches(monkeypatch):
    r = random.Random(3)
    for stretch in (1, 3, 7, 50):
        monkeypatch.setattr(divergence, "STRETCH", stretch)
        for _ in range(60):
            data = "".join(r.choice("aB1-\n\x7fé中") for _ in range(r.randint(0, 60))).encode()
            assert [t for part in divergence._terms(data) for t in part] == data.translate(divergence._TERM_BYTES).split()


@pytest.mark.parametrize(("k", "block", "merged"), [(1, 4096, 250_000), (2, 30, 250_000), (5, 7, 20), (2, 4096, 1)])
def test_skyband_keeps_what_few_dominate(spark, monkeypatch, k, block, merged):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "MERGED", merged)
    r = random.Random(k)
    rows = [(r.choice(["x", "y"]), "s", r.randint(1, 4), r.randint(1, 6), f"t{i:03d}".encode()) for i in range(400)]
    rows = [(a, s, n, max(n, m), t) for a, s, n, m, t in rows]

    def dominated(x):
        return sum(y[0] == x[0] and y[2] >= x[2] and y[3] <= x[3] and y[4] < x[4] for y in rows)

    want = sorted(x for x in rows if dominated(x) < k)
    frame = spark.createDataFrame(rows, "lang string, source string, n long, lang_n long, term binary").repartition(6)
    got = sorted((a, b, c, d, bytes(e)) for a, b, c, d, e in divergence.skyband(frame, k).collect())
    assert got == want


@pytest.mark.parametrize(("tile", "top", "gathered"), [(128, 200, 200_000), (2, 3, 10), (1, 1, 1)])
def test_source_audit_on_awkward_rows(spark, monkeypatch, tile, top, gathered):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "GATHERED", gathered)
    docs = spark.createDataFrame(awkward(9), SCHEMA).repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if tile == 128 else 3)
    try:
        got = divergence.audit_sources(docs, top).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    same(got, by_sql(divergence.SQL.replace("rank <= 200", f"rank <= {top}"), documents=docs.toPandas()))
    assert {"pair", "term"} == set(got["part"])
    assert divergence.audit_sources(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark):
    n, total, v = 5 * 10**12, 10**13, 10**7
    frame = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    got = frame.select(divergence._probability(*map(frame.__getitem__, ("n", "total", "v"))).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + v)


def test_queries(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    same(queries.op12_filter_audit(spark, SF).toPandas(), by_sql(filter_audit.SQL, documents=documents, labels=labels))
    same(queries.op13_source_divergence(spark, SF).toPandas(), by_sql(divergence.SQL, documents=documents))
    assert np.all(documents["doc_id"].notna())
