"""The pipeline's stages on awkward rows and on a given table."""

import random

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from gramloom.llm import queries
from gramloom.llm.jaccard import jaccard_components

SF = "/root/testdata/sf0.001"


def test_registered():
    names = driver.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.ORACLES) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "lang")
    columns, before = docs.columns, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if n < 4:
            assert docs.columns == columns, name
        docs = docs.persist()
        if name == "near duplicates":
            left = jaccard_components(docs).collect()
            assert len({r.component_id for r in left}) == len(left) <= before
    rows = docs.collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= sum(used.values()) / 2048 * 1.02 + 1


@pytest.mark.parametrize("n", range(5))
def test_a_stage_of_nothing(spark, n):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[n][1](spark, empty, SF).count() == 0


def test_stages_of_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "the cat and the dog", "en", None, 19), (4, "the cat and the dog", "en", "a", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF).persist()
        left[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    # Short texts have no windows of three lines; equal rows are one, and the row without doc_id is a copy of document 4;
    # without words nothing is taken.
    assert left == {"line dedup": [1, 2, 2, 4, None], "near duplicates": [1, 2, 4], "mixing": [4], "packing": [4]}
    # No language can be told of these texts, or of none: whatever the first stage decides, it decides alike for equal texts.
    first = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, docs_schema()), SF).collect()
    assert len({r.doc_id in (4, None) for r in first if r.text}) <= 1 and not any(r.text is None or r.text == "" for r in first)


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_of_repeated_rows(spark):
    r = random.Random(5)
    a, b, c, d = (" ".join(str(r.randint(0, 999)) for _ in range(60)) for _ in range(4))
    rows = [
        (1, a, "en", "x", 1), (1, a, "en", "x", 1), (1, a, "en", "w", 1),  # given three times
        (2, a + " end", "en", "x", 1), (2, b, "en", "x", 1),  # one text near document 1, one of its own
        (3, b, "en", "x", 1), (4, c, "en", "x", 1),
        (None, c, "en", "x", 1), (None, d, "en", "x", 1), (None, d, "en", "x", 1), (None, d + " end", "en", "x", 1), (None, None, "en", "x", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = [tuple(x) for x in out.collect()]
    near = [x for x in got if x[0] is None and x[1] is not None]
    assert sorted((x for x in got if x not in near), key=str) == sorted([(1, a, "en", "w", 1), (2, b, "en", "x", 1), (4, c, "en", "x", 1), (None, None, "en", "x", 1)], key=str)
    assert len(near) == 1 and near[0][1] in (d, d + " end")
