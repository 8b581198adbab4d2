"""Columns of the input that are named like an operator's own come back as they were."""

import pytest

from gramloom.llm import language, licences, lines, mixing
from gramloom.llm.near_duplicates import drop_near_duplicates

OWN = "_th _key _id _h _dir _gone _lines _cover _at _copy _size _rest _h1".split()


@pytest.mark.parametrize("run", [mixing.mixed, lines.dedup_lines, licences.scan, language.with_language, drop_near_duplicates])
def test_clashing_names(spark, run):
    text = "the cat sat on the mat and the dog ran to the door of the old house"
    rows = [(i, f"{text} number {i} " + " ".join(f"w{i}x{j}" for j in range(20)), "en", "s", f"p{i}.txt", *[f"{c}{i}" for c in OWN]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, path string, " + ", ".join(f"{c} string" for c in OWN))
    got = run(docs).collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in OWN)
