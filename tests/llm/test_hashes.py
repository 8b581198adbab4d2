"""Exactness where hashes meet: long words, repeated ids, tiles bounded by bytes, tables of all sizes."""

import random

import numpy as np
import pytest

from gramloom.llm import components, counts, jaccard, substrings, textkit

#: Two words of equal polynomial hash modulo 2**64, whatever its base.
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
ESROM = MORSE.translate({97: 98, 98: 97})
SCHEMA = "doc_id long, text string"


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_word_hashes_tell_words_apart():
    r = random.Random(1)
    pool = {"".join(r.choice("ab") for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 255, 256, 257, 300) for _ in range(50)}
    pool |= {MORSE, ESROM, "a" * 8, "a" * 16, "a\0", "a\0\0", "\0" * 8}
    texts = sorted(pool)
    data = np.frombuffer(" ".join(texts * 2).encode(), np.uint8)
    got, first = textkit.word_hashes(data, np.array([0, len(data)]))
    assert len(got) == 2 * len(texts) == first[1]
    assert np.array_equal(got[: len(texts)], got[len(texts) :])
    assert len(np.unique(got)) == len(texts)


def test_long_words_in_components_and_passages(spark):
    rest = " ".join(words(1, 19))
    rows = [(1, f"{rest} {MORSE}"), (2, f"{rest} {ESROM}"), (3, MORSE), (4, ESROM), (5, MORSE.upper())]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}  # 14 of 16 shingles of 1 and 2 are shared
    alone = spark.createDataFrame([(1, " ".join([MORSE] * 6)), (2, " ".join([ESROM] * 6))], SCHEMA)
    assert {r.component_id for r in jaccard.jaccard_components(alone).collect()} == {1, 2}
    gone = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(docs).collect()}
    assert gone == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


def near(seed, ids):
    base = words(seed, 100)
    return [(i, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k, i in enumerate(ids, 10)]


@pytest.mark.parametrize(("tile", "tile_bytes"), [(512, 16 << 20), (4, 16 << 20), (512, 2000), (512, 1)])
def test_two_texts_of_one_id_join_their_families(spark, monkeypatch, tile, tile_bytes):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "TILE_BYTES", tile_bytes)
    rows = [*near(1, range(1, 8)), *near(2, [1, *range(8, 14)]), *near(3, [20, 21]), (30, "own"), (1, None), (31, ""), (30, "own")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    want = sorted((i, 1 if i < 14 else 20 if i < 30 else i) for i, _ in rows)
    assert got == want


@pytest.mark.parametrize("bits", [(3, 4), (16, 25)])
def test_levels_are_never_too_low(spark, monkeypatch, bits):
    monkeypatch.setattr(counts, "LEAST_BITS", bits[0])
    monkeypatch.setattr(counts, "MOST_BITS", bits[1])
    r = np.random.default_rng(1)
    tokens, n = r.integers(-(1 << 63), 1 << 63, 500), r.integers(2, 10**6, 500)
    table = counts.count_table(spark.createDataFrame(list(zip(tokens.tolist(), n.tolist())), "token long, count long"))
    assert len(table) <= 1 << 25
    assert (counts.levels(tokens.view(np.uint64), table) >= np.floor(np.log2(n) * 4).astype(int)).all()


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_components(spark, monkeypatch, part):
    """By one task, and by rounds of stars; chains, stars, repeated edges and loops."""
    monkeypatch.setattr(components, "PART", part)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(400, 400), (5, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(got) == len(want) and {x.node: x.component for x in got} == want
