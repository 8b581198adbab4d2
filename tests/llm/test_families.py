"""Which sets of the Jaccard join may meet: no link is lost, and what shares a few shingles only does not grow into one family."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gramloom.llm import counts, jaccard, near_duplicates

SCHEMA = "doc_id long, text string"
T = (3, 4)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def brute(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root


def texts(seed, n):
    """Copies with words changed, cut or added, of a few words only, so that many shingles are shared by chance."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6)]
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out)[1].split()
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            w = w[: len(w) - r.randint(0, 6)] or w
            w += r.choices(vocabulary, k=r.randint(0, 4))
        else:
            w = r.choices(vocabulary, k=r.randint(5, 120))
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("most_bits", [4, 9, 25])
def test_no_link_is_lost_whatever_the_table_holds(spark, monkeypatch, most_bits):
    monkeypatch.setattr(counts, "LEAST_BITS", 3)
    monkeypatch.setattr(counts, "MOST_BITS", most_bits)
    monkeypatch.setattr(jaccard, "TILE", 8)
    rows = texts(most_bits, 250)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)


@pytest.fixture
def in_families(monkeypatch):
    found, texts_of = [], jaccard._texts
    monkeypatch.setattr(jaccard, "_texts", lambda docs, sets: found.append(sets.count()) or texts_of(docs, sets))
    return found


def far_sizes():
    """Passages, texts of four of them, and all of these again."""
    passage = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(40)]
    rows = [*enumerate(passage), *((100 + i, " ".join(passage[i : i + 4])) for i in range(0, 40, 4))]
    return rows + [(i + 1000, t) for i, t in rows]


def test_sets_of_far_sizes_and_equal_texts_make_no_family(spark, in_families):
    rows = far_sizes()
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 1000 for i, _ in rows}
    assert in_families == [0]


def test_nor_in_the_pipelines_stage(spark, in_families):
    rows = far_sizes()
    got = near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == {x for x in rows if x[0] < 1000} and len(got) == 50
    assert in_families == [0]


def test_a_full_table_still_tells_what_is_rare(spark, monkeypatch):
    r = np.random.default_rng(2)
    many, once = (r.integers(-(1 << 63), 1 << 63, n) for n in (20_000, 20_000))
    monkeypatch.setattr(counts, "MOST_BITS", 16)
    table = counts.count_table(spark.createDataFrame([(int(x), 2 if i else 1 << 20) for i, x in enumerate(many)], "token long, count long"))
    assert len(table) <= 1 << 16
    level = counts.levels(many.view(np.uint64), table)
    assert level.min() == 4 and level[0] == 80 and (level == 4).mean() > 0.99
    # Of shingles that nothing else has, most are known as such. With cells of a byte only, a fifth would not be.
    assert (counts.levels(once.view(np.uint64), table) == 0).mean() > 0.9


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_ties(batch):
    r = random.Random(batch)
    rows = set()
    for _ in range(1500):
        n = r.randint(1, 60)
        place = r.randrange(jaccard._probe_prefix(n, T))
        rows.add((r.randrange(200), n, r.randrange(10**6) * 100 + n, int(jaccard._reach(n, np.array([place]), T)[0])))
    rows = sorted(rows)
    columns = list(zip(*rows, strict=True))
    kinds = [("token", pa.int64()), ("size", pa.int32()), ("key", pa.int64()), ("reach", pa.int32())]
    table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])
    pieces = [table.slice(i, batch) for i in range(0, len(rows), batch)]
    ties = {(a, b) for x in jaccard._ties(iter(pieces)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    root = {x[2]: x[2] for x in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_token = {}
    for token, *rest in rows:
        by_token.setdefault(token, []).append(rest)
    for a, b in ties:
        root[find(a)] = find(b)
    linked = 0
    for own in by_token.values():
        may = [(x[1], y[1]) for i, x in enumerate(own) for y in own[i + 1 :] if y[0] <= x[2] and x[0] <= y[2]]
        linked += len(may)
        assert all(find(a) == find(b) for a, b in may)
        if len(own) == 2:
            assert ((own[0][1], own[1][1]) in ties) == bool(may)
    assert linked > 100
