"""Each operator against a brute-force version or its SQL, on given tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gramloom.llm import fingerprints, jaccard, language, licences, lines, mixing, packing, quality_votes, queries, rules, substrings
from gramloom.llm.tokens import BatchTokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n_lines string, th int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empties, copies, near copies, shared passages and lines, a very long text; extra columns with clashing names."""
    passage, long = prose(1, 40), prose(2, 9000)
    near = prose(3, 120).split()
    texts = [None, "", " \n\t ", "one", "one two three four", prose(4, 60), prose(4, 60), prose(4, 60).upper(), long, long + " end"]
    texts += [" ".join(near[:i] + ["x"] + near[i + 1 :]) for i in range(10, 40, 3)]
    texts += [prose(50 + i, 30) + " " + passage + " " + prose(80 + i, 30) for i in range(6)]
    texts += ["\n".join([prose(100 + i, 8), "first line", "second  line ", "", "third line", prose(130 + i, 8)]) for i in range(4)]
    texts += ["a a a a a a " * 8, "x\ny\nx\ny\nx\ny\nx\ny", "né ß 中文 😀 <|endoftext|> it's we'll"]
    langs = ["en", None, "de", "en"]
    return [(i, t, langs[i % 4], f"s{i % 5}" if i % 5 else None, -1, 7, "clash", 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def pandas(df, key="doc_id"):
    return df.toPandas().set_index(key).sort_index()


def sql(query, frame):
    con = duckdb.connect()
    con.register("documents", frame)
    return con.execute(query).df()


def compare(spark_df, query, docs):
    got = spark_df.toPandas()
    want = sql(query, docs.toPandas())[list(got.columns)]
    key = list(got.columns)
    a, b = (x.sort_values(key).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b), (a[(a != b).any(axis=1)], b[(a != b).any(axis=1)])


# ---- 8: n-gram Jaccard join


def sets_of(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(pairs):
    sets = {i: sets_of(t) for i, t in pairs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in holders[g])
        for g in sets[i]:
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("tile", [512, 4])
def test_jaccard(docs, rows, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == components([r[:2] for r in rows])


def test_jaccard_on_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_jaccard_join(spark, SF).collect()}
    assert got == components([(r.doc_id, r.text) for r in d.collect()])


def test_jaccard_edges(spark, nothing):
    assert jaccard.jaccard_components(nothing).count() == 0
    twice = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(twice).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, 4), (4, 2, 4), (5, 0, 5)], key=str)


# ---- 7: line dedup


def digests(df):
    return df.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def test_lines(docs, nothing, spark):
    out = lines.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    compare(digests(out), lines.SQL, docs)
    assert out.where("n_removed > 0").count() >= 4
    assert lines.dedup_lines(nothing).count() == 0
    same = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup_lines(same).collect()) == ["a\nb\nc", "a\nb\nc", "d"]


# ---- 6: substring dedup


def removed(pairs, window=20):
    seen, out = set(), {}
    for i, t in sorted(pairs):
        w = words(t)
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                keep[p : p + window] = [False] * window
            seen.add(k)
        out[i] = (len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.dedup_substrings(docs).collect()}
    assert got == removed([r[:2] for r in rows])


def test_substring_edges(spark, nothing):
    assert substrings.dedup_substrings(nothing).count() == 0
    t = prose(9, 25)
    d = spark.createDataFrame([(None, t), (3, t), (3, t)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substrings.dedup_substrings(d).collect()) == [("3", 25), ("3", 25), ("None", 0)]


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings_of_repeated_rows(spark, hot, monkeypatch):
    """A row given twice loses nothing to itself, whatever shares a passage with it."""
    monkeypatch.setattr(substrings, "HOT", hot)
    passage = prose(200, 45)
    rows = [(i, prose(210 + i, 30) + " " + passage + " " + prose(220 + i, 30)) for i in (1, 2, 5)]
    rows += [(None, prose(230, 25) + " " + prose(231, 45)), (7, prose(231, 45) + " " + prose(232, 25))]
    d = spark.createDataFrame(rows + [rows[0], rows[0], rows[3]], "doc_id long, text string").repartition(3)
    want = removed([(-1 if i is None else i, t) for i, t in rows])
    got = substrings.dedup_substrings(d).collect()
    assert len(got) == 8 and all((r.n_words, r.n_removed, r.text) == want[-1 if r.doc_id is None else r.doc_id] for r in got)


def test_automaton_matches_all_substrings():
    r = random.Random(4)
    texts = [[r.randint(0, 2) for _ in range(r.randint(1, 30))] for _ in range(40)]
    automaton, known = substrings.Automaton(), set()
    for t in texts:
        best = [max(n for n in range(i + 2) if n == 0 or tuple(t[i + 1 - n : i + 1]) in known) for i in range(len(t))]
        assert list(automaton.matching(t)) == best
        automaton.add(t)
        known |= {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}


# ---- 4: mixing


def test_mixing(docs, nothing):
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    compare(got, mixing.SQL, docs)
    frame = got.toPandas()
    by = frame.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 1).all() and (frame.taken <= 3 * frame["size"]).all()
    assert mixing.mix(nothing).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == frame.taken.sum()


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([(0, "a", 10), (0, "b", 1000), (0, "c", 1000), (1, "", 5)], "_none int, _source string, size long")
    got = {r._source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got[""] == 15 and got["b"] == pytest.approx(2 * 1970 / 3) and got["c"] == pytest.approx(1970 / 3)


# ---- 5: packing


@pytest.fixture(scope="module")
def tokenizer():
    return queries.public_tokenizer()


def test_tokens_equal_the_tokenizer(tokenizer):
    encoder = BatchTokenizer(open(tokenizer, encoding="utf-8").read())
    r = random.Random(3)
    parts = ["a", "b", "'s", "'", "'re", "'ll", " ", "  ", "\n", "\t", "1", "é", "ß", "!", "<|endoftext|>", "中", " ", "😀", "x'", " 's", "\r\n", "l"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_packing(docs, rows, nothing, tokenizer):
    placed = packing.pack(docs, tokenizer)
    frame = placed.toPandas().sort_values(["sequence_id", "offset"])
    for _, g in frame.groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    encoder = BatchTokenizer(open(tokenizer, encoding="utf-8").read()).tokenizer
    for i, g in frame.groupby("doc_id"):
        ids = np.array([*encoder.encode(rows[i][1] or "", add_special_tokens=False).ids, 0], "<u4")
        g = g.sort_values("piece")
        assert g.length.sum() == len(ids) and (g.length.iloc[1:] == 2048).all()
        for start, n, crc in zip(g.start, g.length, g.ids_crc32):
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
    assert frame.sequence_id.nunique() <= -(-frame.length.sum() // 2048) + 1
    by = {r.sequence_id: r.ids for r in packing.sequences(docs, placed, tokenizer).collect()}
    assert sum(map(len, by.values())) == frame.length.sum()
    assert packing.pack(nothing, tokenizer).count() == 0


def test_plan_uses_every_piece_once():
    r = random.Random(6)
    histogram = Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(5000))
    plan = packing.plan(dict(histogram))
    used = Counter()
    for lengths, often in plan:
        assert sum(lengths) <= 2048 and often > 0
        for k in lengths:
            used[k] += often
    assert used == histogram
    assert sum(n for _, n in plan) <= 1.01 * sum(k * v for k, v in histogram.items()) / 2048 + 1


# ---- 1: fingerprints


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def sketch(text):
    w = words((text or "").lower())
    groups = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else ([w] if w else [])
    hashes = set()
    for g in groups:
        h = 42
        for x in g:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        hashes.add(signed(h))
    low = sorted(h for h in hashes if h < fingerprints.threshold())
    return low if len(low) >= 16 else sorted(hashes)[:16]


def test_fingerprints(docs, rows, nothing):
    got = {r.doc_id: r for r in fingerprints.edited_pairs(docs).collect()}
    text = [r[1] or "" for r in rows]
    for i, t in enumerate(text):
        after = text[i - 1] if i else text[-1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i].edited == edited and got[i].n_chars == len(t)
        assert got[i].sketch == sketch(t) and got[i].edited_sketch == sketch(edited) and got[i].next_sketch == sketch(after)
    assert fingerprints.edited_pairs(nothing).count() == 0


def test_containment(spark):
    long, part = prose(20, 4000), " ".join(prose(20, 4000).split()[1000:2000])
    d = spark.createDataFrame([(long, part, prose(21, 500), "", long + " " + prose(21, 500))], "a string, b string, c string, d string, e string")
    for c in "abcde":
        d = fingerprints.with_sketch(d, c, f"{c}s")
    near = lambda x, y: fingerprints.containment(F.col(x), F.col(y))
    r = d.select(near("as", "bs").alias("ab"), near("as", "cs").alias("ac"), near("ds", "ds").alias("dd"), near("as", "ds").alias("ad"),
                 F.size(F.array_except(fingerprints.merge(F.col("as"), F.col("cs")), "es")).alias("extra")).first()
    assert r.ab > 0.95 and r.ac == 0 and r.dd == 1 and r.ad == 0 and r.extra == 0


# ---- 10: quality rules


def test_rules(docs, nothing, spark):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    compare(rules.judge(docs).select(*names), rules.SQL, docs)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    compare(rules.judge(d).select(*names), rules.SQL, d)
    assert rules.judge(nothing).count() == 0


def test_bins(spark):
    values = spark.range(0, 5000).select(F.col("id").alias("v")).withColumn("b", rules.bin_of(F.col("v"))).withColumn("top", rules.top_of(F.col("b")))
    frame = values.toPandas()
    assert frame.b.is_monotonic_increasing and (frame.top >= frame.v).all() and (frame.top <= frame.v * 17 / 16 + 1).all()


# ---- 9: quality classifier


def test_quality(spark, nothing):
    sf = "/root/testdata/sf0.01"
    frame = queries.op9_quality_votes(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = frame[frame.held_out].merge(labels, on="doc_id")
    assert frame.score.between(0, 1).all() and len(frame) == 1000
    assert (held.predicted == held.quality).mean() > 0.93
    assert frame.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in frame.doc_id]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_votes.classify(nothing, none).count() == 0


def test_quality_of_awkward_rows(docs, rows, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(rows))] + [(None, 1), (3, None)], "doc_id long, quality int")
    frame = pandas(quality_votes.classify(docs, labels))
    assert len(frame) == len(rows) and frame.score.between(0, 1).all() and frame.score[5] == frame.score[6] and frame.score[0] == frame.score[1]


# ---- 2: language


def test_language_of_pages(spark):
    frame = queries.op2_language(spark, "/root/testdata/sf0.01").toPandas()
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    told = pages.set_index("page_id").url.str.extract(r"example\.\w+/(\w\w)/")[0]
    frame = frame.set_index("page_id")
    assert len(frame) == len(pages) and (frame.lang == told[frame.index]).mean() > 0.98 and frame.confidence.between(0, 1).all()


def test_language_fusion(spark, nothing):
    """Posterior of a few items, by hand from the texts' likelihoods."""
    model = language.text_model(spark.read.parquet(f"{SF}/documents.parquet"))
    en, de = (spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang") == x).first().text for x in ("en", "de"))
    items = [(i, en, "en", "com", "h", "d") for i in range(6)] + [(6, de, "en", None, "h", "d"), (7, None, "en", "com", "h", "d"), (8, de, None, "de", None, None)]
    frame = spark.createDataFrame(items, "id long, text string, declared string, suffix string, host string, domain string")
    got = {r.id: r for r in language.identify(frame, model).collect()}
    evidence = {r.id: list(r._ll) for r in language.text_evidence(frame, model).collect()}
    names, n = model[0], len(model[0])
    votes = Counter(int(np.argmax(evidence[i[0]])) for i in items if i[1])
    total = [votes[j] for j in range(n)]
    base = [(x + 1) / (sum(total[:-1]) + n - 1) * (1 - language.UNKNOWN) for x in total[:-1]] + [language.UNKNOWN]

    def table(column, value):
        own = Counter(int(np.argmax(evidence[i[0]])) for i in items if i[1] and i[column] == value)
        values = len({i[column] for i in items if i[1] and i[column]}) + 1
        known = [np.log((own[j] + 1) / (total[j] + values)) for j in range(n - 1)]
        return np.array([*known, np.log((sum(own[j] for j in range(n - 1)) + 1) / (sum(total[:-1]) + values))])

    def smooth(column, value, above):
        own = Counter(int(np.argmax(evidence[i[0]])) for i in items if i[1] and i[column] == value)
        return [(own[j] + language.STRENGTH * above[j]) / (sum(own.values()) + language.STRENGTH) for j in range(n)]

    for i, text, declared, suffix, host, domain in items:
        if not text:
            assert got[i].lang == language.NONE and got[i].confidence == 0
            continue
        prior = smooth(4, host, smooth(5, domain, base)) if host else base
        score = np.array(evidence[i]) + np.log(prior)
        score = score + (table(2, declared) if declared else 0) + (table(3, suffix) if suffix else 0)
        p = np.exp(score - score.max())
        assert got[i].lang == names[int(p.argmax())] and got[i].confidence == pytest.approx(p.max() / p.sum(), abs=1e-5)
    assert language.with_language(nothing).count() == 0


def test_language_keeps_clean_documents(docs, spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert language.with_language(d).count() == d.count()
    assert language.with_language(docs).columns == docs.columns
    assert {0, 1, 2}.isdisjoint({r.doc_id for r in language.with_language(docs).collect()})


# ---- 3: licences


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("LICENSE", gpl, 1), ("a/LICENSE", mit, 2), ("a/x.txt", "plain words", 3), ("a/b/y.txt", "plain\n" + gpl, 4), ("a/b/z.txt", None, 5),
        ("c/d/e.txt", "", 6), ("c/COPYING", "nothing of the kind", 7), ("a/x.txt", "plain words", 8), (None, "  " + mit, 9), (None, None, 10),
    ]
    got = {r.licence_dir_id: (r.own_licence, r.licence, r.licence_dir) for r in licences.scan(
        spark.createDataFrame(files, "path string, text string, licence_dir_id int")).collect()}
    assert got == {
        1: ("GPL-3.0", "GPL-3.0", None), 2: ("MIT", "MIT", None), 3: (None, "MIT", "a"), 4: ("GPL-3.0", "GPL-3.0", None), 5: (None, "MIT", "a"),
        6: (None, "GPL-3.0", ""), 7: (None, "GPL-3.0", ""), 8: (None, "MIT", "a"), 9: ("MIT", "MIT", None), 10: (None, None, None),
    }
    assert licences.scan(spark.createDataFrame([], "path string, text string, licence_dir_id int")).count() == 0


def test_licence_lines_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    frame = pandas(queries.op3_licences(spark, sf))
    d = pandas(spark.read.parquet(f"{sf}/documents.parquet"))
    for notice, name in ((v, k) for k, v in licences.TEMPLATES.items()):
        at = [i for i, t in d.text.items() if notice in (t or "").split("\n")]
        assert all(frame.own_licence[i] is not None for i in at) and sum(frame.own_licence[i] == name for i in at) >= 0.9 * len(at)
    assert len(frame) == len(d)


def test_licence_forms(spark):
    """Wrapped headers, SPDX ids, titles and full texts, and the directories below; words alone are no licence."""
    from gramloom.llm.licence_forms import HEADERS, full_texts

    def wrapped(text, mark, width):
        lines, line = [], ""
        for w in text.split():
            if len(line) + len(w) > width:
                lines.append(line)
                line = ""
            line = f"{line} {w}".strip()
        return "\n".join(f"{mark} {x}".rstrip() for x in [*lines, line])

    full, cases = full_texts(), []
    for mark, width in (("#", 70), (" *", 52), ("--", 60)):
        cases += [(k, f"{prose(1, 12)}\n" + wrapped(HEADERS[k][0], mark, width) + f"\n{mark}\n{prose(2, 12)}") for k in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Apache-2.0")]
    cases += [("MIT", "// SPDX-License-Identifier: MIT\n" + prose(3, 9)), ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */"), ("GPL-3.0", "# SPDX-License-Identifier: (GPL-3.0-or-later OR Zlib)")]
    cases += [("MIT", wrapped("Copyright (c) 2020 Someone " + full["MIT"], "#", 72) + "\n" + prose(4, 30))]
    cases += [(None, "# SPDX-License-Identifier: Zlib\n" + prose(5, 9)), (None, "License"), (None, "copyright 2020 someone\n" + prose(6, 40)), (None, prose(7, 50))]
    files = [(f"s/{i}.c", t, i) for i, (_, t) in enumerate(cases)]
    expect = {i: (k, k) for i, (k, _) in enumerate(cases)}
    heads = [("BSD-3-Clause", "BSD 3-Clause License\n\n" + prose(8, 30)), ("Apache-2.0", "Apache License\nVersion 2.0, January 2004"), *full.items(), (None, prose(9, 300)), (None, "License\n" + prose(10, 20))]
    for i, (k, t) in enumerate(heads):
        files += [(f"d{i}/LICENSE", t, 100 + 2 * i), (f"d{i}/x/y.c", prose(20 + i, 9), 101 + 2 * i)]
        expect |= {100 + 2 * i: (k, k), 101 + 2 * i: (None, k)}
    got = licences.scan(spark.createDataFrame(files, "path string, text string, id int")).collect()
    assert {r.id: (r.own_licence, r.licence) for r in got} == expect


def test_licence_block_cosine(spark):
    """The cosine of a wrapped notice, by hand."""
    from gramloom.llm.licence_forms import forms

    def terms(text):
        text = re.sub(r"spdx-license-identifier\s*:?\s*", "spdx+", text.lower())
        return Counter(t for t in re.split(r"[^\w.+-]+|\.(?=\s|$)", text) if re.search(r"[^\W_]", t))

    lines = ["# Copyright someone; this file is subject to the", "# terms of the Mozilla Public License, version 2.0."]
    templates = [terms(t) for k, kind, t in forms(licences.TEMPLATES) if k == "MPL-2.0" and kind == "notice"]
    known = set().union(*(terms(t) for _, _, t in forms(licences.TEMPLATES)))
    df = Counter(t for x in lines for t in terms(x))
    w = lambda c: {t: f * (np.log((len(lines) + 1) / ((df[t] if t in known else 1) + 1)) + 1) for t, f in c.items()}
    cos = lambda a, b: sum(a[t] * b.get(t, 0) for t in a) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    got = licences.scan(spark.createDataFrame([("a.c", "\n".join(lines))], "path string, text string")).first()
    best = max(cos(w(terms("\n".join(x))), w(templates[0])) for x in (lines, lines[:1], lines[1:]))
    assert got.own_licence == "MPL-2.0" and got.cosine == pytest.approx(best, abs=2e-6) and best > cos(w(terms(lines[1])), w(templates[0])) + 0.05
