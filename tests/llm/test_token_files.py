"""Token files and the tokenizer behind them: round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramloom.llm import queries, token_files, tokens
from gramloom.llm.tokens import BatchTokenizer

SF = "/root/testdata/sf0.001"
PATH = queries.public_tokenizer()
#: Two words of equal polynomial hash modulo 2**64, whatever its base.
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
ESROM = MORSE.translate({97: 98, 98: 97})


@pytest.fixture(scope="module")
def encoder():
    with open(PATH) as f:
        return BatchTokenizer(f.read())


def by_library(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def mixed_texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        pool = [chr(r.choice([r.randrange(1, 0x300), r.randrange(0x300, 0xD800), r.randrange(0xE000, 0x20000), 32, 10])) for _ in range(8)]
        pool += list("  '\n're'll aZ1!")
        text = "".join(r.choice(pool) for _ in range(r.choice([0, 5, 30, 150])))
        yield text[:20] + "<|endoftext|>" + text[20:] if r.random() < 0.1 else text


@pytest.mark.parametrize("chunk", [60, 1 << 18])
def test_ids_are_those_of_the_library(encoder, monkeypatch, chunk):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    texts = [*mixed_texts(chunk, 300), MORSE, ESROM, f"{MORSE} {ESROM}", " " * 500 + "x" + " " * 300, "it's we'll 'r'e 'l"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == by_library(encoder, text)


def test_equal_hashes_of_different_pieces(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "LONGEST", 5000)
    for texts in ([MORSE], [ESROM], [ESROM, MORSE], [MORSE]):
        assert [x.tolist() for x in encoder.encode(texts)] == [by_library(encoder, t) for t in texts]


def test_a_full_table_starts_anew(monkeypatch):
    for name, size in (("TABLE", 50), ("TABLE_IDS", 120), ("TABLE_POINTS", 300)):
        monkeypatch.setattr(tokens, name, size)
    with open(PATH) as f:
        small = BatchTokenizer(f.read())
    for seed in range(6):
        texts = list(mixed_texts(seed, 12))
        assert [x.tolist() for x in small.encode(texts)] == [by_library(small, t) for t in texts]


def test_other_tokenizers_encode_whole_texts():
    with open(queries.public_tokenizer("word_bpe_49k.json")) as f:
        other = BatchTokenizer(f.read())
    texts = ["Two  WORDS, it's", "", "three"]
    assert [x.tolist() for x in other.encode(texts)] == [by_library(other, t) for t in texts]


@pytest.mark.parametrize("planes", [4, 32])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    assert np.array_equal(token_files.from_planes(token_files.to_planes(ids, planes), n), ids)


def test_crc_of_parts():
    data = random.Random(4).randbytes(1000)
    for a in (0, 1, 500, 999):
        assert zlib.crc32(data) == token_files.crc_before(zlib.crc32(data[:a]), 1000 - a) ^ zlib.crc32(data[a:])


def want(rows, encoder):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*by_library(encoder, text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ROWS = [(5, None, 1), (3, "one two", 2), (9, "", 3), (1, "long words " * 3000, 4), (7, "<|endoftext|>!", 5), (2, MORSE, 6), (4, ESROM, 7)]


@pytest.mark.parametrize(("planes", "block", "most"), [("byte", 16, 64), ("bit", 64, 256), ("byte", 1 << 16, 1 << 28)])
def test_files(spark, encoder, tmp_path, planes, block, most):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, part long").repartition(4)
    index = token_files.write_tokens(docs, PATH, str(tmp_path / "t"), planes=planes, block=block, file_ids=most)
    rows = sorted(r[:2] for r in ROWS)
    expected = want(rows, encoder)
    got = sorted(tuple(r) for r in token_files.read_documents(spark, str(tmp_path / "t")).collect())
    assert got == sorted(expected)
    stream = [i for _, t in rows for i in [*by_library(encoder, t), 0]]
    at = 0
    blocks = index.orderBy("first_id").collect()
    for name in sorted({b.file for b in blocks}):
        own = [b for b in blocks if b.file == name]
        assert [b.first_id for b in own] == list(range(at, at + block * len(own), block))
        assert all(b.n_ids == block for b in own[:-1])
        file = token_files.TokenFile(str(tmp_path / "t" / name))
        assert file.n_ids == sum(b.n_ids for b in own)
        whole = stream[at : at + file.n_ids]
        for start, n in ((0, file.n_ids), (5, 40), (file.n_ids - 3, 10), (file.n_ids, 1)):
            assert file.read(start, n).tolist() == whole[start : start + n]
        at += file.n_ids
    assert at == len(stream)


def test_files_of_awkward_rows(spark, encoder, tmp_path):
    twice = [(None, "b"), (None, "a"), (4, "x"), (4, "x"), (4, "y"), (None, "a")]
    docs = spark.createDataFrame(twice, "doc_id long, text string").repartition(3)
    token_files.write_tokens(docs, PATH, str(tmp_path / "t"))
    got = token_files.read_documents(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 3 + [4] * 3
    crc = {t: zlib.crc32(np.array([*by_library(encoder, t), 0], "<u4").tobytes()) for t in "abxy"}
    assert sorted(r.ids_crc32 for r in got[:3]) == sorted([crc["a"], crc["a"], crc["b"]])
    assert sorted(r.ids_crc32 for r in got[3:]) == sorted([crc["x"], crc["x"], crc["y"]])
    empty = token_files.write_tokens(docs.limit(0), PATH, str(tmp_path / "e"))
    assert empty.count() == 0 and token_files.read_documents(spark, str(tmp_path / "e")).count() == 0


def test_a_lost_block_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words " * 50)], "doc_id long, text string")
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, PATH, path, block=16)
    read_index = token_files.read_index
    try:
        token_files.read_index = lambda s, p: read_index(s, p).where("first_id <> 16")
        with pytest.raises(Exception, match="ids of a document are missing"):
            token_files.read_documents(spark, path).collect()
    finally:
        token_files.read_index = read_index


def test_query(spark, encoder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = queries.op11_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == want(rows, encoder)
    assert got.agg(F.sum("n_tokens")).first()[0] == want(rows, encoder)[-1][1] + want(rows, encoder)[-1][2]
