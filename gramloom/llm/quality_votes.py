"""Quality classifier: votes of the nearest labelled documents among latent-semantic vectors.

Method. A text is a bag of hashed terms: byte trigrams, shapes of word ends, words that follow themselves and
five-word windows seen before in the text. A bounded sample of labelled documents (``SAMPLE``
rows, the first by a hash of doc_id) gives term weights (log frequency times inverse document
frequency) and, by a truncated singular value decomposition, a space of ``DIMENSIONS`` axes. Projection and labelled vectors have
a fixed size (2 MB together at these settings) and are broadcast. Every document is
projected, its exact cosines with all labelled vectors come from blocked matrix products, and the labels of the
``NEIGHBOURS`` nearest are averaged with weights that grow with similarity.

Edge cases: a null or empty text is the zero vector; it, and any text unlike all labelled ones,
gets the sample's mean label. Without labelled rows every score is 0.5. Rows of labels without quality or
document are left out; a document labelled twice counts twice (of its rows no more than twice ``SAMPLE`` are taken in all). Equal texts get
equal scores. Other columns are not read. An empty table gives no row. A long text is counted alone, at some 60 bytes for each of its own.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm import textkit
from gramloom.llm.common import crc32_of_id

SAMPLE = 4096
TERMS = 4096
DIMENSIONS = 64
NEIGHBOURS = 25
#: Exponent of the similarity in a vote.
SHARPNESS = 8
CUT = 0.3
FOLDS = 5
#: Texts whose terms are counted at once (each a row of ``TERMS`` numbers).
BLOCK = 256
SHAPES, REPEAT, WINDOW = 256, 1, 1


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of term counts of the texts of a chunk."""
    rows = len(offsets) - 1
    room = TERMS - SHAPES - REPEAT - WINDOW
    out = np.zeros(rows * TERMS, np.float32)
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    if len(data) > 2:
        d = data.astype(np.uint32)
        tri = ((d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(room)
        own = owner[:-2]
        same = own == owner[2:]
        out += np.bincount(own[same] * TERMS + tri[same], minlength=len(out)).astype(np.float32)
    starts, ends, first = textkit.word_spans(data, offsets)
    if len(starts):
        own = owner[starts]
        # Kind of the first, second and last byte: capital, other letter, digit or sign.
        kind = np.full(256, 1, np.int64)
        kind[65:91] = 0
        kind[48:58] = 2
        kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
        shape = kind[data[starts]] * 64 + kind[data[np.minimum(starts + 1, ends - 1)]] * 16 + kind[data[ends - 1]] * 4
        shape += np.minimum(ends - starts, 16) // 5
        np.add.at(out, own * TERMS + room + shape, 1)
        words = textkit.byte_hashes(data, starts, ends)
        again = np.flatnonzero((words[1:] == words[:-1]) & (own[1:] == own[:-1])) + 1
        np.add.at(out, own[again] * TERMS + room + SHAPES, 1)
        for i, s in enumerate(textkit.shingle_sets(words, first)):
            out[i * TERMS + TERMS - 1] = max(first[i + 1] - first[i] - 4 - len(s), 0)
    return out.reshape(rows, TERMS)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 1e-12, norm, 1)).astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Term weights, projection and labelled vectors."""
    n = len(counts)
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    x = _weighted(counts, idf).astype(np.float32)
    # Truncated decomposition by block power iteration from a fixed start.
    k = min(DIMENSIONS, n)
    q = np.random.default_rng(7).standard_normal((TERMS, min(k + 16, n))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ v[:k].T).astype(np.float32)
    return {"idf": idf, "axes": axes, "vectors": _unit(x @ axes), "labels": labels.astype(np.float32)}


def vote(model: dict[str, np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Scores of rows of term counts."""
    vectors, labels = model["vectors"], model["labels"]
    mean = float(labels.mean())
    near = np.maximum(_unit(_weighted(counts, model["idf"]) @ model["axes"]) @ vectors.T, 0)
    k = min(NEIGHBOURS, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.take_along_axis(near, at, 1).astype(np.float64) ** SHARPNESS
    total = weight.sum(1)
    return np.where(total > 1e-9, (weight * labels[at]).sum(1) / np.where(total > 1e-9, total, 1), mean)


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, labels = [], []
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            counts += [term_counts(data, offsets) for _, data, offsets in textkit.chunks(part.column(0))]
            labels += part.column(1).to_pylist()
    if labels:
        f = io.BytesIO()
        np.savez(f, **fit(np.concatenate(counts), np.array(labels, np.float32)))
        yield pa.RecordBatch.from_arrays([pa.array([f.getvalue()], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE):
    """The model (bytes) of a bounded sample of labelled rows, or None. The caller picks the rows of ``labels``."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    rows = rows.orderBy(F.xxhash64("doc_id"), "_label", F.xxhash64("text")).limit(2 * sample).select("text", "_label")
    found = rows.coalesce(1).mapInArrow(_fit_task, "model binary").first()
    return bytes(found["model"]) if found else None


def scores(docs: DataFrame, model: bytes | None) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(np.load(io.BytesIO(shared.value)))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                got = [vote(own, term_counts(data, offsets)) for _, data, offsets in textkit.chunks(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(got), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are never seen."""
    fold = crc32_of_id(F.col("doc_id")) % FOLDS
    model = train(docs, labels.where(fold != 0))
    return scores(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
