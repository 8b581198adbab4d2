"""Best-fit packing of documents into sequences of a fixed length, by exact complements.

Method. A piece's length is all that packing needs, so the plan is made on the histogram of lengths, which has
no more rows than a sequence has tokens, however many documents there are. The longest piece left
opens a sequence; its gap is looked up among the single lengths, then the sums of two, then of three that are
available, and a combination that fills it exactly is used as often as its counts allow. Where none does,
the longest piece that fits goes in and the smaller gap is looked up again (best fit).

The plan is a short list of (lengths, how often). Pieces of one length are numbered by a distributed prefix
count, and piece number n of a length takes the n-th place that the plan has for it.

Only documents longer than a sequence are cut, into full sequences; what is left over is the first piece.

Edge cases: a null or empty text is the end mark alone (length 1). Equal rows are packed each by
itself. A null doc_id is kept and comes first among its length. Other columns are left out of the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import gives_back, written
from gramloom.llm.prefix import prefix_sums
from gramloom.llm.tokens import batch_tokenizer

LENGTH = 2048
END = 0
#: Pieces in a batch of rows.
ROWS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(ids: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces."""
    cuts = np.unique(np.append(np.arange(len(ids), 0, -length), 0)) if len(ids) else np.zeros(1, int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; ``tokenizer``: path of the tokenizer's JSON file on the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed vocabulary

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_tokenizer(shared.value)
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            # One text at a time leaves the batch; pieces go on as soon as there are ROWS of them.
            texts = (t.as_py() or "" for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids = np.append(ids, end).astype("<u4")
                for n, (a, b) in enumerate(pieces_of(ids, length)):
                    own = (ids[a:b].astype(np.int32),) if with_ids else ()
                    rows.append((doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), *own))
                    if len(rows) >= ROWS:
                        yield packed()
            batch = texts = None  # before the next batch is read
        if rows:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def _complement(counts: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that add up to ``gap``, the longest first."""
    if gap < len(counts) and counts[gap]:
        return [gap]
    have = counts[: gap + 1] > 0
    lengths = np.flatnonzero(have)

    def pair(total: int, most: int) -> list[int] | None:
        a = lengths[(lengths <= most) & (lengths * 2 >= total) & (lengths < total)]
        a = a[have[a] & have[total - a]]
        for x in a[::-1].tolist():
            if x * 2 != total or counts[x] > 1:
                return [x, total - x]
        return None

    if found := pair(gap, gap):
        return found
    for x in lengths[(lengths * 3 >= gap) & (lengths < gap - 1)][::-1].tolist():
        counts[x] -= 1
        have[x] = counts[x] > 0
        found = pair(gap - x, x)
        counts[x] += 1
        have[x] = True
        if found:
            return [x, *found]
    return None


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences); every piece is in one."""
    counts = np.zeros(length + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    out = []
    top = length
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return out
        left = counts.copy()
        chosen = [top]
        left[top] -= 1
        gap = length - top
        while gap:
            if found := _complement(left, gap):
                chosen += found
                break
            fit = np.flatnonzero(left[1 : gap + 1])
            if not len(fit):
                break
            best = int(fit[-1]) + 1
            chosen.append(best)
            left[best] -= 1
            gap -= best
        used, times = np.unique(chosen, return_counts=True)
        often = int((counts[used] // times).min())
        counts[used] -= times * often
        out.append((chosen, often))


def places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For each run of places of one length: (length, first number, sequence of it, offset), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, often in patterns:
        offset = 0
        for k in lengths:
            rows.append((k, used.get(k, 0), sequence, offset))
            used[k] = used.get(k, 0) + often
            offset += k
        sequence += often
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def place_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    numbered = written(
        prefix_sums(
            pieces.withColumn("_one", F.lit(1)).withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))),
            ["length"], ["_id", "piece", "ids_crc32"], {"_number": "_one"},
        ).drop("_one", "_id")
    )
    histogram = {r["length"]: r["count"] for r in numbered.groupBy("length").count().collect()}  # at most `length` rows
    shared = pieces.sparkSession.sparkContext.broadcast(places(plan(histogram, length)))
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, sequence, offset = shared.value
        groups = np.searchsorted(lengths, np.arange(length + 2))
        for batch in batches:
            own = batch.column("length").to_numpy()
            number = batch.column("_number").to_numpy()
            at = np.zeros(len(own), np.int64)
            for k in np.unique(own):
                a, b = groups[k], groups[k + 1]
                mine = own == k
                at[mine] = a + np.searchsorted(first[a:b], number[mine], "right") - 1
            extra = [sequence[at] + number - first[at], offset[at]] if len(own) else [own, own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(x, pa.int64()) for x in extra], [*names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.select(*names, F.col("_number").cast("long").alias("_number")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    return place_pieces(written(token_pieces(docs, tokenizer, length, end)), length)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The packed sequences (sequence_id, ids): a sequence has at most ``length`` tokens, so a group is small."""
    ids = token_pieces(docs, tokenizer, length, end, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    parts = placed.join(ids, placed.doc_id.eqNullSafe(ids.doc_id) & (placed.piece == ids.piece) & (placed.ids_crc32 == ids.ids_crc32))
    return parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
