"""Token ids in binary files: bit or byte planes of fixed-size blocks, each plane compressed, with a chunk index.

Method. The ids of all documents, in ascending doc_id order and each with its end id, are one stream, cut into files
and these into blocks of ``BLOCK`` ids (a file's last one may be shorter), whatever document an id belongs to. A
block's ids are transposed: byte plane k holds byte k of every id, bit plane k its bit k. Each plane is compressed by
zstandard by itself; high planes are nearly all zeros and shrink to nothing.

A file, all numbers little-endian::

    b"GLTOKEN1", u32 planes, u32 ids in a block
    for each block: documents, plane 0, plane 1, ...      each compressed
    for each block: u64 offset, u32 ids, u32 documents, u32 bytes of the documents and of each plane
    u64 offset of that index, u32 blocks, b"GLTOKEN1"

``documents`` are those with ids in the block, as four i64 columns one after the other: doc_id, 1 if doc_id is null,
number within the file of the document's first id, number of its ids. Beside the files, ``index`` is the index of all files as a
Parquet table, which says where in the stream each block begins.

Texts are range-sorted by doc_id, which is the only shuffle; the task that gets a range tokenizes it text by text and writes its file
block by block. Only the files' totals are added up afterwards, to number the blocks. A file is written to a name of its
own and renamed when whole, so a lost or repeated task leaves nothing half written, and the same bytes. Files are
written and read by byte range through ``pyarrow.fs``, so a path may be a shared folder or a store's address.

Documents are read back in parts, one for each block; the crc32 of a whole document is the sum (xor) of the parts' crc32,
each shifted by the bytes that follow it, so a document of any length needs no task of its own.

Edge cases: a null or empty text is the end id alone. A null doc_id comes first. Rows of equal doc_id are documents of
their own, in the order of a hash of their texts. An empty table has an index without rows and no file. Other
columns are not written. A text's ids are held by one task (4 bytes an id); everything else by blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.llm.common import file_system, gives_back, written
from gramloom.llm.tokens import batch_tokenizer

MAGIC = b"GLTOKEN1"
BLOCK = 1 << 16
#: A task begins another file when one has this many ids.
FILE_IDS = 1 << 28
LEVEL = 3
PLANES = {"byte": 4, "bit": 32}
ID = np.dtype("<u4")

INDEX = "file string, block int, first_id long, n_ids int, n_documents int, offset long, sizes array<int>"


# ---- planes


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of ids, low ones first."""
    parts = ids.astype(ID).view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(parts[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(parts, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        parts = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        parts = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(parts).view(ID).ravel()


# ---- crc32 of parts

#: The polynomial of crc32, bits reversed. A fixed value.
POLYNOMIAL = 0xEDB88320


def _product(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of crc32; the highest bit is the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


_SQUARES = [1 << 30]  # x**(2**k)
while len(_SQUARES) < 64:
    _SQUARES.append(_product(_SQUARES[-1], _SQUARES[-1]))


def crc_before(crc: int, n_bytes: int) -> int:
    """What bytes with this crc32 add to that of a whole in which ``n_bytes`` more follow."""
    bits = n_bytes * 8
    for k in range(bits.bit_length()):
        if bits >> k & 1:
            crc = _product(_SQUARES[k], crc)
    return crc


# ---- writing


class _File:
    """One file, written block by block."""

    def __init__(self, path: str, name: str, block: int, planes: int):
        self.store, folder = file_system(path)
        self.block, self.planes = block, planes
        self.name, self.whole, self.own = name, f"{folder}/{name}", f"{folder}/_{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.own)
        self.n_ids, self.ids, self.documents, self.index = 0, bytearray(), [], []
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL)
        self.out.write(MAGIC + struct.pack("<II", planes, block))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        document = (doc_id or 0, int(doc_id is None), self.n_ids, len(ids) // 4)
        at = 0
        while at < len(ids):
            part = ids[at : at + self.block * 4 - len(self.ids)]
            self.documents.append(document)
            self.ids += part
            at += len(part)
            if len(self.ids) == self.block * 4:
                self._flush()
        self.n_ids += document[3]

    def _flush(self) -> None:
        ids = np.frombuffer(bytes(self.ids), ID)
        chunks = [np.array(self.documents, "<i8").T.tobytes(), *to_planes(ids, self.planes)]
        chunks = [self.squeeze.compress(c) for c in chunks]
        self.index.append((self.out.tell(), len(ids), len(self.documents), [len(c) for c in chunks]))
        for c in chunks:
            self.out.write(c)
        self.ids.clear()
        self.documents = []

    def close(self) -> pa.RecordBatch:
        """Ends the file and returns its part of the index; its first id has the number 0."""
        if self.ids:
            self._flush()
        end = self.out.tell()
        for offset, n, docs, sizes in self.index:
            self.out.write(struct.pack(f"<QII{len(sizes)}I", offset, n, docs, *sizes))
        self.out.write(struct.pack("<QI", end, len(self.index)) + MAGIC)
        self.out.close()
        self.store.move(self.own, self.whole)
        offset, n, docs, sizes = zip(*self.index, strict=True)
        k = len(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.name] * k), pa.array(range(k), pa.int32()), pa.array([self.block * i for i in range(k)], pa.int64()),
             pa.array(n, pa.int32()), pa.array(docs, pa.int32()), pa.array(offset, pa.int64()), pa.array(sizes, pa.list_(pa.int32()))],
            ["file", "block", "first_id", "n_ids", "n_documents", "offset", "sizes"],
        )


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, end: int = 0, planes: str = "byte", block: int = BLOCK, file_ids: int = FILE_IDS
) -> DataFrame:
    """Writes the ids of all ``docs`` (doc_id, text) into files under ``path``, and returns the chunk index."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a fixed vocabulary
    store, folder = file_system(path)
    store.create_dir(folder, recursive=True)
    n_planes = PLANES[planes]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number, file, ids = batch_tokenizer(shared.value), TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                if file is None:
                    file = _File(path, f"{part:08d}-{number:04d}.tokens", block, n_planes)
                file.add(doc_id, np.append(ids, end).astype(ID).tobytes())
                if file.n_ids >= file_ids:
                    yield file.close()
                    file, number = None, number + 1
            batch = texts = ids = None  # before the next batch is read
        if file is not None:
            yield file.close()

    # The last key tells rows apart whose other keys are equal: their order is of no account, but they may be many.
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_t"), F.rand(11).alias("_r"))
    ordered = ordered.repartitionByRange("doc_id", "_t", "_r").sortWithinPartitions("doc_id", "_t")
    # The index is small: a few files hold it, not one for each task.
    few = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    index = written(ordered.select("doc_id", "text").mapInArrow(run, INDEX).repartition(few))
    shared.destroy()
    # A row for each file, in the order of their names: as many as the range sort has partitions, or one for ``file_ids`` ids.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = index.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    index = index.join(F.broadcast(base), "file").withColumn("first_id", F.col("first_id") + F.col("base"))
    index.select(*[c.split(" ")[0] for c in INDEX.split(", ")]).write.parquet(f"{path.rstrip('/')}/index")
    return read_index(spark, path)


# ---- reading


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index")


def _head(file) -> tuple[int, int]:
    """Planes, and ids in a block."""
    head = file.read_at(16, 0)
    if head[:8] != MAGIC:
        raise ValueError("no file of token ids")
    return struct.unpack("<II", head[8:])


def _block(file, offset: int, n_ids: int, n_documents: int, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids and its documents (four rows)."""
    raw, open_ = memoryview(file.read_at(sum(sizes), offset)), zstandard.ZstdDecompressor()
    ends = np.cumsum([0, *sizes]).tolist()
    chunks = [open_.decompress(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return from_planes(chunks[1:], n_ids), np.frombuffer(chunks[0], "<i8").reshape(4, n_documents)


PARTS = "doc_id long, start long, n_tokens long, pos long, n long, crc long"


def read_parts(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document and block that holds ids of it, read from the files.

    ``pos``: the part's first id within its document; ``crc``: what it adds to the document's crc32.
    """
    names = [c.split(" ")[0] for c in PARTS.split(", ")] + (["ids"] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{folder}/{r['file']}") as file:
                    _, block_ids = _head(file)
                    ids, (doc_id, null, start, n_tokens) = _block(file, r["offset"], r["n_ids"], r["n_documents"], r["sizes"])
                start = start + (r["first_id"] - r["block"] * block_ids)  # from the file's numbers to the stream's
                a = np.maximum(start, r["first_id"]) - r["first_id"]
                b = np.minimum(start + n_tokens, r["first_id"] + r["n_ids"]) - r["first_id"]
                raw = ids.tobytes()
                parts = [raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                pos = a + r["first_id"] - start
                after = (n_tokens - pos - (b - a)).tolist()
                crc = [crc_before(zlib.crc32(p), 4 * k) for p, k in zip(parts, after, strict=True)]
                arrays = [pa.array(doc_id, mask=null.astype(bool)), *(pa.array(x) for x in (start, n_tokens, pos, b - a)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(parts, pa.binary())] if with_ids else [])], names)

    # A number of its own, as the index is small and what it stands for is not.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_index(spark, path).repartition(tasks, "file", "block").mapInArrow(run, PARTS + (", ids binary" if with_ids else ""))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; an error where ids are missing."""
    whole = read_parts(spark, path).groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"))
    right = F.when(F.col("n") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("ids of a document are missing")).cast("long"))
    return whole.select("doc_id", "start", "n_tokens", right.alias("ids_crc32"))


class TokenFile:
    """One file opened by itself, for a loader: any stretch of its ids by reading only the blocks that hold it."""

    def __init__(self, path: str):
        store, place = file_system(path)
        self.file = store.open_input_file(place)
        planes, self.block = _head(self.file)
        size = self.file.size()
        at, blocks = struct.unpack("<QI", self.file.read_at(12, size - 20))
        if self.file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{path} is not whole")
        row = struct.Struct(f"<QII{planes + 1}I")
        self.index = list(row.iter_unpack(self.file.read_at(row.size * blocks, at)))
        self.n_ids = sum(r[1] for r in self.index)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file, as far as it has them."""
        low, high = max(start, 0), min(start + n, self.n_ids)
        out = [np.zeros(0, ID)]
        for k in range(low // self.block, -(-high // self.block)) if low < high else ():
            offset, n_ids, n_documents, *sizes = self.index[k]
            out.append(_block(self.file, offset, n_ids, n_documents, sizes)[0][max(low - k * self.block, 0) : high - k * self.block])
        return np.concatenate(out)
