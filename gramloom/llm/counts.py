"""How often hashed items occur, roughly, in a table of bounded size that every task may hold.

The table is made by tasks, a part each, and broadcast; it has some ``SPARE`` cells for each item, at most ``2 ** MOST_BITS``
bytes. Where that is too few, half of it tells which items occur more than once, a bit for each of an item's two places, and the other half
has the cells of the most frequent ones; all others count like the most frequent one left out. Few cells for many items only make
counts less exact, upwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the table, a byte each, as powers of two; an item has two, and the lower one holds.
LEAST_BITS, MOST_BITS = 16, 25
SPARE = 8
#: Cells of a part, as a power of two.
PART_BITS = 19


class Table:
    """Cells of levels, an item's two ``shift`` bits apart; ``marks``, if any, holds bits of the items, those without a cell have
    the level ``floor``."""

    def __init__(self, cells: np.ndarray, shift: int, marks: np.ndarray | None = None, floor: int = 0) -> None:
        self.cells, self.shift, self.marks, self.floor = cells, shift, marks, floor

    def __len__(self) -> int:
        return len(self.cells) + (0 if self.marks is None else len(self.marks))


def _parts(bits: int, join: np.ufunc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells and what they hold as parts of the table."""
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, value = (batch.column(i).to_numpy() for i in (0, 1))
            number = cell >> bits
            for part in np.unique(number).tolist():
                own = number == part
                room = parts.setdefault(part, np.zeros(1 << bits, np.uint8))
                join.at(room, cell[own] & ((1 << bits) - 1), value[own].astype(np.uint8))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int64()), pa.array([b.tobytes() for b in parts.values()], pa.binary())], ["part", "cells"]
        )

    return run


def _halves(tokens: np.ndarray, cells: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return (tokens & mask).astype(np.int64), (tokens >> np.uint64(shift) & mask).astype(np.int64)


#: Bits between an item's two places among the marks.
MARK_SHIFT = 32


def _filled(rows: DataFrame, bits: int, join: np.ufunc) -> np.ndarray:
    """``rows`` (cell, value) as an array."""
    part_bits = min(bits, PART_BITS)
    parts = rows.repartition(F.shiftrightunsigned("cell", part_bits)).mapInArrow(_parts(part_bits, join), "part long, cells binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in parts.toLocalIterator():  # parts of 512 KB
        own = out[r["part"] << part_bits : (r["part"] + 1) << part_bits]
        join(own, np.frombuffer(r["cells"], np.uint8), out=own)
    return out


def count_table(counts: DataFrame) -> Table:
    """The table for ``counts`` (token, count), a written table that leaves out tokens that occur once.

    A cell holds four times the binary logarithm of the largest count that falls to it, so a level is never too
    low, and 0 means that a token occurs once at most.
    """
    level = F.least(F.floor(F.log2("count") * 4), F.lit(255)).cast("int")
    of_level = dict(counts.groupBy(level.alias("level")).count().collect())  # 256 rows at most
    items = sum(of_level.values())

    def cells(rows: DataFrame, bits: int) -> np.ndarray:
        cell = lambda shift: F.shiftrightunsigned("token", shift).bitwiseAND((1 << bits) - 1)
        return _filled(rows.select(F.explode(F.array(cell(0), cell(MOST_BITS))).alias("cell"), level.alias("value")), bits, np.maximum)

    if (items * SPARE).bit_length() <= MOST_BITS:
        return Table(cells(counts, max((items * SPARE).bit_length(), LEAST_BITS)), MOST_BITS)
    bits, floor, above = MOST_BITS - 1, -1, items
    while above * SPARE > 1 << bits:
        floor += 1
        above -= of_level.get(floor, 0)
    return Table(cells(counts.where(level > floor), bits), MOST_BITS, _marks(counts, bits), floor)


def _marks(items: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each token of ``items`` in 2 ** bits bytes."""
    place = lambda shift: F.shiftrightunsigned("token", shift).bitwiseAND((8 << bits) - 1)
    rows = items.select(F.explode(F.array(place(0), place(MARK_SHIFT))).alias("place"))
    value = F.expr("shiftleft(1, cast(place & 7 AS int))").alias("value")
    return _filled(rows.select(F.shiftrightunsigned("place", 3).alias("cell"), value), bits, np.bitwise_or)


def mark_table(items: DataFrame) -> Table:
    """The table for ``items`` (token), a written table: items have level 1, nearly all others 0."""
    bits = min(max((items.count() * SPARE // 8).bit_length(), LEAST_BITS), MOST_BITS)
    return Table(np.zeros(1, np.uint8), 0, _marks(items, bits), 1)


@contextmanager
def shared_table(counts: DataFrame, make: Callable[[DataFrame], Table] = count_table) -> Iterator[Broadcast]:
    """The table as a broadcast that ends with the block: what uses it is to be written within."""
    shared = counts.sparkSession.sparkContext.broadcast(make(counts))
    try:
        yield shared
    finally:
        shared.destroy()


def levels(tokens: np.ndarray, table: Table) -> np.ndarray:
    """The levels of tokens (unsigned 64-bit hashes)."""
    low, high = (table.cells[x] for x in _halves(tokens, len(table.cells), table.shift))
    out = np.minimum(low, high)
    if table.marks is None:
        return out
    marked = [table.marks[x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in _halves(tokens, 8 * len(table.marks), MARK_SHIFT)]
    return np.where(marked[0] & marked[1], np.maximum(out, np.uint8(max(table.floor, 1))), np.uint8(0))
