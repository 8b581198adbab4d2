"""Filter interaction audit: what each filter of a cascade removes, in every order in which the filters can run.

Method. A document matters only by its *mask*, the set of filters it fails; k filters have 2**k masks and k! orders. With
P[f, o] the step at which order o runs filter f (each column the inverse of its permutation), and M[m, f] zero where mask
m fails f and infinite elsewhere, the min-plus product

    R[m, o] = min over f of (M[m, f] + P[f, o])

is the step at which order o removes a document of mask m (infinite: never). The documents of a part and mask are
counted by one aggregate; these counts are the weights that R scatters over the steps: ``removed`` at step s adds
up the weights of masks with R = s, ``redundant`` those that fail the filter of step s with R < s, and so on. So texts are
read once, and the orders cost a product of small matrices for each part, done in the task that holds the part's row.

Counting the masks. Texts are read in Arrow batches, and only their flags and a 256-bit hash go on. A copy has the
hash of a text with smaller doc_id: rows are first added up by (hash, doc_id and all else), then by (hash, flags, part,
labels) with the smallest doc_id and the rows that have it. Copies are added up before they are shuffled by hash, so a group of any
size is a few rows.

Edge cases: a null text is an empty one, a null source the part ''. Empty texts fail the least-words filter and, from the second on, the
copies' one. A null doc_id is neither smaller nor larger than others, so such a row is no copy and has none; rows of one
doc_id are no copies of each other. A label that occurs in several rows of a doc_id counts once, if any of them has it. Other columns are not read.
An empty table has no part and no row. Words of long texts are counted in stretches, so of a long text only its
different words are held beside it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import written

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Percent of words that must differ, and of characters that may be capitals.
LEAST_DISTINCT, MOST_CAPITALS = 50, 2
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Bytes whose words are counted at once.
STRETCH = 1 << 20
#: More filters have too many orders to list them all.
MOST_FILTERS = 6


def removal_steps(k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of k filters, and R[mask, order]: the step (from 1) that removes the mask, k + 1 for none.

    Bit f of a mask says that filter f fails.
    """
    orders = list(itertools.permutations(range(k)))
    position = np.argsort(np.array(orders), axis=1).T + 1  # of each filter in each order
    fails = np.arange(1 << k)[:, None] >> np.arange(k) & 1
    never = k + 1
    steps = np.full((1 << k, len(orders)), never)
    for f in range(k):  # the min-plus product, a filter at a time
        steps = np.minimum(steps, np.where(fails[:, f] == 1, 0, never)[:, None] + position[f])
    return orders, steps


def _cells(k: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """For each (order, step) which masks each count takes: 0/1 matrices of shape (orders * steps, masks)."""
    orders, steps = removal_steps(k)
    mask = np.arange(1 << k)
    filter_at = np.array(orders)  # (orders, steps)
    removed = steps.T[:, None, :] == np.arange(1, k + 1)[:, None]
    gone = steps.T[:, None, :] < np.arange(1, k + 1)[:, None]
    fails = (mask >> filter_at[:, :, None] & 1).astype(bool)
    alone = mask == 1 << filter_at[:, :, None]
    kinds = {"kept": ~gone & ~removed, "removed": removed, "redundant": gone & fails, "unique_fails": alone}
    return orders, {n: m.reshape(-1, 1 << k).astype(np.int64) for n, m in kinds.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step; ``masks``: part, mask int, n, good, toxic (long), several rows of a mask added up.

    Columns part, filter_order, step and ``COUNTS``; the i-th letter of ``filters`` is bit i of a mask.
    """
    k = len(filters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters have their orders listed")
    weights = ("n", "good", "toxic")
    by_mask = masks.groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in weights])
    # A part's weights are one row of at most 2**k masks.
    wide = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", *weights)).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, cells = _cells(k)
        names = pa.array(np.repeat(["".join(filters[f] for f in o) for o in orders], k))
        step = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))
        which = np.array(orders).ravel()
        for batch in batches:
            for r in batch.to_pylist():
                n, good, toxic = table = np.zeros((3, 1 << k), np.int64)
                for m in r["masks"]:
                    table[:, m["mask"]] = [m[w] for w in weights]
                out = {name: cell @ n for name, cell in cells.items()}
                out["good_lost"], out["toxic_lost"] = cells["removed"] @ good, cells["removed"] @ toxic
                total = np.zeros(k, np.int64)
                np.add.at(total, which, out["removed"])
                out["shapley"] = total[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(which), pa.string()), names, step, *(pa.array(out[c]) for c in COUNTS)],
                    ["part", "filter_order", "step", *COUNTS],
                )

    return wide.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def _words(data: bytes) -> tuple[int, int]:
    """Number of words and of different ones (``bytes.split`` takes the six ASCII white-space characters)."""
    n, seen, at = 0, set(), 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data):  # back to the last white space, or on to the next one
            cut = max(data.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if cut <= at:
                found = [x for x in (data.find(c, end) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if x >= 0]
                cut = min(found, default=len(data))
            end = cut
        words = data[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, hash and the mask of the filters that look at a text alone (bits 0 to 3)."""
    for batch in batches:
        hashes, masks = [], []
        for t in batch.column(2):
            text = t.as_py() or ""
            data = text.encode()
            words, distinct = _words(data)
            capitals = len(data) - len(data.translate(None, CAPITALS))
            hashes.append(hashlib.sha256(data).digest())
            masks.append(
                (words < LEAST_WORDS)
                | (100 * distinct < LEAST_DISTINCT * words) << 1
                | (100 * capitals > MOST_CAPITALS * len(text)) << 2
                | any(s in data for s in SIGNS) << 3
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(masks, pa.int32())], ["doc_id", "part", "hash", "mask"]
        )


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(condition.cast("int")), F.lit(0)).cast("long")


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic of the five filters; ``docs``: doc_id, source, text, ``labels``: doc_id, quality, toxic."""
    flags = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(
        text_flags, "doc_id long, part string, hash binary, mask int"
    )
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        _any(F.col("quality") == 1).alias("good"), _any(F.col("toxic") == 1).alias("toxic")
    )
    # Rows without doc_id meet no label; a number of their own keeps them from meeting in one task.
    lone = F.when(F.col("doc_id").isNull(), F.xxhash64("hash", "part")).alias("_lone")
    zero = F.lit(0).cast("long")
    d = written(flags.select("*", lone).groupBy("doc_id", "_lone", "part", "hash", "mask").agg(F.count("*").alias("n")))
    d = d.where("doc_id IS NOT NULL").join(known, "doc_id", "left").select(
        "doc_id", "part", "hash", "mask", "n", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic")
    ).unionByName(d.where("doc_id IS NULL").select("doc_id", "part", "hash", "mask", "n", zero.alias("good"), zero.alias("toxic")))
    first = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    alike = d.groupBy("hash", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(first).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("lone")
    )
    return _copies(alike)


def _copies(alike: DataFrame) -> DataFrame:
    """Sets bit 4 for copies of a text with smaller doc_id."""
    least = alike.groupBy("hash").agg(F.min("first.doc_id").alias("least"))
    met = alike.join(least, "hash")
    # Of one kind, those with the smallest doc_id of the text are no copies, nor are those without doc_id.
    whole = F.col("lone") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = met.select("part", "mask", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("bit"), whole.alias("n")), F.struct(F.lit(16).alias("bit"), (F.col("n") - whole).alias("n"))
    )).alias("x"))
    mask = F.col("mask").bitwiseOR(F.col("x.bit"))
    return split.groupBy("part", mask.alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole texts of ``docs``."""
    return audit(document_masks(docs, labels))


_FAILS = {
    "A": f"nw < {LEAST_WORDS}", "B": f"100 * nd < {LEAST_DISTINCT} * nw", "C": f"100 * nc > {MOST_CAPITALS} * length(text)",
    "D": "regexp_matches(text, '[#$%&*|]')", "E": "coalesce(u.doc_id > min(u.doc_id) OVER (PARTITION BY text), false)",
}

SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS nc FROM documents
), u AS (SELECT *, len(w) AS nw, len(list_distinct(w)) AS nd FROM t
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, {' || '.join(f"CASE WHEN {c} THEN '{k}' ELSE '' END" for k, c in _FAILS.items())} AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM u LEFT JOIN l ON u.doc_id = l.doc_id
), m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o
), r AS (
  SELECT m.*, filter_order, list_min(list_transform(string_split(fails, ''), lambda x: CASE WHEN x = '' THEN 6 ELSE instr(filter_order, x) END)) AS hit
  FROM m, o
), g AS (
  SELECT part, filter_order, step,
         sum(CASE WHEN coalesce(hit, 6) > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM r JOIN s USING (filter_order) GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM g
"""
