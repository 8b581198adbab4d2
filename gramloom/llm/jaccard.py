"""Exact n-gram Jaccard join: which documents share a given part of their word shingles.

Method. Distinct shingle sets are compared in size-banded tiles: sets are laid out as rows of hashed
bitmap signatures, and the bits one set has and another lacks bound their overlap from above; only
pairs that pass the bound have their sorted shingle arrays intersected.

Which sets meet in a tile. Under any fixed order of all shingles, two sets with Jaccard >= t share a
shingle within the first |x| - ceil(t |x|) + 1 of each (prefix filter). Of sets that share such a shingle only those are tied whose sizes, and
its place in each, leave room for enough shared ones behind it (length and position filter; ``_ties``); the connected pieces of these ties are
*families*. Links can only lie within a family. The order is by how many different texts have a shingle, rare ones first, so texts that share a
passage, but little else, are not tied. For it the shingles in the lower ``COUNTED`` part of the hash space are counted
over one text of each class (see below), and the logarithms of counts above one are kept in a hashed table of bounded size (see
``counts``). What it mistakes only changes the order, never the result. Shingles that are not
counted come last. A counted shingle of one text needs no row at all.

A family of up to ``TILE`` sets is one tile. A larger one is cut by size band and a hash: first twice
by itself (two different cuts), which joins nearly all of a group of near copies; then only sets
outside a family's largest component meet the rest, tile by tile (of ``8 * TILE`` sets). Two sets already known to be
connected are not compared again, so a tile of n copies takes some n comparisons and gives at most
n - 1 links.

Rows with equal sets form a *class*, which has a number of its own and one text; everything after the first pass is about
classes. Rows that share a doc_id are tied by links between their classes, so a doc_id with several texts is one node
however its texts are compared.

Memory: texts are hashed in stretches of rows of about ``textkit.CHUNK_BYTES``, a longer one alone (some 60 bytes for each of its own); a
tile holds up to ``TILE`` sets (16 times as many where parts of a family meet) and ``TILE_BYTES`` of text, or one longer text.

Edge cases: a null or empty text has an empty set and is linked with nothing. Rows of one text form
one class with each other (except empty ones). Rows that share a doc_id are one node. A row
without doc_id is returned with its set size and without component. Other columns are not read. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm import textkit
from gramloom.llm.common import gives_back, written
from gramloom.llm.components import connected_components
from gramloom.llm.counts import levels, mark_table, shared_table

#: Sets in a tile. Signatures of a tile take TILE * SIGNATURE_BITS / 8 bytes.
TILE = 512
SIGNATURE_BITS = 1024
#: Shingles below this part of the hash space are counted; prefixes rarely reach beyond.
COUNTED = 0.4
#: Bytes of text in a tile, and in a group of small families.
TILE_BYTES, GROUP_BYTES = 16 << 20, 8 << 20


def _probe_prefix(n: int, t: tuple[int, int]) -> int:
    """Shingles at the front of a set of n of which a set with Jaccard >= t shares one."""
    p, q = t
    return n - -(-p * n // q) + 1


def _summaries(k: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, size = [], [], [], [np.zeros(0, np.int64)]
            for _, data, offsets in textkit.chunks(batch.column(2)):
                size.append(np.diff(offsets))
                for s in textkit.shingle_sets(*textkit.word_hashes(data, offsets, lower=True), k):
                    n.append(len(s))
                    k1.append(int(s.sum(dtype=np.uint64)))
                    k2.append(int(textkit.mix(s).sum(dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.concatenate(size)), pa.array(n, pa.int64()),
                    *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (k1, k2)),
                ],
                ["doc_id", "th", "size", "n_shingles", "k1", "k2"],
            )

    return run


_LIMIT = np.uint64(int(COUNTED * (1 << 64)))


def _wanted(batch: pa.RecordBatch, marks) -> pa.RecordBatch:
    """Rows of a batch whose token, its first column, is in the shared table ``marks``, and few others."""
    return batch.filter(pa.array(levels(batch.column(0).to_numpy().view(np.uint64), marks.value) > 0))


def _counted(k: int, marks):
    """The shingles that are counted, once for each row that has them."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in textkit.chunks(_wanted(batch, marks).column(1)):
                parts = [s[: np.searchsorted(s, _LIMIT)] for s in textkit.shingle_sets(*textkit.word_hashes(data, offsets, lower=True), k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["token"])

    return run


def _reach(n: int, places: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """The size of the largest set that may link to a set of n, if the first shingle they share is the set's ``places``-th (from 0).

    They share n - place at most, and p / (p + q) of both sizes together if Jaccard >= p / q.
    """
    p, q = t
    return (q * n - (p + q) * places) // p


def _prefixes(k: int, t: tuple[int, int], marks, shared):
    """(token, set size, set key, reach) of the prefix of each row's set, without shingles that surely no other set has."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = shared.value, set()
        for batch in batches:
            for _, data, offsets in textkit.chunks(_wanted(batch, marks).column(1)):
                tokens, keys, sizes, reaches = ([np.zeros(0, kind)] for kind in (np.uint64, np.uint64, np.int64, np.int64))
                for s in textkit.shingle_sets(*textkit.word_hashes(data, offsets, lower=True), k):
                    key = int(s.sum(dtype=np.uint64))
                    if key in done:  # a copy of a text of this task
                        continue
                    done.add(key)
                    level = levels(s, table)
                    level[np.searchsorted(s, _LIMIT) :] = 255  # not counted: last
                    order = np.argsort(level, kind="stable")[: _probe_prefix(len(s), t)]
                    place = np.flatnonzero(level[order] > 0)
                    if len(place):
                        tokens.append(s[order][place])
                        keys.append(np.full(len(place), key, np.uint64))
                        sizes.append(np.full(len(place), len(s)))
                        reaches.append(_reach(len(s), place, t))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sizes), pa.int32()),
                        pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(reaches), pa.int32()),
                    ],
                    ["token", "size", "key", "reach"],
                )

    return run


@gives_back
def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token, size and key: (a, b), keys of sets that the token ties.

    Two sets may link if neither is larger than the other's reach. *Early* ones reach their own size at least. Such sets in a row are
    tied while one before reaches them: all early ones that may link are then connected, as those of sizes between them are
    reached too. Another set can only be the larger one of a link; those that it may link to are all connected, and it is tied to the last early one.

    Only the token at hand and one row that stands for its sets so far are carried from batch to batch, so a token that a third
    of all rows have takes no more memory than any other.
    """
    last = None  # token, size of the first set in the row at hand, key of the last early one, largest reach
    for batch in batches:
        if not batch.num_rows:
            continue
        token, size, key, reach = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        if last is not None and token[0] == last[0]:
            token, size, key, reach = (np.concatenate([[x], y]) for x, y in zip(last, (token, size, key, reach), strict=True))
        at = np.arange(len(token))
        group = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]])) << 32
        early = reach >= size
        reached = np.maximum.accumulate(group + np.where(early, reach, -1))
        before = np.concatenate([[-1], reached[:-1]]) - group
        tied = before >= size
        back = lambda x: np.maximum.accumulate(np.where(x, at, -1))
        previous = np.concatenate([[-1], back(early)[:-1]])
        first = back(early & ~tied)
        tied &= early | (size[first] <= reach)
        pairs = np.stack([key[previous[tied]], key[tied]], 1)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        end = back(early)[-1]
        # Without an early one of the last token, what is carried reaches nothing.
        known = end >= 0 and token[end] == token[-1]
        last = (token[-1], size[first[end]], key[end], reached[-1] - group[-1]) if known else None
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), SIGNATURE_BITS // 64), np.uint64)
    for i, s in enumerate(sets):
        bit = textkit.mix(s) & np.uint64(SIGNATURE_BITS - 1)
        np.bitwise_or.at(out[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def tile_links(
    ids: list[int], sets: list[np.ndarray], t: tuple[int, int], joined: list[int], cross: tuple[np.ndarray, ...] | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of a tile.

    ``joined`` holds what is known to be connected (equal numbers). ``cross``: two masks; then only
    pairs of one set of each side are looked at.
    """
    p, q = t
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    sizes, signs = np.array([len(s) for s in sets]), _signatures(sets)
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    for i, o in enumerate(order):
        parent[root(i)] = root(seen.setdefault(joined[o], i))
    roots = np.array([root(i) for i in range(len(ids))])
    left, right = (x[order] for x in cross) if cross else (np.ones(len(ids), bool),) * 2
    links = []
    for i in range(1, len(ids)):
        low = int(np.searchsorted(sizes, -(-p * sizes[i] // q)))
        if low >= i:
            continue
        open_ = (roots[low:i] != roots[i]) & ((left[low:i] & right[i]) | (right[low:i] & left[i]))
        near = low + np.flatnonzero(open_)
        if not len(near):
            continue
        # Bits that one set has and the other lacks: shingles that are not shared.
        only_j = np.bitwise_count(signs[near] & ~signs[i]).sum(1, dtype=np.int64)
        only_i = np.bitwise_count(signs[i] & ~signs[near]).sum(1, dtype=np.int64)
        bound = np.minimum(sizes[near] - only_j, sizes[i] - only_i)
        near = near[(p + q) * bound >= p * (sizes[near] + sizes[i])]
        for j in near[::-1]:
            if roots[j] == roots[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if (p + q) * common >= p * (sizes[i] + sizes[j]):
                links.append((ids[j], ids[i]))
                roots[roots == roots[i]] = roots[j]
    return links


def _tile_job(k: int, t: tuple[int, int], by: str | None):
    """Links of the tiles in a group; ``by``: the column that separates tiles within a group."""

    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        rows: dict[int, list[int]] = {}
        for i, key in enumerate(table.column(by).to_pylist() if by else [0] * table.num_rows):
            rows.setdefault(key, []).append(i)
        ids, joined = table.column("rep").to_pylist(), table.column("joined").to_pylist()
        side = table.column("side").to_numpy()
        text = table.column("text").combine_chunks()
        text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
        sets: list[np.ndarray] = []
        for _, data, offsets in textkit.chunks(text):
            sets += textkit.shingle_sets(*textkit.word_hashes(data, offsets, lower=True), k)
        for own in rows.values():
            s = side[own]
            cross = (s != 2, s != 1) if s.any() else None
            for x, y in tile_links([ids[i] for i in own], [sets[i] for i in own], t, [joined[i] for i in own], cross):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _band(n, t: tuple[int, int], shift: float = 0.0):
    """The size band of a set: sets with Jaccard >= t lie in the same or neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / math.log(t[1] / t[0]) + shift).cast("long")


def _token() -> Column:
    return F.xxhash64("doc_id", "th").alias("token")


def _tokens(classes: DataFrame) -> DataFrame:
    """What ``_wanted`` finds the texts of classes by."""
    return written(classes.select(_token()))


def _families(docs: DataFrame, classes: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """(key, family) of the sets that share a prefix shingle with another one that is near enough in size."""
    # One text of each class will do; the few others that are read as well only change the order of the shingles.
    with shared_table(_tokens(classes), mark_table) as marks:
        rows = docs.select(_token(), "text")
        counts = written(rows.mapInArrow(_counted(k, marks), "token long").groupBy("token").count().where("count > 1"))
        with shared_table(counts) as shared:
            ties = (
                rows.mapInArrow(_prefixes(k, t, marks, shared), "token long, size int, key long, reach int").repartition("token")
                .sortWithinPartitions("token", "size", "key").mapInArrow(_ties, "a long, b long")
            )
            families = connected_components(ties)
    return families.select(F.col("node").alias("key"), F.col("component").alias("family"))


def _tiles(sets: Column, size: Column, times: int = 1, part: int = 1) -> Column:
    """How many tiles of ``times`` as many sets, or parts of one in bytes, so many sets and bytes of text fill."""
    return F.ceil(F.greatest(sets / (TILE * times), size / max(TILE_BYTES // part, 1)))


def _marked(marks):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _wanted(batch, marks)

    return run


def _texts(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, large and text of each class of ``sets``: the texts that aren't wanted are left out before the join shuffles them."""
    wanted = sets.select("rep", "doc_id", "th", "large")
    with shared_table(_tokens(wanted), mark_table) as marks:
        some = written(docs.select(_token(), "doc_id", "th", "text").mapInArrow(_marked(marks), "token long, doc_id long, th long, text string"))
    return written(some.drop("token").join(wanted, ["doc_id", "th"]).select("rep", "large", "text").dropDuplicates(["rep"]))


def _large_families(texts: DataFrame, sets: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """Links within families of more than a tile; ``sets``: rep, size, n_shingles, family."""
    job = _tile_job(k, t, None)
    known, links = sets.withColumn("joined", F.col("rep")), None
    for turn in (0, 1):
        cell = known.withColumn("band", _band(F.col("n_shingles"), t, turn / 2))
        tiles = cell.groupBy("family", "band").agg(_tiles(F.count("*"), F.sum("size")).alias("tiles"))
        cell = cell.join(tiles, ["family", "band"]).withColumn(
            "part", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("tiles")).cast("long")
        )
        found = (
            cell.select("rep", "joined", "family", "band", "part", F.lit(0).alias("side")).join(texts, "rep")
            .groupBy("family", "band", "part").applyInArrow(job, "a long, b long")
        )
        links = written(found if links is None else links.unionByName(found))
        comp = connected_components(links).withColumnRenamed("node", "rep")
        known = written(sets.join(comp, "rep", "left").withColumn("joined", F.coalesce("component", "rep")).drop("component"))
    # What is left: sets outside their family's largest component against all others of near sizes.
    counts = known.groupBy("family", "joined").count()
    largest = counts.groupBy("family").agg(F.max(F.struct("count", "joined")).alias("m"), F.count("*").alias("parts"))
    open_ = largest.where("parts > 1").select("family", F.col("m.joined").alias("main"))
    cell = known.join(open_, "family").withColumn("band", _band(F.col("n_shingles"), t)).withColumn(
        "rest", F.col("joined") != F.col("main")
    )
    rest_of = lambda c: F.sum(F.when(F.col("rest"), c).otherwise(0))
    tiles = cell.groupBy("family", "band").agg(
        # Of many short texts more make a tile: each text goes to all parts of the other side.
        _tiles(rest_of(F.lit(1)), rest_of(F.col("size")), 8, 2).alias("rests"), _tiles(F.count("*"), F.sum("size"), 8, 2).alias("alls")
    )
    cell = written(cell.join(tiles, ["family", "band"]))
    near = tiles.select("family", F.col("band").alias("other"), "rests", "alls")
    part = lambda n: F.pmod(F.xxhash64("rep", F.lit(2)), n).cast("long")
    # Side 1: the rest, once for each part of all sets in its own and the neighbouring bands. Side 2: all sets.
    steps = F.explode(F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1))))
    rest = (
        cell.where("rest").withColumn("step", steps).withColumn("other", F.col("band") + F.col("step")).drop("rests", "alls")
        .join(near, ["family", "other"]).join(tiles.select("family", "band", F.col("rests").alias("own")), ["family", "band"])
        .withColumn("r", part(F.col("own"))).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alls") - 1)))
        .select("rep", "joined", "family", F.col("band").alias("b1"), F.col("other").alias("b2"), "r", "p", F.lit(1).alias("side"))
    )
    everything = (
        cell.withColumn("p", part(F.col("alls"))).withColumn("step", steps).withColumn("other", F.col("band") + F.col("step"))
        .drop("rests", "alls").join(near, ["family", "other"]).where("rests > 0")
        .withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)))
        .select("rep", "joined", "family", F.col("other").alias("b1"), F.col("band").alias("b2"), "r", "p", F.lit(2).alias("side"))
    )
    found = (
        rest.unionByName(everything).join(texts, "rep")
        .groupBy("family", "b1", "b2", "r", "p").applyInArrow(job, "a long, b long")
    )
    return links.unionByName(found)


def _links(docs: DataFrame, classes: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """(a, b): links between classes that connect all classes which links connect."""
    families = _families(docs, classes, k, t).withColumnRenamed("key", "k1")
    members = written(classes.join(families, "k1").select("rep", "doc_id", "th", "size", "n_shingles", "family"))
    sizes = members.groupBy("family").agg(F.count("*").alias("sets"), F.sum("size").alias("bytes"))
    big = written(sizes.where((F.col("sets") > TILE) | (F.col("bytes") > TILE_BYTES)).select("family"))
    members = written(members.join(big.withColumn("large", F.lit(True)), "family", "left").withColumn("large", F.coalesce("large", F.lit(False))))
    small = members.where("NOT large")
    n_groups = int(small.agg(F.sum("size")).first()[0] or 0) // GROUP_BYTES + 1
    texts = _texts(docs, members)
    members = members.select("rep", "size", "n_shingles", "family", "large")
    links = (
        texts.where("NOT large").join(small.select("rep", "family"), "rep")
        .select("rep", F.col("rep").alias("joined"), "family", F.lit(0).alias("side"), "text", F.pmod(F.xxhash64("family"), F.lit(n_groups)).alias("part"))
        .groupBy("part").applyInArrow(_tile_job(k, t, "family"), "a long, b long")
    )
    if not big.isEmpty():
        large = texts.where("large").select("rep", "text")
        links = links.unionByName(_large_families(large, members.where("large").drop("large"), k, t))
    return links


def _shared_ids(own: DataFrame) -> DataFrame:
    """(a, b): links between the classes that rows of one doc_id are in; ``own``: doc_id, rep."""
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    return own.join(several, "doc_id").where(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id long, text string).

    ``threshold`` is a fraction: documents link when intersection / union of their distinct k-word
    shingles (letters A-Z lowered) is at least that. ``component_id`` is the smallest doc_id
    that links reach.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    base = written(docs.mapInArrow(_summaries(k), "doc_id long, th long, size long, n_shingles long, k1 long, k2 long"))
    filled = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["k1", "k2", "n_shingles"]
    classes = filled.groupBy(*key).agg(F.min(F.struct("doc_id", "th", "size")).alias("first")).select(*key, "first.*")
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()))
    # A class is found by what makes it one; rows without doc_id or words are in none.
    of_row = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("rep")).alias("rep")
    own = written(base.join(classes.select(*key, "rep"), key, "left").select("doc_id", "n_shingles", of_row))
    links = _links(docs.where("doc_id IS NOT NULL"), classes, k, threshold)
    links = links.unionByName(_shared_ids(own.where("rep IS NOT NULL").select("doc_id", "rep")))
    comp = connected_components(links).withColumnRenamed("node", "rep")
    ids = classes.select("rep", F.col("doc_id").alias("id"))
    named = comp.join(ids, "rep").groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = written(ids.join(comp.join(named, "component"), "rep", "left").select("rep", F.coalesce("component_id", "id").alias("component_id")))
    return own.join(of_class, "rep", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
