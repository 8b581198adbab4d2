"""Source divergence audit: how far the words of each source of a language are from those of its other sources.

With p = 1 + floor(SCALE * (count + 1) / (N + V)) for a term of a group (lang, source), V kept terms of the language and N
occurrences of them in the group, and q the same of another group or of the whole language, the divergence of a term is
f = floor((p - q)**2 / q). All numbers are integers: p by 64 bits or, for counts beyond nine thousand million, by decimals of 38 digits, f by 64 bits ((p - q)**2 is below 2**63).

Method, part ``term`` (the ``TOP`` most divergent terms of each group): *dominance skyband*. f rises with a term's count in the
group and falls with its count in the language, as long as p > q; equal values go by UTF-8. So a term comes before another one
for sure if its group count isn't lower, its language count isn't higher and its UTF-8 is earlier: it
dominates it. A term that ``TOP`` others dominate can't be listed. Each partition sorts its counts by group and keeps
only the terms that fewer than ``TOP`` others dominate; these skybands are merged the same way (a group of more than ``MERGED`` terms is
dealt over tasks first), as a dominated term stays dominated in any union, and only what is left is ranked by exact values. No values are sorted for whole vocabularies, and a group of a third of all rows is cut down where it lies.

Part ``pair``: the sum of f over all kept terms for each ordered pair of sources of a language. A term's counts in all sources are one
row; tasks add matrices of f for square tiles of ``TILE`` sources, over the terms that occur in either side, and count all others by the one value
they share (f of two zero counts). So a language of any size is dealt over tasks by its terms.

Edge cases: null text, lang and source are ''. A group without terms is compared with all others like any; if its language
keeps no term, every value is 0. A language of one source has no ``pair`` rows. Repeated rows count again, as documents of
their own. Other columns are not read. An empty table gives no row. Long texts are cut at a blank-like byte into stretches; only their different terms are held.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import written

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
TILE = 128
SALT = 32
#: Different (group, term) counts gathered in a task before they go on.
GATHERED = 400_000
#: Terms of a group that one task merges.
MERGED = 250_000
#: Terms that are held against the skyband so far at once.
BLOCK = 4096
STRETCH = 1 << 20
#: Every byte that is no part of a term becomes a blank, capitals become small letters.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

COUNTS = "lang string, source string, term binary, n long, docs long"


def _terms(data: bytes) -> Iterator[list[bytes]]:
    data = data.translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data):
            end = data.rfind(b" ", at, end)
            if end <= at:
                end = data.find(b" ", at + STRETCH)
                end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS rows; a row without term says that the group occurs."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *n]
            k = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k), pa.array([source] * k), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()),
                 pa.array([0, *(docs[t] for t in n)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for batch in batches:
        names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for key, text in zip(names, batch.column(2), strict=True):
            n, docs = groups[key]
            own: set[bytes] = set()
            before = len(n)
            for terms in _terms((text.as_py() or "").encode()):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(n) - before
            if size > GATHERED:
                yield from out()
                size = 0
    yield from out()


def _probability(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, exactly: SCALE * (count + 1) has up to 29 digits."""
    wide = (count + F.lit(1)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    wide = F.floor(_quotient(wide, (total + kept).cast("decimal(20,0)"))).cast("long")
    short = _quotient((count + F.lit(1)) * F.lit(SCALE).cast("long"), total + kept)
    return F.lit(1).cast("long") + F.when(count < (1 << 63) // SCALE - 1, short).otherwise(wide)


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


# ---- skyband

SKYBAND = "lang string, source string, n long, lang_n long, term binary"


class _Skyband:
    """Terms of one group that fewer than ``k`` others dominate, fed in the order n down, lang_n up, term up."""

    def __init__(self, k: int):
        self.k = k
        self.n = self.lang_n = np.zeros(0, np.int64)
        self.terms: list[bytes] = []

    def feed(self, n: np.ndarray, lang_n: np.ndarray, terms: list[bytes]) -> None:
        # What dominates a term came before it. If k do, k that are kept do, as those dropped are dominated by k themselves.
        every = self.terms + terms
        rank = np.empty(len(every), np.int32)
        rank[pc.sort_indices(pa.array(every, pa.binary())).to_numpy()] = np.arange(len(every), dtype=np.int32)
        old, lang_n = len(self.terms), np.append(self.lang_n, lang_n)
        _, level = np.unique(lang_n, return_inverse=True)
        level = level.astype(np.int32)
        kept = np.arange(old)
        for at in range(old, len(every), BLOCK):
            block = np.arange(at, min(at + BLOCK, len(every)))
            if len(kept) >= self.k:
                levels, limit = self._staircase(level[kept], rank[kept])
                place = np.searchsorted(levels, level[block], "right") - 1
                block = block[(place < 0) | (rank[block] <= limit[place])]
            for part in np.split(block, range(256, len(block), 256)):
                own_level, own_rank = level[part][:, None], rank[part][:, None]
                number = np.count_nonzero((level[kept] <= own_level) & (rank[kept] < own_rank), axis=1)
                among = (level[part] <= own_level) & (rank[part] < own_rank) & (part < part[:, None])
                kept = np.concatenate([kept, part[number + np.count_nonzero(among, axis=1) < self.k]])
        self.n, self.lang_n = np.append(self.n, n)[kept], lang_n[kept]
        self.terms = [every[i] for i in kept.tolist()]

    def _staircase(self, lang_n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language counts in order, and the k-th smallest rank among the terms up to each: a later one that ranks higher is dominated by k."""
        order = np.argsort(lang_n, kind="stable")
        least: list[int] = []
        limit = np.full(len(order), np.iinfo(np.int64).max)
        for i, r in enumerate(rank[order].tolist()):
            if len(least) < self.k:
                heapq.heappush(least, -r)
            else:
                heapq.heappushpop(least, -r)
            if len(least) == self.k:
                limit[i] = -least[0]
        return lang_n[order], limit


def _skybands(k: int):
    """Rows sorted by (lang, source, n down, lang_n up, term): those of each group's skyband."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, band = None, _Skyband(k)

        def out() -> pa.RecordBatch:
            m = len(band.terms)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * m, pa.string()), pa.array([key[1]] * m, pa.string()), pa.array(band.n), pa.array(band.lang_n),
                 pa.array(band.terms, pa.binary())],
                ["lang", "source", "n", "lang_n", "term"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1] or sources[i] != sources[i - 1]), len(langs)]
            n, lang_n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (langs[a], sources[a]) != key:
                    if key is not None:
                        yield out()
                    key, band = (langs[a], sources[a]), _Skyband(k)
                band.feed(n[a:b], lang_n[a:b], batch.column(4).slice(a, b - a).to_pylist())
        if key is not None:
            yield out()

    return run


def skyband(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The rows of ``counts`` (lang, source, n, lang_n, term) that fewer than ``top`` others of their group dominate."""
    columns = ["lang", "source", "n", "lang_n", "term"]
    order = ["lang", "source", F.col("n").desc(), "lang_n", "term"]
    keep = lambda rows: rows.sortWithinPartitions(*order).mapInArrow(_skybands(top), SKYBAND)
    some = written(keep(counts.select(*columns)))
    while True:
        most = some.groupBy("lang", "source").count().agg(F.max("count")).first()[0] or 0
        if most <= MERGED:
            return keep(some.repartition("lang", "source"))
        # More than one task should merge: the group is dealt over as many as it fills. Each round's skybands are far smaller.
        part = F.pmod(F.xxhash64("term"), F.lit(-(-most // MERGED) + 1))
        merged = written(keep(some.repartition("lang", "source", part)))
        if merged.count() > 0.9 * some.count():  # few are dominated: the last round takes them as they are, in blocks
            return keep(merged.repartition("lang", "source"))
        some = merged


# ---- sums over pairs of sources


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of f over the terms of each (lang, a, b, slice), without that of two zero counts.

    Rows are sorted by these and ``head``; the first of a slice has the p of zero counts of both sides, the others the places and
    p of the sources that have the term.
    """
    key = total = zero = base = None

    def add(sides: list[pa.ListArray], first: int, end: int) -> None:
        step = max((1 << 20) // total.size, 1)
        for low in range(first, end, step):
            high = min(low + step, end)
            left, right = (np.tile(z, (high - low, 1)) for z in zero)
            for out, at, p in ((left, *sides[:2]), (right, *sides[2:])):
                offsets = at.offsets.to_numpy()[low : high + 1]
                cut = slice(int(offsets[0]), int(offsets[-1]))
                out[np.repeat(np.arange(high - low), np.diff(offsets)), at.values.to_numpy()[cut]] = p.values.to_numpy()[
                    int(p.offsets[low].as_py()) : int(p.offsets[high].as_py())
                ]
            total[:] += ((left[:, :, None] - right[:, None, :]) ** 2 // right[:, None, :] - base).sum(0)

    def done() -> pa.RecordBatch:
        i, j = np.nonzero(total)
        k = len(i)
        lang, a, b, _ = key
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * k, pa.string()), pa.array(a * TILE + i, pa.int32()), pa.array(b * TILE + j, pa.int32()), pa.array(total[i, j])],
            ["lang", "a", "b", "value"],
        )

    for batch in batches:
        sides = [batch.column(c) for c in ("at_a", "p_a", "at_b", "p_b")]
        heads = np.flatnonzero(batch.column("head").to_numpy() == 0).tolist()
        # Rows up to the first head belong to the slice before; each head begins one of its own.
        if key is not None:
            add(sides, 0, heads[0] if heads else batch.num_rows)
        for i, end in zip(heads, [*heads[1:], batch.num_rows], strict=False):  # nothing without heads
            if key is not None:
                yield done()
            key = tuple(batch.column(c)[i].as_py() for c in ("lang", "ta", "tb", "slice"))
            zero = tuple(np.array(sides[c][i].as_py(), np.int64) for c in (1, 3))
            base = (zero[0][:, None] - zero[1][None, :]) ** 2 // zero[1][None, :]
            total = np.zeros_like(base)
            add(sides, i + 1, end)
    if key is not None:
        yield done()


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (places of sources) and the sum of f over all kept terms of the language.

    ``kept``: lang, term, place, p of terms that occur; ``groups``: lang, source, place, p0 (of a zero count), v (kept terms).
    """
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    inside = lambda c: (F.col(c) % TILE).cast("int")
    sides = groups.select("lang", tile("place").alias("t"), F.struct(inside("place").alias("at"), F.col("p0").alias("p")).alias("x"))
    sides = sides.groupBy("lang", "t").agg(F.sort_array(F.collect_list("x")).alias("x"))  # TILE sources at most
    tiles = written(sides)
    a, b = (tiles.select("lang", F.col("t").alias(f"t{s}"), F.col("x.at").alias(f"at_{s}"), F.col("x.p").alias(f"p_{s}")) for s in "ab")
    names = ["lang", "ta", "tb", "slice", "head", "at_a", "p_a", "at_b", "p_b"]
    heads = a.join(b, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("head", F.lit(0))
    # A term's counts in all sources are one row, cut for each pair of tiles of which either has the term.
    terms = kept.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p")).alias("x"))
    of_lang = tiles.groupBy("lang").agg(F.collect_list("t").alias("tiles"))
    met = terms.join(of_lang, "lang").withColumn("ta", F.explode("tiles")).withColumn("tb", F.explode("tiles"))
    cut = lambda t: F.filter("x", lambda y: F.floor(y["place"] / TILE) == F.col(t))
    met = met.select("lang", "ta", "tb", F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int").alias("slice"), cut("ta").alias("xa"), cut("tb").alias("xb"))
    met = met.where((F.size("xa") > 0) | (F.size("xb") > 0))
    places = lambda c, s: [F.transform(f"{c}.place", lambda i: (i % TILE).cast("int")).alias(f"at_{s}"), F.col(f"{c}.p").alias(f"p_{s}")]
    met = met.select("lang", "ta", "tb", "slice", F.lit(1).alias("head"), *places("xa", "a"), *places("xb", "b"))
    rows = heads.select(*names).unionByName(met.select(*names)).repartition("lang", "ta", "tb", "slice")
    sums = rows.sortWithinPartitions("lang", "ta", "tb", "slice", "head").mapInArrow(_tiles, "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


# ---- the audit


def audit_sources(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of ``docs`` (lang, source, text)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(name("lang"), name("source"), "text").mapInArrow(_counted, COUNTS)
    counts = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = written(terms.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    kept = written(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    # A number for each source of a language; sources are names, not documents.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(groups.select(
        "lang", "source", place.alias("place"), F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"), F.coalesce("lang_total", zero).alias("lang_total"),
    ).withColumn("p0", F.when(F.col("v") > 0, _probability(zero, F.col("total"), F.col("v"))).otherwise(1)))
    known = kept.join(groups, ["lang", "source"])
    p, q = _probability(F.col("n"), F.col("total"), F.col("v")), _probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))

    some = known.where(p > q).select("lang", "source", "n", "lang_n", "term")
    best = skyband(some, top).join(groups, ["lang", "source"]).select("lang", "source", F.col("term").cast("string").alias("item"), _divergence(p, q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    sums = pair_sums(known.select("lang", "term", "place", p.alias("p")), groups)
    side = lambda s: groups.select("lang", F.col("source").alias(f"source_{s}"), F.col("place").alias(s), F.col("p0").alias(f"p0_{s}"), "v")
    pairs = side("a").join(side("b").drop("v"), "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    value = F.col("v") * _divergence(F.col("p0_a"), F.col("p0_b")) + F.coalesce("value", zero)
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(best.withColumn("part", F.lit("term")).select(*names))


_TERMS = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}') AS w FROM documents
), o AS (SELECT id, lang, source, unnest(w) AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL
), t AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}
), l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM t GROUP BY lang
), k AS (SELECT c.*, lang_n FROM c JOIN t USING (lang, term)
), g AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM k GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)
), p AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p,
         1 + ({SCALE}::HUGEINT * (t.lang_n + 1)) // (lang_total + v) AS q
  FROM g JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), f AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM f WHERE part = 'pair' OR rank <= {TOP}
"""
