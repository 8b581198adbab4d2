"""Substring dedup: removes words of passages that occur earlier in the corpus.

A window is ``WINDOW`` consecutive words of one document; a window whose words also start earlier (smaller
doc_id, or the same document further up) is repeated, and its words go.

Method. Suffix automata of reference shards: a shard's texts are read in corpus order; each is streamed through the
automaton of what came before for its matching statistics (the longest suffix at each word that occurs
earlier), positions of at least ``WINDOW`` words give the repeated windows, and then the text joins the automaton.

The reference is the corpus itself, so to stream every document past every shard would cost shards times documents.
Instead a text is cut where its content says, and its parts meet in one shard only:

* A window's *anchor* is its five-word shingle of least hash. Consecutive windows with the same anchor
  are a *run* of at most 35 words. Equal windows have equal anchors, so they lie in runs of one anchor.
* Anchors are counted over all documents. Their counts are kept in a hashed table of fixed size (broadcast); runs whose
  anchor surely occurs once are left out.
* Equal runs are found by a partial aggregate of their hash; all but the first are repeated as a whole. So a passage of any
  number of copies reaches a shard once.
* Runs that differ, of anchors that still have several, go to the anchor's shard, sized to ``SHARD_WORDS`` words.
* An anchor of more than ``HOT`` different runs would not fit a shard's bounds. Its runs are cut to single
  windows, which is exact as well: then all that can be equal are whole windows, found by the same aggregate.

Edge cases: a null text has no words; a text of fewer than ``WINDOW`` words has no window and stays. Rows with the
same doc_id and text are one document, and lose the same words; rows of one doc_id with other texts follow
each other by hash; a null doc_id comes first. Other columns are not read. A long text is handled alone, at some 60 bytes
for each of its own. Words are compared by 64-bit hashes, whole runs by 128 bits (their
anchor and words).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm import textkit
from gramloom.llm.common import written
from gramloom.llm.counts import levels, shared_table

WINDOW = 20
ANCHOR = 5
HOT = 2000
SHARD_WORDS = 60_000

_word = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each run of a document's word hashes."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    shingles = textkit.chain(words, anchor)
    width = window - anchor + 1
    at = np.lib.stride_tricks.sliding_window_view(shingles, width).argmin(1) + np.arange(len(shingles) - width + 1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return shingles[at[first]], first, np.diff(np.append(first, len(at)))


def window_hashes(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    n = max(len(words) - window + 1, 0)
    starts = np.arange(n)
    return textkit.span_hashes(words, starts, starts + window)


def _documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text."""
    for row, data, offsets in textkit.chunks(column):
        hashes, first = textkit.word_hashes(data, offsets)
        for i in range(len(offsets) - 1):
            yield row + i, hashes[first[i] : first[i + 1]]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs_of(w, window)[0] for _, w in _documents(batch.column(0))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    return run


RUNS = "anchor long, words long, doc_id long, th int, pos int, n int"


def _runs(window: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows, parts = [], []
            for row, words in _documents(batch.column("text")):
                anchor, first, n = runs_of(words, window)
                some = levels(anchor, table) > 0
                if some.any():
                    anchor, first, n = anchor[some], first[some], n[some]
                    w = window_hashes(words, window)
                    # The first and last window together cover a run.
                    whole = textkit.mix(textkit.mix(w[first]) + w[first + n - 1] * np.uint64(textkit.BASE) + n.astype(np.uint64))
                    parts.append((anchor.view(np.int64), whole.view(np.int64), first, n))
                    rows.append(np.full(len(first), row))
            if not parts:
                continue
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c) for c in columns[:2]), batch.column("doc_id").take(at), batch.column("th").take(at),
                 *(pa.array(c, pa.int32()) for c in columns[2:])],
                ["anchor", "words", "doc_id", "th", "pos", "n"],
            )

    return run


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def matching(self, words: list[int]) -> Iterator[int]:
        """For each word, the length of the longest suffix ending there that the automaton has."""
        follow, link, length = self.next, self.link, self.length
        state = n = 0
        for w in words:
            while state and w not in follow[state]:
                state = link[state]
                n = length[state]
            if w in follow[state]:
                state = follow[state][w]
                n += 1
            yield n

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        follow, link, length = self.next, self.link, self.length
        if w in follow[last]:
            old = follow[last][w]
            return old if length[old] == length[last] + 1 else self._split(last, w, old)
        new = len(length)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p != -1:
            old = follow[p][w]
            link[new] = old if length[old] == length[p] + 1 else self._split(p, w, old)
        return new

    def _split(self, p: int, w: int, old: int) -> int:
        """The state of the suffix one longer than p's, taken out of ``old``."""
        follow, link, length = self.next, self.link, self.length
        part = len(length)
        follow.append(dict(follow[old]))
        link.append(link[old])
        length.append(length[p] + 1)
        link[old] = part
        while p != -1 and follow[p].get(w) == old:
            follow[p][w] = part
            p = link[p]
        return part


SPANS = "doc_id long, th int, pos int, n int"


def _shard(window: int):
    """Repeated windows of a shard's runs, in corpus order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("th", "ascending"), ("pos", "ascending")])
        if table.column("doc_id").null_count:  # nulls sort last there, but come first here
            empty = table.column("doc_id").is_null()
            table = pa.concat_tables([table.filter(empty), table.filter(pa.compute.invert(empty))])
        automaton, rows, pos, n = Automaton(), [], [], []
        starts = table.column("pos").to_pylist()
        for i, words in enumerate(table.column("words").to_pylist()):
            hits = [j - window + 1 for j, m in enumerate(automaton.matching(words)) if m >= window]
            for k, h in enumerate(hits):
                if k and hits[k - 1] == h - 1:
                    n[-1] += 1
                else:
                    rows.append(i)
                    pos.append(starts[i] + h)
                    n.append(1)
            automaton.add(words)
        at = pa.array(rows, pa.int64())
        return pa.table({
            "doc_id": table.column("doc_id").take(at), "th": table.column("th").take(at),
            "pos": pa.array(pos, pa.int32()), "n": pa.array(n, pa.int32()),
        })

    return run


def _segments(window: int, single: bool):
    """The words of wanted runs, or (``single``) the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            rows, shard, pos, words_out, w1, w2 = [], [], [], [], [], []
            for row, words in _documents(batch.column("text")):
                if single:
                    w, v = window_hashes(words, window), window_hashes(textkit.mix(words), window)
                for item in wanted[row]:
                    a, b = item["pos"], item["pos"] + item["n"]
                    if single:
                        rows += [row] * (b - a)
                        pos += range(a, b)
                        w1.append(w[a:b])
                        w2.append(v[a:b])
                    else:
                        rows.append(row)
                        pos.append(a)
                        shard.append(item["shard"])
                        words_out.append(words[a : b + window - 1].view(np.int64))
            at = pa.array(rows, pa.int64())
            base = [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(pos, pa.int32())]
            if single:
                pair = [pa.array(np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64)) for x in (w1, w2)]
                yield pa.RecordBatch.from_arrays([*base, *pair], ["doc_id", "th", "pos", "w1", "w2"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [*base, pa.array(shard, pa.int64()), pa.array(words_out, pa.list_(pa.int64()))], ["doc_id", "th", "pos", "shard", "words"]
                )

    return run


def _later(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs at an earlier place; the first place of a key is a partial aggregate."""
    place = F.struct("doc_id", "th", "pos")
    several = rows.groupBy(*key).agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where(~F.col("_first").eqNullSafe(F.col("_last"))).drop("_last")
    return rows.join(several, key).where(~place.eqNullSafe(F.col("_first"))).drop("_first")


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` with equal rows given once; only texts of repeated rows are shuffled."""
    repeated = written(docs.groupBy("doc_id", "th").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "th"))
    if repeated.isEmpty():
        return docs
    d, r = docs.alias("d"), repeated.alias("r")
    return d.join(r, _same("d", "r"), "left_anti").unionByName(written(d.join(r, _same("d", "r"), "left_semi").dropDuplicates()))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th, pos, n: stretches of repeated windows (n of them, from word pos); ``docs``: doc_id, th, text."""
    # A second copy of a row would meet the first in its shard's automaton, and both would lose the words.
    docs = _once(docs)
    counts = docs.select("text").mapInArrow(_anchors(window), "token long").groupBy("token").count().where("count > 1")
    with shared_table(written(counts)) as shared:
        runs = written(docs.mapInArrow(_runs(window, shared), RUNS))
    # Each different run with its first place, found by a partial aggregate.
    place = F.struct("doc_id", "th", "pos")
    different = written(
        runs.groupBy("anchor", "words").agg(F.min(place).alias("p"), (F.min(place) < F.max(place)).alias("again"), F.first("n").alias("n"))
        .select("anchor", "words", "p.*", "n", "again")
    )
    first = different.where("again").select("anchor", "words", place.alias("_first"))
    whole = runs.join(first, ["anchor", "words"]).where(~place.eqNullSafe(F.col("_first"))).select("doc_id", "th", "pos", "n")
    # Anchors with several different runs.
    several = different.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1")
    meet = written(different.drop("words", "again").join(several, "anchor"))
    total = meet.where(F.col("runs") <= HOT).agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    n_shards = int(total) // SHARD_WORDS + 1

    def segments(rows: DataFrame, single: bool, schema: str) -> DataFrame:
        # At most the runs of one document in a list.
        wanted = rows.groupBy("doc_id", "th").agg(
            F.collect_list(F.struct("pos", "n", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).alias("shard"))).alias("wanted")
        )
        texts = docs.alias("d").join(wanted.alias("w"), _same("d", "w")).select("d.doc_id", "d.th", "d.text", "w.wanted")
        return texts.mapInArrow(_segments(window, single), schema)

    cold = segments(meet.where(F.col("runs") <= HOT), False, "doc_id long, th int, pos int, shard long, words array<long>")
    spans = whole.unionByName(cold.groupBy("shard").applyInArrow(_shard(window), SPANS))
    hot = meet.where(F.col("runs") > HOT)
    if not hot.isEmpty():
        singles = segments(hot, True, "doc_id long, th int, pos int, w1 long, w2 long")
        spans = spans.unionByName(_later(singles, ["w1", "w2"]).select("doc_id", "th", "pos", F.lit(1).alias("n")))
    return spans


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            total, gone, kept = [], [], []
            for text, own in zip(texts, spans, strict=True):
                words = _word.findall(text or "")
                removed = 0
                if own:
                    drop = np.zeros(len(words) + 1, np.int32)
                    for s in own:
                        drop[s["pos"]] += 1
                        drop[s["pos"] + s["n"] + window - 1] -= 1
                    stays = np.cumsum(drop)[:-1] == 0
                    removed = int(len(words) - stays.sum())
                    left = [w for w, k in zip(words, stays.tolist(), strict=True) if k]
                else:
                    left = words
                total.append(len(words))
                gone.append(removed)
                kept.append(" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (``text``, single blanks between) of each row of ``docs``."""
    rows = docs.select("doc_id", F.hash("text").alias("th"), "text")
    spans = repeated_spans(rows, window).distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    joined = rows.alias("d").join(spans.alias("s"), _same("d", "s"), "left").select("d.doc_id", "d.text", "s.spans")
    return joined.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, text string")
