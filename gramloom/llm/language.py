"""Language ID by Bayesian fusion of what a text, its markup and its address say.

Method. Each language has a distribution over hashed byte trigrams, counted over all labelled texts. A text's log
likelihoods under them are tempered to ``EVIDENCE`` trigrams' worth, as neighbouring trigrams are no
independent witnesses. To these are added, as log probabilities found by grouped aggregation over all items:

* the declared markup language and the address suffix, given the language the text alone suggests;
* the prior of the host, smoothed towards its domain's, which is smoothed towards that of all items.

An item counts itself in these tables with one vote; ``STRENGTH`` votes of the next level outweigh that. A last,
undetermined language with a flat distribution takes texts unlike all others; it starts with
``UNKNOWN`` of the probability.

Edge cases: a null or empty text brings no evidence, and the item is undetermined, as is every item when
no labelled text was given. A missing declaration, suffix or host brings none either. Equal rows are judged
alike. Rows with a null id are judged and returned. ``identify`` returns the columns of the items without text; ``with_language`` keeps all
columns of documents, whatever their names. A long text is counted in one array of its trigrams, some 30 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm import textkit
from gramloom.llm.common import gives_back, keeps_names, written

BINS = 1 << 14
#: Languages told apart; counts of each take BINS * 8 bytes on the driver and in each task.
MOST_LANGUAGES = 512
EVIDENCE = 60
STRENGTH = 20
UNKNOWN = 1e-4
NONE = "und"
BLOCK = 128
#: Sums of the tasks' counts, level by level.
SHARES = (4096, 64, 1)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams of letters and blanks, and the row of each. Capitals A-Z are lowered; signs and digits left out."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    low = textkit._lower[data]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    keep = letter | space
    low, owner = np.where(space, 32, low)[keep].astype(np.uint32), owner[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Runs of blanks count as one.
    once = np.ones(len(low), bool)
    once[1:] = (low[1:] != 32) | (low[:-1] != 32)
    low, owner = low[once], owner[once]
    tri = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(2654435761) >> np.uint32(18)
    same = owner[:-2] == owner[2:]
    return (tri[same] % BINS).astype(np.int64), owner[:-2][same]


@gives_back
def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts for each language seen in the task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for row, data, offsets in textkit.chunks(batch.column(0)):
            names = langs[row : row + len(offsets) - 1]
            known = sorted(set(names))
            number = np.array([known.index(x) for x in names])
            tri, owner = _trigrams(data, offsets)
            table = np.bincount(number[owner] * BINS + tri, minlength=len(known) * BINS).reshape(-1, BINS)
            for name, own in zip(known, table, strict=True):
                counts[name] = counts.get(name, 0) + own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array([c.astype(np.int64).tobytes() for c in counts.values()], pa.binary())],
        ["lang", "counts"],
    )


def _sum_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(BINS, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"lang": table.column("lang")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def text_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram distributions, from all rows of ``labelled`` (text, lang)."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    # One row for each task and language goes into the sums, of which none adds up more than a share of the tasks.
    sums = rows.mapInArrow(_count_task, "lang string, counts binary").withColumn("part", F.spark_partition_id())
    for share in SHARES:
        sums = sums.withColumn("part", F.col("part") % share).groupBy("lang", "part").applyInArrow(_sum_counts, "lang string, part int, counts binary")
    found = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in sums.limit(MOST_LANGUAGES + 1).toLocalIterator())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    flat = np.full((1, BINS), -np.log(BINS))
    if not found:
        return [NONE], flat
    table = np.array([c for _, c in found], float) + 0.5
    return [x for x, _ in found] + [NONE], np.concatenate([np.log(table / table.sum(1, keepdims=True)), flat])


def text_evidence(items: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``items`` (id, text, ...) without text, with ``_ll``: tempered log likelihoods, and ``_n``: trigrams."""
    langs, logs = model
    shared = items.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    names = [c for c in items.columns if c != "text"]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(logs)))
            n = np.zeros(batch.num_rows, np.int64)
            for row, data, offsets in textkit.chunks(batch.column("text")):
                tri, owner = _trigrams(data, offsets)
                rows = len(offsets) - 1
                n[row : row + rows] = np.bincount(owner, minlength=rows)
                for j, line in enumerate(logs):
                    sums[row : row + rows, j] = np.bincount(owner, line[tri], minlength=rows)
            sums *= np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
            sums -= sums.max(1, keepdims=True)
            sums = np.round(sums, 6)
            ll = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(logs), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), ll, pa.array(n)], [*names, "_ll", "_n"])

    schema = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in names) + ", _ll array<double>, _n long"
    return items.mapInArrow(run, schema)


def _votes(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """Counts of the text's languages for each value of ``by``, as an array."""
    return rows.groupBy(*by).agg(F.array(*[F.sum((F.col("_guess") == j).cast("double")) for j in range(n)]).alias(name))


def _smoothed(own: str, above: Column) -> Column:
    """(votes + STRENGTH * distribution above) / (sum of votes + STRENGTH)."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + STRENGTH
    return F.zip_with(F.col(own), above, lambda v, p: (v + STRENGTH * p) / total)


def identify(items: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """id, lang, confidence, text_lang of each of ``items`` (id, text, declared, suffix, host, domain)."""
    langs, _ = model
    n = len(langs)
    if n == 1:
        return items.select("id", F.lit(NONE).alias("lang"), F.lit(0.0).alias("confidence"), F.lit(NONE).alias("text_lang"))
    base = text_evidence(items.select("id", "text", "declared", "suffix", "host", "domain"), model)
    # Without trigrams the text suggests nothing.
    guess = F.when(F.col("_n") > 0, F.array_position("_ll", F.array_max("_ll")) - 1)
    base = written(base.withColumn("_guess", guess.cast("int")))
    voted = base.where("_guess IS NOT NULL")
    everything = voted.groupBy().agg(*[F.sum((F.col("_guess") == j).cast("double")) for j in range(n)]).first()
    total = [x or 0.0 for x in everything]
    weight = sum(total[:-1]) + n - 1
    prior = [(x + 1) / weight * (1 - UNKNOWN) for x in total[:-1]] + [UNKNOWN]
    flat = F.array(*[F.lit(float(p)) for p in prior])
    per_lang = F.array(*[F.lit(float(x)) for x in total])
    out = base
    for c in ("declared", "suffix"):
        # P(value | language), with one imagined vote for each of the values.
        table = _votes(voted.where(F.col(c).isNotNull()), [c], n, f"_{c}")
        values = F.lit(float(table.count() + 1))
        logs = F.zip_with(f"_{c}", per_lang, lambda v, t: F.log((v + 1) / (t + values)))
        # An undetermined text says nothing of what is declared: the mean over languages.
        mean = F.aggregate(F.slice(f"_{c}", 1, n - 1), F.lit(0.0), lambda a, x: a + x)
        last = F.log((mean + 1) / (F.lit(float(sum(total[:-1]))) + values))
        table = table.select(F.col(c).alias(f"_v{c}"), F.concat(F.slice(logs, 1, n - 1), F.array(last)).alias(f"_{c}"))
        out = out.join(table, F.col(c) == F.col(f"_v{c}"), "left").drop(f"_v{c}")
    domains = _votes(voted.where("domain IS NOT NULL"), ["domain"], n, "_votes").select("domain", _smoothed("_votes", flat).alias("_above"))
    hosts = _votes(voted.where("host IS NOT NULL"), ["host", "domain"], n, "_votes").join(domains, "domain", "left")
    hosts = hosts.select(F.col("host").alias("_vhost"), F.col("domain").alias("_vdomain"), _smoothed("_votes", F.coalesce("_above", flat)).alias("_host"))
    out = out.join(hosts, (F.col("host") == F.col("_vhost")) & F.col("domain").eqNullSafe(F.col("_vdomain")), "left")
    none = F.array(*[F.lit(0.0)] * n)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    log_prior = F.transform(F.coalesce("_host", flat), lambda p: F.log(p))
    score = add(add(F.col("_ll"), log_prior), add(F.coalesce("_declared", none), F.coalesce("_suffix", none)))
    out = out.withColumn("_score", score).withColumn("_best", F.array_max("_score"))
    share = F.aggregate("_score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_position("_score", F.col("_best")).cast("int")
    heard = F.col("_guess").isNotNull()
    return out.select(
        "id", F.when(heard, F.element_at(names, best)).otherwise(NONE).alias("lang"),
        F.when(heard, F.round(1 / share, 6)).otherwise(0.0).alias("confidence"),
        F.when(heard, F.element_at(names, F.col("_guess") + 1)).otherwise(NONE).alias("text_lang"),
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """Items of web pages (page_id, url, html)."""
    html, host = F.coalesce("html", F.lit("")), F.lower(F.expr("try_parse_url(url, 'HOST')"))
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#a-zA-Z0-9]{1,8};", " ")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    parts = F.split(host, r"\.")
    section = F.regexp_extract(F.coalesce(F.expr("try_parse_url(url, 'PATH')"), F.lit("")), "^/([a-z]{2})(?:/|$)", 1)
    return pages.select(
        F.col("page_id").alias("id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
        F.concat_ws("/", F.element_at(parts, -1), F.nullif(section, F.lit(""))).alias("suffix"), host.alias("host"),
        F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    """Items of documents: the declared language is ``lang``, the source stands for the host."""
    return docs.select(
        F.col("doc_id").alias("id"), "text", F.lower(F.col("lang").cast("string")).alias("declared"),
        F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.lit("documents").alias("domain"),
    )


@keeps_names
def with_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is found with a confidence of one half at least; others go.

    Texts are what is decided on: rows of one doc_id are judged each by itself, by a hash of the text.
    """
    model = text_model(docs)
    items = from_documents(docs).withColumn("id", F.struct("id", F.xxhash64("text", "declared", "host").alias("h")))
    good = identify(items, model).where((F.col("lang") != NONE) & (F.col("confidence") >= 0.5)).select(
        F.col("id.id").alias("_id"), F.col("id.h").alias("_h")
    ).distinct()
    key = F.xxhash64("text", F.lower(F.col("lang").cast("string")), F.col("source").cast("string"))
    return docs.withColumn("_key", key).join(
        good, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h")), "left_semi"
    ).select(*docs.columns)
