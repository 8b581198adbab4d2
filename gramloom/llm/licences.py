"""Licence scan: which licence template a file's header speaks of, and what a directory's licence file grants.

Method. Templates are notices, titles, SPDX ids, standard headers and full texts (``licence_forms``). They are compared with
*pieces* of the files: each header line that mentions a licence; the blocks of up to ``BLOCK`` lines with words around
such a line, so that a wrapped notice is one piece; each id of an SPDX line; and of licence files every line and the whole text.
A block or run is of lines half of whose terms are in notices, titles, headers or short full texts; others would only dilute it.
A term's weight is its frequency times its inverse document frequency over all such lines. The cosine of
each piece with each template is a join of the piece's terms with the templates' terms (a fixed, small table) and
a sum over equal terms. A title or id needs all its terms in the piece, a header or full text half of them, and any but titles all that are decisive (name and
version), as common words alone must not make a match. Texts of one family are alike up to their names, so a piece whose head (of a piece of more than ``RUN`` lines its first
``HEAD``, else all of it) has a word of another one's name is none of the licence. A file's own licence is its best template from ``LIKE`` on.

A file without one inherits from the nearest directory above that has a licence file. Directories, not
files, are joined: each distinct directory meets its ancestors' licences, and the nearest one wins.

Edge cases: a null text has no lines. Of equally good templates the first by name wins; of several licence files
in a directory the best match, then the first path. A null path has a header licence only. Equal rows are scanned
alike and returned each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import keeps_names, written
from gramloom.llm.licence_forms import BARRED, DECISIVE, forms

#: Notices by which files declare licences. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, all copyright is waived. CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
}
MENTION = r"(?i)licen[sc]e|copyright|copying|permission is hereby|spdx"
LIKE = 0.6
BLOCK = 8
HEAD = 3
#: Pieces of more lines are judged by their head.
RUN = 40
#: Full texts of so many words may stand whole in a file's header.
SHORT = 400
SPDX_TAG = r"(?i)spdx-license-identifier\s*:?\s*"
WORDY = r"[\p{L}\p{N}]"
#: All lines of licence files count.
FILE_NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"


def _terms(line: Column) -> Column:
    # An SPDX id is a term of its own: "spdx+mit".
    tagged = F.regexp_replace(F.lower(line), SPDX_TAG, "spdx+")
    return F.filter(F.split(tagged, r"[^\p{L}\p{N}.+-]+|\.(?=\s|$)"), lambda t: t.rlike(WORDY))


def _template_terms(spark) -> DataFrame:
    """licence, form, kind, term, tf, whether the term is ``decisive``, and the numbers of terms and decisive terms a piece must have."""
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(forms(TEMPLATES))], "form int, licence string, kind string, notice string")
    rows = rows.withColumn("terms", _terms(F.col("notice")))
    size = F.size(F.array_distinct("terms"))
    need = F.when(F.col("kind") == "title", size).when(F.col("kind") == "notice", 0).otherwise(F.ceil(size / 2))
    names = F.coalesce(*[F.when(F.col("licence") == k, F.array(*[F.lit(t) for t in v])) for k, v in DECISIVE.items()], F.array().cast("array<string>"))
    names = F.when(F.col("kind") != "title", F.array_intersect(names, "terms")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("licence", "form", "kind", need.cast("long").alias("need"), F.size(names).cast("long").alias("names"), names.alias("n"), F.size("terms").alias("words"), F.explode("terms").alias("term"))
    return rows.groupBy("licence", "form", "kind", "need", "names", "words", "term").agg(F.count("*").alias("tf"), F.max(F.array_contains("n", F.col("term"))).alias("decisive"))


def _pieces(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """_key, line, single: what is compared of each file; ``single`` ones are lines that count for the frequencies."""
    is_file = F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False))
    split = files.where(F.col("text").isNotNull() & (is_file | F.col("text").rlike(MENTION))).select(
        "_key", is_file.alias("_is_file"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORDY)).alias("_lines")
    )
    last = F.size("_lines") - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    known = F.array(*[F.lit(t) for t in vocabulary])

    def legal(line: Column) -> Column:
        terms = F.array_distinct(_terms(line))
        return 2 * F.size(F.array_intersect(terms, known)) >= F.size(terms)

    split = split.withColumn("_at", F.filter(places, lambda i: F.col("_lines")[i].rlike(MENTION)))
    split = split.withColumn("_legal", F.when(F.size("_at") > 0, F.transform("_lines", legal)))
    other = F.filter(places, lambda i: ~F.get("_legal", i))
    split = split.withColumn("_other", F.when(F.size("_at") > 0, other))
    # The run of legal lines that a mention lies in; one of two lines at most is a block already.
    runs = F.array_distinct(F.transform(F.filter("_at", lambda i: F.get("_legal", i)), lambda i: F.struct(
        F.coalesce(F.array_max(F.filter("_other", lambda j: j < i)), F.lit(-1)).alias("a"), F.coalesce(F.array_min(F.filter("_other", lambda j: j > i)), last + 1).alias("z"),
    )))
    runs = F.transform(F.filter(runs, lambda s: s["z"] - s["a"] > BLOCK + 1), lambda s: F.array_join(F.slice("_lines", s["a"] + 2, s["z"] - s["a"] - 1), "\n"))
    spans = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in range(BLOCK) for a in range(BLOCK - b) if a + b])
    blocks = F.flatten(F.transform("_at", lambda i: F.transform(
        F.filter(spans, lambda s: F.when((i - s["b"] >= 0) & (i + s["a"] <= last), F.get("_legal", i - s["b"]) & F.get("_legal", i + s["a"])).otherwise(False)),
        lambda s: F.array_join(F.slice("_lines", i - s["b"] + 1, s["a"] + s["b"] + 1), "\n"),
    )))
    ids = F.flatten(F.transform(
        F.filter("_lines", lambda x: x.rlike(SPDX_TAG)),
        lambda x: F.filter(
            F.split(F.regexp_extract(x, SPDX_TAG + r"([A-Za-z0-9.+() -]+)", 1), "[^A-Za-z0-9.+-]+"),
            lambda t: t.rlike(WORDY) & ~F.lower(t).isin("and", "or", "with"),
        ),
    ))
    ids = F.transform(ids, lambda t: F.concat(F.lit("SPDX-License-Identifier: "), F.regexp_replace(t, "-+$", "")))
    whole = F.when(F.col("_is_file") & (last > 0), F.array(F.array_join("_lines", "\n"))).otherwise(F.array().cast("array<string>"))
    singles = F.filter("_lines", lambda x: F.col("_is_file") | x.rlike(MENTION))
    pair = lambda a, single: F.transform(a, lambda x: F.struct(x.alias("line"), F.lit(single).alias("single")))
    return split.select("_key", F.explode(F.concat(pair(singles, True), pair(blocks, False), pair(runs, False), pair(ids, False), pair(whole, False))).alias("p")).select("_key", "p.*")


def own_licences(files: DataFrame) -> DataFrame:
    """_key, licence, cosine: the best template of each of ``files`` (_key, path, text) that has one."""
    spark = files.sparkSession
    templates = _template_terms(spark)
    templates = spark.createDataFrame(templates.collect(), templates.schema)  # a fixed table of some thousand terms
    vocabulary = sorted(r.term for r in templates.where(f"kind <> 'full' OR words <= {SHORT}").select("term").distinct().collect())
    # Equal pieces are matched once, however many files have them.
    uses = written(_pieces(files, vocabulary).groupBy("line", "single", "_key").agg(F.lit(1).alias("_one")).drop("_one"))
    uses = uses.withColumn("p1", F.xxhash64("line", "single")).withColumn("p2", F.xxhash64(F.lit(1), F.reverse("line"), "single"))
    unique = uses.groupBy("line", "single", "p1", "p2").agg(F.count("*").alias("files"))
    # Hashes stand for pieces from here on: a whole text for each of its terms would be too much.
    piece = ["p1", "p2"]
    counts = written(
        unique.select(*piece, "single", "files", F.explode(_terms(F.col("line"))).alias("term"))
        .groupBy(*piece, "single", "files", "term").agg(F.count("*").alias("tf"))
    )
    n = unique.where("single").agg(F.sum("files")).first()[0] or 0
    df = counts.where("single").join(F.broadcast(templates.select("term").distinct()), "term").groupBy("term").agg(F.sum("files").alias("df"))
    df = written(df)
    idf = lambda d: F.log((F.lit(n) + 1) / (d + 1)) + 1
    weights = templates.join(F.broadcast(df), "term", "left").select("licence", "form", "need", "names", "decisive", "term", (F.col("tf") * idf(F.coalesce("df", F.lit(0)))).alias("tw"))
    weights = weights.join(weights.groupBy("form").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn")), "form")
    known = templates.select("term").distinct().join(F.broadcast(df), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    # Terms that no template has weigh as if in one line.
    line_terms = counts.join(F.broadcast(known), "term", "left").withColumn("lw", F.col("tf") * idf(F.coalesce("df", F.lit(1))))
    norms = line_terms.groupBy(*piece).agg(F.sqrt(F.sum(F.col("lw") * F.col("lw"))).alias("ln"))
    dots = (
        line_terms.join(F.broadcast(weights), "term").groupBy(*piece, "licence", "form")
        .agg(F.sum(F.col("lw") * F.col("tw")).alias("dot"), F.max("tn").alias("tn"), F.count("*").alias("met"), F.max("need").alias("need"),
             F.count_if("decisive").alias("named"), F.max("names").alias("names"))
        .where("met >= need AND named >= names")
    )
    # The heads of pieces against the names of other licences: a fixed list.
    barred = spark.createDataFrame([(k, t) for k, ts in BARRED.items() for t in ts], "licence string, term string")
    whole = F.size(F.split("line", "\n")) > RUN
    head = F.when(whole, F.substring_index("line", "\n", HEAD)).otherwise(F.col("line"))
    heads = unique.select(*piece, F.explode(F.array_distinct(_terms(head))).alias("term"))
    dots = dots.join(heads.join(F.broadcast(barred), "term").select(*piece, "licence").distinct(), [*piece, "licence"], "left_anti")
    cosine = F.round(F.col("dot") / (F.col("ln") * F.col("tn")), 6)
    # Best first: the highest cosine, then the first name.
    best = dots.join(norms, piece).select(*piece, "licence", cosine.alias("cosine")).where(F.col("cosine") >= LIKE)
    best = best.groupBy(*piece).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    return uses.select("_key", *piece).join(best, piece).groupBy("_key").agg(F.min("b").alias("b")).select("_key", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


@keeps_names
def scan(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (path, text and others) without text, with own_licence, cosine, licence and licence_dir."""
    keep = [c for c in files.columns if c not in ("text", "own_licence", "cosine", "licence", "licence_dir")]
    keyed = files.withColumn("_key", F.struct("path", F.xxhash64("path", "text").alias("h")))
    own = written(own_licences(keyed.select("_key", "path", "text")))
    narrow = keyed.select(*keep, F.col("_key.path").alias("_p"), F.col("_key.h").alias("_h"))
    o = own.select(F.col("_key.path").alias("_op"), F.col("_key.h").alias("_oh"), F.col("licence").alias("own_licence"), "cosine")
    narrow = narrow.join(o, (F.col("_h") == F.col("_oh")) & F.col("_p").eqNullSafe(F.col("_op")), "left").withColumn("_dir", _directory(F.col("path")))
    granted = (
        own.where(F.col("_key.path").rlike(FILE_NAMES)).select(_directory(F.col("_key.path")).alias("_above"), F.struct((-F.col("cosine")).alias("c"), F.col("_key.path").alias("p"), F.col("licence").alias("l")).alias("g"))
        .groupBy("_above").agg(F.min("g").alias("g")).select("_above", F.col("g.l").alias("_grant"))
    )
    names = F.split("_dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/"))
    directories = files.where("path IS NOT NULL").select(_directory(F.col("path")).alias("_dir")).distinct()
    nearest = (
        directories.select("_dir", F.explode(F.array_distinct(ancestors)).alias("_above")).join(granted, "_above")
        .groupBy("_dir").agg(F.max(F.struct(F.length("_above").alias("n"), "_above", "_grant")).alias("m"))
        .select("_dir", F.col("m._above").alias("_from"), F.col("m._grant").alias("_grant"))
    )
    return narrow.join(nearest, "_dir", "left").select(
        *keep, "own_licence", "cosine", F.coalesce("own_licence", "_grant").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("_from")).alias("licence_dir"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree of files: source/thousand/hundred/number.txt; the first of a hundred is its LICENSE.

    The first of a thousand is the licence file of the directory above, and of ten thousand that of the source.
    """
    i = F.col("doc_id")
    source = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    thousand, hundred = (F.floor(i / 1000)).cast("string"), (F.floor(i / 100)).cast("string")
    path = (
        F.when(i % 10000 == 0, F.concat(source, F.lit("/LICENSE."), F.lit("txt")))
        .when(i % 1000 == 0, F.concat(source, F.lit("/"), thousand, F.lit("/LICENSE")))
        .when(i % 100 == 0, F.concat(source, F.lit("/"), thousand, F.lit("/"), hundred, F.lit("/LICENSE")))
        .otherwise(F.concat(source, F.lit("/"), thousand, F.lit("/"), hundred, F.lit("/"), i.cast("string"), F.lit(".txt")))
    )
    return docs.select("doc_id", path.alias("path"), "text")
