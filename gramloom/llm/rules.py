"""Quality rules with adaptive thresholds: what is usual for a language and source decides, not a fixed cutoff.

Method. Each document's statistics are whole numbers, put in the bins of a mergeable quantile sketch: 32 exact
bins, then 16 bins for each power of two (relative error 1/16). A sketch is a table of bin counts, so
sketches merge by adding counts, in any order, with the same result. There is one per language and
source; where a pair has fewer than ``LEAST_DOCS`` documents, those of its language are merged,
and where these are too few, all. A rule's limit lies beyond a tail quantile of the group by a multiple of that quantile's distance from the
median, and a few bins: a group whose values scatter accepts more than one whose values lie close, and what is
usual in one source is dropped in another. The limits are joined back to the documents. A document that fails the base rules is dropped
and not counted in a sketch.

Edge cases: a null text has no words and fails. Null languages and sources are groups of their own. Other
columns of the input are left out of the result; equal rows are judged alike, each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import SPACES, words, written

LEAST_WORDS = 10
#: Percent of words in repeated five-word windows.
MOST_REPEATED = 20
K = 5
SYMBOLS = "#*$%&|<>"
LEAST_DOCS = 100
#: Statistic: (tail quantile in thousandths, tenths of its distance from the median that a value may lie beyond it, slack,
#: whether low values are outliers too). Rates that are zero nearly everywhere have their tail further out, but symbols: there
#: the outliers themselves are a twentieth of the documents.
RULES = {
    "word_length": (900, 40, 16, True),  # code points of words per 100 words
    "symbol_rate": (900, 40, 30, False),  # symbols per 1000 words
    "dup_line_rate": (990, 5, 8, False),  # repeated lines per 1000 lines with words
    "repeat_rate": (990, 5, 8, False),  # words in repeated windows per 1000 words
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    d = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.coalesce("text", F.lit("")).alias("_text"),
    )
    d = d.select(
        "*", words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
    )
    d = d.withColumn(
        "_windows",
        F.when(
            F.size("_words") > K - 1,
            F.transform(F.sequence(F.lit(1), F.size("_words") - (K - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, K))),
        ),
    )
    # Only a text with an equal pair of windows needs them in order.
    d = d.withColumn(
        "_order",
        F.when(
            F.size("_windows") > F.size(F.array_distinct("_windows")),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda i, j: F.col("_order")[i]["h"] == F.col("_order")[j]["h"]
    d = d.withColumn(
        "_starts",
        F.array_sort(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size("_order") - 1),
                    lambda i: (F.when(i > 0, same(i, i - 1)).otherwise(False))
                    | (F.when(i < F.size("_order") - 1, same(i, i + 1)).otherwise(False)),
                ),
                lambda i: F.col("_order")[i]["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "_starts",
            lambda s, i: F.when(i < F.size("_starts") - 1, F.least(F.lit(K), F.col("_starts")[F.least(i + 1, F.size("_starts") - 1)] - s)).otherwise(K),
        ),
        F.lit(0).cast("int"), lambda a, x: a + x,
    )
    return d.select(
        "doc_id", "lang", "source",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def with_rates(stats: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    return stats.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.floor(100 * F.col("word_chars") / n).alias("word_length"),
        F.floor(1000 * F.col("n_symbols") / n).alias("symbol_rate"),
        F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_rate"),
        F.floor(1000 * F.col("n_repeat_words") / n).alias("repeat_rate"),
    )


def bin_of(v: Column) -> Column:
    shift = F.length(F.bin(v)) - 5
    return F.when(v < 32, v).otherwise(shift * 16 + F.floor(v / F.pow(F.lit(2.0), shift))).cast("long")


def top_of(b: Column) -> Column:
    """The largest value of a bin."""
    shift = F.floor(b / 16) - 1
    return F.when(b < 32, b).otherwise((b - shift * 16 + 1) * F.pow(F.lit(2.0), shift) - 1).cast("long")


def bottom_of(b: Column) -> Column:
    """The smallest value of a bin."""
    shift = F.floor(b / 16) - 1
    return F.when(b < 32, b).otherwise((b - shift * 16) * F.pow(F.lit(2.0), shift)).cast("long")


def limits(rated: DataFrame) -> DataFrame:
    """_lang, _source and for each statistic its lowest and highest accepted value."""
    sketch = (
        rated.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bin_of(F.col(r)).alias("bin")) for r in RULES])).alias("x"))
        .groupBy("lang", "source", "x.rule", "x.bin").agg(F.count("*").alias("n"))
    )
    sketch = written(sketch)
    groups = rated.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("docs"))
    groups = groups.withColumn("lang_docs", F.sum("docs").over(Window.partitionBy("lang")))
    # Each group's sketch, or that of its language, or that of all: one merge of bin counts at each level.
    level = F.when(F.col("docs") >= LEAST_DOCS, 0).when(F.col("lang_docs") >= LEAST_DOCS, 1).otherwise(2)
    groups = groups.select("lang", "source", level.alias("level"))
    merged = [
        sketch.select(F.lit(0).alias("level"), "lang", "source", "rule", "bin", "n"),
        sketch.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "rule", "bin", "n"),
        sketch.groupBy("rule", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "rule", "bin", "n"),
    ]
    bins = merged[0].unionByName(merged[1]).unionByName(merged[2])
    key = ["level", "lang", "source", "rule"]
    up = Window.partitionBy(*key).orderBy("bin")
    total = Window.partitionBy(*key)
    ranked = bins.select(*key, "bin", F.sum("n").over(up).alias("upto"), F.sum("n").over(total).alias("total"))
    of_rule = lambda i: F.coalesce(*[F.when(F.col("rule") == r, F.lit(v[i])) for r, v in RULES.items()])
    at = lambda q: F.min(F.when(F.col("upto") * 1000 >= q * F.col("total"), F.col("bin")))
    tail, reach, slack = (of_rule(i) for i in range(3))
    quantiles = ranked.groupBy(*key).agg(at(1000 - tail).alias("q1"), at(F.lit(500)).alias("q2"), at(tail).alias("q3"))
    beyond = lambda gap: F.floor(gap * reach / 10) + slack
    # Upper edges of bins above, lower edges below: a bin is never cut.
    low, high = bottom_of(F.col("q1")), top_of(F.col("q3"))
    spread = quantiles.select(
        "level", "lang", "source", "rule", (low - beyond(bottom_of(F.col("q2")) - low)).alias("low"),
        (high + beyond(high - top_of(F.col("q2")))).alias("high"),
    )
    wide = spread.groupBy("level", "lang", "source").agg(
        *[F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{r}_{c}") for r in RULES for c in ("low", "high")]
    )
    g, w = groups.alias("g"), wide.alias("w")
    return g.join(
        w,
        (F.col("g.level") == F.col("w.level"))
        & F.when(F.col("g.level") < 2, F.col("g.lang")).eqNullSafe(F.col("w.lang"))
        & F.when(F.col("g.level") < 1, F.col("g.source")).eqNullSafe(F.col("w.source")),
        "left",
    ).select(F.col("g.lang").alias("_lang"), F.col("g.source").alias("_source"), *[f"{r}_{c}" for r in RULES for c in ("low", "high")])


def judge(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, lang, source): its statistics, base_failed and kept."""
    rated = written(with_rates(statistics(docs)))
    bound = limits(rated)
    inside = F.lit(True)
    for r, (*_, both) in RULES.items():
        inside &= F.coalesce(F.col(r) <= F.col(f"{r}_high"), F.lit(True))
        if both:
            inside &= F.coalesce(F.col(r) >= F.col(f"{r}_low"), F.lit(True))
    return rated.join(
        bound, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    ).select(*rated.columns, (~F.col("base_failed") & inside).alias("kept"))


_RATES = {
    "word_length": "100 * word_chars // greatest(n_words, 1)", "symbol_rate": "1000 * n_symbols // greatest(n_words, 1)",
    "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)",
}
_BIN = "CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END"
_TOP = "CASE WHEN bin < 32 THEN bin ELSE ((bin - (bin // 16 - 1) * 16 + 1) << (bin // 16 - 1)) - 1 END"
_BOTTOM = "CASE WHEN bin < 32 THEN bin ELSE (bin - (bin // 16 - 1) * 16) << (bin // 16 - 1) END"
_TRIM = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

SQL = f"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_TRIM}) <> '') AS l
  FROM documents
), win AS (
  SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM rep) GROUP BY doc_id
), s AS (
  SELECT t.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id
), r AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
         {', '.join(f'{e} AS {k}' for k, e in _RATES.items())} FROM s
), sk AS (
  SELECT lang, source, rule, {_BIN} AS bin, count(*) AS n FROM (
    {' UNION ALL '.join(f"SELECT lang, source, '{k}' AS rule, {k} AS v FROM r WHERE NOT base_failed" for k in RULES)}
  ) GROUP BY ALL
), g AS (
  SELECT lang, source, CASE WHEN docs >= {LEAST_DOCS} THEN 0 WHEN lang_docs >= {LEAST_DOCS} THEN 1 ELSE 2 END AS level FROM (
    SELECT lang, source, docs, sum(docs) OVER (PARTITION BY lang) AS lang_docs FROM (
      SELECT lang, source, sum(CASE WHEN base_failed THEN 0 ELSE 1 END) AS docs FROM r GROUP BY lang, source))
), b AS (
  SELECT g.lang, g.source, rule, bin, sum(n) AS n FROM g JOIN sk ON
    (g.level = 2 OR g.lang IS NOT DISTINCT FROM sk.lang) AND (g.level > 0 OR g.source IS NOT DISTINCT FROM sk.source)
  GROUP BY ALL
), c AS (
  SELECT lang, source, rule, bin, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS upto,
         sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM b
), u AS (
  SELECT c.*, tail, reach, slack FROM c JOIN (VALUES {', '.join(f"('{k}', {t}, {x}, {y})" for k, (t, x, y, _) in RULES.items())}) AS v(rule, tail, reach, slack) USING (rule)
), q AS (
  SELECT lang, source, rule, any_value(reach) AS reach, any_value(slack) AS slack, min(CASE WHEN upto * 1000 >= (1000 - tail) * total THEN {_BOTTOM} END) AS q1,
         min(CASE WHEN upto * 1000 >= 500 * total THEN {_BOTTOM} END) AS q2low,
         min(CASE WHEN upto * 1000 >= 500 * total THEN {_TOP} END) AS q2, min(CASE WHEN upto * 1000 >= tail * total THEN {_TOP} END) AS q3
  FROM u GROUP BY lang, source, rule
), lim AS (
  SELECT lang, source, {', '.join(
      f"max(CASE WHEN rule = '{k}' THEN q1 - (q2low - q1) * reach // 10 - slack END) AS {k}_low, "
      f"max(CASE WHEN rule = '{k}' THEN q3 + (q3 - q2) * reach // 10 + slack END) AS {k}_high" for k in RULES)}
  FROM q GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(
           f"coalesce({k} <= {k}_high, true)" + (f" AND coalesce({k} >= {k}_low, true)" if both else '') for k, (*_, both) in RULES.items())} AS kept
FROM r LEFT JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source
"""
