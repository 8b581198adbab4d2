"""Line dedup: removes passages of three and more lines that occurred before.

Method. Every three consecutive lines of a document that hold a word are hashed to 128 bits; windows
found more than once in the corpus are traced to their first place (smallest doc_id, then place in the
text), and every later one covers its three lines. The covered lines, merged, are removed. Windows
overlap, so a repeated passage of n lines goes whole, and a line that repeats by itself stays.

Blank lines (no word) neither count nor go; lines are compared without surrounding white space.

Edge cases: a null text stays null and an empty one empty. A text of fewer than three lines with
words has no window. Rows with the same doc_id and text are one document: each keeps and loses the
same lines. A null doc_id sorts first. A column of ``docs`` named like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import SPACES, keeps_names

WIDTH = 3


def _filled(lines: Column) -> Column:
    """Places of the lines that hold a word."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.btrim(lines[i], F.lit(SPACES)) != "")


def _windows(lines: Column, filled: Column) -> Column:
    """Two hashes of each window of three filled lines."""
    line = lambda j: F.btrim(lines[filled[j]], F.lit(SPACES))
    return F.transform(
        F.sequence(F.lit(0), F.size(filled) - WIDTH),
        lambda j: F.struct(
            F.xxhash64(line(j), line(j + 1), line(j + 2)).alias("h1"),
            F.xxhash64(F.lit(1), line(j + 2), line(j + 1), line(j)).alias("h2"),
        ),
    )


@keeps_names
def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) with repeated passages cut from ``text``; adds n_lines, n_removed."""
    columns = docs.columns
    split = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.split("text", "\n").alias("_lines"))
    # The outer form: the inner one would have the windows computed again, for a filter on their number.
    windows = (
        split.withColumn("_filled", _filled(F.col("_lines")))
        .withColumn("_windows", F.when(F.size("_filled") >= WIDTH, _windows(F.col("_lines"), F.col("_filled"))))
        .select("doc_id", "_th", F.posexplode_outer("_windows").alias("_at", "_h")).where(F.col("_at").isNotNull())
        .select("doc_id", "_th", "_at", F.col("_h.h1").alias("_h1"), F.col("_h.h2").alias("_h2"))
    )
    place = F.struct("doc_id", "_th", "_at")
    repeated = (
        windows.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .where(~F.col("_first").eqNullSafe(F.col("_last"))).drop("_last")
    )
    later = windows.join(repeated, ["_h1", "_h2"]).where(~place.eqNullSafe(F.col("_first")))
    # At most the windows of one document.
    cover = later.groupBy("doc_id", "_th").agg(F.collect_set("_at").alias("_cover")).withColumnRenamed("doc_id", "_id").withColumnRenamed("_th", "_ith")
    joined = docs.withColumn("_th", F.xxhash64("text")).join(
        cover, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_ith")), "left"
    )
    lines = F.split("text", "\n")
    gone = F.array_distinct(
        F.flatten(F.transform("_cover", lambda j: F.slice(F.col("_fill"), j + 1, WIDTH)))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    return (
        joined.withColumn("_lines", F.when(F.col("_cover").isNotNull(), lines))
        .withColumn("_fill", F.when(F.col("_cover").isNotNull(), _filled(F.col("_lines"))))
        .withColumn("_gone", gone)
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
        .withColumn("n_removed", F.when(F.col("_cover").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
        .withColumn(
            "text",
            F.when(F.col("_cover").isNull(), F.col("text")).otherwise(
                F.array_join(F.transform(kept, lambda i: F.col("_lines")[i]), "\n")
            ),
        )
        .select(*[c for c in columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
    )


#: The digests of the kept texts.
SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), f AS (
  SELECT doc_id, i, trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM l WHERE trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) <> ''
), w AS (
  SELECT doc_id, j, line AS a, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY j) AS b,
         lead(line, 2) OVER (PARTITION BY doc_id ORDER BY j) AS c FROM f
), later AS (
  SELECT doc_id, j FROM (
    SELECT doc_id, j, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, j) AS n FROM w WHERE c IS NOT NULL
  ) WHERE n > 1
), gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM f JOIN (
    SELECT doc_id, unnest([j, j + 1, j + 2]) AS j FROM later
  ) k ON f.doc_id = k.doc_id AND f.j = k.j
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id), 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
