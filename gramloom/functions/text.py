"""Text rendering of ANOVA tables and coefficient summaries, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed output format of the report.
ANOVA_TITLE = "ANOVA table:"
ANOVA_HEADER = "-\tdf\tSS\tMS\tF"


def _fixed(pattern: str, col: Column, absent: str) -> Column:
    return F.coalesce(F.when(col.isNotNull(), F.format_string(pattern, col)), F.lit(absent))


def anova_lines(anova: DataFrame) -> DataFrame:
    """One text line per ANOVA row: (phenotype, line_no, line), the two title lines first."""
    body = anova.select(
        "phenotype",
        (F.col("row") + 2).alias("line_no"),
        F.concat(
            F.col("source"),
            F.lit("\t"),
            F.col("df").cast("string"),
            F.lit("\t"),
            F.format_string("%.4f", "ss"),
            F.lit("\t"),
            F.format_string("%.4f", "ms"),
            F.lit("\t"),
            # a row without F has "-" for it and "-" for p; a row with both ends in a tab
            _fixed("%.5f\t", F.col("f"), "-\t"),
            _fixed("%.5f\t", F.col("p"), "-"),
        ).alias("line"),
    )
    titles = anova.select("phenotype").distinct().select(
        "phenotype",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("line_no"), F.lit(ANOVA_TITLE).alias("line")),
                F.struct(F.lit(1).alias("line_no"), F.lit(ANOVA_HEADER).alias("line")),
            )
        ).alias("t"),
    ).select("phenotype", "t.line_no", "t.line")
    return titles.unionByName(body)


def coefficient_lines(terms: DataFrame) -> DataFrame:
    """Padded coefficient table per phenotype: (phenotype, line_no, line).

    ``terms`` has phenotype, row, term, estimate, std_error, t, p. A model has one row per
    term, so the width aggregate and the join below are k-sized.
    """
    cells = terms.select(
        "phenotype",
        (F.col("row") + 2).alias("line_no"),
        F.col("term").alias("c0"),
        F.format_string("%.6f", "estimate").alias("c1"),
        F.format_string("%.6f", "std_error").alias("c2"),
        F.format_string("%.3f", "t").alias("c3"),
        F.format_string("%.6f", "p").alias("c4"),
    )
    header = terms.select("phenotype").distinct().select(
        "phenotype",
        F.lit(1).alias("line_no"),
        *[
            F.lit(title).alias(f"c{i}")
            for i, title in enumerate(["Name", "Estimate", "Std. Error", "t value", "Pr(>|t|)"])
        ],
    )
    table = header.unionByName(cells)
    widths = table.groupBy("phenotype").agg(
        *[F.max(F.length(f"c{i}")).alias(f"w{i}") for i in range(5)]
    )
    padded = table.join(widths, "phenotype").select(
        "phenotype",
        "line_no",
        F.concat(
            F.rpad("c0", F.col("w0"), F.lit(" ")),
            *[F.lpad(f"c{i}", F.col(f"w{i}") + 3, F.lit(" ")) for i in range(1, 5)],
        ).alias("line"),
    )
    first = terms.select("phenotype").distinct().select(
        "phenotype",
        F.lit(0).alias("line_no"),
        F.concat(F.lit("The Response variable: "), F.col("phenotype")).alias("line"),
    )
    return first.unionByName(padded)
