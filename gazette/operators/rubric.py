"""The writing rubric: one pass over the tree for measurements, everything else native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette import fixed
from gazette.functions import scores, text
from gazette.functions.html import measured_udf


def hits(column: Column) -> Column:
    return F.aggregate(F.map_values(column), F.lit(0), lambda a, n: a + n.cast("int"))


def evaluate(summaries: DataFrame) -> DataFrame:
    """(article_id, summary_html, one_liner) -> measurements, the eleven dimensions and their mean.

    For Korean prose only: gate with ``is_korean`` before. Null HTML is empty, a null lede is none.
    """
    html, lede = F.coalesce("summary_html", F.lit("")), F.coalesce("one_liner", F.lit(""))
    rows = summaries.select("article_id", html.alias("html"), text.trimmed(lede).alias("lede"), lede.alias("raw_lede"), measured_udf(html).alias("m"))
    m = {c: F.col(f"m.{c}") for c in ("length", "required_sections", "subheads", "absence_filler", "code_blocks", "tables", "images", "captioned")}
    prose = F.col("m.prose")
    again = F.array_sort(F.array_intersect(text.quantities(F.col("m.results")), text.quantities(F.col("m.earlier"))))
    m |= {
        "plain_sentences": F.size(text.plain_register(prose)),
        "terminal_colons": text.terminal_colons(F.col("html")),
        "repeated": F.size(again),
        "quantity_count": F.size(text.quantities(prose)),
        "closings": sum((F.contains(prose, F.lit(p)).cast("int") for p in fixed.BANNED_CLOSINGS[1:]), F.contains(prose, F.lit(fixed.BANNED_CLOSINGS[0])).cast("int")),
        "lede_length": F.length("lede"),
        "lede_sentences": F.when(F.length("lede") == 0, 0).otherwise(F.size(text.sentences(F.col("raw_lede")))),
        "lede_banned": F.greatest(*[F.startswith(F.col("lede"), F.lit(p)) for p in fixed.BANNED_OPENERS]),
        "translationese_hits": hits(text.marker_counts(prose, fixed.TRANSLATIONESE)),
        "cliche_hits": hits(text.marker_counts(prose, fixed.CLICHES)),
    }
    taken = rows.select("article_id", F.col("m.missing").alias("missing_sections"), again.alias("repeated_quantities"), *[c.alias(k) for k, c in m.items()])
    scored = taken.withColumns({f"{k}_score": c for k, c in scores.rubric({k: F.col(k) for k in m}).items()})
    parts = [F.col(f"{d}_score") for d in fixed.DIMENSIONS]
    return scored.withColumn("overall", sum(parts[1:], parts[0]) / len(parts))


def means(evaluated: DataFrame) -> DataFrame:
    """(position, dimension, mean) over articles, 0 without any."""
    one = evaluated.agg(*[F.coalesce(F.avg(f"{d}_score"), F.lit(0.0)).alias(d) for d in fixed.DIMENSIONS])
    rows = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(d).alias("dimension"), F.col(d).alias("mean")) for k, d in enumerate(fixed.DIMENSIONS)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def weakest(evaluated: DataFrame, n: int = 3) -> DataFrame:
    return means(evaluated).orderBy("mean", "position").limit(n).select("dimension", "mean")
