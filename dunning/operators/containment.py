"""Containment join (JON-9): which patterns stand anywhere inside which texts.

A theta join on ``contains`` compares every pattern with every text. Here a pattern
is known by one short piece of itself, its anchor, and texts are only compared
with the patterns whose anchor they hold:

1. patterns and texts are cut into grams of ``GRAM`` characters (a shorter pattern is one
   gram), text grams that no pattern has are dropped;
2. a pattern's anchor is the gram of it that the fewest texts hold, so a prefix that all
   patterns share ("plink_") or that every text holds is never chosen if there is a
   rarer one; a pattern with a gram that no text holds matches nothing and is out;
3. texts and patterns meet in an equi join on the anchor, and ``contains`` decides.

Exact: a text that contains a pattern holds all its grams. Equal texts and patterns are
collapsed first, so a note that a third of all rows repeat is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 8


def _grams(text: Column, size: Column) -> Column:
    """The different substrings of ``size`` characters."""
    last = F.char_length(text) - size
    return F.array_distinct(F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.substring(text, i, size)))
                            .otherwise(F.array().cast("array<string>")))


def containing(texts: DataFrame, patterns: DataFrame, gram: int = GRAM) -> DataFrame:
    """(pattern, text): all pairs of a different non-empty pattern and a different text that contains it.

    ``texts`` has a column ``text``, ``patterns`` a column ``pattern``; nulls match nothing."""
    texts = texts.select("text").where(F.col("text").isNotNull()).distinct().withColumn("key", F.unhex(F.md5("text")))
    patterns = patterns.select("pattern").where(F.col("pattern") != "").distinct()
    size = F.least(F.char_length("pattern"), F.lit(gram))
    pieces = patterns.select("pattern", F.explode(_grams(F.col("pattern"), size)).alias("gram"))
    sizes = sorted(r["n"] for r in patterns.select(size.alias("n")).distinct().collect())  # at most ``gram`` numbers
    if not sizes:
        return texts.select(F.lit("").alias("pattern"), "text").where(F.lit(False))
    held = texts.select("key", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("text"), F.lit(n)) for n in sizes])))).alias("gram"))
    held = held.join(pieces.select("gram").distinct(), "gram", "left_semi")
    cost = held.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    anchors = (pieces.join(cost, "gram", "left")
               .groupBy("pattern").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rarest"))
               .where("rarest.texts > 0").select("pattern", F.col("rarest.gram").alias("gram")))
    candidates = held.join(anchors, "gram").select("key", "pattern")
    return candidates.join(texts, "key").where(F.contains("text", "pattern")).select("pattern", "text")


def first_containing(rows: DataFrame, text_col: str, order_by: list[str], patterns: DataFrame) -> DataFrame:
    """(pattern, row): for each pattern the first row, by ``order_by``, whose ``text_col`` contains it; ``row`` is a
    struct of the order columns and then the others."""
    columns = [*order_by, *(c for c in rows.columns if c not in order_by)]
    first = rows.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.min(F.struct(*columns)).alias("row"))
    pairs = containing(first.select("text"), patterns)
    return pairs.join(first, "text").groupBy("pattern").agg(F.min("row").alias("row"))
