"""Checks of written answers about code: foreign letters, names that the code doesn't have, passages copied from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what looks like a name of a schema: upper-case words with an underscore, a digit, a mark or a dot.
NAME = r"(?<![\w$#.])[A-Z][A-Z0-9$#]*(?:[_.][A-Z0-9$#]+)+(?![\w$#])"


def share_of(text: Column, letters: str) -> Column:
    """The share of letters of a script (a class of a regular expression, such as `\\p{IsHangul}`) among all letters; null without letters."""
    n = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(text, f"[^{letters}]", ""))
    return F.when(n > 0, own / n)


def names_in(text: Column) -> Column:
    """Names that a text mentions, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)))


def ungrounded(answers: DataFrame, known: DataFrame) -> DataFrame:
    """(unit, name): names of answers (unit, text) of which a part between dots isn't among the words of the unit's code (unit, word)."""
    said = answers.select("unit", F.explode(names_in(F.col("text"))).alias("name")).distinct()
    parts = said.select("unit", "name", F.explode(F.split("name", "\\.")).alias("_part"))
    words = known.select(F.col("unit").alias("_u"), F.upper("word").alias("_w")).distinct()
    missing = parts.join(words, (F.col("unit") == F.col("_u")) & (F.col("_part") == F.col("_w")), "left_anti")
    return missing.select("unit", "name").distinct()


def most_ungrounded(found: DataFrame, most: int = 30) -> DataFrame:
    """(name, n): the names that most units mention without having them."""
    return found.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(most)


def copies_code(answers: DataFrame, code: DataFrame, least: int = 3) -> DataFrame:
    """(unit, n_lines): answers (unit, text) with at least `least` lines, blanks apart, that stand in the unit's code (unit, text)."""
    lines = lambda df: df.select("unit", F.explode(F.split("text", "\n")).alias("l")).select("unit", F.trim(F.regexp_replace("l", r"\s+", " ")).alias("line")).filter(F.length("line") >= 12).distinct()
    return lines(answers).join(lines(code), ["unit", "line"]).groupBy("unit").agg(F.count("*").alias("n_lines")).filter(F.col("n_lines") >= least)


def worst(issues: DataFrame, most: int = 20) -> DataFrame:
    """The pieces (unit, weight, ..) with the heaviest issues."""
    return issues.orderBy(F.col("weight").desc(), "unit").limit(most)
