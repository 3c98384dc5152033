"""Lines of a prescription: splitting, noise, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions import fixed
from rxloom.functions.text import has, has_any, strip


def split_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row per line, trimmed, with ``line_no`` from 0; the other columns stay."""
    rest = [c for c in texts.columns if c != text]
    lines = texts.select(*rest, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", strip(F.col("line")))


def is_noise(line: Column) -> Column:
    """Contact data, rules, decorations, page numbers."""
    return has_any(line, fixed.NOISE)


def line_score(line: Column) -> Column:
    """How much a line looks like a medicine."""
    codes = "|".join(fixed.SCORED_CODES)
    points = [
        (has(line, fixed.DOSAGE), 5),
        (F.upper(line).rlike(rf"(?U)\b(?:{codes})\b"), 3),
        (has(line, fixed.POSITIONAL), 4),
        (has(line, fixed.SPAN_WORDS), 2),
        (has(line, fixed.NUMBERED), 1),
        (has(line, fixed.BULLETED), 1),
        (has(line, fixed.HEADER_MARKS), -3),
        (F.length(strip(line)) < 8, -2),
    ]
    total = F.lit(0)
    for test, value in points:
        total = total + F.when(test, value).otherwise(0)
    return total


def strict_lines(lines: DataFrame) -> DataFrame:
    """Cheap tests first; scores only for what is left."""
    kept = lines.filter(F.length("line") >= 4).filter(~is_noise(F.col("line")))
    return kept.withColumn("score", line_score(F.col("line"))).filter("score >= 3")


def _is_weak(line: Column, score: Column) -> Column:
    """P17 for a line that is no noise."""
    return (F.length(line) >= 6) & ~has_any(line, [fixed.DOCTOR, fixed.PATIENT, fixed.HOSPITAL]) & ((score >= 1) | has(line, fixed.HINT))


def lenient_lines(lines: DataFrame) -> DataFrame:
    """What may still be a medicine where the strict pass found none."""
    kept = lines.filter(F.length("line") >= 6).filter(~is_noise(F.col("line")))
    return kept.withColumn("score", line_score(F.col("line"))).filter(_is_weak(F.col("line"), F.col("score")))


def either_lines(lines: DataFrame) -> DataFrame:
    """The lines of both passes, read once: ``strict`` says of which."""
    kept = lines.filter(F.length("line") >= 4).filter(~is_noise(F.col("line")))
    # exploding one value keeps the filter from writing out the score at each place where it names it
    kept = kept.withColumn("score", F.explode(F.array(line_score(F.col("line")))))
    return kept.withColumn("strict", F.col("score") >= 3).filter(F.col("strict") | _is_weak(F.col("line"), F.col("score")))
