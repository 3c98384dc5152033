"""String helpers on columns. Patterns follow Unicode, as case-insensitive matching of prescriptions needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def icase(pattern: str) -> str:
    return f"(?iU){pattern}"


def has(text: Column, pattern: str) -> Column:
    return text.rlike(icase(pattern))


def has_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | has(text, p), patterns, F.lit(False))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_first(text: Column, pattern: str) -> Column:
    """Without the first match."""
    return F.regexp_replace(text, f"(?iUs)^(.*?)(?:{pattern})", "$1")


def drop_all(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, icase(pattern), "")


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; empty without one."""
    return F.regexp_extract(text, icase(pattern), group)


def first_label(text: Column, rules: list[tuple[str, str]], default: str = "") -> Column:
    """The label of the first rule that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(has(text, pattern), label).otherwise(out)
    return out
