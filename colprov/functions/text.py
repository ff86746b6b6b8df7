"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def escaped(c: Column) -> Column:
    """The text as a literal inside a regular expression."""
    return F.regexp_replace(c, r"([^A-Za-z0-9_\s])", r"\\$1")


def whole_token(c: Column, ignore_case: bool = False) -> Column:
    """A pattern for ``c`` not touched by a letter, digit or underscore."""
    return F.concat(F.lit(("(?i)" if ignore_case else "") + r"(?<![A-Za-z0-9_])"), escaped(c), F.lit(r"(?![A-Za-z0-9_])"))


def tokens(c: Column, chars: str = "A-Za-z0-9_") -> Column:
    """The distinct maximal runs of ``chars``."""
    return F.array_distinct(F.filter(F.split(c, f"[^{chars}]+"), lambda x: x != ""))


def as_column(p) -> Column:
    return F.lit(p) if isinstance(p, str) else p


def matches(text: Column, pattern) -> Column:
    """All matches, left to right, not overlapping."""
    return F.regexp_extract_all(text, as_column(pattern), F.lit(0))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once.

    An expression named inside a lambda would otherwise be evaluated for every
    element; wrapped in a one-element array it becomes a lambda variable.
    """
    return F.transform(F.array(value), use)[0]


def occurrences(text: Column, pattern) -> Column:
    """Array of (at, hit): 0-based start and text of every match, left to right."""
    both = F.struct(matches(text, pattern).alias("hits"), F.split(text, as_column(pattern), F.lit(-1)).alias("gaps"))

    def placed(b):
        lengths = F.transform(b["hits"], lambda h, i: F.length(b["gaps"][i]) + F.when(i > 0, F.length(F.get(b["hits"], i - 1))).otherwise(0))
        return bind(
            F.struct(b["hits"].alias("hits"), lengths.alias("steps")),
            lambda c: F.transform(
                c["hits"],
                lambda h, i: F.struct(F.aggregate(F.slice(c["steps"], 1, i + 1), F.lit(0), lambda acc, x: acc + x).alias("at"), h.alias("hit")),
            ),
        )

    return bind(both, placed)


def first_match(text: Column, pattern, limit: int | None = None) -> Column:
    """The first match, null when there is none."""
    hit = F.regexp_extract(text, pattern, 0) if isinstance(pattern, str) else F.regexp_substr(text, pattern)
    found = text.rlike(pattern) if isinstance(pattern, str) else F.rlike(text, pattern)
    return F.when(found, F.substring(hit, 1, limit) if limit else hit)


def first_of(*options: Column) -> Column:
    return F.coalesce(*options)
