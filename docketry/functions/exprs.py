"""Column expressions for records in which a missing value has its own rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def paste(*parts: ColumnLike, sep: str = "_") -> Column:
    """Join values with `sep`; a missing value is spelled "NA" and never swallows the rest."""
    return F.concat_ws(sep, *[F.coalesce(_col(p).cast("string"), F.lit("NA")) for p in parts])


def recode(value: ColumnLike, mapping: Mapping[str, str]) -> Column:
    """Replace the listed values, keep all others, leave missing values missing."""
    value = _col(value)
    if not mapping:
        return value
    (first, text), *rest = mapping.items()
    chain = F.when(value == first, F.lit(text))
    for old, new in rest:
        chain = chain.when(value == old, F.lit(new))
    return chain.otherwise(value)


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that is missing where the condition is missing."""
    return F.when(condition, yes).when(~condition, no)


def matches(value: ColumnLike, pattern: str) -> Column:
    """True where the regular expression is found; false, not missing, on missing text.

    A pattern without special characters is a plain substring search, which is much cheaper.
    """
    plain = re.escape(pattern) == pattern
    found = _col(value).contains(pattern) if plain else _col(value).rlike(pattern)
    return F.coalesce(found, F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    """True if one condition is; false for no conditions at all."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches_any(value: ColumnLike, patterns: Iterable[str] | Column, mode: str = "regex") -> Column:
    """True where one of the patterns is found in the value.

    Every pattern is searched by itself, however many there are, so none changes what another
    one finds. They are given one by one or as an array column, which may come from a table.
    mode "regex" reads each pattern as a regular expression, "literal" as plain text. No
    patterns match nothing.
    """
    if mode not in ("regex", "literal"):
        raise ValueError(f"unknown match mode: {mode}")
    if isinstance(patterns, Column):
        find = F.rlike if mode == "regex" else F.contains
        return F.coalesce(F.exists(patterns, lambda p: find(_col(value), p)), F.lit(False))
    if mode == "literal":
        return any_of(F.coalesce(_col(value).contains(p), F.lit(False)) for p in patterns)
    return any_of(matches(value, p) for p in patterns)


def age_group(age: ColumnLike) -> Column:
    """Age band; ages up to 10, from 91 and missing ones share one band."""
    age = _col(age)
    return (
        # The bands and their names.
        F.when((age > 10) & (age < 18), "minor_11-17")
        .when((age >= 18) & (age < 26), "young_adult_18-25")
        .when((age >= 26) & (age < 91), "adult_26-90")
        .otherwise("other_or_missing")
    )


def ratio(part: Column, whole: Column) -> Column:
    """Exact double ratio of two counts, missing over zero."""
    return F.try_divide(part, whole)


def share(condition: Column) -> Column:
    """Aggregate: share of rows for which the condition holds."""
    return ratio(F.count_if(condition), F.count(F.lit(1)))


def missing_share(value: ColumnLike) -> Column:
    """Aggregate: share of rows without a value."""
    return share(_col(value).isNull())


def strict_sum(value: ColumnLike) -> Column:
    """Aggregate: sum that is missing as soon as one input is missing."""
    value = _col(value)
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def distinct_count(value: ColumnLike) -> Column:
    """Aggregate: number of different values, all missing ones counting as one."""
    value = _col(value)
    return F.count_distinct(value) + F.coalesce(F.max(value.isNull().cast("long")), F.lit(0))


def percent_text(part: Column, whole: Column) -> Column:
    """Percent with one decimal, as text; missing over zero.

    Integer arithmetic: halves go up on every engine.
    """
    tenths = _int_div(part * 2000 + whole, F.nullif(whole * 2, F.lit(0)))
    return F.concat(_int_div(tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def count_label(part: Column, whole: Column, noun: str) -> Column:
    """Bar label such as "12.3% \\n (1,234 charges) "."""
    return F.concat(
        percent_text(part, whole), F.lit("% \n ("), F.format_number(part, 0), F.lit(f" {noun}) ")
    )
