"""Tags from exact lists and from include/exclude rules.

All functions take a frame of distinct codes. Tagging the codes once and joining the tags to
the charges keeps regular expressions off the charge rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.constants import LOW_LEVEL_CODES, LOW_LEVEL_PATTERNS
from docketry.functions.exprs import matches_any
from docketry.functions.patterns import pieces_of, required_pieces


def exact_tag(
    codes: DataFrame, listed: DataFrame, tag: str, code: str = "code_section", entry: str = "charge"
) -> DataFrame:
    """Add a true/false column: is the code on the list?"""
    entries = listed.select(F.col(entry).alias("_entry")).distinct().withColumn("_hit", F.lit(True))
    return (
        codes.join(entries, F.col(code) == F.col("_entry"), "left")
        .withColumn(tag, F.coalesce("_hit", F.lit(False)))
        .drop("_entry", "_hit")
    )


def pattern_hits(codes: DataFrame, rules: DataFrame, code: str = "code_section", mode: str = "regex") -> DataFrame:
    """The codes that a pattern of `rules` (charge, include) is found in, with the actions of those patterns.

    Patterns are not tried on every code. Each is filed under literal pieces that all its matches
    contain, each code under all its pieces; equal pieces make a candidate, and only candidates
    are searched. A pattern without such a piece is filed under the empty one, as is every code.
    The join is an equality, so Spark broadcasts, shuffles or splits it like any other, and the
    number of patterns is not bounded.
    """
    if mode not in ("regex", "literal"):
        raise ValueError(f"unknown match mode: {mode}")
    find = F.rlike if mode == "regex" else F.contains
    filed = rules.filter("charge is not null").select("charge", "include").distinct()
    filed = filed.select("charge", "include", F.explode(required_pieces(F.col("charge"), mode)).alias("_piece"))
    values = codes.select(F.col(code).alias("_code")).distinct()
    values = values.select("_code", F.explode(pieces_of(F.col("_code"))).alias("_piece"))
    return (
        values.join(filed, "_piece")
        .filter(find(F.col("_code"), F.col("charge")))
        .groupBy("_code")
        .agg(
            F.bool_or(F.col("include") == "Include").alias("_partly_in"),
            F.bool_or(F.col("include") == "Exclude").alias("_partly_out"),
        )
    )


def rule_tag(
    codes: DataFrame,
    rules: DataFrame,
    tag: str = "low_level",
    code: str = "code_section",
    mode: str = "regex",
    more_patterns: Sequence[str] = LOW_LEVEL_PATTERNS,
    more_codes: Sequence[str] = LOW_LEVEL_CODES,
) -> DataFrame:
    """Add a true/false column from rules (charge, include, match_type).

    A code is tagged if an include rule hits it and no exclude rule does. Exact rules are joined
    by code, partial rules by the pieces they require (`pattern_hits`). `mode` says whether
    partial rules are read as regular expressions or as plain text. The added patterns are always
    regular expressions. `codes` is read twice: hand over a table rather than a long plan.
    """

    def rules_of(action: str, match: str) -> DataFrame:
        return rules.filter((F.col("include") == action) & (F.col("match_type") == match)).select(
            "charge"
        )

    hits = pattern_hits(codes, rules.filter("match_type = 'Partial'"), code, mode)
    included = (
        F.col("_include")
        | F.coalesce("_partly_in", F.lit(False))
        | matches_any(code, more_patterns)
        | F.coalesce(F.col(code).isin(*more_codes), F.lit(False))
    )
    excluded = F.col("_exclude") | F.coalesce("_partly_out", F.lit(False))
    codes = exact_tag(codes, rules_of("Include", "Exact"), "_include", code)
    codes = exact_tag(codes, rules_of("Exclude", "Exact"), "_exclude", code)
    codes = codes.join(hits, F.col(code) == F.col("_code"), "left").withColumn(tag, included & ~excluded)
    return codes.drop("_include", "_exclude", "_code", "_partly_in", "_partly_out")
