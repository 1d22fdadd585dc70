"""The analyses: each takes charge tables and returns one DataFrame.

Default parameters are those of the original study. Counts come first and texts last: charges
are reduced to their short offence key before the long offence text is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.constants import (
    ASSAULT_CODE,
    DECLINABLE_CODES,
    DECLINABLE_PATTERNS,
    DISMISSED,
    DIVERSION,
    FREQUENT_MISDEMEANORS,
    PROGRAM_PARTICIPANTS,
    THREAT_PATTERN,
    TRESPASS_PATTERN,
)
from docketry.functions.exprs import matches, matches_any, missing_share, ratio, share
from docketry.operators.frequency import freq_table, rank_range, ranking, top_k, top_k_of_top_m
from docketry.operators.rollup import (
    entity_count_and_share,
    ordered_distinct_text,
    share_within_entity,
)
from docketry.plans.tables import ChargeTables

OFFENCE = "offense_description"


def _rows() -> Column:
    return F.count(F.lit(1))


def has_result(result: str) -> Column:
    return F.col("result_description") == result


# Shares of all charges


def charge_count(t: ChargeTables) -> DataFrame:
    return t.charges.agg(_rows().alias("n"))


def share_where(t: ChargeTables, condition: Column) -> DataFrame:
    return t.charges.agg(share(condition).alias("share"))


def share_of_level(t: ChargeTables, level: str = "M") -> DataFrame:
    return share_where(t, F.col("charge_level") == level)


def share_low_level(t: ChargeTables) -> DataFrame:
    return share_where(t, F.col("low_level"))


def share_serious(t: ChargeTables) -> DataFrame:
    return share_where(t, F.col("svf"))


def share_dismissed(t: ChargeTables) -> DataFrame:
    return share_where(t, has_result(DISMISSED))


def share_diverted(t: ChargeTables) -> DataFrame:
    return share_where(t, has_result(DIVERSION))


def missing_rates(t: ChargeTables) -> DataFrame:
    return t.charges.agg(
        missing_share("charge_city").alias("charge_city_missing"),
        missing_share("minor_zip_code").alias("minor_zip_code_missing"),
    )


# Frequency tables


def level_mix(t: ChargeTables, condition: Column) -> DataFrame:
    """Charge levels among the charges that meet the condition."""
    return freq_table(t.charges.filter(condition), "charge_level")


def low_level_mix(t: ChargeTables) -> DataFrame:
    return level_mix(t, F.col("low_level"))


def wobbler_level_mix(t: ChargeTables) -> DataFrame:
    return level_mix(t, F.col("wobbler"))


def pattern_level_mix(t: ChargeTables, pattern: str = THREAT_PATTERN) -> DataFrame:
    return level_mix(t, matches("code_section", pattern))


def exact_level_mix(t: ChargeTables, code: str = ASSAULT_CODE) -> DataFrame:
    return level_mix(t, F.col("code_section") == code)


def low_level_freq(t: ChargeTables) -> DataFrame:
    return freq_table(t.charges, "low_level")


def result_freq(t: ChargeTables) -> DataFrame:
    return freq_table(t.charges, "result_description")


def top_results(t: ChargeTables, k: int = 6) -> DataFrame:
    results = freq_table(t.charges, "result_description", sort=False)
    return top_k(results, k, "n", ["result_description"])


def low_level_results(t: ChargeTables) -> DataFrame:
    return freq_table(t.charges.filter("low_level"), "result_description")


def results_within_level(t: ChargeTables) -> DataFrame:
    """All results of each charge level, as percent of the level's charges."""
    return freq_table(t.charges, "result_description", within=["charge_level"])


def dismissed_within_level(t: ChargeTables) -> DataFrame:
    """Per charge level, the percent of its charges that were dismissed."""
    levels = t.charges.groupBy("charge_level").agg(
        F.count_if(has_result(DISMISSED)).alias("n"), _rows().alias("rows")
    )
    return (
        levels.filter("n > 0")
        .select(
            "charge_level",
            F.lit(DISMISSED).alias("result_description"),
            "n",
            (ratio(F.col("n"), F.col("rows")) * 100).alias("pct"),
        )
        .orderBy(*ranking("n", ["charge_level"]))
    )


# Offences


def offence_freq(t: ChargeTables, condition: Column | None = None) -> DataFrame:
    """Charges per offence text with percents, unsorted."""
    charges = t.charges if condition is None else t.charges.filter(condition)
    return t.describe(freq_table(charges, "key", sort=False)).select(OFFENCE, "n", "pct")


def top_low_level(t: ChargeTables, k: int = 10) -> DataFrame:
    """The most frequent low-level offences, as percent of all charges."""
    counts = t.charges.filter("low_level").groupBy("key").agg(_rows().alias("n"))
    percent = ratio(F.col("n"), charge_count(t).scalar()) * 100
    listed = t.describe(counts).select(OFFENCE, "n", percent.alias("pct_chrgs"))
    return top_k(listed, k, "n", [OFFENCE])


def top_misdemeanors(t: ChargeTables, k: int = 3) -> DataFrame:
    return top_k(offence_freq(t, F.col("charge_level") == "M"), k, "n", [OFFENCE])


def top_misdemeanors_total(t: ChargeTables, k: int = 3) -> DataFrame:
    """Percent of all misdemeanor charges that fall on the k most frequent offences."""
    counts = t.charges.filter("charge_level = 'M'").groupBy("key").agg(_rows().alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    top = top_k(counts, k, "n", ["key"]).agg(F.sum("n").alias("n"))
    return top.select((ratio(F.col("n"), total) * 100).alias("pct_total"))


def offences_by_rank(t: ChargeTables, first: int = 22, last: int = 23) -> DataFrame:
    return rank_range(offence_freq(t), first, last, "n", [OFFENCE])


def text_match_count(t: ChargeTables, pattern: str = TRESPASS_PATTERN) -> DataFrame:
    """Charges whose offence text contains the pattern; upper-case fallback keys never do."""
    offences = t.describe(t.charges.groupBy("key").agg(_rows().alias("n")))
    hits = offences.filter(matches(OFFENCE, pattern))
    return hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def top_diverted(t: ChargeTables, k: int = 5) -> DataFrame:
    """The offences with most diverted charges, and which part of their charges that is.

    Both counts come from one aggregation instead of a join of two frequency tables.
    """
    counts = (
        t.charges.groupBy("key")
        .agg(F.count_if(has_result(DIVERSION)).alias("diverted"), _rows().alias("total"))
        .filter("diverted > 0")
        .withColumn("pct_diverted", ratio(F.col("diverted"), F.col("total")))
    )
    offences = t.describe(counts).select(OFFENCE, "diverted", "total", "pct_diverted")
    return top_k(offences, k, "diverted", [OFFENCE])


def top_dismissed_codes(t: ChargeTables, k: int = 10, among: int = 50) -> DataFrame:
    """The codes with the highest dismissed share, out of the most frequent codes."""
    codes = (
        t.charges.groupBy("code_section_m_f")
        .agg(_rows().alias("rows"), F.count_if(has_result(DISMISSED)).alias("n"))
        .withColumn("pct", ratio(F.col("n"), F.col("rows")))
    )
    listed = top_k_of_top_m(codes, k, "pct", among, "rows", ["code_section_m_f"])
    return listed.filter("n > 0").select(
        "code_section_m_f", F.lit(DISMISSED).alias("result_description"), "n", "pct"
    )


# Persons and cases


def all_dismissed_persons(t: ChargeTables) -> DataFrame:
    return entity_count_and_share(t.persons, F.col("pct_dismissed") == 1)


def half_dismissed_persons(t: ChargeTables) -> DataFrame:
    return entity_count_and_share(t.persons, F.col("pct_dismissed") >= 0.5)


def any_diverted_persons(t: ChargeTables) -> DataFrame:
    return t.persons.agg(
        share(F.col("diverted") > 0).alias("share"),
        F.count_if(F.col("diverted") > 0).alias("diverted_persons"),
        _rows().alias("persons"),
    )


def person_counts(t: ChargeTables) -> DataFrame:
    """Persons before and after superseded rows were removed."""
    before = t.persons_before_removal.scalar()
    return t.persons.agg(_rows().alias("persons")).withColumn("persons_before_removal", before)


def any_diverted_persons_of_all(t: ChargeTables) -> DataFrame:
    """Persons with a diverted charge, over the persons before superseded rows were removed."""
    diverted = t.persons.agg(F.count_if(F.col("diverted") > 0).alias("diverted_persons"))
    return diverted.select(ratio(F.col("diverted_persons"), t.persons_before_removal.scalar()).alias("share"))


def one_diverted_persons(t: ChargeTables) -> DataFrame:
    """Persons with exactly one diverted charge, and persons with nothing but diverted ones."""
    counts = t.persons.agg(
        F.count_if(F.col("diverted") == 1).alias("one_diverted"),
        F.count_if(F.col("diverted") == F.col("num_charges")).alias("all_diverted"),
    )
    persons = t.persons_before_removal.scalar()
    return counts.select(
        "one_diverted",
        ratio(F.col("one_diverted"), persons).alias("one_diverted_share"),
        "all_diverted",
        ratio(F.col("all_diverted"), persons).alias("all_diverted_share"),
    )


def external_ratio(t: ChargeTables, numerator: int = PROGRAM_PARTICIPANTS) -> DataFrame:
    """An outside head count over the persons in the data."""
    return t.persons.agg(ratio(F.lit(numerator), _rows()).alias("share"))


def misdemeanor_cases(t: ChargeTables) -> DataFrame:
    return t.cases.agg(F.count_if(F.col("case_level") == "M").alias("n"))


def misdemeanor_defendants(t: ChargeTables) -> DataFrame:
    """Defendants, within their case, whose first row belongs to a misdemeanor case."""
    return t.defendants.agg(F.count_if(F.col("case_level") == "M").alias("n"))


def target_share_distribution(
    t: ChargeTables, targets: Sequence[str] = FREQUENT_MISDEMEANORS, k: int = 2
) -> DataFrame:
    """For persons charged with a target code: how often which share of their charges are targets."""
    shares = share_within_entity(
        t.charges, "person_id", hit=F.col("code_section_m_f").isin(*targets), name="target_share"
    )
    table = freq_table(shares, "target_share", sort=False)
    return top_k(table, k, "n", ["target_share"]).select("target_share", "pct")


# What if certain charges were declined


def is_declinable_code(
    patterns: Sequence[str] = DECLINABLE_PATTERNS, codes: Sequence[str] = DECLINABLE_CODES
) -> Column:
    return matches_any("code_section", patterns) | F.col("code_section_m_f").isin(*codes)


def is_declinable(
    patterns: Sequence[str] = DECLINABLE_PATTERNS, codes: Sequence[str] = DECLINABLE_CODES
) -> Column:
    """A declinable code charged below felony level; a missing level does not count as below."""
    return (F.col("charge_level") != "F") & is_declinable_code(patterns, codes)


def declinable_total(t: ChargeTables, *lists: Sequence[str]) -> DataFrame:
    condition = is_declinable(*lists)
    return t.charges.agg(
        F.count_if(condition).alias("num_charges"), share(condition).alias("pct_of_all_charges")
    )


def declinable_results(t: ChargeTables, *lists: Sequence[str], k: int = 5) -> DataFrame:
    results = freq_table(t.charges.filter(is_declinable(*lists)), "result_description", sort=False)
    return top_k(results, k, "n", ["result_description"])


def only_declinable_persons(t: ChargeTables, *lists: Sequence[str]) -> DataFrame:
    """Persons with a declinable charge all of whose charges have a declinable code.

    As in the study, the level counts for finding the persons, not for the share.
    """
    shares = share_within_entity(
        t.charges, "person_id", hit=is_declinable_code(*lists), member=is_declinable(*lists)
    )
    return shares.agg(F.count_if(F.col("share") == 1).alias("n"))


def low_level_code_string(t: ChargeTables, sep: str = " -- ") -> DataFrame:
    """All low-level codes in order of first appearance, as one text."""
    return ordered_distinct_text(t.charges.filter("low_level"), "code_section_m_f", "row_order", sep)
