from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketry.functions import exprs as x


def values(df, column="v"):
    return [r[column] for r in df.select(column).collect()]


def test_paste_spells_missing_values(make):
    df = make("a string, b string", ("PC", "1"), (None, "#7"), ("PC", None))
    assert values(df.select(x.paste("a", "b").alias("v"))) == ["PC_1", "NA_#7", "PC_NA"]


def test_paste_of_whole_numbers_has_no_fraction(make):
    assert values(make("a long", (1,)).select(x.paste(F.lit("p"), "a").alias("v"))) == ["p_1"]


def test_recode_keeps_unlisted_and_missing(make):
    df = make("a string", ("NG",), ("XX",), (None,))
    assert values(df.select(x.recode("a", {"NG": "Not guilty"}).alias("v"))) == ["Not guilty", "XX", None]
    assert values(df.select(x.recode("a", {}).alias("v"))) == ["NG", "XX", None]


def test_if_else_is_missing_for_missing_condition(make):
    df = make("a string", ("F",), ("M",), (None,))
    flag = x.if_else(F.col("a") == "F", F.lit(1), F.lit(0))
    assert values(df.select(flag.alias("v"))) == [1, 0, None]


def test_matches_is_false_on_missing_text(make):
    df = make("a string", ("PC_490.2",), ("PC_49012",), ("tres",), (None,))
    assert values(df.select(x.matches("a", "490.2").alias("v"))) == [True, True, False, False]
    assert values(df.select(x.matches("a", "tres").alias("v"))) == [False, False, True, False]


def test_matching_is_case_sensitive(make):
    df = make("a string", ("trespass -- PC_602",), ("TRES_1",))
    assert values(df.select(x.matches("a", "tres").alias("v"))) == [True, False]


def test_no_patterns_match_nothing(make):
    df = make("a string", ("x",), (None,))
    assert values(df.select(x.matches_any("a", []).alias("v"))) == [False, False]


def as_array(patterns):
    return F.array(*[F.lit(p) for p in patterns])


@pytest.mark.parametrize("given", [list, as_array])
def test_regex_and_literal_modes(make, given):
    df = make("a string", ("PC_602(M)",), ("PC_602M",), ("PC_602",), ("a\\Eb",))
    regex = x.matches_any("a", given(["PC_602(M)"]))
    literal = x.matches_any("a", given(["PC_602(M)", "\\Eb"]), "literal")
    assert values(df.select(regex.alias("v"))) == [False, True, False, False]
    assert values(df.select(literal.alias("v"))) == [True, False, False, True]


@pytest.mark.parametrize("given", [list, as_array])
@pytest.mark.parametrize("others", [0, 7, 8, 199, 200, 299])
def test_a_pattern_finds_the_same_whatever_its_neighbours(make, given, others):
    df = make("a string", ("Y",), ("aab",), ("other5z",), (None,))
    more = [f"other{i}[xy]" for i in range(others)]
    hits = lambda *patterns: values(df.select(x.matches_any("a", given([*more, *patterns])).alias("v")))
    assert hits("(?i)x", "y") == [False, False, False, False]
    assert hits("(q)\\1", "(a)\\1b") == [False, True, False, False]
    assert hits("(?i)y") == [True, False, False, False]


def test_age_bands(make):
    ages = [10, 11, 17, 18, 25, 26, 90, 91, None]
    got = values(make("a int", *[(a,) for a in ages]).select(x.age_group("a").alias("v")))
    minor, young, adult, other = "minor_11-17", "young_adult_18-25", "adult_26-90", "other_or_missing"
    assert got == [other, minor, minor, young, young, adult, adult, other, other]
    assert values(make("a double", (10.5,)).select(x.age_group("a").alias("v"))) == [minor]


def test_strict_sum_is_missing_with_one_missing_input(make):
    df = make("k string, a int", ("full", 1), ("full", 2), ("gap", 1), ("gap", None))
    rows = df.groupBy("k").agg(x.strict_sum("a").alias("v")).collect()
    assert {r.k: r.v for r in rows} == {"full": 3, "gap": None}


def test_distinct_count_counts_missing_once(make):
    df = make("a string", ("x",), ("x",), ("y",), (None,), (None,))
    assert values(df.agg(x.distinct_count("a").alias("v"))) == [3]
    assert values(df.filter("a = 'x'").agg(x.distinct_count("a").alias("v"))) == [1]
    assert values(df.filter("a = 'z'").agg(x.distinct_count("a").alias("v"))) == [0]


def test_shares(make):
    df = make("a string", ("M",), ("F",), (None,), ("M",))
    assert values(df.agg(x.share(F.col("a") == "M").alias("v"))) == [0.5]
    assert values(df.agg(x.missing_share("a").alias("v"))) == [0.25]
    assert values(df.filter("false").agg(x.missing_share("a").alias("v"))) == [None]


def test_labels(make):
    df = make("n long, t long", (1, 3), (1, 400), (1234, 1234), (0, 5), (5, 2000), (0, 0))
    text = x.percent_text(F.col("n"), F.col("t"))
    assert values(df.select(text.alias("v"))) == ["33.3", "0.3", "100.0", "0.0", "0.3", None]
    label = x.count_label(F.col("n"), F.col("t"), "charges")
    assert values(df.select(label.alias("v")))[2] == "100.0% \n (1,234 charges) "
