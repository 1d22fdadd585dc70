"""Charge records derived from the order tables, with all gaps and statuses charges have."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.constants import CONVICTED, DISMISSED, DIVERSION, HAND_ENTERED_OFFENCES, HELD_TO_ANSWER, PLEA_TEXTS
from docketry.plans.build import CodeLists, build_charges, build_from_parts
from docketry.plans.tables import ChargeTables
from docketry.sources.files import read_parts
from docketry.store import location, materialise

# The known pleas, and one that has no text; the ninth place is a missing plea.
PLEAS = (*PLEA_TEXTS, "XX")

# Codes that the model names, with section and level. Parts whose key leaves
# their place (modulo NAMED_EVERY) have them; those the code table must not know come first.
NAMED_CODES = (
    *[(*key.split("_")[:2], key.split("_")[2]) for key in HAND_ENTERED_OFFENCES],
    ("HS", "11550(A)", "M"),
    ("VC", "23152(A)", "M"),
    ("VC", "14601.1(A)", "M"),
    ("PC", "485&490.2", "M"),
    ("PC", "422", "F"),
    ("PC", "592.2", "M"),
    ("PC", "485", "M"),
    ("PC", "490.2", "M"),
    ("PC", "245(A)(4)", "F"),
)
NAMED_EVERY = 40
PART_TYPES = ("ECONOMY", "LARGE", "PROMO", "SMALL", "STANDARD")

WOBBLERS = ("PROMO_0(A)", "LARGE_1(B)", "SMALL_3(C)", "NA_2(A)")
SERIOUS = ("F_PROMO_0(A)", "F_STANDARD_2(B)", "F_ECONOMY_4(C)")
RULES = (
    ("PROMO_1(A)", "Include", "Exact"),
    ("SMALL_2(C)", "Include", "Exact"),
    ("SMALL_2", "Include", "Partial"),
    ("STANDARD_.", "Include", "Partial"),
    ("LARGE_3(B)", "Include", "Partial"),
    ("SMALL_2(C)", "Exclude", "Exact"),
    ("STANDARD_4", "Exclude", "Partial"),
    ("STANDARD_0(A)", "Exclude", "Partial"),
)


def inline(spark: SparkSession, **columns: list[str]) -> DataFrame:
    """A small frame from literal values."""
    return spark.createDataFrame(pa.table(columns))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _named(field: int) -> Column:
    """The code, section or level of a part that has one of the named codes, else missing."""
    values = F.array(*[F.lit(named[field]) for named in NAMED_CODES])
    return F.get(values, (F.col("p_partkey") % NAMED_EVERY).cast("int"))


def _own() -> dict[str, Column]:
    """The code, section and level a part has by its type, size and key."""
    size = F.col("p_size")
    letter = F.substring(F.lit("ABC"), F.pmod("p_partkey", F.lit(3)).cast("int") + 1, F.lit(1))
    return {
        "code": F.col("p_type"),
        "section": F.concat((size % 5).cast("string"), F.lit("("), letter, F.lit(")")),
        "charge_level": F.when(size <= 30, "M").when(size <= 46, "F").otherwise("I"),
    }


def part_codes(part: DataFrame) -> DataFrame:
    """The code, section and level a part stands for; some parts lack code or level."""
    code, section, level = (F.coalesce(_named(i), own) for i, own in enumerate(_own().values()))
    return part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 211 != 0, code).alias("code"),
        section.alias("section"),
        F.when(F.col("p_partkey") % 397 != 0, level).alias("charge_level"),
    )


def charge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One charge per line item, described by its order (case) and its part (code)."""
    rows = (
        read(spark, sf_dir, "lineitem")
        .join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part_codes(read(spark, sf_dir, "part")), F.col("l_partkey") == F.col("p_partkey"))
    )
    flag, status, quantity = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    part_tags = F.array(*[F.lit(f"part{i}") for i in (1, 3, 4, 5, 6)])
    return rows.select(
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
        ).alias("row_order"),
        F.get(part_tags, (F.col("l_orderkey") % 5).cast("int")).alias("data_part"),
        F.col("l_orderkey").cast("string").alias("masked_case_no"),
        (F.col("l_suppkey") % 2 + 1).cast("string").alias("defendant_no"),
        F.when(F.col("o_orderstatus") == "F", "F").otherwise("M").alias("case_level"),
        F.when(F.col("o_custkey") % 97 != 0, (F.col("o_custkey") % 90 + 5).cast("int")).alias(
            "age_at_time_of_crime"
        ),
        F.get(F.array(F.lit("M"), F.lit("F")), (F.col("o_custkey") % 3).cast("int")).alias("sex"),
        F.when(F.col("l_orderkey") % 5 != 0, "criminal").alias("case_type"),
        F.when(F.col("l_orderkey") % 5 == 0, "motion").alias("case_category_description"),
        F.col("l_linenumber").cast("int").alias("count_no"),
        F.concat("l_returnflag", "l_linestatus").alias("result"),
        F.col("l_shipdate").cast("timestamp").alias("result_date"),
        "charge_level",
        "code",
        "section",
        F.get(
            F.array(*[F.lit(p) for p in PLEAS]), ((F.col("l_linenumber") + F.col("l_partkey")) % 9).cast("int")
        ).alias("plea"),
        F.when(flag == "R", DISMISSED)
        .when((flag == "A") & (status == "F"), CONVICTED)
        .when(flag == "A", HELD_TO_ANSWER)
        .when(quantity <= 2, DIVERSION)
        .when(quantity > 10, "Acquitted")
        .alias("result_description"),
        F.when(F.col("l_linenumber") == 7, "CITY").alias("charge_city"),
        F.when(
            F.col("o_custkey") % 5 >= 2,
            F.concat((F.col("o_custkey") % 1000 + 90000).cast("string"), F.lit("-1234")),
        ).alias("minor_zip_code"),
    )


def code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code table with the distinct texts of each code, in the order of their first part.

    Its blanks and capitals are what the key and text clean-up is for. Charges without code or
    level, and those with a text entered by hand, find no text in it.
    """
    code, section, level = (F.coalesce(_named(i), own) for i, own in enumerate(_own().values()))
    known = F.col("p_partkey") % NAMED_EVERY >= len(HAND_ENTERED_OFFENCES)
    # The texts of two codes of the diversion figure.
    text = F.when(_named(1) == "11550(A)", "Use/Under Influence of Controlled Substance")
    text = text.when(_named(1) == "23152(A)", "DUI Alcohol").otherwise(F.upper("p_name"))
    return (
        read(spark, sf_dir, "part")
        .filter(known)
        .groupBy(
            code.alias("penal_code"),
            F.concat(F.lit(" "), section, F.lit(" ")).alias("offense_number"),
            level.alias("m_f"),
            text.alias("offense_description"),
        )
        .agg(F.min("p_partkey").alias("row_order"))
    )


def code_lists(spark: SparkSession, sf_dir: str, match_mode: str = "regex") -> CodeLists:
    charges, includes, match_types = (list(column) for column in zip(*RULES))
    return CodeLists(
        wobblers=inline(spark, charge=list(WOBBLERS)),
        rules=inline(spark, charge=charges, include=includes, match_type=match_types),
        svf=inline(spark, code_section=list(SERIOUS)),
        code_table=code_table(spark, sf_dir),
        match_mode=match_mode,
    )


def many_rules(spark: SparkSession, n: int = 5000) -> DataFrame:
    """`n` partial rules of several shapes: 90 of them fit codes of the parts, every seventh excludes."""
    k = F.col("id")
    kind = F.get(F.array(*[F.lit(t) for t in PART_TYPES]), (k % 5).cast("int"))
    digit = F.expr("id div 5 % 5").cast("string")
    letter = F.substring(F.lit("ABC"), F.expr("id div 25 % 3").cast("int") + 1, F.lit(1))
    tail = F.when(k < 90, F.lit("")).otherwise(F.concat(F.lit("rule"), k.cast("string")))
    place = F.concat(kind, F.lit("_"), digit, F.lit("[(]"), letter, tail)
    shape = (
        F.when(k == 4990, F.lit("^[A-Z]{5}_[0-9][(]C[)]$"))  # no plain text in it
        .when(k % 3 == 0, F.concat(F.lit("^"), place))
        .when(k % 3 == 1, F.concat(F.lit("(?:x|y)?"), place, F.lit("[)]*")))
        .otherwise(F.concat(place, F.lit("|no such code"), k.cast("string")))
    )
    return spark.range(n).select(
        shape.alias("charge"),
        F.when(k % 7 == 0, "Exclude").otherwise("Include").alias("include"),
        F.lit("Partial").alias("match_type"),
    )


_built: dict[tuple[str, str], ChargeTables] = {}


def charge_tables(spark: SparkSession, sf_dir: str) -> ChargeTables:
    """The charge tables over one data folder, built once per Spark application."""
    build = (spark.sparkContext.applicationId, sf_dir)
    if build not in _built:
        codes = part_codes(read(spark, sf_dir, "part"))
        _built[build] = build_charges(charge_rows(spark, sf_dir), code_lists(spark, sf_dir), codes)
    return _built[build]


_read_again: dict[tuple[str, str], tuple[dict[str, DataFrame], ChargeTables]] = {}
PART_ORDER = ("part3", "part4", "part5", "part6", "part1")


def part_tables(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], ChargeTables]:
    """The user's path: the charges as files of five parts, read, stacked and built; once per application."""
    build = (spark.sparkContext.applicationId, sf_dir)
    if build not in _read_again:
        written = materialise(charge_rows(spark, sf_dir).drop("row_order"), "part_files", ["data_part"])
        paths = {tag: f"{location(written)}/data_part={tag}" for tag in PART_ORDER}
        parts = read_parts(spark, paths, fmt="parquet")
        _read_again[build] = parts, build_from_parts(parts, code_lists(spark, sf_dir))
    return _read_again[build]
