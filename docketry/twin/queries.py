"""Registered queries: every operator and analysis over the twin tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.exprs import distinct_count
from docketry.operators.dictionary import code_table_keys, merge_texts
from docketry.operators.frequency import freq_table
from docketry.operators.rules import exact_tag, rule_tag
from docketry.plans import analyses as a
from docketry.plans.build import reconcile, stack_parts
from docketry.plans.report import ANALYSES
from docketry.plans.tables import ChargeTables
from docketry.twin import tables as twin

Query = Callable[[SparkSession, str], DataFrame]

TARGETS = ("M_PROMO_1(A)", "M_SMALL_2(C)", "M_LARGE_0(B)")
DECLINABLE = (("PROMO_1", "LARGE_0", "SMALL_3"), ("M_ECONOMY_4(A)",))

# Analyses whose codes and patterns are those of the twin.
TWIN_ANALYSES: dict[str, Callable[[ChargeTables], DataFrame]] = {
    "target_share_distribution": lambda t: a.target_share_distribution(t, TARGETS),
    "text_match_count": lambda t: a.text_match_count(t, "ring"),
    "pattern_level_mix": lambda t: a.pattern_level_mix(t, "SMALL_2"),
    "exact_level_mix": lambda t: a.exact_level_mix(t, "PROMO_0(A)"),
    "declinable_total": lambda t: a.declinable_total(t, *DECLINABLE),
    "declinable_results": lambda t: a.declinable_results(t, *DECLINABLE),
    "only_declinable_persons": lambda t: a.only_declinable_persons(t, *DECLINABLE),
}


def _over_tables(analysis: Callable[[ChargeTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: analysis(twin.charge_tables(spark, sf_dir))


def union_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts, one of them without level and city, aligned and stacked again."""
    stored = twin.charge_tables(spark, sf_dir).parts.withColumn(
        "case_category_description", F.lit(None).cast("string")
    )
    columns = [
        "data_part", "masked_case_no", "defendant_no", "case_type", "case_level", "charge_level",
        "code", "section", "plea", "result_description", "charge_city", "minor_zip_code",
        "case_category_description",
    ]
    parts = {}
    for tag in ("part3", "part4", "part5", "part6", "part1"):
        part = stored.filter(F.col("data_part") == tag).drop("data_part")
        if tag == "part1":
            part = part.drop("case_level", "charge_level", "charge_city")
        else:
            part = part.withColumn("case_type", F.lit("criminal")).drop("case_category_description")
        parts[tag] = part
    return stack_parts(parts, columns)


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def row_ids(t: ChargeTables) -> DataFrame:
    """All charges numbered in their order, with the zero-padded text id."""
    rows = t.with_row_numbers(t.all_charges.select("row_order", "charge_id"))
    order = [F.col(f"row_order.{c}") for c in ORDER[:4]]
    return rows.select(*order, "charge_id", "unique_id", F.col("row_number").alias("row_order"))


def composite_ids(t: ChargeTables) -> DataFrame:
    return t.all_charges.select(
        "code_section", "code_section_m_f", "charge_id", "person_id", "case_id", "minor_zip_code"
    )


def distinct_codes(t: ChargeTables) -> DataFrame:
    """Number of different codes, the missing one among them."""
    return t.all_charges.agg(distinct_count("code").alias("codes"))


def age_bands(t: ChargeTables) -> DataFrame:
    return freq_table(t.all_charges, "age_at_time_of_crime", "age_group")


def relabel_parts(t: ChargeTables) -> DataFrame:
    return freq_table(t.all_charges, "plea", "plea_description", within=["data_part"])


def exact_tags(t: ChargeTables) -> DataFrame:
    tags = ["code_section", "charge_level", "wobbler", "svf"]
    return t.charges.groupBy(*tags).agg(F.count(F.lit(1)).alias("n"))


def rule_tags(mode: str, many: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = twin.many_rules(spark) if many else twin.code_lists(spark, sf_dir).rules
        counts = (
            twin.charge_tables(spark, sf_dir)
            .all_charges.groupBy("code_section")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        return rule_tag(counts, rules, mode=mode)

    return query


def code_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_texts(code_table_keys(twin.code_table(spark, sf_dir)))


def enriched_descriptions(t: ChargeTables) -> DataFrame:
    return t.describe(freq_table(t.charges, "key", sort=False))


def remaining_rows(t: ChargeTables) -> DataFrame:
    order = [F.col(f"row_order.{c}") for c in ORDER[:4]]
    return t.charges.select(*order, "charge_id", "result_description")


def remaining_rows_keep_one(t: ChargeTables) -> DataFrame:
    """Rows that stay if a charge with interim rows only keeps the first of them."""
    order = [F.col(f"row_order.{c}") for c in ORDER[:4]]
    return t.charges_keep_one.select(*order, "charge_id", "result_description")


def parts_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each part as read from its files, as built and as kept, with their row numbers."""
    return reconcile(*twin.part_tables(spark, sf_dir))


QUERIES: dict[str, Query] = {
    **{name: _over_tables(analysis) for name, analysis in {**ANALYSES, **TWIN_ANALYSES}.items()},
    "union_parts": union_parts,
    "parts_reconciled": parts_reconciled,
    "row_ids": _over_tables(row_ids),
    "composite_ids": _over_tables(composite_ids),
    "distinct_codes": _over_tables(distinct_codes),
    "age_bands": _over_tables(age_bands),
    "relabel_parts": _over_tables(relabel_parts),
    "exact_tags": _over_tables(exact_tags),
    "rule_tags_regex": rule_tags("regex"),
    "rule_tags_literal": rule_tags("literal"),
    "rule_tags_many": rule_tags("regex", many=True),
    "code_dictionary": code_dictionary,
    "enriched_descriptions": _over_tables(enriched_descriptions),
    "fact_table": _over_tables(ChargeTables.fact),
    "drop_superseded": _over_tables(remaining_rows),
    "drop_superseded_keep_one": _over_tables(remaining_rows_keep_one),
}
