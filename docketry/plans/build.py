"""From record parts to the tagged, described and cleaned fact table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.constants import PART_NAMES
from docketry.operators.ordinal import ORIGIN
from docketry.operators.rules import exact_tag, rule_tag
from docketry.plans.keys import add_code_keys, is_interim
from docketry.plans.tables import ChargeTables
from docketry.schemas import CHARGE_PART
from docketry.store import free, materialise

# The part whose records are all felonies and come without level, case type and city.
MOTION_PART = "part1"
TAGS = ("wobbler", "low_level", "svf")


@dataclass(frozen=True)
class CodeLists:
    """The lists charges are tagged and described with."""

    wobblers: DataFrame  # charge
    rules: DataFrame  # charge, include, match_type
    svf: DataFrame  # code_section, with the level in front
    code_table: DataFrame  # row_order, m_f, offense_number, penal_code, offense_description
    match_mode: str = "regex"


def align_part(part: DataFrame, tag: str, columns: list[str] | None = None) -> DataFrame:
    """Bring one part to the common columns: fill what this part lacks, fix the order."""
    if tag == MOTION_PART:
        filled = {
            "case_level": F.lit("F"),
            "charge_level": F.lit("F"),
            "case_type": F.lit(None).cast("string"),
            "charge_city": F.lit(None).cast("string"),
        }
    else:
        filled = {"case_category_description": F.lit(None).cast("string")}
    columns = columns or CHARGE_PART.names
    part = part.withColumns({"data_part": F.lit(tag), **filled})
    extra = [c for c in part.columns if c.startswith("_")]
    return part.select(*columns, *extra)


def stack_parts(parts: Mapping[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """Stack the parts by column name; a part that lacks a column is an error.

    Parts with a known place in their file also get the number of the part, for row order.
    """
    digits = [tag[4:5] for tag in parts]
    if len(set(digits)) < len(digits):
        raise ValueError(f"part tags must differ in the digit that starts their ids: {list(parts)}")
    stacked = None
    for number, (tag, part) in enumerate(parts.items()):
        aligned = align_part(part, tag, columns)
        if "_file" in aligned.columns:
            aligned = aligned.withColumn("_part_no", F.lit(number))
        stacked = aligned if stacked is None else stacked.unionByName(aligned)
    if stacked is None:
        raise ValueError("no parts given")
    return stacked


def tag_codes(codes: DataFrame, lists: CodeLists) -> DataFrame:
    """Tag distinct codes (code_section, code_section_m_f) by all lists."""
    codes = exact_tag(codes, lists.wobblers, "wobbler")
    codes = rule_tag(codes, lists.rules, mode=lists.match_mode)
    return exact_tag(codes, lists.svf, "svf", code="code_section_m_f", entry="code_section")


def build_charges(
    stacked: DataFrame,
    lists: CodeLists,
    codes: DataFrame | None = None,
    keep_one_if_all_superseded: bool = False,
    placed: bool = False,
) -> ChargeTables:
    """Build the fact table from stacked parts with a `row_order` column.

    `codes` may name a cheaper source of every (code, section, charge_level) in the data than
    the data itself; a charge whose code it lacks ends the build.

    The charges are written once, laid out by part and by interim status. Removing superseded
    rows then only rewrites the few interim rows; the others are never moved for it. Each task
    writes the rows it has where they are: nothing is shuffled or sorted for the layout.
    """
    stacked_codes = (stacked if codes is None else codes).select("code", "section", "charge_level")
    distinct_codes = add_code_keys(stacked_codes).select("code_section", "code_section_m_f").distinct()
    distinct_codes = materialise(distinct_codes, "distinct_codes")
    tagged_codes = materialise(tag_codes(distinct_codes, lists), "codes")

    known = F.when(F.col("_tagged"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("the source of codes lacks "), "code_section_m_f")).cast("boolean")
    )
    tagged = (
        add_code_keys(stacked)
        .join(tagged_codes.withColumn("_tagged", F.lit(True)), ["code_section", "code_section_m_f"], "left")
        .withColumns({tag: known & F.col(tag) for tag in TAGS})
        .withColumn("interim", is_interim())
        .select(*stacked.columns, *TAGS, "interim")
    )
    layout = ("data_part", "interim")
    stored = materialise(tagged, "charges", layout)
    free(distinct_codes, tagged_codes)

    return ChargeTables(stored, lists.code_table, keep_one_if_all_superseded, placed)


def build_from_parts(parts: Mapping[str, DataFrame], lists: CodeLists, **options) -> ChargeTables:
    """Stack parts read from files and build the fact table; rows keep the order of parts, files and lines.

    A row's place in that order is stored beside it, so the rows are written once; their numbers
    are worked out from the places when they are asked for.
    """
    stacked = stack_parts(parts)
    rows = stacked.withColumn("row_order", F.struct(*[F.col(c).alias(c.strip("_")) for c in ORIGIN]))
    return build_charges(rows.drop(*ORIGIN), lists, placed=True, **options)


def reconcile(parts: Mapping[str, DataFrame], tables: ChargeTables) -> DataFrame:
    """One row per part: its rows as read, as built and as kept, and the numbers its rows got.

    `complete` tells that no row was lost or made on the way and that the part's rows have one
    unbroken stretch of numbers.
    """
    read = None
    for tag, part in parts.items():
        name = F.lit(PART_NAMES.get(tag, tag)).alias("data_part")
        rows = part.agg(F.count(F.lit(1)).alias("rows_in")).select(name, "rows_in")
        read = rows if read is None else read.unionByName(rows)
    if read is None:
        raise ValueError("no parts given")
    numbers = tables.with_row_numbers(tables.all_charges.select("data_part", "row_order"))
    built = numbers.groupBy("data_part").agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.min("row_number").alias("first_number"),
        F.max("row_number").alias("last_number"),
    )
    kept = tables.charges.groupBy("data_part").agg(F.count(F.lit(1)).alias("rows_kept"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    stretch = F.coalesce(F.col("last_number") - F.col("first_number") + 1, F.lit(0))
    return (
        read.join(built, "data_part", "full")
        .join(kept, "data_part", "left")
        .select("data_part", none("rows_in"), none("rows_out"), none("rows_kept"), "first_number", "last_number", stretch.alias("_n"))
        .withColumn("complete", (F.col("rows_in") == F.col("rows_out")) & (F.col("rows_out") == F.col("_n")))
        .drop("_n")
    )
