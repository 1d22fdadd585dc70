"""Ids, bands and readable texts computed from the columns of one charge row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.constants import HELD_TO_ANSWER, PART_NAMES, PLEA_TEXTS
from docketry.functions.exprs import age_group, paste, recode


def add_code_keys(df: DataFrame) -> DataFrame:
    """Add the code with its section, without and with the charge level in front."""
    return df.withColumn("code_section", paste("code", "section")).withColumn(
        "code_section_m_f", paste("charge_level", "code_section")
    )


def part_digit() -> Column:
    """The digit of a part tag, with which all ids start."""
    return F.substring("data_part", 5, 1)


def charge_id() -> Column:
    """One code charged to one defendant in one case; several rows may carry it."""
    return paste(part_digit(), "masked_case_no", "defendant_no", paste("code", "section"))


def add_keys(df: DataFrame) -> DataFrame:
    """Add charge, person and case ids, bands and readable texts.

    All of it is computed from columns of the same row, so it is added on reading and Spark
    drops what an analysis does not use. The last step replaces the part tag, the ids beside
    it still see the old one.
    """
    return add_code_keys(df).withColumns(
        {
            "minor_zip_code": F.substring("minor_zip_code", 1, 5),
            "age_group": age_group("age_at_time_of_crime"),
            "charge_id": charge_id(),
            "person_id": paste(part_digit(), "masked_case_no", "defendant_no"),
            "case_id": paste(part_digit(), "masked_case_no"),
            "data_part": recode("data_part", PART_NAMES),
            "plea_description": recode("plea", PLEA_TEXTS),
            "key": paste("code_section", "charge_level"),
        }
    )


def is_interim() -> Column:
    """True for a status that a later disposition of the same charge replaces."""
    return F.coalesce(F.col("result_description") == HELD_TO_ANSWER, F.lit(False))
