"""Declared schemas and column lists of the charge model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# One row per charge, as every part delivers it once its own gaps are filled.
# Case and defendant numbers are text: a number read as double would print as "1.0" in a key.
CHARGE_PART = _struct(
    data_part=T.StringType(),
    masked_case_no=T.StringType(),
    defendant_no=T.StringType(),
    case_type=T.StringType(),
    case_level=T.StringType(),
    sex=T.StringType(),
    age_at_time_of_crime=T.IntegerType(),
    charge_level=T.StringType(),
    count_no=T.IntegerType(),
    code=T.StringType(),
    section=T.StringType(),
    plea=T.StringType(),
    result=T.StringType(),
    result_description=T.StringType(),
    result_date=T.TimestampType(),
    charge_city=T.StringType(),
    minor_zip_code=T.StringType(),
    case_category_description=T.StringType(),
)

CODE_LIST = _struct(charge=T.StringType())

# Columns of a rule list that the rule tag uses, after header clean-up.
RULE_COLUMNS = ("charge", "include", "type", "description", "match_type")

# The code table comes without a header; names go by position.
CODE_TABLE = _struct(
    bcs_code=T.StringType(),
    no_2=T.StringType(),
    no_3=T.StringType(),
    m_f=T.StringType(),
    offense_number=T.StringType(),
    penal_code=T.StringType(),
    offense_description=T.StringType(),
    sentence=T.StringType(),
)

# The finished fact table, in the order it is handed out.
CHARGE_FACT_COLUMNS = (
    *CHARGE_PART.names,
    "unique_id",
    "code_section",
    "code_section_m_f",
    "age_group",
    "charge_id",
    "person_id",
    "case_id",
    "plea_description",
    "wobbler",
    "low_level",
    "svf",
    "key",
    "offense_description",
)
