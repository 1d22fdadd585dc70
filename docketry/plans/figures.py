"""Chart-ready tables: rows, drawing order and bar labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.constants import (
    ADULT_PARTS,
    CHARGE_TYPES,
    DIVERSION_FIGURE_TEXTS,
    OUTCOME_CLASSES,
)
from docketry.functions.exprs import count_label, percent_text, ratio, recode
from docketry.operators.frequency import with_percent
from docketry.plans.analyses import OFFENCE, top_diverted
from docketry.plans.tables import ChargeTables


def _position(value: str, order: list[str]) -> Column:
    """Place of a value in a declared order, missing for values outside it."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(value))
    return F.when(place > 0, place.cast("int"))


def charge_types(t: ChargeTables, sort: bool = True) -> DataFrame:
    """Charge-type figure: four types over all charges, serious felonies over adult ones.

    Both populations come from the charges' tallies and are then turned into rows.
    """
    adult = F.col("data_part").isin(*ADULT_PARTS)
    level = F.col("charge_level")

    def charges_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counts = t.tallies.agg(
        charges_where(F.lit(True)).alias("all_rows"),
        charges_where(adult).alias("adult_rows"),
        charges_where(level == "F").alias("felonies"),
        charges_where(level == "M").alias("misdemeanors"),
        charges_where(level == "I").alias("infractions"),
        charges_where(adult & F.col("svf")).alias("serious_or_violent"),
        charges_where(F.col("low_level")).alias("low_level"),
    )
    names = [name for name, _, _ in CHARGE_TYPES]
    rows = counts.unpivot(["all_rows", "adult_rows"], names, "type", "n")
    total = F.when(F.col("type") == "serious_or_violent", F.col("adult_rows")).otherwise(
        F.col("all_rows")
    )
    figure = rows.select(
        _position("type", names).alias("sort_order"),
        "type",
        recode("type", {name: text for name, text, _ in CHARGE_TYPES}).alias("label"),
        recode("type", {name: group for name, _, group in CHARGE_TYPES}).alias("colour_group"),
        "n",
        total.alias("total"),
        ratio(F.col("n"), total).alias("pct"),
    )
    return figure.orderBy("sort_order") if sort else figure


def _case_counts(t: ChargeTables) -> DataFrame:
    level = F.col("case_level")
    return t.cases.agg(
        F.count_if(level == "F").alias("felonies"),
        F.count_if(level == "M").alias("misdemeanors"),
        F.count(F.lit(1)).alias("n"),
    )


def case_severity(t: ChargeTables) -> DataFrame:
    """Case figure: shares of felony and misdemeanor cases, and the case count as a third row."""
    wide = _case_counts(t).select(
        ratio(F.col("felonies"), F.col("n")).alias("felonies"),
        ratio(F.col("misdemeanors"), F.col("n")).alias("misdemeanors"),
        F.col("n").cast("double").alias("n"),
    )
    return wide.unpivot([], ["felonies", "misdemeanors", "n"], "type", "pct")


def outcomes(t: ChargeTables, sort: bool = True) -> DataFrame:
    """Outcome figure: results folded to five classes, a missing result among "Other"."""
    fold = F.lit(next(text for result, text in OUTCOME_CLASSES if result is None))
    named = {result: text for result, text in OUTCOME_CLASSES if result is not None}
    result = F.col("result_description")
    simple = F.when(result.isin(*named), recode(result, named)).otherwise(fold)
    counts = t.tallies.groupBy(simple.alias("result_simple")).agg(F.sum("n").alias("n"))
    table = with_percent(counts)
    order = _position("result_simple", [text for _, text in OUTCOME_CLASSES])
    figure = table.withColumn("sort_order", order)
    return figure.orderBy("sort_order") if sort else figure


def diverted_offences(t: ChargeTables, k: int = 5, sort: bool = True) -> DataFrame:
    """Diversion figure: most diverted offences under their short names, in order of their rate."""
    rows = top_diverted(t, k).withColumn(OFFENCE, recode(OFFENCE, DIVERSION_FIGURE_TEXTS))
    return rows.orderBy("pct_diverted", OFFENCE) if sort else rows


def bar_labels(t: ChargeTables) -> DataFrame:
    """The text on each bar of the four figures, made from the counts behind it."""
    types = charge_types(t, sort=False).select(
        F.lit("charge_types").alias("figure"),
        F.col("label").alias("category"),
        count_label(F.col("n"), F.col("total"), "charges").alias("bar_label"),
    )
    cases = (
        _case_counts(t)
        .unpivot(["n"], ["felonies", "misdemeanors"], "category", "cases")
        .select(
            F.lit("case_severity").alias("figure"),
            "category",
            count_label(F.col("cases"), F.col("n"), "cases").alias("bar_label"),
        )
    )
    results = outcomes(t, sort=False).select(
        F.lit("outcomes").alias("figure"),
        F.col("result_simple").alias("category"),
        count_label(F.col("n"), t.tallies.agg(F.sum("n")).scalar(), "charges").alias("bar_label"),
    )
    diverted = diverted_offences(t, sort=False).select(
        F.lit("diverted_offences").alias("figure"),
        F.col(OFFENCE).alias("category"),
        F.concat(
            percent_text(F.col("diverted"), F.col("total")),
            F.lit("% ("),
            F.col("diverted").cast("string"),
            F.lit(" diverted)"),
        ).alias("bar_label"),
    )
    return types.unionByName(cases).unionByName(results).unionByName(diverted)
