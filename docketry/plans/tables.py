"""The tables an analysis starts from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.constants import DISMISSED, DIVERSION
from docketry.functions.exprs import if_else, paste, ratio, strict_sum
from docketry.operators.dictionary import code_table_keys, describe, merge_texts
from docketry.operators.ordinal import ORIGIN, origin_offsets, sorted_ranges, with_row_numbers
from docketry.operators.rollup import entity_rollup, first_per_group
from docketry.operators.superseded import superseded_keys, surviving_interim_rows
from docketry.plans.keys import add_keys, charge_id
from docketry.schemas import CHARGE_FACT_COLUMNS
from docketry.store import finished, materialise


@dataclass(frozen=True)
class ChargeTables:
    """The stored charges and everything derived from them, each made on first use."""

    stored: DataFrame  # every row as stacked, with its tags and whether it is interim
    code_table: DataFrame
    keep_one_if_all_superseded: bool = False
    placed: bool = False  # row_order holds part, file, block and line

    @property
    def parts(self) -> DataFrame:
        """Every row as stacked, with its part tag."""
        return self.stored.drop("interim")

    @property
    def parts_of_interim(self) -> DataFrame:
        """The interim rows as stacked."""
        return self.stored.filter("interim").drop("interim")

    @cached_property
    def all_charges(self) -> DataFrame:
        """Every charge row, with ids and readable texts."""
        return add_keys(self.parts)

    @cached_property
    def charges(self) -> DataFrame:
        """The charges without superseded rows.

        Only the interim rows are looked at one by one and rewritten; the others are read as
        they are stored.
        """
        return add_keys(self._kept)

    @cached_property
    def charges_keep_one(self) -> DataFrame:
        """The charges if one that has interim rows only keeps the first of them."""
        return add_keys(self._without_superseded(self._surviving(True)))

    @cached_property
    def superseded(self) -> DataFrame:
        """The charges with an interim row and more than one row."""
        return materialise(superseded_keys(self._identified, "charge_id", F.col("interim")), "superseded")

    @property
    def _identified(self) -> DataFrame:
        return self.stored.withColumn("charge_id", charge_id())

    def _surviving(self, keep_one: bool) -> DataFrame:
        rows = surviving_interim_rows(self._identified.filter("interim"), self.superseded, "charge_id", keep_one)
        return materialise(rows.select(*self.stored.columns), "surviving")

    @cached_property
    def _kept(self) -> DataFrame:
        """The rows without superseded ones, as stacked."""
        return self._without_superseded(self._surviving(self.keep_one_if_all_superseded))

    def _without_superseded(self, surviving: DataFrame) -> DataFrame:
        return self.stored.filter(~F.col("interim")).unionByName(surviving).drop("interim")

    def with_row_numbers(self, df: DataFrame) -> DataFrame:
        """Add row_number and unique_id, the place of a row among all charges in `row_order`.

        Rows placed by file and line add their file split's offset; others, whose `row_order`
        must be a key, are looked up among the sorted ones.
        """
        if not self.placed:
            return df.join(self._sorted_numbers, "row_order")
        fields = {c: F.col(f"row_order.{c.strip('_')}") for c in ORIGIN}
        return with_row_numbers(df.withColumns(fields), self._offsets, ORIGIN[:-1], ORIGIN[-1])

    @cached_property
    def _offsets(self) -> DataFrame:
        fields = [F.col(f"row_order.{c.strip('_')}").alias(c) for c in ORIGIN]
        return self._written_offsets(self.stored.select(*fields), ORIGIN[:-1], ORIGIN[-1])

    def _written_offsets(self, rows: DataFrame, origin: Sequence[str], line: str) -> DataFrame:
        spark = rows.sparkSession
        return finished(spark, "offsets", lambda: origin_offsets(rows, origin, line))

    @cached_property
    def _sorted_numbers(self) -> DataFrame:
        ranges = materialise(sorted_ranges(self.stored.select("row_order"), "row_order"), "ranges")
        offsets = self._written_offsets(ranges, ["_range"], "_generated")
        return with_row_numbers(ranges, offsets, ["_range"], "_generated")

    @cached_property
    def texts(self) -> DataFrame:
        """One offence text per key."""
        return materialise(merge_texts(code_table_keys(self.code_table)), "texts")

    def describe(self, df: DataFrame) -> DataFrame:
        """Add offence texts to a frame with a `key`, best after it has been aggregated."""
        return describe(df, self.texts)

    @cached_property
    def defendants(self) -> DataFrame:
        """One row per defendant of a case: counts, and the level and place of the first row.

        Cases are rolled up from it.
        """
        rollup = entity_rollup(
            self.charges,
            "case_id",
            "defendant_no",
            **self._outcomes(),
            first_row=F.min("row_order"),
            case_level=F.min_by("case_level", "row_order"),
        )
        # The person's id is the case's and the defendant's number: no third text is shuffled.
        return materialise(rollup.withColumn("person_id", paste("case_id", "defendant_no")), "defendants")

    @staticmethod
    def _outcomes() -> dict[str, Column]:
        """The number of diverted charges and, unless one has no result, of dismissed ones."""
        dismissed = if_else(F.col("result_description") == DISMISSED, F.lit(1), F.lit(0))
        return {
            "diverted": F.count_if(F.col("result_description") == DIVERSION),
            "dismissed": strict_sum(dismissed),
        }

    @cached_property
    def persons(self) -> DataFrame:
        """One row per person: charges, diverted and dismissed ones, and the dismissed share.

        Rolled up from the charges by one key with counts only, so its map-side part is hashed and
        never sorted. A person with a charge without result has no dismissed share.
        """
        persons = entity_rollup(self.charges, "person_id", **self._outcomes())
        share = ratio(F.col("dismissed"), F.col("num_charges"))
        return materialise(persons.withColumn("pct_dismissed", share), "persons")

    @cached_property
    def cases(self) -> DataFrame:
        """One row per case with the level of its first row."""
        return materialise(
            first_per_group(self.defendants, ["case_id"], "first_row", "case_level"), "cases"
        )

    @cached_property
    def persons_before_removal(self) -> DataFrame:
        """One row: the number of persons before superseded rows were removed.

        Those left and those who had no other rows than removed ones, who are all among the few
        interim rows; the ids of all charges are not compared again.
        """
        interim = add_keys(self.parts_of_interim).select("person_id").distinct()
        gone = interim.join(self.persons.select("person_id"), "person_id", "left_anti")
        both = self.persons.agg(F.count(F.lit(1)).alias("n")).unionByName(gone.agg(F.count(F.lit(1)).alias("n")))
        return materialise(both.agg(F.sum("n").alias("persons")), "person_count")

    @cached_property
    def tallies(self) -> DataFrame:
        """Charges per part, level, tags and result: what the charge figures are made from."""
        keys = ("data_part", "charge_level", "svf", "low_level", "result_description")
        return materialise(self.charges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "tallies")

    def fact(self) -> DataFrame:
        """The cleaned charges with all columns of the fact table; an absent column is an error."""
        there = {*self.charges.columns, "offense_description", "unique_id"}
        if missing := [c for c in CHARGE_FACT_COLUMNS if c not in there]:
            raise ValueError(f"the charges lack columns of the fact table: {missing}")
        # Rows are numbered as they are stored; ids and texts are added after that shuffle.
        return self.describe(add_keys(self.with_row_numbers(self._kept))).select(*CHARGE_FACT_COLUMNS)
