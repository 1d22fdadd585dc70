"""Charge-record analytics on Spark DataFrames."""

from docketry.operators.frequency import freq_table
from docketry.plans.build import CodeLists, build_charges, build_from_parts
from docketry.plans.report import report
from docketry.plans.tables import ChargeTables
from docketry.sources.files import read_parts

__all__ = ["ChargeTables", "CodeLists", "build_charges", "build_from_parts", "freq_table", "read_parts", "report"]
