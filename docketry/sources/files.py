"""Readers for record parts, code lists, rule lists and the code table."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.schemas import CHARGE_PART, CODE_LIST, CODE_TABLE, RULE_COLUMNS

# Blanks around list entries would end up inside the codes they are compared with; a quote
# inside a quoted cell is doubled.
_CSV = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "escape": '"'}

# In lists and in the code table the text NA stands for a missing value, as an empty cell does.
_LIST = {**_CSV, "nullValue": "NA"}

# Header characters that are spelled out or dropped.
HEADER_SIGNS = {"'": "", '"': "", "%": "_percent_", "#": "_number_"}


def snake_case(name: str) -> str:
    """Header text as a column name: "Masked Case No." becomes masked_case_no."""
    for sign, word in HEADER_SIGNS.items():
        name = name.replace(sign, word)
    words = re.sub(r"([a-z0-9])([A-Z])|([A-Z])(?=[A-Z][a-z])", r"\1\3_\2", name)
    snake = re.sub(r"[^0-9A-Za-z]+", "_", words).strip("_").lower()
    return f"x{snake}" if not snake or snake[0].isdigit() else snake


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case all headers; a repeated name gets the number of its repetition."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        name = snake_case(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def headers(spark: SparkSession, path: str, **options) -> dict[str, list[str]]:
    """The files of a CSV part by their header line.

    Found by one pass over the first split of each file, which keeps a line a file. Files without
    any line hold no rows and have no header.
    """
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    text = {k: v for k, v in options.items() if k in ("encoding", "lineSep", "pathGlobFilter", "recursiveFileLookup")}
    lines = spark.read.options(**text).text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    first = lines.filter("at.file_block_start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    found: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        found.setdefault(row.header.lstrip("\ufeff").rstrip("\r"), []).append(row.file)
    return found


def _raw_part(spark: SparkSession, path: str, fmt: str, options: dict) -> DataFrame:
    """The declared columns of a part as they are in the files, with file, block and line of each row.

    CSV files with the same header are read together, with that header, and the readers are united
    by column name. A declared column that only some files have is an error.
    """
    if fmt != "csv":
        return _with_origin(spark.read.format(fmt).options(**options).load(path), fmt)
    reader = spark.read.format(fmt).options(header=True, enforceSchema=False, **_CSV).options(**options)
    groups = list(headers(spark, path, **options).values())
    frames = [_with_origin(reader.load(paths if len(groups) > 1 else path), fmt) for paths in groups or [path]]
    columns = [set(df.columns) for df in frames]
    if odd := sorted(set.union(*columns) - set.intersection(*columns)):
        raise ValueError(f"some files of {path} lack the columns {odd}")
    return reduce(DataFrame.unionByName, frames)


def _with_origin(df: DataFrame, fmt: str) -> DataFrame:
    line = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
    block = F.lit(0).cast("bigint") if fmt == "parquet" else F.col("_metadata.file_block_start")
    origin = df.select("*", F.col("_metadata.file_path"), block.alias("file_block_start"), line.alias("file_line"))
    part = clean_names(origin).withColumnsRenamed(
        {"file_path": "_file", "file_block_start": "_block", "file_line": "_line"}
    )
    return part.select(*[f.name for f in _declared(part)], "_file", "_block", "_line")


def _declared(part: DataFrame) -> list[T.StructField]:
    return [f for f in CHARGE_PART if f.name in part.columns and f.name != "data_part"]


def read_part(spark: SparkSession, path: str, tag: str, fmt: str = "csv", bad_cells: str = "raise", **options) -> DataFrame:
    """Read one record part and tag its rows with their origin.

    Columns are found by header name, whatever their order, and cast to the declared types. The
    files of a part may differ in the order of their columns and in columns that are not declared.
    `bad_cells` says what happens to a cell that is no number or date where one is declared:
    "raise" ends the read, "missing" makes it a missing value; `quarantine` lists these cells.
    """
    if bad_cells not in ("raise", "missing"):
        raise ValueError(f"unknown way with bad cells: {bad_cells}")
    part = _raw_part(spark, path, fmt, options)
    typed = lambda f: (F.col(f.name).cast if bad_cells == "raise" else F.col(f.name).try_cast)(f.dataType).alias(f.name)
    return part.select(*map(typed, _declared(part)), F.lit(tag).alias("data_part"), "_file", "_block", "_line")


def read_parts(
    spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv", bad_cells: str = "raise", **options
) -> dict[str, DataFrame]:
    """Read several parts, given as {tag: path}."""
    return {tag: read_part(spark, path, tag, fmt, bad_cells, **options) for tag, path in paths.items()}


def quarantine(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv", **options) -> DataFrame:
    """Every cell of the parts that does not fit its declared type: part, file, block, line, column and raw text."""
    found = None
    for tag, path in paths.items():
        part = _raw_part(spark, path, fmt, options)
        unfit = lambda f: F.when(
            F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(),
            F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("raw")),
        )
        cells = F.array_compact(F.array(*[unfit(f) for f in _declared(part) if f.dataType != T.StringType()]))
        cells = cells.cast("array<struct<column:string,raw:string>>")
        rows = part.select(
            F.lit(tag).alias("part"), F.col("_file").alias("file"), F.col("_block").alias("block"),
            F.col("_line").alias("line"), F.inline(cells),
        )
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no parts given")
    return found


def bad_cell_counts(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv", **options) -> DataFrame:
    """For every part and typed column, the number of its cells in `quarantine`; zero where there are none."""
    names = [f.name for f in CHARGE_PART if f.dataType != T.StringType()]
    pairs = [(tag, name) for tag in paths for name in names]
    every = F.explode(F.array(*[F.struct(F.lit(t).alias("part"), F.lit(n).alias("column")) for t, n in pairs]))
    counts = quarantine(spark, paths, fmt, **options).groupBy("part", "column").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(1).select(every.alias("c")).select("c.*")
    return grid.join(counts, ["part", "column"], "left").select("part", "column", F.coalesce("n", F.lit(0)).alias("bad_cells"))


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """Read a one-column list of codes with a header line."""
    return spark.read.options(header=True, **_LIST).schema(CODE_LIST).csv(path)


def read_listed_codes(spark: SparkSession, path: str, column: str = "code_section") -> DataFrame:
    """Read one column of a list file with any number of columns."""
    return clean_names(spark.read.options(header=True, **_LIST).csv(path)).select(column)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Read a rule list: headers snake-cased, unnamed columns dropped, blanks in codes as "_"."""
    rules = clean_names(spark.read.options(header=True, **_LIST).csv(path))
    return rules.select(*[c for c in RULE_COLUMNS if c in rules.columns]).withColumn(
        "charge", F.replace("charge", F.lit(" "), F.lit("_"))
    )


def read_code_table(spark: SparkSession, path: str) -> DataFrame:
    """Read the headerless code table; `row_order` keeps the order of its lines."""
    table = spark.read.options(**_LIST).schema(CODE_TABLE).csv(path)
    origin = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return table.select("*", origin.alias("row_order"))
