"""Tables written once in the shared folder, where several analyses read them, and freed by their owner.

Every written table is a managed table of a database that lies in the shared folder, so that
dropping it deletes its files wherever they are. A table belongs to the block (`owned`) in which it
was written and goes when the block ends; a table written outside of any block stays until
`clean_up`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from hashlib import sha256
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

ARROW_SETTING, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
# Files that a task of a partitioned write keeps open, one per part and interim status (ten digits); with more
# partitions Spark sorts the task's remaining rows.
FILES_SETTING, FILES_OPEN = "spark.sql.maxConcurrentOutputFileWriters", 20

# Per application, the tables of each open block, innermost last; the first block never ends.
_blocks: dict[str, list[list[str]]] = {}
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    A local session has one machine and may do without: its tables then lie in its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.split("[")[0] == "local":
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder in which this application keeps its tables."""
    return f"{shared_folder(spark).rstrip('/')}/docketry/{spark.sparkContext.applicationId}"


def _database(spark: SparkSession) -> str:
    return f"docketry_{sha256(own_folder(spark).encode()).hexdigest()[:16]}"


def _open_blocks(spark: SparkSession) -> list[list[str]]:
    return _blocks.setdefault(spark.sparkContext.applicationId, [[]])


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the frame as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not the joins before it. The file
    sizes also tell Spark whether the table is small enough to broadcast.
    """
    return _write(df, name, partition_by, _open_blocks(df.sparkSession)[-1])


def _write(df: DataFrame, name: str, partition_by: Sequence[str], block: list[str]) -> DataFrame:
    spark = df.sparkSession
    database, table = _database(spark), f"{name}_{uuid4().hex}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{own_folder(spark)}'")
    with _small_arrow_batches(spark), _files_side_by_side(spark):
        df.write.partitionBy(*partition_by).format("parquet").saveAsTable(f"{database}.{table}")
    written = spark.read.schema(df.schema).parquet(f"{own_folder(spark)}/{table}").select(*df.columns)
    block.append(f"{database}.{table}")
    _tables[written] = f"{database}.{table}"
    return written


@contextmanager
def _small_arrow_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, Python gets at most `ARROW_ROWS` rows at a time, since rows may be long texts.

    A batch is held by the executor and by its Python worker, once on each way.
    """
    before = spark.conf.get(ARROW_SETTING)
    if 0 < int(before) <= ARROW_ROWS:
        yield
        return
    spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(ARROW_SETTING, before)


@contextmanager
def _files_side_by_side(spark: SparkSession) -> Iterator[None]:
    """While a table is written, rows go to the files of their partitions as they come, without a sort before."""
    before = spark.conf.get(FILES_SETTING)
    spark.conf.set(FILES_SETTING, str(max(int(before), FILES_OPEN)))
    try:
        yield
    finally:
        spark.conf.set(FILES_SETTING, before)


def location(df: DataFrame) -> str:
    """The folder of a frame that `materialise` gave."""
    return f"{own_folder(df.sparkSession)}/{_tables[df].split('.')[1]}"


def free(*frames: DataFrame) -> None:
    """Drop the tables behind frames that `materialise` gave; whatever reads them must be written by now."""
    for df in frames:
        if table := _tables.pop(df, None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
            for block in _open_blocks(df.sparkSession):
                if table in block:
                    block.remove(table)


@contextmanager
def owned(spark: SparkSession) -> Iterator[list[str]]:
    """A block that owns the tables written in it and drops them when it ends, also by an error."""
    blocks = _open_blocks(spark)
    blocks.append(block := [])
    try:
        yield block
    finally:
        blocks.remove(block)
        for table in block:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def finished(spark: SparkSession, name: str, build: Callable[[], DataFrame], always: bool = False) -> DataFrame:
    """The frame `build` makes, written for the caller's block if tables were written on the way; those go.

    With `always` it is written in any case.
    """
    outer = _open_blocks(spark)[-1]
    with owned(spark) as block:
        df = build()
        return _write(df, name, (), outer) if block or always else df


def clean_up(spark: SparkSession) -> None:
    """Drop all tables this application has written; frames that read them become useless."""
    spark.sql(f"DROP DATABASE IF EXISTS {_database(spark)} CASCADE")
    _blocks.pop(spark.sparkContext.applicationId, None)
