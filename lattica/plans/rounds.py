"""Cutting the lineage of iterative plans with tables in the shared folder.

All tables of an application stand in one folder under spark.checkpoint.dir, so that `clear` removes what is left of them;
loops `discard` a round's tables once the next round's are written. The shuffle files of a round are removed as soon as its
table is written: the table replaces them, also for recovery from lost executors.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The application's folder under spark.checkpoint.dir. Where that is unset, a local one is set in local mode; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it, a query's shuffle files are removed when the query ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back; survives lost executors, unlike a local checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if OPEN:
        OPEN[-1].tables.append(out)
    return out


def cut_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """cut, and the number of rows, read from the footers of the files."""
    out = cut(df, name)
    return out, out.count()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by cut that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_cut_path", None):
            remove(t.sparkSession, t._cut_path)


class Scratch:
    """The tables cut within a `with scratch()`; all but those kept are deleted at its end."""

    def __init__(self):
        self.tables, self.kept = [], set()

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._cut_path)
        return table


OPEN: list[Scratch] = []


@contextmanager
def scratch():
    """For steps that end in tables they write: what else they wrote goes when they are done. Plans that still read one of the
    other tables must not leave the block."""
    mine = Scratch()
    OPEN.append(mine)
    try:
        yield mine
    finally:
        OPEN.pop()
        kept = [t for t in mine.tables if t._cut_path in mine.kept]
        discard(*[t for t in mine.tables if t._cut_path not in mine.kept])
        if OPEN:
            OPEN[-1].tables += kept


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has cut."""
    remove(spark, shared_dir(spark))
