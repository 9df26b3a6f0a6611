"""What the corpus operators share: reading tables, stage tables in the shared folder, small Column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D. ``bytes.split()`` cuts at exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Where a session on one machine names none (tests), a folder of this machine becomes the checkpoint folder; on a
    cluster that is an error, since the others could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="pagequarry-"))
            named = context._jsc.sc().getCheckpointDir().get()
    return named if "://" in named or named.startswith("file:") else "file://" + os.path.abspath(named)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pagequarry/{name}-{uuid.uuid4().hex}"


#: With this setting the shuffle files of an execution go when it ends, not when the driver's memory is next collected.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files. A plan that runs again computes them anew."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


#: Paths of stage tables by the blocks of ``scratch`` that are open, outermost first.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Stage tables written inside are deleted when the block ends, but for those written with ``keep``."""
    token = _written.set((*_written.get(), []))
    try:
        yield
    finally:
        for path in _written.get()[-1]:
            drop_path(spark, path)
        _written.reset(token)


def stage_table(df: DataFrame, name: str, path: str | None = None, keep: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: work done once, and no lineage behind it to lose.

    Inside ``scratch`` the table goes when the block ends; with ``keep`` when the block around it does, if there is one.
    A table at a given ``path`` is the caller's to delete.
    """
    held = _written.get()[: -1 if keep else None]
    if path is None:
        path = new_path(df.sparkSession, name)
        if held:
            held[-1].append(path)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE_CLASS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_crc(col: Column) -> Column:
    """crc32 of the id's decimal text: what splits training rows from held-out ones."""
    return F.crc32(col.cast("string"))


def column_bytes(col: Column) -> Column:
    return F.octet_length(F.coalesce(col, F.lit("")))
