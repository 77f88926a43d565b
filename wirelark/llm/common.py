"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelark import shared

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^ \t-\r]+")
WORD_BYTES = re.compile(rb"[^ \t-\r]+")
#: Rows that are broadcast at most (keys and a few numbers: some 30 MB), and texts of a batch for a Python worker.
MOST_BROADCAST, TEXT_BATCH = 200_000, 1024
#: Where an enclosing scratch() has intermediate tables written.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nothing has used yet in the folder all executors share; it goes with the scratch() around it or with the run."""
    path = shared.fresh_path(spark, name)
    return f"{inside}/{path.rpartition('/')[2]}" if (inside := _scratch.get()) else path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end: what is needed later is materialised outside."""
    path = shared.fresh_path(spark, "scratch")
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        shared.remove(spark, path)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], rows: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """left joined with right, which has each key once and ``n``, the rows that left has of it; n is dropped.

    rows: the sum of n. right is written and counted: up to ``most_broadcast`` rows are broadcast. Of more, the keys
    that hold a ten-thousandth of left's rows or more, which are 10,000 at most, are broadcast; no other
    key is more than a ten-thousandth of a shuffle.
    """
    right = materialise(right)
    if right.count() <= most_broadcast:
        return left.join(F.broadcast(right.drop("n")), keys)
    heavy = max(1000, rows // 10_000)
    by_broadcast = left.join(F.broadcast(right.where(F.col("n") >= heavy)), keys)
    by_shuffle = left.join(right.where(F.col("n") < heavy), keys)
    return by_broadcast.unionByName(by_shuffle).drop("n")


def text_batches(df: DataFrame) -> DataFrame:
    """df, whose whole texts are about to go to Python workers: the session's batches are bounded at TEXT_BATCH rows, so that what a worker holds is."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_BATCH:
        conf.set(name, TEXT_BATCH)
    return df
