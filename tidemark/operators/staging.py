"""Results that are used more than once, kept where every executor finds them."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a reliable checkpoint in the folder that the session names.

    Only a session in one process may go without one; it gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder, and a cluster needs one")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-kept-"))
    return df.checkpoint(eager=True)


@contextmanager
def evenly(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is kept inside keep their partitions: few rows that are slow to judge would share one by their size."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows that are sent to every executor at most.
FEW = 10_000


def sent(df: DataFrame) -> DataFrame:
    """df kept, and sent to every executor by joins if it has few rows; then the other side stays where it is."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= FEW else df


#: Rows of a few numbers that are sent to every executor at most: some 200 MB.
MANY = 1_000_000


def brought(df: DataFrame) -> DataFrame:
    """df of rows of a few numbers, kept, and sent to every executor by joins unless there are too many."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= MANY else df
