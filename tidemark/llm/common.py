"""Helpers shared by the training-data operators: staging, row mapping, splits and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of the word pattern [^\x20\x09-\x0D]+ that separate words; bytes.split() cuts at exactly these.
SPACE = b" \t\n\r\x0b\x0c"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a temporary one only where it names none and runs in one process."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder, and a cluster needs one")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again; for tables with whole texts."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal digits, modulo `of`: the fold of a row (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def text_hash(text: Column) -> Column:
    """A hash of a whole text; null counts as empty. With the id it names a row of documents."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


#: What Python workers remember between tasks; another operator's tasks on the same worker start without it.
WORKER_CACHES: list[dict] = []


def forget() -> None:
    """Empties the worker's caches and gives the memory back."""
    if any(WORKER_CACHES):
        for cache in WORKER_CACHES:
            cache.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, after the session's Arrow batches are held to `rows`: whole texts in batches of 10000 fill a worker's memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def per_text(df: DataFrame, fn: Callable[[list[bytes | None]], dict], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns that `fn` makes of a batch of whole texts (UTF-8, or None), beside the columns `keep`.

    Only `keep` and `text` are read, so extra or clashing columns of the input don't matter."""
    kept = small_batches(df).select(*dict.fromkeys([*keep, "text"]))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # bounds what Python objects of a batch take
                part = batch.slice(at, 1000)
                made = fn(texts(part))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(x if isinstance(x, pa.Array) else pa.array(x) for x in made.values())], [*keep, *made])

    return kept.mapInArrow(work, f"{types}, {schema}")


def size_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def splits_of(df: DataFrame) -> int:
    """In how many parts a shuffle of what df has should go: as many as df has, or as the session's shuffles have."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """One table for each run of rows with equal keys, of batches that are sorted by them; nulls are equal."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(k)) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            null = c.is_null().to_numpy(zero_copy_only=False)
            differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False)
            change[1:] |= differs | (null[1:] != null[:-1])
        key = [c[0].as_py() for c in columns]
        if held and key != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for k, (a, z) in enumerate(zip(edges, edges[1:])):
            if k and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
        last = [c[b.num_rows - 1].as_py() for c in columns]
    if held:
        yield pa.Table.from_batches(held)


def tree_summed(rows: DataFrame, add: Callable, kind: str, splits: int) -> DataFrame:
    """rows (with a part number i) after `add` over groups of splits and then over all: no task gets every split's rows."""
    if splits > 64:
        width = int(splits**0.5)
        rows = rows.withColumn("_g", F.spark_partition_id() % width).repartition(width, "_g").drop("_g").mapInArrow(add, kind)
    return rows.repartition("i").mapInArrow(add, kind)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the connected components of links (a, b), each named by its smallest node.

    Alternates large-star and small-star steps until neither changes an edge. Every step keeps one row
    per edge, so a hub costs as many rows as it has links; nothing is collected. Nodes without a link
    to another node don't appear. Lineage is cut at each round."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(joined.select("a", F.col("m").alias("b"))).distinct()
        edges = staged(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
