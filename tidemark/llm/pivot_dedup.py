"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are vectors of a bounded sample, none close to another. A vector is described by its nearest
pivots in order. Inverted lists hold, for each label and pivot, the vectors that have it among their `LISTS` nearest
ones. Two vectors that meet in a list and share at least `SHARED` of the `DESCRIBED` pivots of their descriptions are
candidates; their cosine in double precision decides. A pair that meets in several lists counts in the one of the
smallest pivot only.

Equal vectors of a label are one class with a number of copies before anything is emitted, so exact copies cost one row.
Near copies share their lists. A list that is longer than `BLOCK` is cut into blocks by a hash, and every two blocks
meet in a task of their own; a list yields the number of links of each vector and a spanning forest of the links, never
its pairs. The number of links between m different near copies still takes m * m / 2 cosines, which is what their count
asks for, in matrix products.

The number of pivots grows with the square root of the number of classes, from `SAMPLE` vectors at most, so that lists
grow no faster than that. Every class is in the index.

Defined cases: vectors that are null, empty, zero or hold a null or a component that isn't finite, and rows without a
label, link with nothing and are components of their own; vectors of different lengths don't link; rows that repeat a
vec_id are vectors of their own, and rows without a vec_id link, but name no component; an empty table gives an empty
result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, runs, size_checked, small_batches, splits_of, staged, stored

COSINE = 0.98
#: Vectors that pivots are chosen from, and pivots for each square root of the number of classes.
SAMPLE, PIVOTS = 4096, 2
#: Pivots are no closer to each other than this cosine.
APART = 0.7
#: Pivots in a description, lists that a vector is in, and pivots that candidates share.
DESCRIBED, LISTS, SHARED = 12, 5, 3
#: Vectors of a list that are compared in one task with as many others.
BLOCK = 4096
#: Rows of a block whose cosines are held at once.
ROWS = 512


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, label and v (doubles) of the rows that can link; a vector's scale is a power of two that makes its cosine safe."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select("vec_id", "label", v.alias("v")).where(F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def matrix(column, width: int | None = None) -> np.ndarray:
    """The rows of a list column as a matrix, cut or filled with zeros to `width`; each is scaled by a power of two."""
    rows = [np.asarray(x, np.float64) for x in column.to_pylist()]
    out = np.zeros((len(rows), width or max(map(len, rows), default=0)))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x[: out.shape[1]]
    largest = np.abs(out).max(1, initial=0)
    return np.ldexp(out, -np.frexp(np.where(largest > 0, largest, 1))[1][:, None])


def chosen_pivots(classes: DataFrame, n: int) -> np.ndarray:
    """Directions of at most PIVOTS * sqrt(n) vectors of a hashed sample, none near an earlier one."""
    found = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    x = matrix(pa.array([r["v"] for r in found], pa.list_(pa.float64())))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want, out = max(DESCRIBED, int(PIVOTS * n**0.5)), np.zeros((0, x.shape[1]))
    for row in x:
        if len(out) < want and (not len(out) or (out @ row).max() < APART):
            out = np.vstack([out, row])
    return out


def described(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """classes with `near`: the numbers of their nearest pivots in order, the nearest first."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(pivots)  # at most SAMPLE rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        k = min(DESCRIBED, len(of))
        for b in batches:
            near = []
            for at in range(0, b.num_rows, ROWS):
                x = matrix(b.column(2).slice(at, ROWS), of.shape[1])
                near += np.argsort(-(x @ of.T), axis=1, kind="stable")[:, :k].astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.list_(pa.int32()))], [*b.schema.names, "near"])

    label = classes.schema["label"].dataType.simpleString()
    return small_batches(classes).select("class", "label", "v", "copies").mapInArrow(describe, f"class long, label {label}, v array<double>, copies long, near array<int>")


def lists(index: DataFrame) -> DataFrame:
    """The rows of index in each of their lists: (label, pivot, one, two, side), once for every block of the list.

    Blocks one and two of a list meet; side says in which of them a row is (0: both are the same block)."""
    entries = index.withColumn("pivot", F.explode(F.slice("near", 1, LISTS)))
    size = entries.groupBy("label", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    long = size_checked(size.where("blocks > 1"), 100_000)
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = entries.join(long, ["label", "pivot"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return met.select("label", "pivot", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), side.alias("side"), "class", "v", "copies", "near")


def linked(near_a: np.ndarray, near_b: np.ndarray, a: np.ndarray, b: np.ndarray, pivot: int) -> np.ndarray:
    """Which rows of a and b are linked, and meet first at this pivot: they share pivots enough, and their cosine is high."""
    names, places = np.unique(np.concatenate([near_a, near_b]), return_inverse=True)
    places = places.reshape(-1, near_a.shape[1])
    has = np.zeros((len(places), len(names)), np.float32)
    np.put_along_axis(has, places, 1, 1)
    first = np.zeros_like(has)
    np.put_along_axis(first, places[:, :LISTS], 1, 1)
    first[:, names >= pivot] = 0
    n = len(near_a)
    enough = has[:n] @ has[n:].T >= min(SHARED, near_a.shape[1])
    enough &= first[:n] @ first[n:].T == 0
    return enough & ((a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)) >= COSINE)


def links(met: DataFrame) -> DataFrame:
    """(a, b, n) of the rows of lists: n links of class a where b is null, else an edge of a spanning forest of a list's links."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "label", "pivot", "one", "two"):
            if table.num_rows < 2:
                continue
            pivot, ids = table["pivot"][0].as_py(), table["class"].to_numpy()
            sides, copies = table["side"].to_numpy(), table["copies"].to_numpy()
            near = np.array(table["near"].to_pylist(), np.int32)
            v, size = matrix(table["v"]), np.array([len(x) for x in table["v"].to_pylist()])
            left, right = np.flatnonzero(sides < 2), np.flatnonzero(sides != 1)
            one = bool(len(left)) and sides[left[0]] == 0
            group, count, edges = np.arange(len(ids)), np.zeros(len(ids), np.int64), []
            for at in range(0, len(left), ROWS):
                rows = left[at : at + ROWS]
                mask = linked(near[rows], near[right], v[rows], v[right], pivot) & (size[rows][:, None] == size[right])
                if one:
                    mask &= rows[:, None] != right
                count[rows] += mask @ copies[right]
                if not one:
                    count[right] += copies[rows] @ mask
                for k in np.flatnonzero(mask.any(1)):
                    partners = right[mask[k]]
                    roots, where = np.unique(group[partners], return_index=True)
                    for j in partners[where[roots != group[rows[k]]]]:
                        edges.append((ids[rows[k]], ids[j]))
                    joined = np.append(roots, group[rows[k]])
                    if len(joined) > 1:
                        group[np.isin(group, joined)] = joined.min()
            some = np.flatnonzero(count)
            a = [*ids[some].tolist(), *(int(x) for x, _ in edges)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(some) + [int(x) for _, x in edges], pa.int64()), pa.array([*count[some].tolist(), *[0] * len(edges)], pa.int64())], ["a", "b", "n"])

    keys = ["label", "pivot", "one", "two"]
    return small_batches(met).repartition(splits_of(met), *keys).sortWithinPartitions(*keys).mapInArrow(found, "a long, b long, n long")


def embedding_duplicates(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of table (vec_id, embedding, label)."""
    rows = stored(vectors(table))
    classes = rows.groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()))
    n = classes.count()
    alone = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    if not n:
        return alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = staged(links(lists(stored(described(classes, chosen_pivots(classes, n))))))
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).toDF("class", "root")
    named = classes.select("class", "label", "v", "copies", "least").join(counts, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(least, "root").select("label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    joined = alone.join(known, ["label", "v"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
