"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits differ in at most one bit of one of their two halves. So every
distinct fingerprint emits, for each half, all variants of it within half the radius (one bit); the variants are
the shuffle key, the whole fingerprint is carried. Where an exact half meets a variant, the other half decides.
A bucket yields a spanning forest of its links, never its pairs, by a second meeting in the middle over the other
half, which takes time in proportion to its size.

Exact copies collapse into one fingerprint before anything is emitted, so a group of copies costs one row.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a text of one or two
words is one shingle; repeated rows keep their rows and share a component; an empty table gives an empty result;
other columns of the input are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, per_text, staged

SEED = 42
WIDTH = 3
#: Distinct fingerprints for each partition of the shuffle on variants.
PER_PARTITION = 20_000
_LOW = np.uint64(0xFFFFFFFF)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a whole text: a bit is set if over half the shingle hashes have it set."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and fp, the fingerprint as a signed long, of every row of docs."""
    made = lambda batch: {"fp": pa.array(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))}
    return per_text(docs, made, "fp long", keep)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def emitted(fps: DataFrame) -> DataFrame:
    """(variant, fp): each half of fp with at most one bit flipped; bit 32 of the variant names the half."""
    flips = F.array(*(F.lit(x).cast("long") for x in [0] + [1 << k for k in range(32)]))
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.array(low, high.bitwiseOR(F.lit(1 << 32)))
    return fps.select("fp", F.explode(halves).alias("half")).select(F.explode(flips).alias("flip"), "half", "fp").select(F.col("half").bitwiseXOR(F.col("flip")).alias("variant"), "fp")


class _Forest:
    """Union-find over what has been linked; keeps the edges that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def link(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def bucket_links(variant: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints (unsigned) that meet on a variant.

    In a bucket an exact entry stands at all points within one bit of its other half, a variant (one bit is spent) at
    its own. Entries at one point are linked, and so are points one bit apart: with both steps and the bits that were
    spent, that is every pair within three bits that has an exact entry, and no pair beyond it. The time is in
    proportion to the entries, for buckets of any size, and all buckets are worked on at once."""
    order = np.argsort(variant, kind="stable")
    variant, fp = variant[order], fp[order]
    high = (variant >> np.uint64(32)) > 0
    exact = np.where(high, fp >> np.uint64(32), fp & _LOW) == (variant & _LOW)
    start = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]])) if len(variant) else np.zeros(0, int)
    size = np.diff(np.concatenate([start, [len(variant)]]))
    some = (np.add.reduceat(exact, start) > 0) & (size > 1) if len(start) else np.zeros(0, bool)
    kept = np.repeat(some, size)
    bucket = np.repeat(np.cumsum(some).astype(np.uint64) << np.uint64(32), size)[kept]
    fp, exact = fp[kept], exact[kept]
    other = np.where(high[kept], fp & _LOW, fp >> np.uint64(32)) | bucket
    forest = _Forest()
    if not len(fp):
        return forest.edges
    bits = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint64)
    point = np.concatenate([(other[exact][:, None] ^ bits).ravel(), other[~exact]])
    owner = np.concatenate([np.repeat(fp[exact], 33), fp[~exact]])
    order = np.lexsort((owner, point))
    point, owner = point[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
    leader = np.repeat(owner[first], np.diff(np.concatenate([first, [len(point)]])))
    pairs = [np.stack([owner, leader], 1)[owner != leader]]
    points, leaders = point[first], owner[first]
    for k in range(32):
        want = points ^ np.uint64(1 << k)
        at = np.minimum(np.searchsorted(points, want), len(points) - 1)
        hit = (points[at] == want) & (points < want) & (leaders != leaders[at])
        pairs.append(np.stack([leaders[hit], leaders[at[hit]]], 1))
    for a, b in np.unique(np.concatenate(pairs), axis=0).tolist():
        forest.link(a, b)
    return forest.edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        variant, fp = (np.concatenate(x).view(np.uint64) for x in zip(*held))
        edges = np.array(bucket_links(variant, fp), np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def fingerprint_roots(prints: DataFrame) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint of prints (fp), named by a fingerprint."""
    distinct = staged(prints.select("fp").distinct())
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct.count() // PER_PARTITION + 1)
    links = emitted(distinct).repartition(parts, "variant").mapInArrow(_links, "a long, b long")
    return staged(distinct.join(components(links), distinct["fp"] == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))


def component_firsts(prints: DataFrame, first: Column) -> DataFrame:
    """(fp, first): the least `first` (of the rows of prints) in the component of each distinct fingerprint."""
    least = prints.groupBy("fp").agg(F.min(first).alias("first"))
    rooted = fingerprint_roots(prints).join(least, "fp")
    return rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("first").alias("first")), "root").select("fp", "first")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs."""
    prints = staged(fingerprints(docs))
    return prints.join(component_firsts(prints, F.col("doc_id")), "fp").select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("first").alias("component_id"))
