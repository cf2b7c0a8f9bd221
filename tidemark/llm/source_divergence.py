"""Source divergence audit: how the word use of each source differs from the other sources of its language.

DuckDB counts shards of terms, Spark merges their sums and rankings:

1. Every task counts the terms of its texts by (lang, source), bounded in memory, and deals its counts to shards by a
   hash of lang and term. A term's counts are in one shard whole.
2. In each shard SQL sums the counts, keeps the terms that enough documents of the language have, and counts them for
   the language, too. Kept terms and their totals are sums over shards.
3. The totals of all groups go to every shard: a group that lacks a term has its smoothed share all the same. SQL makes
   each shard's part of the pair sums, and its best terms of each group, in blocks of `BLOCK` sources: a task holds sums
   of so many sources with the others of their language, whatever number of sources there is.
4. Spark adds up the parts of the pair sums and ranks pairs and terms.

All arithmetic is in integers, of 128 bits where counts are scaled. Every word of every text counts, also in very long
texts, which are cut between words.

Defined cases: null texts, langs and sources count as empty strings; a row is a document, so repeated rows count one by
one and ids don't matter; a group without terms is ranked with counts of zero; where a language keeps no term, its pairs
have value 0 and no term is listed; a language with one source has no pairs; ties are ranked by item; an empty table
gives an empty result; other columns of the input are ignored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, runs, small_batches, splits_of, staged, texts

#: Documents of a language that a term must be in.
DOCUMENTS = 30
#: Terms that are listed for a group.
LISTED = 50
#: Fixed values of the smoothed shares: what is added to a count, and the scale.
ADDED, SCALE = 5, 1_000_000_000
#: Different terms that a task holds before it passes their counts on.
HELD = 300_000
#: Bytes of a text that are cut into terms together.
PIECE = 1 << 20
#: Kept rows of a shard of pair sums, and sources that are paired with the others at once.
SHARD_ROWS, BLOCK = 20_000, 128
#: Letters become small, all that is no letter of ASCII and no byte over 0x7F a blank.
FOLDED = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

COUNTS = """
with counted as (select lang, term, source, sum(n)::bigint as n, sum(d)::bigint as d from partial group by all),
many as (select lang, term from counted group by lang, term having sum(d) >= $documents)
select lang, source, term, n from counted semi join many using (lang, term)
union all select lang, null, term, sum(n)::bigint from counted semi join many using (lang, term) group by lang, term"""

SHARES = """
create or replace temp table shares as
with total as (select lang, source, total + $added * v as size, row_number() over (partition by lang order by source) as k from shard where term is null and v > 0),
kept as (select lang, source, term, n from shard where term is not null),
term as (select distinct lang, term from kept)
select total.lang, term.term, total.source, k, coalesce(n, 0) as n, (1 + $scale::hugeint * (coalesce(n, 0) + $added) // size)::bigint as p
from term join total on term.lang = total.lang left join kept on kept.lang = total.lang and kept.source is not distinct from total.source and kept.term = term.term"""

PAIRS = """
select 'pair' as part, a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source < b.source
where a.k > $first and a.k <= $last group by all"""

TERMS = """
select 'term' as part, g.lang, g.source, g.term as item, g.p - l.p as value
from shares g join shares l on l.lang = g.lang and l.term = g.term and l.source is null
where g.source is not null and g.n > 0 and g.p > l.p and g.k > $first and g.k <= $last
qualify row_number() over (partition by g.lang, g.source order by value desc, item) <= $listed"""


def terms(text: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists of some `piece` bytes of text."""
    folded = (text or b"").translate(FOLDED)
    at = 0
    while len(folded) - at > piece:
        cut = folded.find(b" ", at + piece)
        if cut < 0:
            break
        yield folded[at:cut].split()
        at = cut
    yield folded[at:].split()


def connected():
    """A DuckDB connection for one task: one thread, bounded memory, no files."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def strings(values: list[bytes]) -> pa.Array:
    """The UTF-8 bytes of texts as strings."""
    return pa.array(values, pa.binary()).view(pa.string())


def partial_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, as tasks have counted them; several rows a term."""
    names = ["lang", "source", "term", "n", "d"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), pa.repeat(source, len(n)), strings(list(n)), pa.array(list(n.values()), pa.int64()), pa.array([d[w] for w in n], pa.int64())], names)
            held.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b)):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for words in terms(text):
                    n.update(words)
                    seen.update(words)
                d.update(seen)
                size += len(n)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    return small_batches(rows).select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, d long")


def kept_counts(rows: DataFrame, shards: int, documents: int = DOCUMENTS) -> DataFrame:
    """(lang, source, term, n) of the terms in at least `documents` rows of their lang; source is null for the whole lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = connected()
        for shard in runs(batches, "shard"):
            db.register("partial", shard)
            yield from db.sql(COUNTS, params={"documents": documents}).to_arrow_table().to_batches()
            db.unregister("partial")

    dealt = partial_counts(rows).withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(count, "lang string, source string, term string, n long")


def compared(rows: DataFrame, listed: int) -> DataFrame:
    """(part, lang, source, item, value): each shard's part of the pair sums (source < item), and its best terms."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = connected()
        for shard in runs(batches, "shard"):
            db.register("shard", shard)
            db.execute(SHARES, {"added": ADDED, "scale": SCALE})
            most = db.execute("select coalesce(max(k), 0) from shares").fetchall()[0][0]
            for first in range(0, most, BLOCK):
                block = {"first": first, "last": first + BLOCK}
                yield from db.sql(PAIRS, params=block).to_arrow_table().to_batches()
                yield from db.sql(TERMS, params=block | {"listed": listed}).to_arrow_table().to_batches()
            db.unregister("shard")

    return rows.mapInArrow(compare, "part string, lang string, source string, item string, value long")


def source_divergence(docs: DataFrame, documents: int = DOCUMENTS, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value and rank: the other sources and the own terms of every (lang, source) of docs."""
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    shards = splits_of(docs)
    kept = staged(kept_counts(rows, shards, documents))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("v"))
    whole = sums.where("source is null").select("lang", "total", "v")
    groups = staged(rows.select("lang", "source").distinct())
    own = groups.join(sums.select("lang", "source", "total"), ["lang", "source"], "left").join(whole.select("lang", "v"), "lang", "left")
    totals = own.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")).union(whole.select("lang", F.lit(None).cast("string"), "total", "v"))

    few = max(1, min(shards, kept.count() // SHARD_ROWS + 1))
    none = lambda kind: F.lit(None).cast(kind)
    dealt = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(few)).cast("int").alias("shard"), "lang", "source", "term", "n", none("long").alias("total"), none("long").alias("v"))
    every = totals.select(F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("shard"), "lang", "source", none("string").alias("term"), none("long").alias("n"), "total", "v")
    found = compared(dealt.union(every).repartition(few, "shard").sortWithinPartitions("shard"), listed)
    # a language that keeps no term has pairs, too
    bare = groups.join(totals.where("v = 0").select("lang").distinct(), "lang", "left_semi")
    zeros = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source < item").select(F.lit("pair").alias("part"), "lang", "source", "item", F.lit(0).cast("long").alias("value"))
    found = staged(found.union(zeros).groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value")))

    sides = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = found.where("part = 'pair'").select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    best = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(best.withColumn("rank", rank).where(F.col("rank") <= listed))
