"""LM scoring by masked pseudo-likelihood.

Every word has a class: the most frequent words (at least one token in `SHARE`) have one each, the others share classes by the hash of their ending.
A bidirectional window network (numpy) predicts every token's class from two tokens on both sides. It is trained in
rounds: each partition starts from the shared weights, takes gradient steps at the round's positions of all its texts,
and the partitions' weights are averaged by the positions they trained on; over the rounds every position is masked
once. A token's probability is that of its class given its neighbours, times that of the word in its class, which
follows the counts of all words of the corpus. A document's score is the sum of the logarithms of these.

The counts grow with the corpus and stay distributed. Words are told apart by 64-bit hashes that end in their class;
hashes are dealt to buckets, as many as the input has splits at least, and a bucket's counts are one row of arrays. A
chunk of documents sends each bucket the hashes of its own words, once, and gets their counts back; a task streams
the chunks past one bucket's counts, so a frequent word is no hot key. Only the most frequent words, the classes' sums
and one set of weights reach the driver. Masks follow the text, so a lost task trains again as before.

Defined cases: a null, empty or blank text has no tokens, log_prob 0 and a null mean; repeated rows are scored one by
one; an empty table gives an empty result; other columns of the input are ignored."""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import forget, small_batches, staged, texts, tree_summed

WORDS = 192
ENDINGS = 64
#: A word with a class of its own is at least one token in this many; so it is frequent in some task, too.
SHARE = 5000
SIDE = 2
HIDDEN = 32
ROUNDS = 2
BATCH = 512
#: Different words that a task holds before it passes them on.
HELD = 200_000
#: Different words and documents of one chunk of scored documents; the latter are numbered in 16 bits.
CHUNK, DOCUMENTS = 150_000, 50_000
#: Bytes of texts that are cut into words together, if they are several.
PART = 2_000_000
CLASSES = WORDS + ENDINGS
LOW = np.uint64(ENDINGS - 1)


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; words are UTF-8 bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for text in texts(b):
                held.update(tokens(text))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return small_batches(docs).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: What one byte does to a CRC-32: the register after it, from a register of zeros.
_STEP = np.array([crc32(bytes([b ^ 0xFF])) ^ 0xFFFFFFFF ^ 0x00FFFFFF for b in range(256)], np.uint32)


def shared_classes(words: list[bytes]) -> np.ndarray:
    """The shared class of each word: the CRC-32 of its last three bytes, modulo ENDINGS."""
    if not words:
        return np.zeros(0, np.int32)
    code = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 2
    first = np.append(0, end[:-1] + 2)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (2, 1, 0):
        at = end - back
        step = _STEP[(crc ^ code[np.maximum(at, 0)]) & 0xFF] ^ (crc >> np.uint32(8))
        crc = np.where(at >= first, step, crc)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % ENDINGS).astype(np.int32)


def hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit number of each word, whose last bits are the shared class of its ending."""
    made = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    return (made & ~LOW) | shared_classes(words).astype(np.uint64)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (text last) of at most 500 rows and PART bytes, or of one row."""
    size = np.cumsum(np.array([len(t or b"") for t in texts(batch)], np.int64)) // PART
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield from (batch.slice(k, min(500, b - k)) for k in range(a, b, 500))


class Network:
    """Class tables for each neighbour position, a tanh layer and a softmax over the classes."""

    def __init__(self, words: list[bytes], prior: np.ndarray, seed: int = 5):
        self.at = {w: k for k, w in enumerate(words)}
        draw = np.random.default_rng(seed)
        self.weights = [
            draw.normal(0, 0.05, (2 * SIDE, CLASSES + 1, HIDDEN)).astype(np.float32),
            draw.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32),
            np.log(prior).astype(np.float32),
        ]

    def classes(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
        other = np.flatnonzero(out < 0)
        out[other] = WORDS + shared_classes([words[j] for j in other.tolist()])
        return out

    def padded(self, batch: list[bytes | None], words: list[list[bytes]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all texts with SIDE pads around each, the places of real tokens, and their texts."""
        words = [tokens(t) for t in batch] if words is None else words
        size = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(owner)) + SIDE * (owner + 1)
        ids = np.full(len(owner) + SIDE * (len(size) + 1), CLASSES, np.int32)
        ids[place] = self.classes([x for w in words for x in w])
        return ids, place, owner

    def _hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        table = self.weights[0]
        steps = [*range(-SIDE, 0), *range(1, SIDE + 1)]
        total = table[0][ids[at + steps[0]]]
        for k, step in enumerate(steps[1:], 1):
            total += table[k][ids[at + step]]
        return np.tanh(total)

    def log_probs(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(place), np.float32)
        for k in range(0, len(place), 1024):
            at = place[k : k + 1024]
            logits = self._logits(self._hidden(ids, at))
            own = logits[np.arange(len(at)), ids[at]]
            out[k : k + 1024] = own - np.log(np.exp(logits, out=logits).sum(1))
        return out

    def _logits(self, h: np.ndarray) -> np.ndarray:
        """The logits of hidden rows (each at most one), less their greatest if they can be large."""
        out = h @ self.weights[1]
        out += self.weights[2]
        if float(np.abs(self.weights[1]).sum(0).max() + np.abs(self.weights[2]).max()) > 60:
            out -= out.max(1, keepdims=True)
        return out

    def train(self, ids: np.ndarray, place: np.ndarray, past: list[np.ndarray], rate: float = 0.05) -> None:
        """One Adagrad pass over the given places; past holds the squared gradients so far."""
        steps = [*range(-SIDE, 0), *range(1, SIDE + 1)]
        for k in range(0, len(place), BATCH):
            at = place[k : k + BATCH]
            h = self._hidden(ids, at)
            p = self._logits(h)
            np.exp(p, out=p)
            p *= 1 / (len(at) * p.sum(1, keepdims=True))
            p[np.arange(len(at)), ids[at]] -= 1 / len(at)
            back = (p @ self.weights[1].T) * (1 - h * h)
            # rows of the class tables that no neighbour has get no gradient, so only the others are touched
            seen = np.concatenate([j * (CLASSES + 1) + ids[at + step] for j, step in enumerate(steps)]).astype(np.int16)  # sorted by radix
            order = np.argsort(seen, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(seen[order]) > 0]))
            rows = seen[order][first]
            g = np.add.reduceat(back[order % len(at)], first, axis=0)
            w, s = self.weights[0].reshape(-1, HIDDEN), past[0].reshape(-1, HIDDEN)
            s[rows] += g * g
            w[rows] -= rate * g / np.sqrt(s[rows])
            for w, g, s in zip(self.weights[1:], (h.T @ p, p.sum(0)), past[1:]):
                s += g * g
                w -= rate * g / np.sqrt(s)


def _flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


COUNTS = "bucket int, words binary, n binary"


def bucketed(found: Iterator[tuple[list[bytes], list[int]]], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, words, n) rows of words with their counts: hashes in rising order, and 64-bit numbers."""
    for words, n in found:
        if words:
            h, n = hashed(words), np.array(n, np.int64)
            order, cuts = dealt(h, buckets)
            h, n = h[order], n[order]
            at = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in at], pa.int32()), pa.array([h[a:b].tobytes() for _, a, b in at], pa.binary()), pa.array([n[a:b].tobytes() for _, a, b in at], pa.binary())], ["bucket", "words", "n"])


def dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of hashes by bucket and hash, and where each bucket starts."""
    bucket = (h >> np.uint64(6)) % np.uint64(buckets)
    order = np.lexsort((h, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def merged(rows: DataFrame) -> DataFrame:
    """One row (bucket, words, n) of each bucket: sums over all rows of rows, which are streamed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = None, [], 0

        def compact() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            return h[first], np.add.reduceat(n, first)

        def out() -> pa.RecordBatch:
            h, n = compact()
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["bucket", "words", "n"])

        for b in batches:
            for at in range(b.num_rows):
                k, words, n = (b.column(j)[at].as_py() for j in range(3))
                if k != bucket:
                    if held:
                        yield out()
                    bucket, held, size = k, [], 0
                held.append((np.frombuffer(words, np.uint64), np.frombuffer(n, np.int64)))
                size += len(n) // 8
                if len(held) > 1 and size > 2 * len(held[0][0]) + HELD:
                    held = [compact()]
                    size = len(held[0][0])
        if held:
            yield out()

    return small_batches(rows).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, COUNTS)


def buckets_of(docs: DataFrame) -> int:
    """Buckets for the words of docs: enough that one bucket's counts are small in memory at any size of the input."""
    return max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def count_table(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The counts (bucket, words, n) of all words of docs, and the names (word, h) of those that are frequent in a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: Counter = Counter()
        total, named = 0, set()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(held)
            often = [w for w in words if held[w] * SHARE >= total and w not in named]
            named.update(often)
            for b in bucketed([(words, list(held.values()))], buckets):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], ["bucket", "words", "n", "word"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), pa.int32()), pa.array([h.tobytes() for h in hashed(often)], pa.binary()), pa.nulls(len(often), pa.binary()), pa.array(often, pa.binary())], ["bucket", "words", "n", "word"])

        for b in (p for b in batches for p in parts(b)):
            for text in texts(b):
                found = tokens(text)
                held.update(found)
                total += len(found)
                if len(held) > HELD:
                    yield from out()
                    held.clear()
                    total = 0
        yield from out()

    rows = staged(small_batches(docs).select("text").mapInArrow(count, COUNTS + ", word binary"))
    names = rows.where("word is not null").select("word", F.col("words").alias("h")).distinct()
    return staged(merged(rows.where("word is null").select("bucket", "words", "n"))), names


def hashed_counts(counts: DataFrame, buckets: int) -> DataFrame:
    """The table (bucket, words, n) of given counts (word, n)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bucketed(((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches), buckets)

    return staged(merged(counts.select("word", "n").where("word is not null").mapInArrow(deal, COUNTS)))


def sums_of(table: DataFrame, own: list[bytes] = ()) -> np.ndarray:
    """The sum of the counts of each shared class; words `own` are left out."""
    skip = np.sort(hashed(list(own)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ENDINGS, np.int64)
        for b in batches:
            for words, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.frombuffer(words, np.uint64)
                np.add.at(sums, (h & LOW).astype(int), np.where(np.isin(h, skip), 0, np.frombuffer(n, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(range(ENDINGS), pa.int32()), pa.array(sums)], ["c", "n"])

    out = np.zeros(ENDINGS)
    for r in table.select("words", "n").mapInArrow(add, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        out[r["c"]] = r["n"]
    return out


def most_frequent(table: DataFrame, names: DataFrame) -> tuple[list[bytes], list[int]]:
    """The WORDS most frequent words that are at least one token in SHARE, and their counts."""
    least = sums_of(table).sum() / SHARE

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, n = np.frombuffer(words, np.uint64).view(np.int64), np.frombuffer(n, np.int64)
                best = np.lexsort((h, -n))[:WORDS]
                best = best[n[best] >= least]
                yield pa.RecordBatch.from_arrays([pa.array(h[best]), pa.array(n[best])], ["h", "n"])

    found = {r["h"]: r["n"] for r in table.select("words", "n").mapInArrow(top, "h long, n long").orderBy(F.col("n").desc(), "h").limit(WORDS).collect()}
    keys = [np.int64(h).tobytes() for h in found]
    word = {int(np.frombuffer(bytes(r["h"]), np.int64)[0]): bytes(r["word"]) for r in names.where(F.col("h").isin(keys)).collect()} if keys else {}
    return [word[h] for h in found if h in word], [n for h, n in found.items() if h in word]


def chosen(batch: list[bytes | None], place: np.ndarray, owner: np.ndarray, fold: int, folds: int) -> np.ndarray:
    """The places that round `fold` of `folds` masks: each place is in one round, by the text's hash and the place in it."""
    size = np.bincount(owner, minlength=len(batch))
    inside = (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
    start = np.array([crc32(t or b"") for t in batch], np.uint64)
    mix = inside * np.uint64(0x9E3779B97F4A7C15) ^ start[owner] * np.uint64(0xC2B2AE3D27D4EB4F)
    return place[((mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(folds) == fold]


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Network:
    """Counts all words, then trains on every position of all documents, each in one of `rounds` averaged rounds."""
    return fitted(docs, rounds)[0]


def fitted(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Network, DataFrame, np.ndarray]:
    """The trained network, the counts (bucket, words, n) of all words, and the sums of the shared classes."""
    spark = docs.sparkSession
    table, names = count_table(docs, buckets_of(docs))
    words, n = most_frequent(table, names)
    sums = sums_of(table, words)
    prior = np.ones(CLASSES)
    prior[: len(words)] += n
    prior[WORDS:] += sums
    net = Network(words, prior / prior.sum())
    splits = docs.rdd.getNumPartitions()
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(net)
        size = len(_flat(net.weights))
        cuts = list(range(0, size, 8192))

        def part(batches: Iterator[pa.RecordBatch], shared=shared, fold=k) -> Iterator[pa.RecordBatch]:
            forget()
            own = copy.deepcopy(shared.value)
            past = [np.full_like(w, 1e-6) for w in own.weights]
            seen = 0
            for b in (p for b in batches for p in parts(b)):
                rows = texts(b)
                ids, place, owner = own.padded(rows)
                masked = chosen(rows, place, owner, fold, rounds)
                own.train(ids, masked, past)
                seen += len(masked)
            if seen:
                flat = _flat(own.weights).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int32()), pa.array([float(seen)] * len(cuts), pa.float64()), pa.array([flat[c : c + 8192].tobytes() for c in cuts], pa.binary())], ["i", "n", "v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for i, m, v in zip(*(c.to_pylist() for c in b.columns)):
                    v = np.frombuffer(v, np.float64)
                    sums[i] = [sums[i][0] + m, sums[i][1] + v] if i in sums else [m, v.copy()]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m for m, _ in sums.values()], pa.float64()), pa.array([v.tobytes() for _, v in sums.values()], pa.binary())], ["i", "n", "v"])

        kind = "i int, n double, v binary"
        got = tree_summed(small_batches(docs).select("text").mapInArrow(part, kind), add, kind, splits).collect()
        if not got:
            break
        flat = np.empty(size, np.float32)
        for r in got:
            v = np.frombuffer(bytes(r["v"]), np.float64) / r["n"]
            flat[r["i"] : r["i"] + len(v)] = v
        at = 0
        for j, w in enumerate(net.weights):
            net.weights[j] = flat[at : at + w.size].reshape(w.shape).copy()
            at += w.size
    return net, table, sums


def lm_scores(docs: DataFrame, net: Network | None = None, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of every row of docs; trains on docs if no network is given.

    counts (word, n) gives the words' probabilities in their classes, by default the counts of docs; a word that isn't
    in it counts once."""
    spark, buckets = docs.sparkSession, buckets_of(docs)
    table = None
    if net is None:
        net, table, sums = fitted(docs)
    if table is None or counts is not None:
        table = count_table(docs, buckets)[0] if counts is None else hashed_counts(counts, buckets)
        sums = sums_of(table, list(net.at))
    shared = spark.sparkContext.broadcast(net)  # one set of weights, of fixed size
    narrow = small_batches(docs).select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "kind", "chunk", "words", "n"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk of documents rows (kind 1) of the hashes of its words, and one (kind 2) of the documents."""
        forget()
        net, task = shared.value, TaskContext.get().partitionId()
        local: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows: list[pa.RecordBatch] = []
        chunks = docs = 0

        def out() -> pa.RecordBatch:
            chunk, h = task << 32 | chunks, hashed(list(local))
            order, cuts = dealt(h, buckets)
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h))
            word, document = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.uint16))
            word = rank[word]
            by_word = np.argsort(word, kind="stable")
            n = np.bincount(word, minlength=len(h)).astype(np.uint32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema) as stream:
                for b in rows:
                    stream.write_batch(b)
            h = h[order]
            at = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
            size = len(at) + 1
            return pa.RecordBatch.from_arrays([pa.array([*(k for k, _, _ in at), chunk % buckets], pa.int32()), pa.array([1] * len(at) + [2], pa.int32()), pa.array([chunk] * size, pa.int64()), pa.array([*(h[a:b].tobytes() for _, a, b in at), sink.getvalue().to_pybytes()], pa.binary()), pa.array([None] * len(at) + [n.tobytes() + document[by_word].tobytes()], pa.binary())], names)

        for part in (p for b in batches for p in parts(b)):
            words = [tokens(t) for t in texts(part)]
            ids, place, owner = net.padded(words, words)
            total = np.bincount(owner, net.log_probs(ids, place).astype(float), minlength=len(words))
            rows.append(pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(owner, minlength=len(words)), pa.int64()), pa.array(total, pa.float64())], ["doc_id", "n_tokens", "log_prob"]))
            shares = np.flatnonzero(ids[place] >= WORDS)
            if len(shares):
                every = [x for w in words for x in w]
                held.append((np.array([local.setdefault(every[j], len(local)) for j in shares.tolist()], np.int32), (owner[shares] + docs).astype(np.uint16)))
            docs += len(words)
            if len(local) > CHUNK or docs > DOCUMENTS:
                yield out()
                local, held, rows, chunks, docs = {}, [], [], chunks + 1, 0
        if rows:
            yield out()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row of kind 1 its words' counts and classes; the counts of a bucket (kind 0) come first."""
        bucket, h, of = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for at in range(b.num_rows):
                k, what, chunk, words, n = (b.column(j)[at].as_py() for j in range(5))
                if k != bucket:
                    bucket, h, of = k, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if what == 0:
                    h, of = np.frombuffer(words, np.uint64), np.frombuffer(n, np.int64)
                    continue
                if what == 1:
                    own = np.frombuffer(words, np.uint64)
                    place = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
                    found = np.where(h[place] == own, of[place], 0) if len(h) else np.zeros(len(own), np.int64)
                    words, n = None, (found * ENDINGS + (own & LOW).astype(np.int64)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([what], pa.int32()), pa.array([chunk], pa.int64()), pa.array([words], pa.binary()), pa.array([n], pa.binary())], names)

    def summed(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        *words, packed = chunk["n"].to_pylist()
        documents = pa.ipc.open_stream(chunk["words"][-1].as_py()).read_all()
        told = np.frombuffer(b"".join(words), np.int64)
        own = np.log(np.maximum(told // ENDINGS, 1) / (sums[told % ENDINGS] + 1))
        n = np.frombuffer(packed[: 4 * len(told)], np.uint32)
        document = np.frombuffer(packed[4 * len(told) :], np.uint16)
        total = documents["log_prob"].to_numpy() + np.bincount(document, np.repeat(own, n), minlength=documents.num_rows)
        return pa.table({"doc_id": documents["doc_id"], "n_tokens": documents["n_tokens"], "log_prob": pa.array(total, pa.float64())})

    schema = "bucket int, kind int, chunk long, words binary, n binary"
    rows = narrow.mapInArrow(scored, schema).unionByName(table.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "words", "n"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(counted, schema)
    found = rows.groupBy("chunk").applyInArrow(summed, f"doc_id {kind}, n_tokens long, log_prob double")
    return found.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
