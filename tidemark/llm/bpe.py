"""Byte-level BPE: encoding by DuckDB recursive queries per partition, decoding by ordered aggregation.

A vectorised splitter cuts whole texts into the matches of the public pattern. Matches that a worker hasn't met
yet become rows (word, position, token); a recursive query joins neighbouring tokens with the merge table and
contracts each word's leftmost pair of least rank until no pair is left. Decoding joins token rows with the
vocabulary and aggregates their bytes in order.

What a worker remembers of earlier words is bounded (`REMEMBER`, two generations). Matches over LONG bytes, for
which rows times merges would grow with the square, are contracted with a heap by the same rule.

Defined cases: a null text counts as empty and has no tokens; texts with control strings of special tokens are
plain text; repeated rows are encoded one by one; other columns of the input are ignored."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORKER_CACHES, small_batches, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
REMEMBER = 150_000
LONG = 1000
CHUNK = 600_000
#: Words of one recursive query; it holds the rows of all its steps until it ends.
WORDS = 20_000
# The code points with the White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)

ENCODE = """
with recursive state as (
  select n.w, n.p, n.t, n.np, n.nt, m.r + n.p as k, 0 as done
  from (select w, p, t, lead(p) over x as np, lead(t) over x as nt from words window x as (partition by w order by p)) n
  left join merges m on m.pair = n.t::bigint * 65536 + n.nt
  union all (
  with live as (select * from state where done = 0),
  least as (select w, min(k) as k, arg_min(np, k) as np from live where k is not null group by w),
  pick as (select b.w, b.k % 1048576 as p, (b.k // 1048576)::int as t, b.np, x.np as np2, x.nt as nt2 from least b join live x on x.w = b.w and x.p = b.np),
  moved as (
    select x.w, x.p, case when x.p = c.p then c.t else x.t end as t, case when x.p = c.p then c.np2 else x.np end as np,
      case when x.p = c.p then c.nt2 when x.np = c.p then c.t else x.nt end as nt,
      case when x.p = c.p or x.np = c.p then null else x.k end as k, (x.p = c.p or x.np = c.p) as changed, (c.w is null)::int as done
    from live x left join pick c on c.w = x.w where c.np is null or x.p <> c.np)
  select y.w, y.p, y.t, y.np, y.nt, coalesce(y.k, m.r + y.p), y.done
  from moved y left join merges m on m.pair = case when y.changed then y.t::bigint * 65536 + y.nt end)
)
select w, t from state where done = 1 order by w, p"""
DECODE = "select d, array_to_string(list(s order by p), '') as s from tokens join vocabulary using (t) group by d"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def code_classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE for every code point."""
    import unicodedata

    kind = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    out = np.where(kind == ord("L"), LETTER, np.where(kind == ord("N"), NUMBER, OTHER)).astype(np.uint8)
    out[WHITE] = SPACE
    return out


def split(code: np.ndarray, classes: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start in the concatenated texts `code` (code points); every point is in a match."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[code]
    fresh = np.zeros(n + 1, bool)
    fresh[doc_start] = True
    fresh = fresh[:n]
    begin = fresh.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    cls, size = kind[start], end - start
    follows = np.append(~fresh[start[1:]], False)  # another run of the same text comes after this one
    blank = cls == SPACE
    lends = blank & follows & (code[end - 1] == 32)  # its last space goes to the next run
    takes = np.append(False, lends[:-1])
    mark = np.zeros(n + 1, bool)
    quote = (cls == OTHER) & (size == 1) & (code[start] == 39) & ~takes & follows
    quote[:-1] &= cls[1:] == LETTER
    at = np.flatnonzero(quote)
    if len(at):
        one, two = code[start[at + 1]], code[np.minimum(start[at + 1] + 1, n - 1)]
        cut = np.isin(one, [ord(x) for x in "stmd"]).astype(np.int64)
        double = (size[at + 1] >= 2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        cut[double] = 2
        skip = np.zeros(len(start), np.int64)
        skip[at + 1] = cut
    else:
        skip = np.zeros(len(start), np.int64)
    plain = ~blank & (skip < size)
    mark[(start - takes + skip)[plain]] = True
    mark[start[blank & ((size > 1) | ~lends)]] = True
    mark[(end - 1)[blank & follows & ~lends & (size > 1)]] = True
    return np.flatnonzero(mark[:n])


def contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one word, contracting the leftmost pair of least rank, with a heap over the pairs."""
    parts: list[bytes | None] = [bytes([b]) for b in word]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, k) for k in range(len(parts) - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        nxt = after[k]
        if parts[k] is None or nxt >= len(parts) or ranks.get(parts[k] + parts[nxt]) != r:
            continue
        parts[k], parts[nxt], after[k] = parts[k] + parts[nxt], None, after[nxt]
        if after[k] < len(parts):
            before[after[k]] = k
            if (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (r, k))
        if before[k] >= 0 and (r := ranks.get(parts[before[k]] + parts[k])) is not None:
            heapq.heappush(heap, (r, before[k]))
    return [ranks[x] for x in parts if x is not None]


class Coder:
    """Encoder and decoder over one vocabulary, with a DuckDB connection of its own."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.decimal = [str(k) for k in range(max(ranks.values()) + 1)]
        self.classes = code_classes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        pairs, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a * 65536 + b)
                    merged.append(rank * 1048576)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for name, table in (
            ("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "r": pa.array(merged, pa.int64())})),
            ("vocabulary", pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "s": pa.array([x.decode("latin-1") for x in ranks], pa.string())})),
        ):
            self.db.register("given", table)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")

    def words(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word, as 32-bit integers."""
        out = [b""] * len(words)
        rows: list[int] = []
        for k, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[k] = np.int32(rank).tobytes()
            elif len(word) > LONG:
                out[k] = np.array(contract(word, self.ranks), np.int32).tobytes()
            elif word:
                rows.append(k)
        for at in range(0, len(rows), WORDS):
            part = rows[at : at + WORDS]
            size = np.array([len(words[k]) for k in part])
            owner = np.repeat(np.arange(len(part), dtype=np.int32), size)
            place = (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            self.db.register("words", pa.table({"w": owner, "p": place, "t": self.base[np.frombuffer(b"".join(words[k] for k in part), np.uint8)]}))
            got = self.db.execute(ENCODE).fetchnumpy()
            self.db.unregister("words")
            cuts = np.searchsorted(got["w"], np.arange(len(part) + 1)) * 4
            tokens = np.asarray(got["t"], np.int32).tobytes()
            for k, a, b in zip(part, cuts.tolist(), cuts[1:].tolist()):
                out[k] = tokens[a:b]
        return out

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        text = "".join(batch)
        lengths = np.array([len(x) for x in batch], np.int64)
        first = np.cumsum(lengths) - lengths
        start = split(np.frombuffer(text.encode("utf-32-le"), np.uint32), self.classes, first)
        bounds = start.tolist() + [len(text)]
        pieces = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        found = list(map(self.young.get, pieces))
        if None in found:
            missing = {p for p, x in zip(pieces, found) if x is None}
            if len(self.young) + len(missing) > REMEMBER:
                self.old, self.young = self.young, {}
                found = None
            known = {p: x for p in missing if (x := self.old.get(p)) is not None}
            new = sorted(missing - known.keys())
            known.update(zip(new, self.words([p.encode() for p in new])))
            self.young.update(known)
            look = {**known} if found is not None else None
            if look is not None:
                found = [look[p] if x is None else x for p, x in zip(pieces, found)]
            else:
                keep = self.old
                found = [x if (x := known.get(p)) is not None else keep[p] for p in pieces]
        cuts = np.searchsorted(start, np.append(first, len(text))).tolist()
        return [np.frombuffer(b"".join(found[a:b]), np.int32) for a, b in zip(cuts, cuts[1:])]

    def decode(self, batch: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        out = [b""] * len(batch)
        size = np.array([len(x) for x in batch])
        if size.sum():
            ids = np.concatenate(batch)
            self.db.register("tokens", pa.table({"d": np.repeat(np.arange(len(batch), dtype=np.int32), size), "p": np.arange(len(ids), dtype=np.int32), "t": ids}))
            for d, s in self.db.execute(DECODE).fetchall():
                out[d] = s.encode("latin-1")
            self.db.unregister("tokens")
        return out


_CODER: dict[int, Coder] = {}
WORKER_CACHES.append(_CODER)


def _coder(key: int, ranks) -> Coder:
    if key not in _CODER:
        _CODER.clear()
        _CODER[key] = Coder(ranks.value)
    return _CODER[key]


def encode_decode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `outputs` of every row of docs: n_tokens, ids, ids_sha256, decoded (bytes), decoded_sha256.

    path is the rank file; its contents have a fixed size and are broadcast, so executors need no file."""
    spark: SparkSession = docs.sparkSession
    loaded = load_ranks(path)
    key, ranks = hash(tuple(sorted(loaded.items()))), spark.sparkContext.broadcast(loaded)
    kinds = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()), "decoded": ("binary", pa.binary()), "decoded_sha256": ("string", pa.string())}
    kept = small_batches(docs).select(*keep, "text")

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum(np.array([len(t or b"") for t in texts(batch)], np.int64)) // CHUNK
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, ranks)
        dec = coder.decimal
        for part in (p for b in batches for p in parts(b)):
            ids = coder.encode([(t or b"").decode("utf-8", "replace") for t in texts(part)])
            raw = coder.decode(ids) if {"decoded", "decoded_sha256"} & set(outputs) else []
            made = {
                "n_tokens": lambda: [len(x) for x in ids],
                "ids": lambda: ids,
                "ids_sha256": lambda: [sha256(",".join([dec[k] for k in x.tolist()]).encode()).hexdigest() for x in ids],
                "decoded": lambda: raw,
                "decoded_sha256": lambda: [sha256(x).hexdigest() for x in raw],
            }
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(made[o](), kinds[o][1]) for o in outputs)], [*keep, *outputs])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keep)
    return kept.mapInArrow(work, types + "".join(f", {o} {kinds[o][0]}" for o in outputs))
