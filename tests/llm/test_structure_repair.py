"""Structure repair against its SQL, against all edit sequences of short conversations, and over blocks of any size."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import structure_repair as S
from tidemark.llm.queries import ORACLES

NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def by_spark(df):
    return sorted((tuple(r[k] for k in NAMES) for r in df.collect()), key=str)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    out = con.execute(ORACLES["op13_structure_repair"])
    at = [[c[0] for c in out.description].index(k) for k in NAMES]
    return sorted((tuple(r[k] for k in at) for r in out.fetchall()), key=str)


def conversations(seed, n):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "Maybe so!", "", " \t\n", None, "why?  ", "é𝔸.", "naïve 漢", "x. y"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "s", "unknown"]
    return [(c, draw.choice((None, k, k, k, k // 2, 2 * k)), draw.choice(roles), draw.choice(texts)) for c in [None, *range(n)] for k in range(draw.randrange(9))]


def cheapest(rows):
    """Cost, audit and lines of the least of the cheapest edit sequences of rows (role, text, first fault), by trying all."""
    best = None

    def tried(k, cost, audit, lines, initials):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        if k < len(rows):
            role, text, fault = rows[k]
            tried(k + 1, cost + 3, audit + "D", lines, initials)
            if fault not in ("blank", "duplicate"):
                for letter, as_role, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if re.fullmatch("s?(ua)*u?", initials + as_role[:1]):
                        tried(k + 1, cost + price + (fault == "truncated"), audit + letter, [*lines, f"{as_role}:{text}"], initials + as_role[:1])
        if len(lines) <= 2 * len(rows) + 2:
            for role in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", initials + role[:1]):
                    tried(k, cost + 2, audit + "I", [*lines, f"{role}:"], initials + role[:1])

    tried(0, 0, "", [], "")
    return best


def test_equals_its_sql_on_odd_rows(spark):
    rows = conversations(1, 150) + [(900 + c, t, "user", "same.") for c in range(60) for t in (5, 5, 5)] + [(2000, k, ("user", "assistant")[k % 2], "word " * 20000 + ".") for k in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.lit("clash") for c in ("n", "later", "part", "seq", "kind", "codes", "of", "h")})
    want = by_sql(rows)
    assert by_spark(S.structure_repair(df.repartition(7))) == want
    assert by_spark(S.structure_repair(clashing)) == want
    assert any(r[0] is None for r in want) and any(r[7] == "" for r in want)


@pytest.mark.parametrize("seed", [2, 3])
def test_equals_all_edit_sequences(spark, seed):
    draw = random.Random(seed)
    kinds = [(r, t) for r in ("user", "assistant", "system", "tool") for t in ("Yes.", "No", "  ")]
    short = {c: [draw.choice(kinds) for _ in range(draw.randrange(1, 6))] for c in range(60)}
    rows = [(c, k, r, t, 1) for c, said in short.items() for k, (r, t) in enumerate(said)]
    got = {r["conv_id"]: r for r in S.repaired(spark.createDataFrame(rows, SCHEMA + ", n int")).collect()}
    for c, said in short.items():
        faults = ["blank" if not t.strip() else "duplicate" if (r, t) in said[:k] else "truncated" if t == "No" else "" for k, (r, t) in enumerate(said)]
        cost, audit, lines = cheapest([(r, t, f) for (r, t), f in zip(said, faults)])
        assert (got[c]["cost"], got[c]["audit"], got[c]["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert got[c]["illegal"] == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))


@pytest.mark.parametrize("block, size", [(1, 1 << 16), (3, 1 << 16), (4096, 1), (4096, 12)])
def test_blocks_make_no_difference(spark, monkeypatch, block, size):
    rows = conversations(4, 30) + [(77, k % 400, ("user", "assistant", "user")[k % 3], f"{k % 50}.") for k in range(900)]
    want = by_sql(rows)
    real = S.blocks
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "BYTES", size)
    cut = []
    monkeypatch.setattr(S, "blocks", lambda x: cut.append(real(x)) or cut[-1])
    assert by_spark(S.structure_repair(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want
    assert cut[0].where("conv_id = 77").count() > 20


def test_no_conversations(spark):
    assert S.structure_repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_of_arcs_are_costs_of_walks():
    codes = bytes(random.Random(5).randrange(16) for _ in range(40))
    codes = bytes(c & ~8 if c & 4 else c for c in codes)
    whole = S.product(S.ARCS[list(codes)])
    ends = S.inserted([int(x) for x in whole[0]], False)
    total = min(ends[0], ends[3])
    entry, letters, last = S.walks(codes, [0, *[int(S.NEVER)] * 3], S.END.tolist(), total)[0]
    assert entry == 0 and len(letters.replace("I", "")) == 40 and S.END[last] + sum({"D": 3, "I": 2, "R": 2, "K": 0}[x] for x in letters) <= total
