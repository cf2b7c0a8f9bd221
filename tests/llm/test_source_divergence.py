"""The source divergence audit against its SQL on odd tables, and the parts that SQL doesn't show."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import source_divergence as S
from tidemark.llm.queries import ORACLES

from .conftest import documents, prose


def by_sql(rows, least=30, listed=50):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    sql = ORACLES["op12_source_divergence"].replace(">= 30", f">= {least}").replace("<= 50", f"<= {listed}")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return sorted(tuple(r[names.index(c)] for c in ("lang", "source", "part", "rank", "item", "value")) for r in out.fetchall())


def by_spark(docs, least=30, listed=50):
    return sorted((r["lang"], r["source"], r["part"], r["rank"], r["item"], r["value"]) for r in S.source_divergence(docs, least, listed).collect())


ROWS = [(k, prose(k, 30 + k % 7) + (" naïve ÜNÏ İx" if k % 3 else " CAT'S"), ("en", "de", None)[k % 3], (None, "a", "b", "ü")[k % 4], 1) for k in range(60)]
ROWS += [(100 + k, t, "xx", s, 1) for k, (t, s) in enumerate([(None, "p"), ("", "q"), ("1 2 3", "r"), ("word " * 30000, "p"), ("x" * 6000, None)])]
ROWS += [(7, "one two", "yy", "only", 1)] * 3


@pytest.mark.parametrize("least, listed", [(30, 50), (3, 4), (1, 1000)])
def test_equals_its_sql(spark, least, listed):
    want = by_sql(ROWS, least, listed)
    assert by_spark(documents(spark, ROWS).repartition(5), least, listed) == want
    assert any(r[2] == "term" for r in want) == (least < 30) and any(r[0] == "xx" and r[2] == "pair" for r in want)


def test_no_documents(spark, empty):
    assert by_spark(empty) == []


def test_blocks_and_shards_make_no_difference(spark, monkeypatch):
    docs = documents(spark, ROWS, False)
    whole = by_spark(docs, 2, 20)
    monkeypatch.setattr(S, "BLOCK", 1)
    monkeypatch.setattr(S, "SHARD_ROWS", 10)
    monkeypatch.setattr(S, "HELD", 5)
    assert by_spark(docs.repartition(9), 2, 20) == whole


def test_terms_of_long_texts_are_whole():
    text = ("Abc déf-ghi " * 5000).encode()
    want = [w for piece in S.terms(text) for w in piece]
    assert want == [b"abc", "déf".encode(), b"ghi"] * 5000
    assert [w for piece in S.terms(text, 7) for w in piece] == want
    assert [w for piece in S.terms(b"x" * 100, 7) for w in piece] == [b"x" * 100]
    assert list(S.terms(None)) == [[]]


def test_other_columns_do_not_matter(spark):
    docs = documents(spark, ROWS, False)
    more = docs.withColumns({c: F.lit("clash") for c in ("shard", "term", "n", "d", "total", "v", "item", "part", "rank", "value")})
    assert by_spark(more, 3) == by_spark(docs, 3)
