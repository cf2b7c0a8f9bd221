"""Clues and research over a small corpus."""

import math
import random

from pyspark.sql import functions as F

from tidemark.functions import questions as Q
from tidemark.functions import text as T
from tidemark.functions.dialect import SPARK as D
from tidemark.plans import clues as C
from tidemark.plans import research as R
from tidemark.plans.config import load_config
from tidemark.sources import search
from tidemark.sources.relations import QUESTIONS


def test_clauses_by_hand(spark):
    texts = ["lamp maker, who lived in Oslo, sold red lamps before 1990", "the green lamp; the blue lamp and a fish", ""]
    spark.createDataFrame(list(enumerate(texts)), "id int, query string").createOrReplaceTempView("asked_here")
    spark.sql(f"SELECT id, query, {T.constraint_phrases(D, 'query')} AS phrases FROM asked_here").createOrReplaceTempView("asked_there")
    rows = {r["id"]: r for r in spark.sql(f"SELECT id, phrases, {Q.clauses(D, 'query', 'phrases')} AS clauses FROM asked_there").collect()}
    assert rows[0]["phrases"] == ["before 1990"] and rows[0]["clauses"] == ["lamp maker", "lived in Oslo", "sold red lamps before 1990"]
    assert rows[1]["clauses"] == ["the green lamp", "the blue lamp"] or len(rows[1]["clauses"]) == 2
    assert rows[2]["clauses"] == []


def test_clue_rules(spark):
    def of(rule, column, schema, *rows):
        return [r[column] for r in rule(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema)).orderBy("k").collect()]

    plain = of(C.simple, "plain", "query string", ("What is the lamp?",), ("What is red green blue black white brown pink lamp oil?",))
    assert plain[0] == ["the lamp"] and len(plain[1]) == 2
    found, none, short = of(C.decomposed, "heuristic", "query string", ("Which lamp maker, who lived in Oslo, sold red lamps before 1990?",), ("",), ("red lamps",))
    assert 3 <= len(found) <= 5 and any("before 1990" in c for c in found) and none == [] and short == ["red lamps"]
    mixed = of(C.merged, "clues", "model array<string>, heuristic array<string>, browsing boolean", (["one two", "x", "three four", "five six"], ["h h2"], False), (["one two"], ["lamp oil"], True))
    assert mixed == [["one two", "three four", "five six"], ["lamp oil", "one two"]]
    flags = [c for c in C.INTENT_COLUMNS if c != "mode"]
    schema = "query string, clues array<string>, " + ", ".join(f"{c} boolean" for c in flags)
    wide = of(C.expanded, "wide", schema, ("three authors sample", ["university lamp", "film genre", "thanks"], *[True] * len(flags)), ("x", ["red lamps", "Red  lamps"], *[False] * len(flags)))
    assert len(wide[0]) == 10 and wide[0][3] == "university lamp thesis repository pdf" and wide[1] == ["red lamps"]
    asked = spark.createDataFrame([(1, "What is the lamp?"), (2, "Which lamp maker, who lived in Oslo, sold red lamps before 1990 and moved to Rome in 1995?")], "id long, query string")
    clues = {(r["id"], r["pos"]): r["clue"] for r in C.question_clues(asked, lambda q: ["harbour lamps sold"]).collect()}
    assert clues[1, 0] == "the lamp" and "harbour lamps sold" in clues.values()


def test_frontier_gives_unused_clues_best_first(spark):
    frontier = spark.createDataFrame([(1, 0, "a", 0.1), (1, 1, "B ", 0.9), (1, 2, "b", 0.8), (1, 3, "c", 0.5), (2, 0, "a", 0.1)], "query_id long, pos long, clue string, priority double")
    used = spark.createDataFrame([(1, "c")], "query_id long, key string")
    got = sorted((r["query_id"], r["key"]) for r in R.frontier_batch(frontier, used, 2).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a")]


def test_research_finds_the_document_on_the_topic(spark):
    corpus = spark.createDataFrame([(k, None, f"Page {k}", f"filler words number {k} about nothing in particular here") for k in range(20)] + [(99, "https://e.org", "Amber lantern makers", "Amber lantern makers lived in the harbour town and sold lanterns to ships for many years.")], "doc_key long, url string, title string, text string")
    questions = spark.createDataFrame([(1, "Who were the amber lantern makers?")], "query_id long, query string")
    got = R.research(questions, corpus, load_config({"TIDEMARK_MAX_ITERATIONS": "2"})).orderBy("rank").first()
    assert got["doc_key"] == 99 and "lantern" in got["snippet"]
    assert R.research(questions.where(F.lit(False)), corpus).count() == 0


def test_corpus_search_equals_a_loop_and_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "CLUE_BLOCK", 3)
    monkeypatch.setattr(search, "DOCUMENT_BLOCK", 7)
    draw = random.Random(4)
    words = [f"word{k}" for k in range(30)]
    docs = [(k, None, draw.choice(words), " ".join(draw.choices(words, k=draw.randint(0, 9)))) for k in range(60)]
    clues = [(k % 4, " ".join(draw.choices(words, k=draw.randint(0, 4)))) for k in range(12)] + [(9, "unknown")]
    found = search.corpus_search(spark.createDataFrame(clues, "query_id long, clue string"), spark.createDataFrame(docs, "doc_key long, url string, title string, text string"), 3)
    got = {(r["query_id"], r["clue"], r["idx"]): r["doc_key"] for r in found.collect()}
    terms = {k: {title, *text.split()} for k, _, title, text in docs}
    df = {w: sum(w in t for t in terms.values()) for w in words}
    want = {}
    for q, clue in clues:
        shared = {k: sorted(t & {*clue.split()}) for k, t in terms.items()}
        best = sorted((k for k, t in shared.items() if t), key=lambda k: (-round(sum(1 / math.log1p(df[w]) for w in shared[k]), 12), k))
        want |= {(q, clue, n): k for n, k in enumerate(best[:3])}
    assert got == want
    assert "HashAggregate(keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()
