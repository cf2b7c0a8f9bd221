"""Candidates that stand, best-first search, similar clues and the loop of hops against plain loops."""

import heapq
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.operators.clues import alike, novel
from tidemark.operators.frontier import expanded
from tidemark.plans import research as R
from tidemark.plans.config import load_config


def standing_by_loop(candidates):
    best = None
    for new in candidates:
        if not new["answer"] or (best and best["confidence"] >= 0.85):
            continue
        if best is None:
            best = new
        elif " ".join(best["answer"].split()).lower() == " ".join(new["answer"].split()).lower():
            best = new if new["score"] >= best["score"] - 0.02 and new["confidence"] >= best["confidence"] else best
        elif new["score"] > best["score"] + 0.05:
            best = new
    return best and (best["hop"], best["answer"])


def test_standing_answers_equal_a_loop(spark):
    draw = random.Random(8)
    rows = [{"query_id": q, "hop": k, "answer": draw.choice(("Ann", " ann", "Bob", "Cy", "")), "confidence": draw.choice((0.3, 0.5, 0.7, 0.84, 0.85)), "score": draw.randrange(20) / 20} for q in range(200) for k in range(draw.randrange(6))]
    got = R.standing(spark.createDataFrame(rows, "query_id long, hop int, answer string, confidence double, score double").withColumns({"evidence": F.lit("e"), "source": F.lit("s")}))
    want = {q: w for q in range(200) if (w := standing_by_loop([r for r in rows if r["query_id"] == q]))}
    assert {r["query_id"]: (r["hop"], r["answer"]) for r in got.collect()} == want


def expanded_by_heap(seeds, links, rounds, width, most, depth, least):
    """What one question meets: node -> (score, depth, via, round)."""
    met, queue = {}, []
    for node, score in seeds.items():
        met[node] = [score, 0, None, None]
        heapq.heappush(queue, (-score, 0, node))
    for now in range(1, rounds + 1):
        opened = []
        while queue and len(opened) < width:
            opened.append(heapq.heappop(queue)[2])
        fresh = {}
        for node in opened:
            met[node][3] = now
            for source, target, score in links:
                if source == node and target != source and target not in met and score >= least and (target not in fresh or (-score, source) < fresh[target][:2]):
                    fresh[target] = (-score, source, met[node][1] + 1)
        for score, target, source, at in sorted((s, t, v, d) for t, (s, v, d) in fresh.items())[:most]:
            met[target] = [-score, at, source, None]
            if at < depth:
                heapq.heappush(queue, (score, now, target))
    return {k: tuple(v) for k, v in met.items()}


def test_best_first_search_equals_a_heap(spark):
    draw = random.Random(5)
    names = [f"n{k:02}" for k in range(60)]
    edges = sorted({(draw.choice(names), draw.choice(names)) for _ in range(260)})
    scores = {(q, e): draw.randrange(1, 30) / 30 for q in range(6) for e in edges}
    seeds = {q: {draw.choice(names): draw.randrange(10) / 10 for _ in range(draw.randrange(1, 5))} for q in range(6)}
    links = spark.createDataFrame(edges, "source string, target string")
    table = spark.createDataFrame([(q, *e, s) for (q, e), s in scores.items()], "query_id long, source string, target string, link_score double")
    start = spark.createDataFrame([(q, n, s) for q, own in seeds.items() for n, s in own.items()], "query_id long, node string, score double")
    got = {}
    for r in expanded(start, links, lambda rows: rows.join(table, ["query_id", "source", "target"]), rounds=4, width=3, most=4, depth=3, least=0.3).collect():
        got.setdefault(r["query_id"], {})[r["node"]] = (r["score"], r["depth"], r["via"], r["round"])
    assert got == {q: expanded_by_heap(own, [(a, b, scores[q, (a, b)]) for a, b in edges], 4, 3, 4, 3, 0.3) for q, own in seeds.items()}
    assert max(v[1] for own in got.values() for v in own.values()) == 3


def mutated(draw, text):
    out = list(text)
    for _ in range(draw.randrange(5)):
        k = draw.randrange(len(out) + 1)
        out[k : k + draw.randrange(2)] = draw.choice(("", "x", " ", "é"))
    return "".join(out)


@pytest.mark.parametrize("ratio", [0.85, 0.92])
def test_similar_clues_equal_all_pairs(spark, ratio):
    draw = random.Random(11)
    base = ["".join(draw.choice("abcde é") for _ in range(draw.randrange(1, 40))) for _ in range(60)] + ["a", "ab", "aaaa aaaa", "lamp oil", "Lamp  OIL", "", " "]
    left, right = ([(draw.randrange(2), k, mutated(draw, draw.choice(base))) for k in range(220)] for _ in range(2))
    schema = "query_id long, pos long, clue string"
    got = {(r["query_id"], r["id_a"], r["id_b"]): r["ratio"] for r in alike(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ratio).collect()}
    fold = lambda t: " ".join(t.split()).lower()
    want = {(q, i, j): r for q, i, a in left for p, j, b in right if p == q and fold(a) and fold(b) and (r := SequenceMatcher(None, fold(a), fold(b)).ratio()) >= ratio}
    assert got == want and len(want) > 100


def test_texts_of_few_syllables_seldom_meet_the_matcher(monkeypatch):
    """All pairs of alike texts are found, also where the matcher starts from rare characters, and few others reach it."""
    import numpy as np

    from tidemark.operators import clues

    draw = random.Random(5)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st is ar ing tion ly k w . z".split()
    base = ["".join(draw.choice([*syllables, " "]) for _ in range(draw.randrange(20, 150))) for _ in range(60)] + ["the of " * 40, "x" * 250, "a"]
    left, right = ([mutated(draw, mutated(draw, mutated(draw, draw.choice(base)))) or "a" for _ in range(90)] for _ in range(2))
    want = {(i, j): r for i, a in enumerate(left) for j, b in enumerate(right) if (r := SequenceMatcher(None, a, b).ratio()) >= 0.85}
    met = []

    class Counting(SequenceMatcher):
        def ratio(self):
            met.append(1)
            return super().ratio()

    monkeypatch.setattr(clues, "SequenceMatcher", Counting)
    for words in (8, 0):  # common subsequences of all pairs together, and one by one
        met.clear()
        monkeypatch.setattr(clues, "WORDS", words)
        got = list(clues.alike_texts(left, right, 0.85, np.ones((90, 90), bool)))
        assert {(i, j): r for i, j, r in got} == want and len(got) == len(want) > 50
        assert len(met) < 2 * len(want) < 8100 / 10


def test_new_clues_say_something_else(spark):
    clues = [(1, 0, "red lamp makers of Oslo"), (1, 1, "Red  lamp makers of oslo"), (1, 2, "harbour lanterns"), (1, 3, "green lamp"), (2, 0, "red lamp makers of Oslo"), (2, 1, " ")]
    existing = [(1, "the red lamp makers of Oslo"), (1, "green lamp"), (3, "harbour lanterns")]
    schema = "query_id long, pos long, clue string"
    got = novel(spark.createDataFrame(clues, schema), spark.createDataFrame(existing, "query_id long, clue string")).collect()
    assert {(r["query_id"], r["pos"]) for r in got} == {(1, 2), (2, 0)}


def test_questions_leave_one_by_one(spark):
    corpus = spark.createDataFrame([(k, None, f"Page {k}", f"filler words number {k} about nothing in particular here") for k in range(12)] + [(99, "https://e.org", "Amber lantern makers", "Amber lantern makers lived in the harbour town and sold lanterns to ships for many years.")], "doc_key long, url string, title string, text string")
    long = "Which amber lantern makers, who lived in the harbour town before 1990, sold lanterns to ships and later moved to Rome in 1995 with their families?"
    questions = spark.createDataFrame([(1, "amber lanterns"), (2, long), (3, long + " Why?"), (4, "")], "query_id long, query string")
    seen = []

    def extract(ranked):
        rows = ranked.select("query_id").distinct()
        seen.append({r["query_id"] for r in rows.collect()})
        hop = len(seen)
        sure = F.when(F.col("query_id") == 2, 0.9).otherwise(0.5)
        return rows.select("query_id", F.concat(F.lit(f"answer {hop} of "), F.col("query_id").cast("string")).alias("answer"), F.lit("e").alias("evidence"), F.lit("s").alias("source"), sure.alias("confidence"), (F.lit(0.5) + 0.01 * hop).alias("score"))

    ranked, ends = R.converged(questions, corpus, load_config({"TIDEMARK_MAX_ITERATIONS": "2"}), extract=extract)
    got = {r["query_id"]: (r["hops"], r["reason"], r["answer"]) for r in ends.collect()}
    assert got[1] == (1, "budget", "answer 1 of 1") and got[2] == (1, "sure", "answer 1 of 2")
    assert got[3] == (2, "budget", "answer 1 of 3")  # the second answer is no better by enough
    assert got[4] == (0, "frontier", None)
    assert seen == [{1, 2, 3}, {3}]
    first = {r["query_id"]: r["doc_key"] for r in ranked.where("rank = 1").collect()}
    assert first[1] == first[2] == first[3] == 99


def test_two_blocks_meet_once_for_both_ways():
    """One meeting finds what either block's strings are as the left one, though the matcher isn't symmetric."""
    import random

    import numpy as np
    import pyarrow as pa

    from tidemark.operators import clues

    draw = random.Random(4)
    left = [" ".join(draw.choice(("amber", "lamp", "of", "the", "quiz", "harbor")) for _ in range(draw.choice((4, 40, 70)))) for _ in range(30)]
    right = [t[: (cut := draw.randint(0, len(t)))] + draw.choice(("", "x", "the lamp")) + t[cut + draw.randint(0, 12) :] for t in left] + left[:3] + ["of the " * 40]
    held = lambda texts, first: pa.array([[{"by": 0, "low": t, "least": first + k, "most": first + k} for k, t in enumerate(texts)]])
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    batch = pa.RecordBatch.from_arrays([held(left, 0), held(right, 100), pa.array([True])], ["held", "held_b", "both"])
    found = {(r["low"], r["low_b"]): r["ratio"] for out in clues._met(0.85, False)([batch]) for r in out.to_pylist()}
    assert found == {(x, y): r for a, b in ((left, right), (right, left)) for x in a for y in b if (r := ratio(x, y)) >= 0.85} and len(found) > 20
    once = [(r["low"], r["low_b"]) for out in clues._met(0.85, True)([batch]) for r in out.to_pylist()]
    assert set(once) == {(x, y) for x in left for y in right if ratio(x, y) >= 0.85}
    i, j = clues._may_match(left, right, 0.85, np.zeros((len(left), len(right)), bool), True)
    assert not len(i) and not len(j)
