"""Typed answers of invented questions, folds and distances against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import answers as X

ROWS = [
    # question, query, place, url, title, text
    (1, "Who won the beauty pageant at the harvest festival of Millbrook township, which celebrates the local stew?", 1, "https://millbrook.gov/fest", "Millbrook harvest festival", "The harvest festival of Millbrook township celebrates the stew. At the official beauty pageant of the harvest festival Maria Clara Santos was crowned winner. Tourism officer John Albert Reyes spoke at length about roads, budgets, bridges and many other things that mattered to him."),
    (1, "Who won the beauty pageant at the harvest festival of Millbrook township, which celebrates the local stew?", 2, "https://food.example.com/stew", "Stew recipe", "Ingredients and preparation: cook the recipe. Serves four. Nutrition and cooking time."),
    (2, "What is the last name of the professor thanked in the thesis acknowledgements?", 1, "https://u.edu/t.pdf", "A thesis on lamps", "Chapter One\nSome text here.\nAcknowledgements\nI thank Dr. Helena Quist for her help. I am grateful to Omar Bell.\nReferences\nNone."),
    (3, "How many techniques does the fighter in the novel use?", 1, "https://lib.org/f", "The Fighter", "The fighter in the novel used 14 different techniques. The book has 30 pages."),
    (4, "Which character is the rival named in the novel about clocks?", 1, "https://lib.org/c", "The Clock", "The novel about clocks has a rival named Grintley. Nothing else happens."),
    (5, "what year did the massacre of the victims happen that the memorial in Sarajevo Bosnia commemorates?", 1, "https://c.org/m", "Monument to the victims in Sarajevo", "The memorial in Sarajevo commemorates victims killed in 1942 in Bosnia. It was built in 1961. The census of 1971 counted its population."),
    (6, "What is the title of the pdf about old lamps?", 1, "https://x.org", "", "old"),
    (6, "What is the title of the pdf about old lamps?", 2, "https://x.org/2", "Bright Lamps of Orchid Harbour", "lamps"),
    (7, "Find which institution studied lamps", 1, "https://x.org/3", "Study", "Researchers at Orchid Harbour University studied lamps."),
    (8, "what year was the monument to the victims in Bosnia constructed prior to 1970 by a sculptor who was born in 1930?", 1, "https://c.org/n", "Monument to the victims in Sarajevo", "The memorial commemorates victims killed in 1942 in Bosnia. It was built in 1984 by a sculptor, born in 1950."),
    (9, "Tell me about lamps", 1, "", "", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, *r, 0.5, 0.5) for k, r in enumerate(ROWS)], "id long, query_id long, query string, place int, url string, title string, text string, rank_score double, retrieval_score double")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return {r["query_id"]: r for r in X.extracted(rows).collect()}


def test_answers_by_type(found):
    answers = {k: r["answer"] for k, r in found.items()}
    assert answers[1] == "Maria Clara Santos" and answers[2] == "Quist" and found[2]["supporting_person"] == "Helena Quist"
    assert answers[3] == "14" and answers[4] == "Grintley" and answers[5] == "1942"
    assert answers[6] == "Bright Lamps of Orchid Harbour" and answers[7] == "Orchid Harbour University"
    assert 8 not in answers and 9 not in answers  # contradicted by its structure; nothing to read
    assert found[2]["confidence"] == 0.77 and found[6]["confidence"] == 0.58
    assert all(0 <= r["confidence"] <= 0.84 and r["evidence"] for r in found.values())
    assert "crowned winner" in found[1]["evidence"] and "killed in 1942" in found[5]["evidence"]


def test_fold_equals_a_loop(spark):
    draw = random.Random(4)
    cases = [[(k, f"s{k}", *([(draw.choice((0.1, 0.3, 0.5, 0.59, 0.6, 0.9)), f"{kind}{k}{j}") for j in range(draw.randrange(3))] for kind in "ab")) for k in range(draw.randrange(5))] for _ in range(80)]
    want = []
    for sentences in cases:
        best = (0.0, "", "")
        for _, sentence, explicit, capitals in sentences:
            for score, value in explicit:
                best = (score, value, sentence) if score > best[0] else best
            if best[0] < 0.6:
                for score, value in capitals:
                    best = (score, value, sentence) if score > best[0] else best
        want.append(best)
    kind = "array<struct<score:double,value:string>>"
    df = spark.createDataFrame(list(enumerate(cases)), f"k int, s array<struct<nth:int,sentence:string,explicit:{kind},capitals:{kind}>>")
    got = df.select("k", X.fold(F.col("s"), "explicit", "capitals").alias("c")).orderBy("k").collect()
    assert [tuple(r["c"]) for r in got] == want


def test_places_and_distances(spark):
    text = "Zoé 𝔸 won; Ann Lee won, and the queen Ann Lee won again"
    r = spark.createDataFrame([(text,)], "t string").select(X.located(F.col("t"), r"\bwon\b").alias("won"), X.located(F.col("t"), r"\b(Ann) (Lee)\b", 2).alias("names"), X.first_match(F.col("t"), r"\b(nobody)\b").alias("none"), X.nearest(F.lit(11), F.transform(X.located(F.col("t"), r"\bwon\b"), lambda x: x["start"])).alias("d")).first()
    assert [(x["start"], x["end"]) for x in r["won"]] == [(k, k + 3) for k in range(len(text)) if text[k : k + 3] == "won"]
    assert [(text[x["start"] : x["end"]], x["value"]) for x in r["names"]] == [("Ann Lee", "Lee")] * 2 and r["none"] == []
    assert r["d"] == min(abs(11 - k) for k in range(len(text)) if text[k : k + 3] == "won")
