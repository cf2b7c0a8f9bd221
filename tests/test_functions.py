"""Functions and operators on hand-made rows with known results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import answers as A
from tidemark.functions import pages as P
from tidemark.functions import questions as Q
from tidemark.functions import ranking as K
from tidemark.functions import similarity as S
from tidemark.functions import text as T
from tidemark.functions.dialect import SPARK as D
from tidemark.functions.similarity import TextView
from tidemark.operators import documents as O
from tidemark.operators import pagerank
from tidemark.plans import config, refine
from tidemark.sources import html, search


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(F.expr(expression).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "function, text, want",
    [
        (T.normalize_whitespace, " a \t b\n", "a b"),
        (T.normalize_heading, " 1. The  INTRO! ", "1 the intro"),
        (T.normalize_document_text, "a  b\r\n\n c", "a b\nc"),
        (T.strip_question_prefix, "What is  the sea", "the sea"),
        (T.clean_fragment, "-- lamps and oil of", "lamps and oil"),
        (T.canonicalize_url, "https://www.Ex.org/a/b/?q#f", "ex.org/a/b"),
        (T.extract_source, "nothing", "unknown"),
        (T.important_terms, "the Lamp of Ana's house", ["Lamp", "Ana's", "house"]),
        (T.specific_terms, "lamp lantern oil lantern beacon", ["lantern", "beacon", "lamp"]),
        (T.doi_candidates, "see 10.1234/Ab.c). and 10.1234/AB.C", ["10.1234/Ab.c"]),
        (T.capitalized_entities, "The River Song met Ana in March", ["The River Song"]),
        (T.plausible_person_name, "Maria Clara Santos", True),
        (T.plausible_person_name, "ANA LUND", False),
        (T.plausible_person_name, "Orchid University", False),
        (T.author_names, "Lamps. by Ana Lund", ["Ana Lund"]),
        (T.institutions, "at Green Hill University now", ["Green Hill University"]),
        (T.sentences, "One. Two! Three? four", ["One.", "Two!", "Three?", "four"]),
        (T.constraint_phrases, "papers from 1990 to 1999 with at least 20 pages", ["from 1990 to 1999", "at least 20 pages"]),
    ],
)
def test_text_functions(spark, function, text, want):
    assert one(spark, function(D, "x"), x=text) == want


def test_exact_phrases_respect_words(spark):
    assert one(spark, T.exact_phrase(D, "x", "last name"), x="the last  name?")
    assert not one(spark, T.exact_phrase(D, "x", "won"), x="wonder")


def features(spark, url="", title="", text=""):
    spark.createDataFrame([(1, url, title, text)], "id int, url string, title string, text string").createOrReplaceTempView("given_page")
    return spark.sql(f"SELECT * FROM {P.features(D, 'given_page')} f").first()


@pytest.mark.parametrize(
    "predicate, page, want",
    [
        ("broad_overview", {"title": "List of lamps"}, True),
        ("broad_overview", {"title": "Ana's lamps"}, False),
        ("non_english_wiki", {"url": "https://de.m.wikipedia.org/wiki/x"}, True),
        ("non_english_wiki", {"url": "https://en.wikipedia.org/wiki/x"}, False),
        ("wiki_meta", {"title": "Template:Lamp"}, True),
        ("recipe", {"text": "recipe ingredients preparation"}, True),
        ("recipe", {"text": "lamp"}, False),
        ("monument", {"title": "Photos of the memorial"}, True),
        ("event_topic", {"title": "Beauty pageant"}, True),
        ("media_topic", {"title": "Anime culture"}, True),
    ],
)
def test_page_predicates(spark, predicate, page, want):
    assert features(spark, **page)[predicate] is want


def test_intent_and_plan(spark):
    spark.createDataFrame([(1, "What is the DOI of the paper?"), (2, "What year was the lamp made?"), (3, "old lamps"), (4, "How many lamps?")], "id int, query string").createOrReplaceTempView("given_question")
    kinds = {r["id"]: r["answer_type"] for r in spark.sql(f"SELECT id, answer_type FROM {Q.intent(D, 'given_question')} i").collect()}
    assert kinds == {1: "doi", 2: "year", 3: "generic", 4: "count"}
    modes = {r["id"]: (r["mode"], r["max_iterations"]) for r in spark.sql(f"SELECT id, mode, max_iterations FROM {Q.plans(D, 'given_question')} p").collect()}
    assert modes[3] == ("simple", 1) and modes[1][0] != "simple" or modes[1] == ("simple", 1)


def test_constraints_and_their_assessment(spark):
    query = "a paper by two authors published in 2014 with a sample of couples between 40 and 90"
    spark.createDataFrame([(1, query)], "id int, query string").createOrReplaceTempView("given_question")
    asked = spark.sql(f"SELECT * FROM {Q.constraints(D, 'given_question')} c")
    r = asked.first()
    assert (r["author_count"], r["sample_min"], r["sample_max"], r["publication_year"]) == (2, 40, 90, 2014)
    docs = [("right", "Published 2014. We surveyed 55 couples.", ["A B", "C D"]), ("wrong", "Published 2001. We surveyed 500 couples.", ["A B"]), ("none", "Lamps.", [])]
    rows = spark.createDataFrame(docs, "title string, content string, authors array<string>").withColumns({"reference_text": F.lit(""), "published_date": F.lit("")}).crossJoin(asked)
    got = {x["title"]: x for x in O.assess_constraints(rows).collect()}
    assert got["right"]["matched"] == ["publication_date", "author_count", "sample_size"]
    assert got["wrong"]["contradicted"] == ["publication_date", "author_count", "sample_size"] and got["wrong"]["score"] < 0.35
    assert got["none"]["missing"] == ["publication_date", "author_count", "sample_size"]


def test_lexical_relevance_agrees_with_the_kernel(spark):
    pairs = [("red lamps 1990", "Red lamps were made in 1990 by Ana"), ("", "x"), ("the of", "a b"), ("blue", "red")]
    got = [r["v"] for r in spark.createDataFrame(pairs, "a string, b string").select(S.lexical_relevance(F.col("a"), F.col("b")).alias("v")).collect()]
    assert np.allclose(got, [TextView(a).lexical(TextView(b)) for a, b in pairs])
    assert got[0] > 0.6 and got[1:] == [0.0, 0.0, pytest.approx(0.3 * O.ratio("blue", "red"))]


def test_pagerank_edges(spark):
    rows = [(1, k, None, "", t, c, p) for k, (t, c, p) in enumerate([("a", "x y z", 1.0), ("b", "x y z", 0.0), ("c", "", None)])] + [(2, 0, None, None, None, None, None)]
    got = {(r["request_id"], r["pos"]): r for r in pagerank.pagerank_rerank(spark.createDataFrame(rows, "request_id long, pos int, id string, query string, title string, content string, prior double")).collect()}
    assert [got[1, k]["relevance"] for k in range(3)] == [1, 0, 0] and abs(sum(got[1, k]["pagerank"] for k in range(3)) - 1) < 1e-9
    assert got[1, 0]["rank"] == 1 and got[1, 2]["id"] == "doc-2" and got[2, 0]["pagerank"] == 1
    assert pagerank.ranks(np.zeros((1, 1)), np.ones(1))[0].tolist() == [1.0]
    assert pagerank.scaled(np.array([2.0, 2.0])).tolist() == [1, 1] and pagerank.scaled(np.zeros(2)).tolist() == [0, 0]
    assert pagerank.distribution(np.zeros(2), np.zeros(2)).tolist() == [0.5, 0.5]


def test_pagerank_equals_all_pairs(spark):
    texts = ["amber lanterns burn in the harbour", "harbour lanterns burn 12 nights", "the fish market opens at dawn", "lantern makers of the harbour town", ""]
    rows = [(q, k, None, "amber harbour lanterns", f"Title {k}", t, 0.5) for q in (1, 2) for k, t in enumerate(texts[: 3 + q])]
    got = {(r["request_id"], r["pos"]): r["pagerank"] for r in pagerank.pagerank_rerank(spark.createDataFrame(rows, "request_id long, pos int, id string, query string, title string, content string, prior double")).collect()}
    for q in (1, 2):
        views = [TextView(f"{r[4]} {r[5]}") for r in rows if r[0] == q]
        weights = np.array([[0.0 if a == b else views[b].similarity(views[a]) for a in range(len(views))] for b in range(len(views))])
        asked = TextView("amber harbour lanterns")
        told = np.array([min(1.0, 0.55 * asked.lexical(v) + 0.3 * asked.specificity(v) + 0.15 * asked.lexical(TextView(f"Title {k}"))) for k, v in enumerate(views)])
        want = pagerank.ranks(weights, pagerank.distribution(told, np.full(len(views), 0.5)))[0]
        assert np.allclose([got[q, k] for k in range(len(views))], want)


def test_pagerank_ranks_the_topic_first(spark):
    rows = [(1, 0, None, "red lamps", "Fish", "fish swim in the sea", 0.9), (1, 1, "b", "red lamps", "Red lamps", "how red lamps glow", 0.1)]
    got = {r["id"]: r for r in pagerank.pagerank_rerank(spark.createDataFrame(rows, "request_id long, pos int, id string, query string, title string, content string, prior double")).collect()}
    assert got["b"]["rank"] == 1 and set(got) == {"doc-0", "b"}


def test_deduplication_is_greedy(spark):
    rows = [
        (1, 0, "https://x.org/a?1", "A", "short", "x.org", 0.5, ["p"]),
        (1, 1, "http://www.x.org/a/", "", "a much longer text", "x.org", 0.9, ["q", "p"]),
        (1, 2, "https://y.org", "T", "other words entirely here", "y.org", 0.1, ["r"]),
        (1, 3, "https://z.org", "U", "other words entirely here", "z.org", 0.0, ["s"]),
        (2, 0, "https://x.org/a", "A", "short", "x.org", 0.5, ["p"]),
    ]
    docs = spark.createDataFrame(rows, "query_id long, pos int, url string, title string, content string, source string, retrieval_score double, matched_clues array<string>")
    got = {(r["query_id"], r["pos"]): r for r in O.deduplicate(docs).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 0)}
    assert got[1, 1]["title"] == "A" and got[1, 1]["matched_clues"] == ["q", "p"] and got[1, 2]["merged"] == 1
    pairs = O.near_duplicate_pairs(docs).collect()
    assert {(r["query_id"], r["pos"], r["pos_b"]) for r in pairs} == {(1, 2, 3)}


def test_sections_and_thanks(spark):
    text = "Intro\nsome words here that are not a heading at all really\nAcknowledgements:\nI thank Dr. Jane Doe for her help.\nmore thanks\nReferences\nA. (1999)."
    texts = [text, "x acknowledgement: to all\nAbstract\n", "", None, "Acknowledgements: to Ann\nand Bob\n\nChapter 2\nx", "Acknowledgements\nReferences\nA.\nAcknowledgments\nto Eve"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string").select("id", O.named_section(F.col("content"), ("acknowledgements", "acknowledgments", "acknowledgement")).alias("s")).orderBy("id").collect()
    found = [r["s"] for r in rows]
    assert found[0]["text"] == "I thank Dr. Jane Doe for her help.\nmore thanks" and (found[0]["start"], found[0]["end"], found[0]["offset_kind"]) == (2, 5, "line")
    assert found[1]["text"] == "to all" and found[1]["offset_kind"] == "char" and found[1]["start"] == 2
    assert found[2] is None and found[3] is None
    assert found[4]["text"] == "to Ann\nand Bob" and found[5]["text"] == "to Eve"
    row = spark.createDataFrame([(text,)], "content string").select(O.thanked_people("content").alias("v")).first()["v"]
    assert [(x["name"], x["evidence"][-32:]) for x in row] == [("Jane Doe", "thank Dr. Jane Doe for her help.")] or row[0]["name"].startswith("Jane")


def test_snippets(spark):
    long, plain = "word " * 30 + "end. " + "tail " * 60, "word " * 80
    contents = ["a\nb", "x lamp y lamp z", "", long + "\n" + plain, "é lampé LAMP " * 20]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "k int, c string")
    got = df.select("k", O.truncated(F.col("c")).alias("t"), O.passages(F.col("c")).alias("p"), O.windows(S.clean(F.col("c")), F.array(F.lit("lamp"), F.lit("z")), 3).alias("w")).orderBy("k").collect()
    for text, r in zip(contents, got):
        clean = " ".join(text.split())
        places = [(w, k) for w in ("lamp", "z") for k in range(len(clean)) if clean.lower().startswith(w, k)]
        assert r["w"] == [clean[max(0, k - 3) : k + 3].strip() for _, k in places]
        lines = [" ".join(x.split()) for x in text.split("\n") if x.strip()]
        pairs = [f"{a} {b}" for a, b in zip(lines, lines[1:])]
        assert set(r["p"]) == ({x for x in lines if len(x) >= 40} | {x for x in pairs if 60 <= len(x) <= 640} or set(filter(None, [clean])))
        assert r["t"] == clean if len(clean) <= 320 else r["t"].endswith("...") and len(r["t"]) <= 324
    assert got[3]["t"] == ("word " * 30 + "end")[:320] + "..."


def test_evidence_around_identifiers_thanks_and_words(spark):
    rows = [
        (1, 1, "What is the DOI of the paper on lamps?", "Lamps", "https://e.org/1", "Abstract of the journal. Filler text " * 8 + "see doi 10.1234/ab.cd here. More text follows " * 3),
        (2, 1, "Who is thanked in the thesis acknowledgements?", "Thesis", "https://e.org/2", "Chapter One\nText.\nAcknowledgements\nI thank Dr. Jane Doe for her help.\nReferences\nNone."),
        (3, 1, "amber lanterns harbour", "Page", "https://e.org/3", "Nothing of note is on this line of the page at all, really.\nAmber lanterns burned in the harbour all night long, they say."),
        (3, 1, "amber lanterns harbour", "", "", ""),
    ]
    got = {(r["query_id"], r["title"]): r["snippet"] for r in O.evidence(spark.createDataFrame([(*r, 0.5) for r in rows], "query_id long, pos int, query string, title string, url string, content string, rank_score double")).collect()}
    assert "10.1234/ab.cd" in got[1, "Lamps"] and len(got[1, "Lamps"]) < 320
    assert got[2, "Thesis"] == "I thank Dr. Jane Doe for her help." and "Amber lanterns burned in the harbour" in got[3, "Page"]
    assert len(got) == 3


def test_html_page(spark):
    page = '<html><title> T &amp; U </title><meta name="citation_author" content="Ana"><meta name="Author" content="Ana"><meta name="doi" content="10.1/x"><h1>H</h1><h2>I <b>J</b></h2><p>one <b>two</b></p><script>no</script><a href="/a">go</a><a href="/a">GO</a><a href="#x">no</a><a>none</a><img src=x>'
    rows = spark.createDataFrame([(1, "https://e.org/p/", page), (2, None, None), (3, "https://e.org", '<a href="http://[bad">x</a>')], "page_id long, url string, html string")
    got = {r["id"]: r for r in html.parse_pages(rows).collect()}
    r = got[1]
    assert (r["title"], r["doi"], r["authors"], r["text"], r["n_images"], r["n_links"]) == ("T & U", "10.1/x", ["Ana"], "one two", 1, 4)
    assert [tuple(x) for x in r["links"]] == [("go", "https://e.org/a")] and r["headings"] == ["H", "I J"] and [tuple(x) for x in r["outline"]] == [(1, "H"), (2, "I J")]
    assert got[2]["text"] == "" and got[2]["links"] == [] and got[3]["n_links"] == 1


def test_search_cascade():
    now = [0.0]
    rest = search.Cooldowns(lambda: now[0])

    def broke(clue):
        raise search.SearchError("one", '{"x": "quota"}', 429)

    hits, report = search.search_cascade(["a", "b"], {"one": broke, "two": lambda c: [c] if c == "a" else []}, rest)
    assert hits == ["a"] and report.quota_exhausted == ["one"] and report.used == ["two"] and report.retried_clues == 2
    assert rest.resting("one")
    now[0] = 3601
    assert not rest.resting("one")
    assert rest.rotated(["p", "q"]) == ["p", "q"] and rest.rotated(["p", "q"]) == ["q", "p"]
    with pytest.raises(search.SearchError):
        search.search_cascade(["a"], {"one": broke}, rest)
    assert search.error_detail('{"detail": {"error": "no"}}') == "no" and search.error_detail("plain") == "plain"


def test_provider_answers(spark):
    body = '{"organic": [{"title": "A", "link": "https://a.org", "snippet": "s", "date": "2020"}, {"title": "no link"}, {"title": "B", "link": "https://b.org"}]}'
    rows = search.hits_of(spark.createDataFrame([(1, "c", "", body)], "query_id long, clue string, branch string, body string"), "serper").orderBy("idx").collect()
    assert [(r["url"], r["retrieval_score"]) for r in rows] == [("https://a.org", 1.0), ("https://b.org", 0.6667)]


def test_settings():
    env = {"TIDEMARK_MAX_ITERATIONS": "9", "TIDEMARK_PIPELINE_MODE": "odd", "TIDEMARK_FETCH_TIMEOUT_SECONDS": "x", "TIDEMARK_USE_FOLLOW_UP_RETRIEVAL": "off", "TIDEMARK_PROVIDER_ORDER": " Serper, ,tavily"}
    got = config.load_config(env)
    assert (got.max_iterations, got.pipeline_mode, got.fetch_timeout, got.use_follow_up, got.provider_order) == (4, "auto", 20.0, False, ("serper", "tavily"))


def test_refinement():
    class Client:
        def complete(self, instruction, text):
            return text + "!" if instruction.startswith(refine.UPDATE) else f"bad {text}"

    assert refine.refine_query(Client(), "q", 2).text == "q!!"
    assert refine.refine_answer(Client(), "q", "c", None, 0).text == "bad q"
    assert len(refine.optimize_prompt(Client(), "p", ["a", "b"], "kind", 3).critiques) == 3


def test_cooldown_stream(spark, tmp_path):
    import datetime as dt

    from tidemark.streaming.cooldowns import provider_cooldowns

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    calls = [("a", at(0), "failure"), ("a", at(10), "ok"), ("a", at(400), "ok"), ("b", at(0), "quota"), ("b", at(400), "ok")]
    spark.createDataFrame(calls, "provider string, at timestamp, outcome string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("provider string, at timestamp, outcome string").parquet(f"{tmp_path}/in")
    query = provider_cooldowns(stream).writeStream.format("memory").queryName("cooled").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    got = {(r["provider"], r["at"].timestamp() - at(0).timestamp()): r["resting"] for r in spark.sql("SELECT * FROM cooled").collect()}
    assert sorted(got.values()) == [False, False, False, True, True]


def test_sinks_and_samples(spark, tmp_path):
    from tidemark.sources import sinks

    df = spark.createDataFrame([("", "e", "s", 0.5), ("42", "e", "s", 0.9)], "a string, e string, s string, c double")
    made = df.select(sinks.response(F.col("a"), F.col("e"), F.col("s"), F.col("c"), F.array("s")).alias("v"))
    assert [r["v"] for r in made.collect()] == ['{"evidence":"e","source":"s","confidence":0.5,"sources":["s"]}', '{"answer":"42","evidence":"e","source":"s","confidence":0.9,"sources":["s"]}']
    paths = sinks.save_both(df, made, str(tmp_path), "now")
    assert spark.read.json(paths["raw"]).count() == 2
    (tmp_path / "q.csv").write_text('Problem,ANSWER\n"a, b",1\nc,2\n')
    got = sinks.sampled_questions(spark, f"{tmp_path}/q.csv", 5).collect()
    assert sorted((r["problem"], r["answer"], r["url"]) for r in got) == [("a, b", "1", ""), ("c", "2", "")]
    cells = [(0, "x")] + [(2, f" {c} ") for c in sinks.HEADER_CELLS] + [(3, c) for c in sinks.HEADER_CELLS]
    assert sinks.header_row(spark.createDataFrame(cells, "row int, value string")) == 2


def test_prior_rules(spark):
    rows = [
        (1, 1, "Tell me about lamps", "https://a.edu", "Lamps", "Plain words about lamps.", "", "", 0.0, 0.0, 0, True),
        (2, 1, "Tell me about lamps", "https://a.edu/apply", "Lamps", "Course admissions.", "", "", 0.0, 0.0, 0, True),
        (3, 2, "What is the DOI of the journal article cited in 1999?", "https://doi.org/10.1234/ab", "Light", "Abstract 1999.", "", "refs", 0.0, 1.0, 1, True),
        (4, 3, "Who is thanked in the thesis acknowledgements?", "https://lib.org/thesis.pdf", "A thesis", "I thank Ana Perez Lund.", "I thank", "", 0.0, 0.0, 0, True),
    ]
    spark.createDataFrame(rows, "id long, query_id long, query string, url string, title string, text string, acknowledgements string, reference_text string, lexical double, constraint_score double, n_contradicted int, grounded boolean").createOrReplaceTempView("prior_rows")
    got = {r["id"]: r for r in spark.sql(f"SELECT * FROM {K.scores(D, 'prior_rows')} s").collect()}
    assert got[1]["prior"] == got[2]["prior"] == 0 and got[1]["paper"] == 0
    # DOI 0.25, paper word 0.2, references 0.1, constraints 0.35 - 0.1, the year 0.05
    assert got[3]["prior"] == pytest.approx(0.85) and got[3]["reference"] == pytest.approx(0.6 + 0.15 * 0)
    assert got[3]["doi_bearing"] == pytest.approx(0.6 + 0.4 + 0.2 - 0.08)
    # a PDF 0.2, a repository's name 0.15, a thesis 0.3, thanks 0.2
    assert got[4]["prior"] == pytest.approx(0.85) and got[4]["acknowledgement"] == pytest.approx(0.55 + 0.25 + 0.1)


def test_context_documents(spark):
    names = [name.replace("-", "_") for _, name in K.WANTED]
    rows = []

    def add(query, pos, url, score, rank, mode, **signals):
        rows.append((query, pos, url, f"t{pos}", score, rank, mode, 1 if mode == "multi-hop" else None, *(float(signals.get(n, 0)) for n in names)))

    for k, (url, signals) in enumerate([("https://a.org", {}), ("https://www.a.org/", {"paper": 0.9}), ("https://b.org", {"paper": 0.3}), ("https://c.org", {"career": 0.2}), ("https://d.org", {}), ("", {}), ("", {})]):
        for query, mode in ((1, "multi-hop"), (2, "decomposition"), (3, "simple")):
            add(query, k, url, 1 - 0.1 * k, k + 1, mode, **signals)
    df = spark.createDataFrame(rows, "query_id long, pos int, url string, title string, rank_score double, rank int, mode string, primary int, " + ", ".join(f"{n} double" for n in names))

    def of(n):
        out = {}
        for r in O.context_documents(df, n).orderBy("query_id", "place").collect():
            out.setdefault(r["query_id"], []).append(r["pos"])
        return out

    assert of(1) == {1: [1], 2: [0], 3: [0]}
    assert of(3) == {1: [1, 2, 3], 2: [0, 2, 3], 3: [0, 1, 2]}
    assert of(20) == {1: [1, 2, 3, 4, 5, 6], 2: [0, 2, 3, 4, 5, 6], 3: [0, 1, 2, 3, 4, 5, 6]}
    assert of(0) == {} and O.context_documents(df.where("false"), 3).count() == 0


def test_alike_contents_are_found_without_comparing_all(monkeypatch):
    draw = random.Random(5)
    syllables = ("the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "sti")
    texts = [" ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(draw.choice((0, 3, 60, 300)))) for _ in range(60)]
    for t in texts[:40]:
        cut = draw.randint(0, len(t))
        texts.append(t[:cut] + draw.choice(("", "x", " lantern", "z" * 40)) + t[cut + draw.randint(0, 60) :])
    views = [O.TextView(t) for t in texts]
    slow = [next((k for k in range(n) if O.alike(v, views[k]) >= 0.92), n) for n, v in enumerate(views)]
    compared, alike = [], O.alike
    monkeypatch.setattr(O, "alike", lambda a, b: compared.append(1) or alike(a, b))
    contents, fast = O.AlikeContents(0.92), []
    for n, v in enumerate(views):
        fast.append(contents.first(v, n))
        contents.put(v, n)
    assert fast == slow and any(k < n for n, k in enumerate(slow))
    assert len(compared) < len(views) * 10


def test_deduplication_by_links_is_the_greedy_one(spark):
    """Leaders as a plain loop over all of them finds them; a group's rows hold no contents."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice(("the", "er", "on", "qui", "re", "za", "in", "ed", "nd")) for _ in range(draw.randint(1, 3)))
    texts = [" ".join(word() for _ in range(draw.choice((0, 2, 40, 300)))) for _ in range(25)] + ["of the " * 60, "of the " * 60, "of the " * 60 + "and"]
    texts += [t[: (cut := draw.randint(0, len(t)))] + draw.choice(("", " lantern", "z" * 30)) + t[cut + draw.randint(0, 90) :] for t in texts for _ in range(2)]
    rows = [(1 + k % 2, k, f"https://x.org/{draw.randint(0, 90)}", draw.choice(("", "", "A", f"T{k}")), t, "x.org", draw.choice((0.1, 0.5)), [f"c{k % 3}"]) for k, t in enumerate(texts)]
    want = {}
    for q in (1, 2):
        leaders, views = [], {r[1]: O.TextView(r[4]) for r in rows}
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[6], -len(r[4]), -len(r[7]), r[1])):
            k = next((k for k in leaders if O._url_key(k["url"]) == O._url_key(r[2]) or (r[3] and (r[3].lower(), r[5]) in k["names"]) or O.alike(views[r[1]], views[k["has"]]) >= 0.92), None)
            if k is None:
                leaders.append({"pos": r[1], "url": r[2], "has": r[1], "title": r[3], "names": {(r[3].lower(), r[5])}, "merged": 0})
                continue
            k["merged"] += 1
            k["has"] = r[1] if len(r[4]) > len(texts[k["has"]]) else k["has"]
            if not k["title"] and r[3]:
                k["title"] = r[3]
                k["names"].add((r[3].lower(), r[5]))
        want |= {(q, k["pos"]): (texts[k["has"]], k["title"], k["merged"]) for k in leaders}
    docs = spark.createDataFrame(rows, "query_id long, pos int, url string, title string, content string, source string, retrieval_score double, matched_clues array<string>")
    found = O.deduplicate(docs)
    assert {(r["query_id"], r["pos"]): (r["content"], r["title"], r["merged"]) for r in found.collect()} == want
    grouped = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "FlatMapCoGroups" in line)
    assert "content#" not in grouped


def test_pages_reach_workers_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        rows = spark.range(1200).selectExpr("id AS page_id", "'https://a.org' AS url", "concat('<p>', id, '</p>') AS html").coalesce(1)
        assert html.elements(rows).count() == 1200
        assert int(spark.conf.get(name)) <= html.BATCH
    finally:
        spark.conf.set(name, before)


def test_a_questions_terms_and_phrases_are_made_once(spark):
    # comparing in the sort, and the look for an earlier spelling, made them again for every pair
    assert T.specific_terms(D, "query").count("regexp_extract_all") == 1
    assert T.constraint_phrases(D, "query").count("regexp_extract_all") == 5
    rows = A.anchor_groups(D, "(SELECT 1 AS id, 'Old lamps burn. Bright towers, which shine in Mostar' AS query UNION ALL SELECT 2, 'Lamps burn, and towers shine' UNION ALL SELECT 3, '')")
    plan = spark.sql(f"SELECT * FROM {rows} a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 1 and "Join" not in plan
    got = [tuple(r) for r in spark.sql(f"SELECT * FROM {rows} a ORDER BY id, nth").collect()]
    assert got == [(1, 1, "lamps burn"), (1, 2, "bright towers mostar shine"), (2, 1, "towers lamps shine burn"), (2, 2, "lamps burn"), (2, 3, "towers shine")]
