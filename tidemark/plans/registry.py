"""Registered queries of the engine and the SQL that must agree with them.

Each SQL query is one definition rendered for Spark and for DuckDB; queries that SQL can't express have no oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import answers as A
from tidemark.functions import pages as P
from tidemark.functions import questions as Q
from tidemark.functions import ranking as K
from tidemark.functions import text as T
from tidemark.functions.dialect import DUCK, SPARK, Dialect
from tidemark.operators import retrieval as R
from tidemark.sources import relations as S

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of sql over the tables of sf_dir that it names."""
    for table in TABLES:
        if SPARK.table(table) in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(SPARK.table(table))
    return spark.sql(sql)


def sql_query(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    name = build.__name__
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, build(SPARK))
    ORACLES[name] = build(DUCK)
    return build


def plan_query(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


@sql_query
def source_profile(d: Dialect) -> str:
    """Documents and characters by source."""
    return f"SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM {d.table('documents')} GROUP BY source"


@sql_query
def text_normalization(d: Dialect) -> str:
    return f"SELECT id, {T.normalize_whitespace(d, 'text')} AS clean, {T.normalize_heading(d, 'title')} AS heading, {T.normalize_document_text(d, 'text')} AS lines FROM {S.pages(d)} p"


@sql_query
def term_functions(d: Dialect) -> str:
    return f"SELECT id, {d.join(T.important_terms(d, 'query'), ' ')} AS terms, {T.keyword_focus(d, 'query', 6)} AS focus, {T.strip_question_prefix(d, 'query')} AS stripped, {T.clean_fragment(d, 'query')} AS fragment, {d.join(T.specific_terms(d, 'query'), ' ')} AS specific FROM {S.questions(d)} q"


@sql_query
def constraint_phrases(d: Dialect) -> str:
    a = f"SELECT id, {T.normalize_whitespace(d, 'query')} AS q FROM {S.questions(d)} s"
    b = f"SELECT id, {T.constraint_phrases(d, 'q')} AS phrases, {T.strip_question_prefix(d, 'q')} AS stripped FROM a"
    return f"WITH a AS ({a}), b AS ({b}) SELECT id, {d.join('phrases', '|')} AS phrases, {d.join(Q.clauses(d, 'stripped', 'phrases'), '|')} AS clauses FROM b"


@sql_query
def url_functions(d: Dialect) -> str:
    return f"SELECT id, {T.canonicalize_url(d, 'url')} AS canonical_url, {T.extract_source(d, 'url')} AS source, CAST({T.domain_reliability(d, 'url')} AS DOUBLE) AS reliability, CAST({T.document_type(d, 'url', 'title', 'text')} AS DOUBLE) AS type_score FROM {S.pages(d)} p"


@sql_query
def identifier_functions(d: Dialect) -> str:
    return f"SELECT id, {d.join(T.doi_candidates(d, 'text'), ' ')} AS dois, {T.contains_primary_doi(d, 'url', 'title', 'text')} AS has_primary_doi, {d.join(T.years(d, 'text'), ' ')} AS years, {T.looks_like_reference(d, 'text')} AS is_reference FROM {S.pages(d)} p"


@sql_query
def name_functions(d: Dialect) -> str:
    return f"SELECT id, {d.join(T.capitalized_entities(d, 'title'), '|')} AS entities, {d.join(T.person_names(d, 'text'), '|')} AS people, {T.plausible_person_name(d, 'title')} AS title_is_person, {d.join(T.author_names(d, 'text'), '|')} AS authors, {d.join(T.institutions(d, 'text'), '|')} AS institutions FROM {S.pages(d)} p"


@sql_query
def sentence_split(d: Dialect) -> str:
    return f"SELECT id, {d.size(T.sentences(d, 'text'))} AS n_sentences, {d.join(d.head(T.sentences(d, 'text'), 2), '|')} AS first_two FROM {S.pages(d)} p"


PREDICATES = ("broad_overview", "non_english_wiki", "wiki_meta", "listing", "forum", "social", "recipe", "monument", "media_topic", "event_topic")


@sql_query
def page_predicates(d: Dialect) -> str:
    return f"SELECT id, {', '.join(PREDICATES)} FROM {P.features(d, S.pages(d))} f"


@sql_query
def page_scores(d: Dialect) -> str:
    return f"SELECT id, round(event_score, 9) AS event_score, event_score >= 0.28 AS looks_like_event, round(media_score, 9) AS media_score, media_score >= 0.32 AS looks_like_media FROM {P.features(d, S.pages(d))} f"


@sql_query
def title_phrases(d: Dialect) -> str:
    return f"SELECT id, title_phrase FROM {P.title_phrases(d, S.pages(d))} t"


@sql_query
def query_intent(d: Dialect) -> str:
    return f"SELECT id, answer_type, {', '.join(Q.FLAGS)}, {Q.signals(d)} AS signals, {Q.media_type(d, 'q', 'is_media_query')} AS media_type FROM {Q.intent(d, S.questions(d))} i"


@sql_query
def query_constraints(d: Dialect) -> str:
    return f"SELECT id, author_count, sample_min, sample_max, sample_terms, publication_year, publication_month, reference_year_min, reference_year_max, institution_year_min, institution_year_max FROM {Q.constraints(d, S.questions(d))} c"


@sql_query
def query_plan(d: Dialect) -> str:
    return f"SELECT id, mode, use_decomposition, use_follow_up, max_results_per_clue, max_iterations FROM {Q.plans(d, S.questions(d))} g"


@sql_query
def query_page_overlap(d: Dialect) -> str:
    """Specificity and shared years of invented questions and every page, joined by a question number."""
    questions = d.rows("v", ("qid", "query"), [(k, q) for k, q in enumerate(S.QUESTIONS)])
    joined = f"SELECT p.id, q.qid, {T.specific_terms(d, 'q.query')} AS terms, {T.years(d, 'q.query')} AS asked_years, {T.years(d, 'p.text')} AS own_years, lower({T.normalize_whitespace(d, 'p.text')}) AS clean FROM {S.pages(d)} p JOIN {questions} q ON q.qid = abs(p.id) % {len(S.QUESTIONS)}"
    termed = f"SELECT *, {T.important_terms(d, 'clean')} AS own FROM ({joined}) j"
    return f"SELECT id, qid, round(CAST({T.specificity_overlap(d, 'terms', 'own', 'clean')} AS DOUBLE), 9) AS specificity, {T.share_an_item(d, 'asked_years', 'own_years')} AS same_year FROM ({termed}) k"


@sql_query
def seen_hits(d: Dialect) -> str:
    """What the memory of search hits admits: the first hit of each canonical URL."""
    return f"SELECT query_id, pos, k AS url_key FROM {R.first_by_key(d, S.hits(d), R.url_key(d))} f"


@sql_query
def merged_documents(d: Dialect) -> str:
    return R.merged_documents(d, S.hits(d))


@sql_query
def normalized_scores(d: Dialect) -> str:
    return f"SELECT query_id, pos, round(normalized, 9) AS normalized FROM ({R.normalized_scores(d, S.hits(d))}) n"


@sql_query
def provider_rank_scores(d: Dialect) -> str:
    return R.rank_scores(d, S.hits(d))


@sql_query
def frontier_batch(d: Dialect) -> str:
    tasks = f"(SELECT query_id, pos AS seq, CASE WHEN pos % 3 = 0 THEN 'search' ELSE 'fetch' END AS kind, retrieval_score AS priority FROM {S.hits(d)} h)"
    return R.frontier(d, tasks, 4, "fetch")


@sql_query
def evidence_graph_summary(d: Dialect) -> str:
    return R.evidence_graph(d, f"(SELECT query_id, url, 'entity' AS kind, clue AS value FROM {S.hits(d)} h UNION ALL SELECT query_id, url, 'fact', title FROM {S.hits(d)} i WHERE title <> '')")


@sql_query
def context_block(d: Dialect) -> str:
    return R.context_block(d, f"(SELECT query_id, pos, title, url, {T.normalize_whitespace(d, 'content')} AS snippet, retrieval_score AS score FROM {S.hits(d)} h)")


@sql_query
def evaluation_records(d: Dialect) -> str:
    return f"SELECT * FROM {R.records(d, S.evaluation(d))} r"


@sql_query
def evaluation_metrics(d: Dialect) -> str:
    return R.metrics(d, S.evaluation(d))


@sql_query
def winner_evidence(d: Dialect) -> str:
    return f"SELECT id, round(winner_score, 9) AS winner_score, winner_score >= 0.38 AS has_winner FROM {A.winner_evidence(d, S.pages(d))} w"


@sql_query
def year_questions(d: Dialect) -> str:
    return f"SELECT * FROM {A.year_questions(d, S.questions(d))} y"


@sql_query
def construction_years(d: Dialect) -> str:
    return f"SELECT id, {d.join(A.construction_years(d, 'lower(text)'), ' ')} AS built FROM {S.pages(d)} p"


@sql_query
def link_scores(d: Dialect) -> str:
    """Page titles as link texts, judged for an invented question."""
    relation = f"(SELECT p.id, p.url, p.title, '' AS text, {T.specific_terms(d, d.lit(S.QUESTIONS[2]))} AS terms FROM {S.pages(d)} p)"
    return f"SELECT id, round(link_score, 9) AS link_score FROM {A.link_scores(d, relation)} l"


@sql_query
def anchor_groups(d: Dialect) -> str:
    return f"SELECT id, nth, terms FROM {A.anchor_groups(d, S.questions(d))} a"


@sql_query
def first_answers(d: Dialect) -> str:
    documents = f"(SELECT abs(p.id) % 20 AS query_id, p.id AS place, p.id, p.title, p.text FROM {S.pages(d)} p)"
    return f"SELECT * FROM {A.first_answers(d, documents)} f"


@sql_query
def document_priors(d: Dialect) -> str:
    """Prior and signals of every page for the question of its number; the figures that need a matcher are invented."""
    asked = d.rows("v", ("query_id", "query"), list(enumerate(S.QUESTIONS)))
    pages = f"""(SELECT p.*, a.query_id, a.query, CASE WHEN p.id % 4 = 0 THEN 'thanks' ELSE '' END AS acknowledgements, CASE WHEN p.id % 5 = 0 THEN 'cited' ELSE '' END AS reference_text,
      CAST(abs(p.id) % 9 AS DOUBLE) / 8 AS lexical, CAST(abs(p.id) % 5 AS DOUBLE) / 4 AS constraint_score, abs(p.id) % 4 AS n_contradicted, p.id % 2 = 0 AS grounded
      FROM {S.pages(d)} p JOIN {asked} a ON a.query_id = abs(p.id) % {len(S.QUESTIONS)})"""
    signals = ", ".join(f"round({c}, 9) AS {c}" for c in (name.replace("-", "_") for _, name in K.WANTED))
    return f"SELECT query_id, id, round(prior, 9) AS prior, {signals} FROM {K.scores(d, pages)} s"


@sql_query
def result_summary(d: Dialect) -> str:
    """How many results there are, their mean title and text lengths, and how many have text."""
    return f"SELECT count(*) AS n_results, round(avg(length(title)), 6) AS title_length, round(avg(length(text)), 6) AS text_length, CAST(sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_with_text FROM {S.pages(d)} p"


FLAGSHIP = QUERIES["evaluation_metrics"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT id, url, title, text FROM {S.pages(SPARK)} p")


def _question_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of invented questions: pages dealt to questions by number, with clues and scores."""
    sql = f"""SELECT abs(id) % {len(S.QUESTIONS)} AS query_id, CAST(id + 1000 AS INT) AS pos, url, title, text AS content, {T.extract_source(SPARK, 'url')} AS source, CAST(abs(id) % 7 AS DOUBLE) / 7 AS retrieval_score,
      array(concat('clue ', abs(id) % 3)) AS matched_clues FROM {S.pages(SPARK)} p"""
    asked = SPARK.rows("v", ("query_id", "query"), list(enumerate(S.QUESTIONS)))
    return run_sql(spark, sf_dir, f"SELECT d.*, a.query FROM ({sql}) d JOIN {asked} a ON a.query_id = d.query_id")


def _covering(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """question_id, query and place of the pages (id, url, title, text) that cover each invented question and benchmark item best."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.operators.grounding import asked, coverage, fronts
    from tidemark.operators.staging import kept

    questions, pages = kept(run_sql(spark, sf_dir, f"SELECT id, query FROM {S.questions(SPARK)} q WHERE id < 1000000")), kept(_pages(spark, sf_dir))
    best = Window.partitionBy("question_id").orderBy(F.desc("matched_groups"), F.desc("specificity"), "id")
    found = coverage(kept(asked(questions)), kept(fronts(pages))).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    return kept(found.join(questions.withColumnRenamed("id", "question_id"), "question_id").join(pages, "id"))


@plan_query
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.html import parse_pages

    return parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@plan_query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link graph of the pages: absolute targets with their canonical form."""
    links = parsed_pages(spark, sf_dir).selectExpr("id", "url", "explode(links) AS link")
    return links.selectExpr("id", "url", "link.text AS link_text", "link.url AS link_url", f"{T.canonicalize_url(SPARK, 'link.url')} AS target")


@plan_query
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query-aware PageRank of the ten pages that cover each invented question and benchmark item best."""
    from pyspark.sql import functions as F

    from tidemark.operators.pagerank import pagerank_rerank

    found = _covering(spark, sf_dir, 10)
    return pagerank_rerank(found.select(F.col("question_id").alias("request_id"), F.col("place").alias("pos"), F.col("id").cast("string").alias("id"), "query", "title", F.col("text").alias("content"), F.col("specificity").alias("prior")))


@plan_query
def deduplicated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each question, merged over their whole contents."""
    from tidemark.operators.documents import deduplicate

    return deduplicate(_question_documents(spark, sf_dir))


@plan_query
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of alike pages among all, each page beside a copy with two more words; the oracle compares all pairs."""
    from pyspark.sql import functions as F

    from tidemark.operators.documents import near_duplicate_pairs as pairs

    docs = _question_documents(spark, sf_dir).withColumn("query_id", F.lit(0))
    copies = docs.withColumns({"pos": F.col("pos") + 1000000, "content": F.concat("content", F.lit(" lantern beacon"))})
    return pairs(docs.unionByName(copies)).withColumn("jaccard", F.round("jaccard", 9))


def _all_pairs() -> str:
    """DuckDB's answer to near_duplicate_pairs by comparing every pair."""
    d = DUCK
    rows = f"SELECT 0 AS query_id, id + 1000 + n * 1000000 AS pos, concat(text, CASE WHEN n = 1 THEN ' lantern beacon' ELSE '' END) AS content FROM {S.pages(d)} p CROSS JOIN (SELECT unnest([0, 1]) AS n) c"
    terms = f"SELECT query_id, pos, list_distinct({T.important_terms(d, f'lower({T.normalize_whitespace(d, 'content')})')}) AS terms FROM ({rows}) r"
    shared = "len(list_intersect(a.terms, b.terms))"
    jaccard = f"CAST({shared} AS DOUBLE) / (len(a.terms) + len(b.terms) - {shared})"
    return f"WITH t AS ({terms}) SELECT a.query_id, CAST(a.pos AS INT) AS pos, CAST(b.pos AS INT) AS pos_b, round({jaccard}, 9) AS jaccard FROM t a JOIN t b ON a.query_id = b.query_id AND a.pos < b.pos WHERE len(a.terms) > 0 AND len(b.terms) > 0 AND {jaccard} >= 0.92"


ORACLES["near_duplicate_pairs"] = _all_pairs()


@plan_query
def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked with their priors."""
    from pyspark.sql import functions as F

    from tidemark.operators.documents import judged, ranked

    return ranked(judged(_question_documents(spark, sf_dir)), F.col("prior")).select("query_id", "pos", "url", "lexical", "prior", "rank_score", "rank")


@plan_query
def context_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six sources of each question's context."""
    from pyspark.sql import functions as F

    from tidemark.operators.documents import context_documents as chosen
    from tidemark.operators.documents import judged, ranked

    return chosen(ranked(judged(_question_documents(spark, sf_dir)), F.col("prior")), 6)


@plan_query
def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.documents import evidence, ranked

    return evidence(ranked(_question_documents(spark, sf_dir)).where("rank <= 6"))


@plan_query
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.documents import sections, thanked_people

    docs = _question_documents(spark, sf_dir)
    return sections(docs).select("query_id", "pos", "acknowledgements", "references", thanked_people("content").alias("thanked"))


@plan_query
def constraint_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidemark.operators.documents import assess_constraints

    asked = run_sql(spark, sf_dir, f"SELECT * FROM {Q.constraints(SPARK, '(SELECT query_id AS id, query FROM ' + SPARK.rows('v', ('query_id', 'query'), list(enumerate(S.QUESTIONS))) + ' w)')} c")
    docs = _question_documents(spark, sf_dir).drop("query")
    rows = docs.join(F.broadcast(asked), docs["query_id"] == asked["id"]).withColumns({"reference_text": F.lit(""), "authors": F.array().cast("array<string>"), "published_date": F.lit("")})
    return assess_constraints(rows).select("query_id", "pos", "score", "matched", "missing", "contradicted")


@plan_query
def corpus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline search: the five best documents for each benchmark item by shared terms."""
    from tidemark.sources.search import corpus_search as search

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS doc_key", "CAST(NULL AS string) AS url", "'' AS title", "text")
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS clue"), docs).drop("text")


@plan_query
def anchor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question and page that share a specific term: how specific the page is, and how many anchor groups it covers."""
    from tidemark.operators.grounding import asked, coverage, fronts
    from tidemark.operators.staging import kept

    questions = asked(run_sql(spark, sf_dir, f"SELECT id, query FROM {S.questions(SPARK)} q"))
    return coverage(kept(questions), kept(fronts(_pages(spark, sf_dir))), digits=9)


def _coverage_of_all_pairs() -> str:
    """DuckDB's answer to anchor_coverage by looking for every term of every question in every page."""
    d = DUCK
    asked = f"SELECT id AS question_id, {T.specific_terms(d, 'query')} AS terms FROM {S.questions(d)} q"
    groups = f"SELECT id AS question_id, list(string_split(terms, ' ')) AS groups FROM {A.anchor_groups(d, S.questions(d))} a GROUP BY id"
    low = f"lower({T.normalize_whitespace(d, f'concat_ws({d.lit(" ")}, title, url, left(text, 3200))')})"
    pages = f"SELECT id, {low} AS low, list_transform(regexp_extract_all({low}, '[A-Za-z0-9][A-Za-z0-9''-]*'), lambda x: x) AS words FROM {S.pages(d)} p"
    pairs = "SELECT question_id, id, terms, coalesce(groups, []) AS groups, low, words FROM a LEFT JOIN g USING (question_id) CROSS JOIN p"
    counts = "list_filter(list_transform(groups, lambda g: [len(list_filter(g, lambda t: contains(low, t))), least(2, len(g))]), lambda c: c[1] >= c[2])"
    figures = f"SELECT question_id, id, len(list_filter(terms, lambda t: list_contains(words, t))) AS hits, len(list_filter(list_slice(terms, 1, 4), lambda t: length(t) >= 6 AND contains(low, t))) AS long, len(terms) AS n, {counts} AS counts, len(groups) AS total FROM x WHERE len(list_filter(list_concat(terms, flatten(groups)), lambda t: contains(low, t))) > 0"
    return f"WITH a AS ({asked}), g AS ({groups}), p AS ({pages}), x AS ({pairs}), f AS ({figures}) SELECT question_id, id, round(CASE WHEN n > 0 THEN least(1.0, CAST(hits AS DOUBLE) / n + least(0.12, 0.03 * long)) ELSE 0.0 END, 9) AS specificity, CAST(len(counts) AS INT) AS matched_groups, CAST(coalesce(list_sum(list_transform(counts, lambda c: c[1])), 0) AS INT) AS matched_terms, CAST(total AS INT) AS total_groups FROM f"


ORACLES["anchor_coverage"] = _coverage_of_all_pairs()


@plan_query
def grounded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with the pages that are grounded in it."""
    from tidemark.operators.grounding import grounded_pages as pages

    found = pages(run_sql(spark, sf_dir, f"SELECT id, query FROM {S.questions(SPARK)} q"), _pages(spark, sf_dir))
    return found.selectExpr("question_id", "id", "round(specificity, 9) AS specificity", *(f"CAST({c} AS INT) AS {c}" for c in ("matched_groups", "matched_terms", "total_groups")), "memorial")


def _grounded_of_all_pairs() -> str:
    """DuckDB's answer to grounded_pages by judging every question with every page."""
    from tidemark.functions import lexicons as L
    from tidemark.operators import grounding as G

    d = DUCK
    questions = S.questions(d)
    memorial, grounded = G.rules()
    found = lambda texts, most, extra: f"lower({T.normalize_whitespace(d, f"concat_ws(' ', {texts}, left(text, {most}){extra})")})"
    years = lambda *rules: f"list_filter(list_transform({d.concat(*(d.extract_all('low', p, g) for p, g in rules))}, lambda y: try_cast(y AS INT)), lambda y: y IS NOT NULL)"
    places = lambda column: "list_filter([" + ", ".join(d.lit(x) for x in G.PLACES) + f"], lambda x: contains({column}, x))"
    cities = "[" + ", ".join(d.lit(x) for x in L.BOSNIA_TOP_FOUR_CITY_TERMS) + "]"
    asked = f"SELECT i.id AS question_id, {T.specific_terms(d, 'i.query')} AS terms, i.q AS low_query, is_media_query, is_event_query FROM {Q.intent(d, questions)} i"
    groups = f"SELECT id AS question_id, list(string_split(terms, ' ')) AS groups FROM {A.anchor_groups(d, questions)} a GROUP BY id"
    told = f"SELECT a.*, coalesce(g.groups, []) AS groups, y.* EXCLUDE (id, places), string_split(y.places, '|') AS places, {d.any_in('low_query', A.YEAR_QUESTIONS)} AS year_question, {d.any_in('low_query', G.ASKED_YEARS)} AS asked_year, {d.contains('low_query', 'former yugoslavia')} AS former FROM a LEFT JOIN g USING (question_id) JOIN {A.year_questions(d, questions)} y ON y.id = a.question_id"
    texts = f"SELECT id, lower(url) AS low_url, lower(concat_ws(' ', {T.normalize_whitespace(d, 'title')}, url)) AS head, {found('title, url', G.FRONT, '')} AS low, {found('title', G.MEMORIAL_FRONT, '')} AS near, {found('url, title', G.BIOGRAPHY_FRONT, '')} AS life FROM {S.pages(d)} p"
    phrases = f"SELECT id, coalesce(nullif(title_phrase, ''), {T.normalize_whitespace(d, 'title')}) AS phrase FROM {P.title_phrases(d, S.pages(d))} t"
    marks = {
        "build_years": years((G.BUILT, 1), (G.BUILT, 2)), "birth_years": years((G.BORN[0], 1), (G.BORN[1], 1)), "yugoslav": d.any_in("low", L.YUGOSLAV_HINTS), "trusted": d.any_in("low_url", L.MEMORIAL_SOURCE_HINTS),
        "places_in": places("low"), "places_in_head": places("head"), "year_in": d.matches("low", T.YEAR), "old_year_in": d.matches("low", r"\b19(?:[0-5]\d|6\d)\b"), "memorial_evidence": d.any_in("low", L.MEMORIAL_EVIDENCE_HINTS),
        "memorial_page": d.any_in("low", L.MEMORIAL_PAGE_HINTS), "casualties": d.any_in("low", L.CASUALTY_HINTS), "memorial_head": d.any_in("head", L.MEMORIAL_TITLE_HINTS), "artist_in": d.any_in("low", L.MEMORIAL_ARTIST_HINTS),
        "biography": f"NOT {d.any_in('lower(phrase)', L.MEMORIAL_PAGE_HINTS)} AND phrase <> '' AND {T.plausible_person_name(d, 'phrase')} AND ({d.any_in('life', L.PERSON_BIOGRAPHY_HINTS)} OR contains(low_url, 'wikipedia.org/wiki/'))",
    }
    words = lambda column: f"regexp_extract_all({column}, '[A-Za-z0-9][A-Za-z0-9''-]*')"
    pages = f"SELECT t.*, h.phrase, f.* EXCLUDE (id), {', '.join(f'{sql} AS {name}' for name, sql in marks.items())}, {words('low')} AS low_words, {words('near')} AS near_words FROM t JOIN h USING (id) JOIN (SELECT * EXCLUDE (url, title, text, low_url) FROM {P.features(d, S.pages(d))} e) f USING (id)"

    def figures(column: str, prefix: str) -> str:
        hits, long = f"len(list_filter(terms, lambda t: list_contains({column}_words, t)))", f"len(list_filter(list_slice(terms, 1, 4), lambda t: length(t) >= 6 AND contains({column}, t)))"
        counts = f"list_filter(list_transform(groups, lambda g: [len(list_filter(g, lambda t: contains({column}, t))), least(2, len(g))]), lambda c: c[1] >= c[2])"
        return f"CASE WHEN len(terms) > 0 THEN least(1.0, CAST({hits} AS DOUBLE) / len(terms) + least(0.12, 0.03 * {long})) ELSE 0.0 END AS {prefix}specificity, {counts} AS {prefix}counts"

    summed = ", ".join(f"len({p}counts) AS {p}matched_groups, coalesce(list_sum(list_transform({p}counts, lambda c: c[1])), 0) AS {p}matched_terms" for p in ("", "near_"))
    structure = {
        "score": "0.26 * CAST(c1 AS INT) - 0.42 * CAST(c2 AS INT) + 0.22 * CAST(c3 AS INT) - 0.32 * CAST(c4 AS INT) + 0.14 * CAST(c5 AS INT) + 0.08 * CAST(trusted AS INT)",
        "matches": "CAST(c1 AS INT) + CAST(c3 AS INT) + CAST(c5 AS INT)", "contradictions": "CAST(c2 AS INT) + CAST(c4 AS INT)",
    }
    conditions = {
        "c1": "len(list_filter(build_years, lambda y: y < build_cutoff)) > 0", "c2": "len(build_years) > 0 AND list_min(build_years) >= build_cutoff", "c3": "list_contains(birth_years, birth_year)",
        "c4": "birth_year IS NOT NULL AND len(birth_years) > 0 AND NOT list_contains(birth_years, birth_year)", "c5": "former AND yugoslav",
    }
    hits = f"list_has_any(places, places_in) AS place_hit, list_has_any(places, places_in_head) AS place_in_head, top_city AND list_has_any({cities}, places_in) AS city_hit, list_has_any({cities}, places_in_head) AS city_in_head"
    parts = [
        f"a AS ({asked})", f"g AS ({groups})", f"q AS ({told})", f"t AS ({texts})", f"h AS ({phrases})", f"p AS ({pages})",
        f"x AS (SELECT *, {figures('low', '')}, {figures('near', 'near_')}, len(groups) AS total_groups, {hits}, {', '.join(f'coalesce({sql}, false) AS {name}' for name, sql in conditions.items())} FROM q CROSS JOIN p)",
        f"s AS (SELECT *, {summed}, {', '.join(f'{sql} AS structural_{name}' for name, sql in structure.items())} FROM x)",
    ]
    return f"WITH {', '.join(parts)} SELECT question_id, id, round(CAST(specificity AS DOUBLE), 9) AS specificity, CAST(matched_groups AS INT) AS matched_groups, CAST(matched_terms AS INT) AS matched_terms, CAST(total_groups AS INT) AS total_groups, {memorial} AS memorial FROM s WHERE {grounded}"


ORACLES["grounded_pages"] = _grounded_of_all_pairs()


@plan_query
def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed answer of each invented question and benchmark item, from the six pages that cover it best."""
    from pyspark.sql import functions as F

    from tidemark.operators.answers import extracted

    rows = _covering(spark, sf_dir, 6).select(F.concat_ws(":", "question_id", "id").alias("id"), F.col("question_id").alias("query_id"), "query", "place", "url", "title", "text", F.col("specificity").alias("rank_score"), F.col("specificity").alias("retrieval_score"))
    return extracted(rows).withColumnRenamed("id", "source")


#: Candidates of answers made of search hits: a hit's clue answers its query, hit by hit.
CANDIDATES = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS hop, CASE WHEN pos % 11 = 0 THEN '' ELSE clue END AS answer, round(0.2e0 + 0.7e0 * retrieval_score, 6) AS confidence, round(0.2e0 + 0.7e0 * retrieval_score + CASE WHEN pos % 3 = 0 THEN 0.04e0 ELSE 0e0 END, 6) AS score FROM"


@plan_query
def standing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that stands after all candidates of a query, in order."""
    from tidemark.plans.research import standing

    rows = run_sql(spark, sf_dir, f"{CANDIDATES} {S.hits(SPARK)} h").selectExpr("query_id", "CAST(hop AS INT) AS hop", "answer", "'' AS evidence", "'' AS source", "confidence", "score")
    return standing(rows).select("query_id", "hop", "answer", "confidence", "score")


ORACLES["standing_answers"] = f"""WITH RECURSIVE c AS ({CANDIDATES} {S.hits(DUCK)} h),
best AS (SELECT query_id, 0::BIGINT AS nth, 0::BIGINT AS hop, '' AS answer, 0e0 AS confidence, 0e0 AS score FROM c GROUP BY query_id
  UNION ALL SELECT query_id, n, CASE WHEN adopt THEN n ELSE hop END, CASE WHEN adopt THEN a ELSE answer END, CASE WHEN adopt THEN f ELSE confidence END, CASE WHEN adopt THEN s ELSE score END FROM (
    SELECT best.*, c.hop AS n, c.answer AS a, c.confidence AS f, c.score AS s,
      c.answer <> '' AND (best.answer = '' OR (best.confidence < 0.85 AND CASE WHEN lower(c.answer) = lower(best.answer) THEN c.score >= best.score - 0.02 AND c.confidence >= best.confidence ELSE c.score > best.score + 0.05 END)) AS adopt
    FROM best JOIN c ON c.query_id = best.query_id AND c.hop = best.nth + 1))
SELECT query_id, CAST(hop AS INT) AS hop, answer, confidence, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nth DESC) AS last FROM best) WHERE last = 1 AND answer <> ''"""


@plan_query
def link_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the invented questions meet by following links, best first, from the four pages that cover each best."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.operators.frontier import expanded
    from tidemark.operators.grounding import asked, coverage, fronts, named
    from tidemark.operators.staging import kept

    questions, pages = kept(asked(run_sql(spark, sf_dir, f"SELECT id, query FROM {S.questions(SPARK)} q WHERE id < 1000000"))), kept(_pages(spark, sf_dir))
    best = Window.partitionBy("question_id").orderBy(F.desc("matched_groups"), F.desc("specificity"), "id")
    found = coverage(questions, kept(fronts(pages))).withColumn("place", F.row_number().over(best)).where("place <= 4")
    seeds = found.join(pages.selectExpr("id", f"{T.canonicalize_url(SPARK, 'url')} AS node"), "id").where("node <> ''").select(F.col("question_id").alias("query_id"), "node", F.col("specificity").alias("score"))
    links = kept(page_links(spark, sf_dir).selectExpr(f"{T.canonicalize_url(SPARK, 'url')} AS source", "target", "link_url", "link_text").where("target <> ''").distinct())

    def score(rows: DataFrame) -> DataFrame:
        rows = kept(rows.join(questions.select(F.col("id").alias("query_id"), "terms"), "query_id").withColumn("id", F.monotonically_increasing_id()))
        with named(rows) as r:
            scores = spark.sql(f"SELECT id, link_score FROM {A.link_scores(SPARK, f'(SELECT id, link_url AS url, link_text AS title, {SPARK.lit(chr(32))} AS text, terms FROM {r})')} l")
        return rows.join(scores, "id").drop("id", "terms")

    return expanded(kept(seeds), links, score, rounds=2, least=0.2).withColumn("score", F.round("score", 9))


@plan_query
def similar_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions whose words are alike by the matcher's ratio, 0.85 or more; an equal one of a smaller number stands first."""
    from pyspark.sql import functions as F

    from tidemark.operators.clues import alike

    rows = run_sql(spark, sf_dir, f"SELECT 0 AS query_id, id AS pos, query AS clue FROM {S.questions(SPARK)} q")
    return alike(rows, rows, 0.85, once=True).select("id_a", "id_b", F.round("ratio", 9).alias("ratio"))


@plan_query
def question_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.clues import question_clues as clues

    return clues(run_sql(spark, sf_dir, f"SELECT id, query FROM {S.questions(SPARK)} q"))


@plan_query
def research_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops of search over the documents for every benchmark item, and the best five snippets of each."""
    from tidemark.plans.research import research

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS doc_key", "CAST(NULL AS string) AS url", "'' AS title", "text")
    return research(spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query"), docs)
