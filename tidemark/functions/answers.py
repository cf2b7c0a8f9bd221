"""Scores of answers' evidence: winners of events, years of memorials, links worth following, grounded pages."""

from __future__ import annotations

from . import lexicons as L
from . import pages as P
from . import questions as Q
from . import text as T
from .dialect import Dialect

# Phrases of the rules below.
OFFICIAL = ("official", "tourism", "municipal", "municipality", "province")
TOP_CITY_PHRASES = ("top 4", "largest cities", "population census")
YEAR_QUESTIONS = ("what year", "which year", "in what year", "when was", "when did", "dated")
MEMORIAL_TERMS = ("monument", "memorial", "spomenik", "victims", "loss of lives", "in their honor")
#: Characters of a document, after its title, in which an institution is looked for.
INSTITUTION_CHARS = 2500
LINK_PENALTIES = ("category", "history", "list", "portal", "template")


def winner_score(d: Dialect, sentence: str, generic: str) -> str:
    """The score of one sentence as evidence of a winner; zero without a winner's word."""
    low = f"lower({sentence})"
    winner, strong = d.count_in(low, L.EVENT_WINNER_HINTS), d.count_in(low, L.EVENT_WINNER_STRONG_HINTS)
    named = f"CASE WHEN {d.size(T.person_names(d, sentence))} > 0 THEN 0.28 ELSE 0.0 END"
    official = f"CASE WHEN {d.any_in(low, OFFICIAL)} THEN 0.06 ELSE 0.0 END"
    score = f"least(0.42, 0.08 * {winner}) + least(0.2, 0.08 * {strong}) + {named} + {official} - CASE WHEN {generic} THEN 0.22 ELSE 0.0 END"
    return f"CASE WHEN {winner} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(greatest(0.0, least(1.0, {score})) AS DOUBLE) END"


def winner_evidence(d: Dialect, relation: str) -> str:
    """relation (id, text) with winner_score: the best sentence's score, lower if the text's opening is a generic topic."""
    cut = f"SELECT r.*, {T.normalize_whitespace(d, 'text')} AS clean FROM {relation} r"
    judged = P.features(d, "(SELECT id, '' AS url, left(clean, 140) AS title, left(clean, 1200) AS text FROM w1)")
    parts = f"SELECT w1.id, f.event_topic AS generic, {T.sentences(d, 'w1.clean')} AS sentences FROM w1 JOIN {judged} f ON f.id = w1.id"
    rows = "SELECT id, generic, explode_outer(sentences) AS sentence FROM w2" if d.spark else "SELECT w2.id, w2.generic, s.sentence FROM w2 LEFT JOIN LATERAL (SELECT unnest(w2.sentences) AS sentence) s ON true"
    scored = f"SELECT id, {winner_score(d, 'coalesce(sentence, ' + d.lit('') + ')', 'generic')} AS score FROM w3"
    return f"(WITH w1 AS ({cut}), w2 AS ({parts}), w3 AS ({rows}), w4 AS ({scored}) SELECT id, max(score) AS winner_score FROM w4 GROUP BY id)"


def build_year_cutoff(d: Dialect, q: str) -> str:
    return d.try_int(f"nullif({d.extract(q, r'\b(?:constructed|built|erected|completed|opened|unveiled|installed)\b[^.]{0,40}?\b(?:prior to|before)[ ]+((?:19|20)\d{2})\b', 1)}, '')")


def artist_birth_year(d: Dialect, q: str) -> str:
    return d.try_int(f"nullif({d.extract(q, r'\b(?:artist|sculptor|architect|designer|author)\b[^.]{0,80}?\b(?:who[ ]+was[ ]+|was[ ]+)?born(?:[ ]+in)?[ ]+((?:19|20)\d{2})\b', 1)}, '')")


def top_city_question(d: Dialect, q: str) -> str:
    return f"({d.contains(q, 'bosnia')} AND {d.any_in(q, TOP_CITY_PHRASES)})"


def location_terms(d: Dialect, q: str) -> str:
    """The place names that a memorial question asks about, in order."""
    asked = [f"CASE WHEN {d.contains(q, t)} THEN {d.lit(t)} END" for t in ("bosnia", "yugoslavia")]
    cities = f"{d.any_in(q, ('bosnia', 'largest cities', 'population census'))}"
    return f"concat_ws('|', {', '.join(asked)}, " + ", ".join(f"CASE WHEN {cities} THEN {d.lit(t)} END" for t in L.BOSNIA_TOP_FOUR_CITY_TERMS) + ")"


def construction_years(d: Dialect, x: str) -> str:
    """Distinct first years near a word of building, in order."""
    return d.distinct(d.extract_all(x, r"\b(?:built|constructed|erected|completed|unveiled|opened|installed)\b[^.]{0,60}?\b((?:19|20)\d{2})\b", 1))


def structural_question(d: Dialect, q: str) -> str:
    return f"({build_year_cutoff(d, q)} IS NOT NULL OR {artist_birth_year(d, q)} IS NOT NULL OR {d.contains(q, 'former yugoslavia')})"


def year_questions(d: Dialect, relation: str) -> str:
    """relation (id, query) with what memorial questions ask for."""
    a = f"SELECT r.id, lower({T.normalize_whitespace(d, 'query')}) AS q FROM {relation} r"
    return f"(WITH y1 AS ({a}) SELECT id, {build_year_cutoff(d, 'q')} AS build_cutoff, {artist_birth_year(d, 'q')} AS birth_year, {top_city_question(d, 'q')} AS top_city, {location_terms(d, 'q')} AS places, {structural_question(d, 'q')} AS structural, ({d.any_in('q', YEAR_QUESTIONS)} AND {d.any_in('q', MEMORIAL_TERMS)}) AS memorial_year FROM y1)"


def link_scores(d: Dialect, relation: str) -> str:
    """relation (id, url, title, text = '', terms) with the score of following a link: title is the link's text."""
    f = P.features(d, relation)
    tokens = T.important_terms(d, "clean_title")
    low = f"lower({T.normalize_whitespace(d, f'concat(clean_title, {d.lit(' ')}, url)')})"
    spaced = f"lower(concat(clean_title, ' ', replace(replace(url, '-', ' '), '_', ' ')))"
    a = f"SELECT f.*, {tokens} AS tokens, {low} AS link_low, {T.important_terms(d, spaced)} AS own, {T.normalize_whitespace(d, spaced)} AS own_text FROM {f} f"
    n = d.size("tokens")
    reject = f"clean_title = '' OR length(clean_title) > 120 OR {d.any_in('link_low', L.BROWSECOMP_LINK_EXCLUDE_HINTS)} OR broad_overview OR listing OR wiki_meta OR non_english_wiki OR media_topic OR event_topic OR monument OR forum OR {d.is_in('lower(clean_title)', L.GENERIC_LINK_TEXT_HINTS)} OR {n} = 0 OR {n} > 9"
    score = f"0.18 + CASE WHEN {n} <= 6 THEN 0.12 ELSE 0.0 END + CASE WHEN {d.size(T.capitalized_entities(d, 'clean_title'))} > 0 THEN 0.12 ELSE 0.0 END + CASE WHEN {d.matches('clean_title', '[A-Z][a-z]+')} THEN 0.07 ELSE 0.0 END"
    score += f" + 0.28 * media_score + 0.22 * ({T.specificity_overlap(d, 'terms', 'own', 'own_text')}) - CASE WHEN {d.any_in('lower(clean_title)', LINK_PENALTIES)} THEN 0.4 ELSE 0.0 END - CASE WHEN {n} = 1 AND length({d.at('tokens', 1)}) < 5 THEN 0.08 ELSE 0.0 END"
    return f"(WITH l1 AS ({a}) SELECT id, CASE WHEN {reject} THEN CAST(0 AS DOUBLE) ELSE CAST(greatest(0.0, least(1.0, {score})) AS DOUBLE) END AS link_score FROM l1)"


def anchor_groups(d: Dialect, relation: str) -> str:
    """relation (id, query) as rows (id, place, terms): up to four specific terms of each sentence, of each clause if there are fewer than two such groups; six groups at most."""
    a = f"SELECT r.id, {T.normalize_whitespace(d, 'query')} AS nq FROM {relation} r"
    b = f"SELECT id, nq, {T.sentences(d, 'nq')} AS parts, {T.constraint_phrases(d, 'nq')} AS phrases, {T.strip_question_prefix(d, 'nq')} AS stripped FROM a1"
    c = f"SELECT id, parts, {Q.clauses(d, 'stripped', 'phrases')} AS clauses FROM a2"
    if d.spark:
        # one pass: the clauses are looked at only where a question's own sentences give fewer than two groups
        terms = lambda parts, base: f"transform({parts}, (part, place) -> struct({base} + place AS place, {d.join(d.head(T.specific_terms(d, 'part'), 4), ' ')} AS terms))"
        told = lambda column: f"filter({column}, g -> g.terms <> '')"
        a4 = f"SELECT id, nq, {told(terms(T.sentences(d, 'nq'), 0))} AS own FROM a1"
        cut = d.let(T.strip_question_prefix(d, "nq"), lambda stripped: d.let(T.constraint_phrases(d, "nq"), lambda phrases: Q.clauses(d, stripped, phrases), "phrases"), "stripped")
        a5 = f"SELECT id, CASE WHEN size(array_distinct(own.terms)) >= 2 THEN own ELSE concat(own, {told(terms(cut, 1000000))}) END AS every FROM a4"
        a6 = "SELECT id, g.terms, min(g.place) AS place FROM a5 LATERAL VIEW explode(every) v AS g GROUP BY id, g.terms"
        a7 = "SELECT id, place, terms, count_if(place < 1000000) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY place) AS nth FROM a6"
        return f"(WITH a1 AS ({a}), a4 AS ({a4}), a5 AS ({a5}), a6 AS ({a6}), a7 AS ({a7}) SELECT id, CAST(nth AS INT) AS nth, terms FROM a7 WHERE nth <= 6 AND (place < 1000000 OR n < 2))"
    rows = lambda column: f"SELECT id, generate_subscripts({column}, 1) - 1 AS place, unnest({column}) AS part FROM a3"
    termed = lambda column, base: f"SELECT id, {base} + min(place) AS place, terms FROM (SELECT id, place, {d.join(d.head(T.specific_terms(d, 'part'), 4), ' ')} AS terms FROM ({rows(column)}) g) h WHERE terms <> '' GROUP BY id, terms"
    own = "SELECT id, count(*) AS n FROM a4 GROUP BY id"
    more = "SELECT a5.* FROM a5 LEFT JOIN a6 ON a6.id = a5.id LEFT JOIN a4 ON a4.id = a5.id AND a4.terms = a5.terms WHERE coalesce(a6.n, 0) < 2 AND a4.id IS NULL"
    every = f"SELECT id, place, terms, row_number() OVER (PARTITION BY id ORDER BY place) AS nth FROM (SELECT * FROM a4 UNION ALL {more}) u"
    return f"(WITH a1 AS ({a}), a2 AS ({b}), a3 AS ({c}), a4 AS ({termed('parts', 0)}), a5 AS ({termed('clauses', 1000000)}), a6 AS ({own}) SELECT id, CAST(nth AS INT) AS nth, terms FROM ({every}) e WHERE nth <= 6)"


def first_answers(d: Dialect, documents: str) -> str:
    """The first document of each question (query_id, place, id, title, text) that names a title, and an institution."""
    titled = P.title_phrases(d, documents)
    place = d.at(T.institutions(d, f"concat_ws({d.lit(' ')}, title, left(text, {INSTITUTION_CHARS}))"), 1)
    rows = f"SELECT query_id, place, title_phrase, coalesce({place}, '') AS institution FROM {titled} t"
    best = lambda column: f"SELECT query_id, {column} AS answer FROM (SELECT query_id, {column}, row_number() OVER (PARTITION BY query_id ORDER BY place) AS nth FROM f1 WHERE {column} <> '') x WHERE nth = 1"
    return f"(WITH f1 AS ({rows}) SELECT query_id, 'title' AS answer_type, answer, 0.58e0 AS confidence FROM ({best('title_phrase')}) a UNION ALL SELECT query_id, 'institution', answer, 0.56e0 FROM ({best('institution')}) b)"
