"""Question-side functions: lookups, intent, plan and constraints, as layers over a relation with id and query."""

from __future__ import annotations

from . import lexicons as L
from . import text as T
from .dialect import Dialect

# Phrases of the intent rules, and limits of the plan.
FULL_NAME = ("full name", "first and last name", "first and last names", "first name and last name")
WINNER_TASK = ("winner", "won", "person", "full name", "first and last name", "first and last names", "beauty pageant", "pageant")
COUNT_PHRASES = ("how many", "count of", "how much", "what number")
YEAR_PHRASES = ("what year", "which year", "in what year", "when was", "when did", "dated")
INSTITUTION_PHRASES = ("which university", "what university", "institution")
NAME_PHRASES = ("what's the name", "what is the name", "name of", "which character", "who is")
REPOSITORY_WORDS = ("department", "university", "student", "submitted", "completed", "advisor", "supervisor", "repository")
PAPER_WORDS = ("journal", "article", "authors", "sample size", "published", "citation")
PAPER_PHRASES = ("research paper", "journal article", "peer reviewed")
ENCYCLOPEDIC_WORDS = ("wiki", "fandom", "character", "plot summary")
DISCOVERY_PHRASES = ("created by", "became known", "based on", "draws some elements")
EVENT_HOP_PHRASES = ("named after", "began after", "set them apart", "celebration", "festival", "anniversary", "winner", "pageant", "contest")
IDENTITY_WORDS = ("student", "children", "article", "admitted", "schools", "growth", "violence")
RELATION_PHRASES = ("after", "before", "between", "as of", "during", "inclusive", "anniversary", "winner", "named after", "began after", "shifted")
MEMORIAL_WORDS = ("monument", "memorial", "spomenik", "loss of lives", "lost their lives", "victims", "dedication", "honor", "battle", "massacre", "tragedy")
STRUCTURE_PHRASES = ("constructed", "prior to", "before 1970", "former yugoslavia", "population census", "largest cities", "artist who was born", "born in")
CAREER_MOVES = ("later", "became", "joined", "appointed", "uk")
MEDIA_TYPES = ("manga", "anime", "comic", "comics", "graphic novel", "novel", "game", "film", "movie", "tv", "television")
ACADEMIC_RESULTS, LONG_RESULTS, RESULTS = 8, 8, 5
SIMPLE_TERMS, SIMPLE_CLAUSES, SIMPLE_CONSTRAINTS, COMPLEX_TERMS = 8, 2, 1, 12


def _hint(d: Dialect, q: str, hint: str) -> str:
    return d.contains(q, hint) if hint.endswith("acknowledg") else T.exact_phrase(d, q, hint)


def _any_hint(d: Dialect, q: str, hints) -> str:
    return "(" + " OR ".join(_hint(d, q, h) for h in hints) + ")"


def _count_hints(d: Dialect, q: str, hints) -> str:
    return "(" + " + ".join(f"CASE WHEN {_hint(d, q, h)} THEN 1 ELSE 0 END" for h in hints) + ")"


def academic_lookup(d: Dialect, q: str) -> str:
    n = d.count_in(q, L.ACADEMIC_QUERY_HINTS)
    return f"({n} >= 2 OR ({n} >= 1 AND {d.matches(q, T.YEAR)}))"


def media_lookup(d: Dialect, q: str) -> str:
    n = T.count_exact_phrases(d, q, L.MEDIA_QUERY_HINTS)
    return f"({n} >= 2 OR ({n} >= 1 AND {T.any_exact_phrase(d, q, L.CHARACTER_QUERY_HINTS)}))"


def event_lookup(d: Dialect, q: str) -> str:
    n = T.count_exact_phrases(d, q, L.EVENT_QUERY_HINTS)
    return f"({n} >= 2 OR ({n} >= 1 AND {T.any_exact_phrase(d, q, WINNER_TASK)}))"


def person_target(d: Dialect, q: str) -> str:
    return T.any_exact_phrase(d, q, L.PERSON_QUERY_HINTS)


def media_type(d: Dialect, q: str, is_media: str) -> str:
    """The first media word in the query; manga for other media queries."""
    cases = " ".join(f"WHEN {d.contains(q, m)} THEN {d.lit('comic' if m == 'comics' else m)}" for m in MEDIA_TYPES)
    return f"CASE {cases} WHEN {is_media} THEN 'manga' ELSE '' END"


def clauses(d: Dialect, x: str, phrases: str) -> str:
    """Parts of x between commas, semicolons and connectives, of two terms or more; constraint phrases stay whole.

    x and phrases are columns. A phrase's blanks, commas and semicolons stand as control characters while x is split;
    connectives count only between plain blanks or marks, so those inside a phrase don't split."""
    hide = lambda p: f"replace(replace(replace({p}, ' ', {d.lit(chr(2))}), ',', {d.lit(chr(3))}), ';', {d.lit(chr(4))})"
    show = lambda p: f"replace(replace(replace({p}, {d.lit(chr(2))}, ' '), {d.lit(chr(3))}, ','), {d.lit(chr(4))}, ';')"
    if d.spark:
        hidden = f"aggregate({phrases}, {x}, (acc, p) -> replace(acc, p, {hide('p')}))"
    else:
        hidden = f"list_reduce(list_concat([{x}], {phrases}), lambda acc, p: replace(acc, p, {hide('p')}))"
    spaced = d.replace_all(hidden, "(?i)(^|[ ,;])(?:and|or|but|who|which|that|where|when|whose)(?:[ ,;]+(?:and|or|but|who|which|that|where|when|whose))*([ ,;]|$)", ";")
    parts = d.transform(d.split(spaced, "[,;]"), lambda p: T.clean_fragment(d, show(p)), "p")
    return T.distinct_ignoring_case(d, d.filter(parts, lambda p: f"{d.size(T.important_terms(d, p))} >= 2", "p"))


def intent(d: Dialect, relation: str) -> str:
    """relation with the question's intent: answer_type, the flags and the signals."""
    q = "q"
    a = f"SELECT r.*, lower({T.normalize_whitespace(d, 'query')}) AS q FROM {relation} r"
    b = f"""SELECT *, {academic_lookup(d, q)} AS academic, {media_lookup(d, q)} AS is_media_query, {event_lookup(d, q)} AS is_event_query,
      {_count_hints(d, q, L.MEDIA_QUERY_HINTS)} AS media_signals, {d.size(T.constraint_phrases(d, q))} AS n_constraints,
      {_count_hints(d, q, (*L.THESIS_CONTENT_HINTS, *REPOSITORY_WORDS))} AS repository_signals,
      {_count_hints(d, q, dict.fromkeys((*L.PAPER_QUERY_HINTS, *L.REFERENCE_HINTS, *PAPER_WORDS)))} AS paper_signals,
      {_any_hint(d, q, L.THESIS_CONTENT_HINTS)} AS explicit_thesis, {T.any_exact_phrase(d, q, ('doi', 'digital object identifier'))} AS targets_citation_identifier,
      {d.any_in(q, L.ACKNOWLEDGEMENT_HINTS)} AS requires_acknowledgement_section, {_any_hint(d, q, L.REFERENCE_HINTS)} AS requires_reference_section,
      {T.any_exact_phrase(d, q, FULL_NAME)} AS asks_full_name, {T.any_exact_phrase(d, q, ('last name', 'surname'))} AS names_surname, {T.exact_phrase(d, q, 'title')} AS asks_title,
      ({T.any_exact_phrase(d, q, COUNT_PHRASES)} OR {d.matches(q, r"\bwhat(?:'s| is)?[ ]+(?:the[ ]+)?number of\b")}) AS targets_count,
      {T.any_exact_phrase(d, q, YEAR_PHRASES)} AS asks_year, {person_target(d, q)} AS person_target, {T.any_exact_phrase(d, q, INSTITUTION_PHRASES)} AS asks_institution,
      {T.any_exact_phrase(d, q, NAME_PHRASES)} AS asks_name, {_any_hint(d, q, PAPER_PHRASES)} AS paper_phrase,
      {d.size(d.extract_all(q, r'\barticles?\b'))} AS n_articles, {d.count_in(q, RELATION_PHRASES)} AS n_relations FROM i1"""
    c = f"""SELECT *, (targets_citation_identifier OR paper_signals >= 2 OR paper_phrase) AS explicit_paper, (person_target AND NOT asks_year) AS targets_person,
      (names_surname AND NOT asks_full_name) AS asks_last_name FROM i2"""
    e = f"""SELECT *, (is_event_query AND NOT explicit_paper AND NOT explicit_thesis) AS prefers_event_sources,
      (is_media_query OR {d.any_in(q, ENCYCLOPEDIC_WORDS)}) AS prefers_encyclopedic_sources, (is_media_query AND {d.any_in(q, L.CHARACTER_QUERY_HINTS)}) AS prefers_character_sources,
      (NOT explicit_paper AND NOT explicit_thesis AND (is_media_query OR media_signals >= 2) AND {d.any_in(q, DISCOVERY_PHRASES)}) AS needs_entity_discovery_hop,
      (targets_person AND NOT asks_full_name AND NOT asks_last_name AND NOT asks_year AND NOT explicit_thesis AND NOT explicit_paper AND NOT targets_citation_identifier
        AND NOT requires_acknowledgement_section AND NOT requires_reference_section AND (n_articles >= 2 OR (n_constraints >= 3 AND {_any_hint(d, q, IDENTITY_WORDS)}))) AS needs_person_identity_hop,
      ((asks_name OR targets_person OR {d.contains(q, 'who')}) AND targets_count) AS targets_compound_answer,
      (asks_year AND NOT academic AND (n_constraints >= 2 OR n_relations >= 2 OR ({d.any_in(q, MEMORIAL_WORDS)} AND {d.any_in(q, STRUCTURE_PHRASES)}))) AS historical_year,
      (explicit_thesis OR requires_acknowledgement_section OR (repository_signals >= 2 AND paper_signals <= repository_signals + 1)) AS prefers_repository_sources,
      (targets_citation_identifier OR requires_reference_section OR (explicit_paper AND paper_signals >= greatest(2, repository_signals))) AS prefers_paper_sources,
      (requires_reference_section OR {d.any_in(q, ('cited', 'reference'))}) AS needs_reference_hop, ({d.any_in(q, L.CAREER_HINTS)} AND {d.any_in(q, CAREER_MOVES)}) AS needs_career_hop FROM i3"""
    f = f"""SELECT *, (prefers_event_sources AND {d.any_in(q, EVENT_HOP_PHRASES)}) AS needs_event_discovery_hop, (prefers_repository_sources OR explicit_thesis OR {d.contains(q, 'pdf')}) AS prefers_pdf_sources FROM i4"""
    g = f"""SELECT *, (needs_person_identity_hop OR (NOT academic AND (needs_entity_discovery_hop OR needs_event_discovery_hop OR targets_compound_answer OR historical_year
      OR (is_media_query AND {d.any_in(q, ('between', 'first chapter', 'released'))})
      OR (prefers_event_sources AND (n_relations >= 3 OR n_constraints >= 2 OR (targets_person AND {d.any_in(q, ('winner', 'won', 'pageant', 'contest'))})))))) AS is_open_domain_browsecomp,
      CASE WHEN targets_citation_identifier THEN 'doi' WHEN asks_year THEN 'year' WHEN targets_compound_answer THEN 'entity_and_count' WHEN asks_last_name THEN 'person_last_name'
        WHEN asks_full_name OR (targets_person AND NOT targets_count) THEN 'person_name' WHEN targets_count THEN 'count' WHEN asks_name OR (is_media_query AND targets_person) THEN 'entity_name'
        WHEN asks_title THEN 'title' WHEN asks_institution THEN 'institution' ELSE 'generic' END AS answer_type FROM i5"""
    return f"(WITH i1 AS ({a}), i2 AS ({b}), i3 AS ({c}), i4 AS ({e}), i5 AS ({f}) {g})"


FLAGS = (
    "explicit_thesis", "explicit_paper", "prefers_repository_sources", "prefers_paper_sources", "prefers_pdf_sources", "prefers_encyclopedic_sources", "prefers_character_sources",
    "prefers_event_sources", "requires_acknowledgement_section", "requires_reference_section", "needs_career_hop", "needs_reference_hop", "needs_entity_discovery_hop",
    "needs_event_discovery_hop", "needs_person_identity_hop", "targets_person", "targets_citation_identifier", "targets_count", "targets_compound_answer", "is_media_query",
    "is_event_query", "is_open_domain_browsecomp",
)
SIGNALS = (
    ("academic", "academic"), ("thesis", "explicit_thesis"), ("paper", "explicit_paper"), ("acknowledgement", "requires_acknowledgement_section"), ("reference", "requires_reference_section"),
    ("career", "needs_career_hop"), ("doi", "targets_citation_identifier"), ("year", "asks_year"), ("person", "targets_person"), ("media", "is_media_query"), ("event", "is_event_query"),
    ("browsecomp", "is_open_domain_browsecomp"), ("count", "targets_count"),
)


def signals(d: Dialect) -> str:
    """The names of the signals that hold, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {flag} THEN '{name}' END" for name, flag in SIGNALS) + ")"


def _number(d: Dialect, x: str) -> str:
    words = " ".join(f"WHEN {d.lit(w)} THEN {n}" for w, n in L.NUMBER_WORDS.items())
    return f"coalesce({d.try_int(x)}, CASE {x} {words} END)"


def constraints(d: Dialect, relation: str) -> str:
    """relation with the figures that a question asks for: authors, sample, dates and year ranges."""
    q = "q"
    pair = lambda p, f: f"{f}({d.try_int(d.extract(q, p, 1))}, {d.try_int(d.extract(q, p, 2))})"
    both = lambda p, f: f"CASE WHEN {d.matches(q, p)} THEN {pair(p, f)} END"
    count = d.extract(q, L.AUTHOR_COUNT_PATTERN.replace("?P<count>", ""), 1)
    month, year = d.extract(q, L.MONTH_YEAR_PATTERN, 1), d.extract(q, L.MONTH_YEAR_PATTERN, 2)
    a = f"SELECT r.*, lower({T.normalize_whitespace(d, 'query')}) AS q FROM {relation} r"
    terms = d.filter(d.list(map(d.lit, L.SAMPLE_ENTITY_HINTS)), lambda t: f"contains(q, {t})", "t")
    b = f"""SELECT *, {_number(d, count)} AS author_count, {both(L.SAMPLE_RANGE_PATTERN, 'least')} AS sample_min, {both(L.SAMPLE_RANGE_PATTERN, 'greatest')} AS sample_max,
      {d.join(terms, ',')} AS sample_terms, coalesce({d.try_int(f"nullif({year}, '')")}, {d.try_int(f"nullif({d.extract(q, L.PUBLICATION_YEAR_PATTERN, 1)}, '')")}) AS publication_year, lower({month}) AS publication_month,
      {both(L.REFERENCE_RANGE_PATTERN, 'least')} AS reference_year_min, {both(L.REFERENCE_RANGE_PATTERN, 'greatest')} AS reference_year_max,
      {both(L.INSTITUTION_RANGE_PATTERN, 'least')} AS institution_year_min, {both(L.INSTITUTION_RANGE_PATTERN, 'greatest')} AS institution_year_max FROM k1"""
    return f"(WITH k1 AS ({a}) {b})"


def plans(d: Dialect, relation: str) -> str:
    """relation with the pipeline plan of each question: mode, use_decomposition, use_follow_up and limits."""
    asked = f"(SELECT n.*, {T.normalize_whitespace(d, 'query')} AS nq FROM {relation} n)"
    a = f"SELECT m.*, {T.constraint_phrases(d, 'nq')} AS phrases, {T.strip_question_prefix(d, 'nq')} AS stripped, {d.size(T.important_terms(d, 'nq'))} AS n_terms, {d.count_in('lower(nq)', L.MULTI_HOP_RELATIONSHIP_HINTS)} AS n_hops, {d.matches('nq', T.YEAR)} AS has_year FROM {intent(d, asked)} m"
    b = f"SELECT *, {d.size('phrases')} AS n_phrases, {d.size(clauses(d, 'stripped', 'phrases'))} AS n_clauses FROM g1"
    c = f"""SELECT *, CASE WHEN NOT academic AND n_terms <= {SIMPLE_TERMS} AND n_clauses <= {SIMPLE_CLAUSES} AND n_phrases <= {SIMPLE_CONSTRAINTS} AND n_hops <= 1 AND NOT has_year THEN 'simple'
      WHEN academic OR n_phrases >= 2 OR n_clauses >= 3 OR n_hops >= 3 OR (person_target AND has_year) OR n_terms >= {COMPLEX_TERMS} THEN 'multi-hop' ELSE 'decomposition' END AS mode FROM g2"""
    e = f"""SELECT *, mode <> 'simple' AS use_decomposition, mode = 'multi-hop' AS use_follow_up,
      CASE WHEN mode <> 'multi-hop' THEN {RESULTS} WHEN academic THEN {ACADEMIC_RESULTS} WHEN is_media_query OR n_terms >= {COMPLEX_TERMS} THEN {LONG_RESULTS} ELSE {RESULTS} END AS max_results_per_clue,
      CASE WHEN mode = 'simple' THEN 1 WHEN is_open_domain_browsecomp THEN 3 ELSE 2 END AS max_iterations FROM g3"""
    return f"(WITH g1 AS ({a}), g2 AS ({b}), g3 AS ({c}) {e})"
