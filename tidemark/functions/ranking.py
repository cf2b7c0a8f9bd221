"""What a document is worth to a question before any text is compared: its prior, and a score for each kind of evidence.

Both are sums of rules (asked, seen, weight): `weight` counts where the question's intent `asked` holds and the document
shows `seen`; a rule whose `seen` is a number counts in proportion to it. The rules are rows of tables below.

Pages are judged by one opening of their text (`PAGE_CHARS`) for all rules. Questions for the year of a memorial have
further rules, which aren't built."""

from __future__ import annotations

from . import answers as A
from . import lexicons as L
from . import pages as P
from . import questions as Q
from . import text as T
from .dialect import Dialect

# Phrases of single marks, and the text that each group of marks is looked for in.
DOWNLOADS = ("download", "bitstream", "bitstreams", "viewcontent")
PRIOR_CHARS, SIGNAL_CHARS, PAGE_CHARS = 5000, 4000, 2500
PLACES = (" uk ", " united kingdom ", "ac.uk")
PHRASES = {
    "repository": L.ACADEMIC_REPOSITORY_HINTS,
    "thesis": L.THESIS_CONTENT_HINTS,
    "thanks": L.ACKNOWLEDGEMENT_HINTS,
    "cites": L.REFERENCE_HINTS,
    "career": L.CAREER_HINTS,
    "person_word": L.PERSON_CONTEXT_HINTS,
    "winner": L.EVENT_WINNER_HINTS,
    "character": L.CHARACTER_QUERY_HINTS,
    "ability": L.ABILITY_QUERY_HINTS,
    "media": L.MEDIA_QUERY_HINTS,
    "unrelated": L.NON_RESEARCH_PAGE_HINTS,
    "british": PLACES,
}
PRIOR_PHRASES = {"wiki_words": ("wiki", "fandom", "characters", "plot"), "roles": ("companion", "villain", "rival", "antagonist")}
SIGNAL_PHRASES = {"wiki_words": ("wiki", "fandom", "characters", "plot", "story"), "roles": ("companion", "rival", "villain", "hero"), "lists": ("list of", "abilities", "moves", "effects")}

# Fixed values: (asked, seen, weight); an empty `asked` holds for every question.
OPEN_PAGES = (("broad_overview", -0.28), ("listing_300", -0.32), ("meta_300", -0.35), ("non_english_wiki", -0.3), ("media_topic_600", -0.35), ("forum_300", -0.28))
PRIOR = (
    ("prefers_repository_sources", "download", 0.2), ("prefers_repository_sources", "p_repository", 0.15), ("prefers_repository_sources", "p_thesis", 0.3),
    ("requires_acknowledgement_section", "has_thanks OR p_thanks", 0.2),
    ("prefers_paper_sources", "has_doi", 0.25), ("prefers_paper_sources", "front_paper", 0.2), ("prefers_paper_sources", "has_references OR p_cites", 0.1),
    ("prefers_paper_sources AND NOT explicit_thesis", "p_thesis", -0.35), ("prefers_paper_sources", "constraint_score", 0.35), ("prefers_paper_sources", "least(3, n_contradicted)", -0.1),
    ("needs_career_hop", "p_career", 0.1), ("", "same_year", 0.05), ("", "p_unrelated", -0.25),
    ("NOT academic AND prefers_encyclopedic_sources", "url_wiki", 0.25), ("NOT academic AND prefers_encyclopedic_sources", "p_wiki_words", 0.15),
    ("NOT academic AND prefers_character_sources", "p_character", 0.25), ("NOT academic AND prefers_character_sources", "p_roles", 0.1),
    ("NOT academic AND targets_count", "p_ability", 0.2), ("NOT academic AND targets_count", "p_number", 0.05),
    ("NOT academic AND prefers_event_sources", "event_score", 0.28), ("NOT academic AND prefers_event_sources", "winner_score", 0.28), ("NOT academic AND prefers_event_sources", "p_winner", 0.18),
    ("NOT academic AND prefers_event_sources", "named", 0.08), ("NOT academic AND prefers_event_sources", "named AND p_winner", 0.12),
    ("NOT academic AND prefers_event_sources", "winner_score < 0.24 AND event_score < 0.3", -0.25), ("NOT academic AND prefers_event_sources", "vague", -0.28), ("NOT academic AND prefers_event_sources", "gossip", -0.28),
    ("NOT academic AND is_media_query", "p_media", 0.1),
    ("is_open_domain_browsecomp", "specificity", 0.3), ("is_open_domain_browsecomp", "media_score", 0.28), *(("is_open_domain_browsecomp", seen, weight) for seen, weight in OPEN_PAGES),
    ("is_open_domain_browsecomp AND is_media_query", "media_score < 0.18", -0.35), ("is_open_domain_browsecomp", "grounded", 0.24), ("is_open_domain_browsecomp", "NOT grounded", -0.28),
)


def _topic(overview: float, listing: float, meta: float, foreign: float, topic: float, forum: float, grounded: float, adrift: float) -> tuple:
    """The rules on kinds of pages that the signals share, by their weights."""
    kinds = (("broad_overview", overview), ("listing_300", listing), ("meta_300", meta), ("non_english_wiki", foreign), ("media_topic_600", topic), ("forum_300", forum))
    return (*(("", seen, weight) for seen, weight in kinds), ("is_open_domain_browsecomp", "grounded", grounded), ("is_open_domain_browsecomp", "NOT grounded", adrift))


SIGNALS = {
    "repository": (("", "download", 0.35), ("", "s_repository", 0.3), ("", "s_thesis", 0.35)),
    "acknowledgement": (("", "has_thanks", 0.55), ("", "s_thanks", 0.25), ("", "named_2500", 0.1), ("asks_surname", "true", 0.1)),
    "career": (("", "s_career", 0.7), ("asks_uk", "s_british", 0.2), ("", "s_person_word", 0.1)),
    "paper": (
        ("", "has_doi", 0.35), ("", "front_paper", 0.35), ("", "front_abstract", 0.1), ("", "s_cites", 0.1), ("", "constraint_score", 0.25), ("", "least(2.5, n_contradicted)", -0.08),
        ("NOT explicit_thesis", "s_thesis", -0.25),
    ),
    "doi-bearing": (("", "url_doi", 0.6), ("", "has_doi", 0.4), ("", "constraint_score", 0.2), ("", "least(2.5, n_contradicted)", -0.08)),
    "reference": (("", "has_references", 0.6), ("", "s_cites", 0.25), ("", "text_doi", 0.15)),
    "name-bearing": (
        ("", "named", 0.6), ("", "s_thanks", 0.2), ("", "s_career", 0.1), ("prefers_event_sources", "event_score", 0.25), ("prefers_event_sources", "winner_score", 0.25),
        ("prefers_event_sources", "s_winner", 0.18), ("prefers_event_sources", "winner_score < 0.38 AND event_score < 0.3", -0.22), ("prefers_event_sources", "vague", -0.25),
        ("prefers_event_sources", "gossip", -0.2), ("asks_surname", "true", 0.1),
    ),
    "event": (
        ("", "event_score", 0.6), ("", "winner_score", 0.28), ("", "s_winner", 0.2), ("", "named", 0.12), ("", "event_score >= 0.28", 0.1), ("", "winner_score < 0.24 AND event_score < 0.3", -0.28),
        ("", "vague", -0.3), ("", "gossip", -0.25), ("", "broad_overview", -0.12), ("", "listing_300", -0.15), ("", "meta_300", -0.2), ("", "non_english_wiki", -0.2), ("", "forum_300", -0.18),
    ),
    "encyclopedic": (
        ("", "url_wiki", 0.45), ("", "s_wiki_words", 0.25), ("is_media_query", "lexical", 0.15), ("is_media_query", "specificity", 0.2), ("is_media_query", "media_score", 0.22),
        ("is_media_query", "media_score < 0.18", -0.28), *_topic(-0.18, -0.2, -0.3, -0.28, -0.3, -0.2, 0.18, -0.22),
    ),
    "character": (
        ("", "s_character", 0.45), ("", "s_roles", 0.2), ("", "named", 0.1), ("", "url_wiki", 0.1), ("", "specificity", 0.18), ("", "media_score", 0.18),
        ("is_media_query", "media_score < 0.18", -0.26), *_topic(-0.16, -0.18, -0.28, -0.26, -0.28, -0.2, 0.2, -0.24),
    ),
    "count": (
        ("", "s_ability", 0.45), ("", "s_number", 0.15), ("", "s_lists", 0.15), ("", "specificity", 0.15), ("", "media_score", 0.15),
        ("is_media_query", "media_score < 0.18", -0.24), *_topic(-0.12, -0.15, -0.22, -0.2, -0.24, -0.18, 0.18, -0.22),
    ),
}
#: The kinds of evidence that a question wants, by its intent, in the order in which documents are chosen for them.
WANTED = (
    ("prefers_repository_sources", "repository"), ("prefers_paper_sources", "paper"), ("targets_citation_identifier", "doi-bearing"), ("requires_reference_section", "reference"),
    ("requires_acknowledgement_section", "acknowledgement"), ("needs_career_hop", "career"), ("prefers_event_sources", "event"), ("targets_person", "name-bearing"),
    ("prefers_encyclopedic_sources", "encyclopedic"), ("prefers_character_sources", "character"), ("targets_count", "count"),
)
#: What of `seen` is a number; all else is a condition.
NUMBERS = ("constraint_score", "least(3, n_contradicted)", "least(2.5, n_contradicted)", "event_score", "winner_score", "media_score", "specificity", "lexical")


def _sum(rules: tuple) -> str:
    def term(asked: str, seen: str, weight: float) -> str:
        if seen in NUMBERS:
            return f"CASE WHEN {asked or 'true'} THEN {weight}e0 * ({seen}) ELSE 0e0 END"
        return f"CASE WHEN ({asked or 'true'}) AND ({seen}) THEN {weight}e0 ELSE 0e0 END"

    return " + ".join(term(*rule) for rule in rules)


def marked(d: Dialect, relation: str) -> str:
    """relation (id, query_id, query, url, title, text, acknowledgements, reference_text, lexical, constraint_score,
    n_contradicted, grounded) with the question's intent and every mark that the rules look at."""
    asked = f"(SELECT DISTINCT query_id AS id, query FROM {relation} q)"
    wants = ", ".join(dict.fromkeys(("academic", *Q.FLAGS)))
    a = f"SELECT id AS asked_id, {wants}, {T.specific_terms(d, 'query')} AS terms, {T.years(d, 'query')} AS asked_years, {d.any_in('lower(query)', ('last name', 'surname'))} AS asks_surname, {d.contains('lower(query)', 'uk')} AS asks_uk FROM {Q.intent(d, asked)} i"
    cut = f"(SELECT id, url, title, left(text, {PAGE_CHARS}) AS text FROM {relation} p)"
    kept = "id, broad_overview, listing_300, forum_300, meta_300, non_english_wiki, media_topic_600, event_score, media_score"
    b = f"SELECT {kept}, {d.any_in(P.combined(d, 500), L.LOW_TRUST_SOCIAL_SOURCE_HINTS)} AS social FROM {P.features(d, cut)} f"
    said = T.normalize_whitespace(d, f"concat(title, '. ', left(text, {PAGE_CHARS}))")
    c = A.winner_evidence(d, f"(SELECT id, {said} AS text FROM {relation} s)")
    shown = lambda most: f"lower({T.normalize_whitespace(d, f'concat(title, {d.lit(' ')}, left(text, {most}), {d.lit(' ')}, url)')})"
    e = f"""SELECT r.*, lower(url) AS low_url, {shown(PRIOR_CHARS)} AS prior_text, {shown(SIGNAL_CHARS)} AS signal_text, lower({T.normalize_whitespace(d, f"concat(title, ' ', left(text, 3000))")}) AS front,
      lower({T.normalize_whitespace(d, f"concat(title, ' ', left(text, {PAGE_CHARS}))")}) AS near, {d.size(T.person_names(d, 'left(text, 3000)'))} > 0 AS named, {d.size(T.person_names(d, f'left(text, {PAGE_CHARS})'))} > 0 AS named_2500,
      {T.contains_primary_doi(d, 'url', 'title', 'text')} AS has_doi, {d.matches('left(text, 3000)', L.DOI_PATTERN)} AS text_doi FROM {relation} r"""
    marks = {f"{k}_{name}": d.any_in(text, hints) for k, text, more in (("p", "prior_text", PRIOR_PHRASES), ("s", "signal_text", SIGNAL_PHRASES)) for name, hints in (PHRASES | more).items()}
    marks |= {f"{k}_number": d.matches(text, r"\b\d+\b") for k, text in (("p", "prior_text"), ("s", "signal_text"))}
    marks |= {
        "download": f"({d.ends('low_url', '.pdf')} OR {d.any_in('low_url', DOWNLOADS)})",
        "url_wiki": d.any_in("low_url", L.ENCYCLOPEDIC_SOURCE_HINTS),
        "url_doi": d.contains("low_url", "doi.org/"),
        "front_paper": d.any_in("front", L.PAPER_CONTENT_HINTS),
        "front_abstract": d.contains("front", "abstract"),
        "has_thanks": "acknowledgements <> ''",
        "has_references": "reference_text <> ''",
    }
    f = f"SELECT t.*, {', '.join(f'{sql} AS {name}' for name, sql in marks.items())}, {T.important_terms(d, 'near')} AS own, {T.years(d, 'prior_text')} AS own_years FROM r4 t"
    g = f"SELECT r5.*, r1.*, r2.broad_overview, r2.listing_300, r2.forum_300, r2.meta_300, r2.non_english_wiki, r2.media_topic_600, r2.event_score, r2.media_score, r2.social, r3.winner_score FROM r5 JOIN r1 ON r1.asked_id = r5.query_id JOIN r2 ON r2.id = r5.id JOIN r3 ON r3.id = r5.id"
    h = f"SELECT *, CAST({T.specificity_overlap(d, 'terms', 'own', 'near')} AS DOUBLE) AS specificity, {T.share_an_item(d, 'asked_years', 'own_years')} AS same_year FROM r6"
    last = "SELECT *, (is_open_domain_browsecomp AND specificity < 0.1 AND event_score < 0.5) AS vague, (social AND event_score < 0.55) AS gossip FROM r7"
    return f"(WITH r1 AS ({a}), r2 AS ({b}), r3 AS (SELECT * FROM {c} w), r4 AS ({e}), r5 AS ({f}), r6 AS ({g}), r7 AS ({h}) {last})"


def scores(d: Dialect, relation: str) -> str:
    """query_id, id, prior (0 to 1) and a column for each signal: zero where the question doesn't want that evidence."""
    def signal(name: str) -> str:
        floor = f"greatest(0e0, {_sum(SIGNALS[name])})" if name == "paper" else _sum(SIGNALS[name])
        wanted = next(flag for flag, k in WANTED if k == name)
        return f"CASE WHEN {wanted} THEN {floor} ELSE 0e0 END AS {name.replace('-', '_')}"

    return f"(SELECT query_id, id, greatest(0e0, least(1e0, {_sum(PRIOR)})) AS prior, {', '.join(signal(name) for _, name in WANTED)} FROM {marked(d, relation)} m)"
