"""Text functions of the retrieval engine: normalisation, terms, phrases, names, URLs, identifiers.

Every function takes a dialect and SQL operands and returns SQL (see dialect.py). Strings are never null inside:
callers pass coalesced text."""

from __future__ import annotations

from . import lexicons as L
from .dialect import SPACES, Dialect

TERM = r"[A-Za-z0-9][A-Za-z0-9'-]*"
YEAR = r"\b(?:19|20)\d{2}\b"


def normalize_whitespace(d: Dialect, x: str) -> str:
    """White space runs become one blank; the ends are stripped."""
    return f"trim({d.replace_all(f"coalesce({x}, '')", f'[{SPACES}]+', ' ')})"


def normalize_heading(d: Dialect, x: str) -> str:
    return f"trim({d.replace_all(f'lower({normalize_whitespace(d, x)})', '[^a-z0-9]+', ' ')})"


def normalize_document_text(d: Dialect, x: str) -> str:
    """Lines are normalised one by one; blank ones go; carriage returns end lines."""
    lines = d.split(f"coalesce({x}, '')", r"[\r\n]")
    return d.join(d.filter(d.transform(lines, lambda v: normalize_whitespace(d, v)), lambda v: f"{v} <> ''"), "\n")


def distinct_ignoring_case(d: Dialect, a: str) -> str:
    """The first spelling of every non-blank item, in order."""
    clean = d.filter(d.transform(a, lambda v: normalize_whitespace(d, v), "u"), lambda v: f"{v} <> ''", "u")
    low = lambda c: d.transform(c, lambda w: f"lower({w})", "w")
    return d.let(clean, lambda c: d.let(low(c), lambda lows: d.filter_at(c, lambda v, i: f"{d.position(lows, f'lower({v})')} = {i}", "v", "k"), "lows"), "cleaned")


def important_terms(d: Dialect, x: str) -> str:
    return d.filter(d.extract_all(x, TERM), lambda t: f"NOT {d.is_in(f'lower({t})', L.STOPWORDS)}", "t")


def keyword_focus(d: Dialect, x: str, most: int) -> str:
    return d.join(d.head(important_terms(d, x), most), " ")


def strip_question_prefix(d: Dialect, x: str) -> str:
    """The text without the first question opening that it starts with."""
    cases = " ".join(f"WHEN {d.starts(f'lower({x})', p)} THEN {normalize_whitespace(d, f'substr({x}, {len(p) + 1})')}" for p in L.QUESTION_PREFIXES)
    return f"CASE {cases} ELSE {x} END"


def clean_fragment(d: Dialect, x: str) -> str:
    ends = d.replace_all(normalize_whitespace(d, x), "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$")
    tail = d.replace_all(ends, r"(?i)(^|[^\p{L}\p{N}_])(?:and|or|with|by|from|in|on|for|to|of|about|between|before|after)$", d.group(1))
    return normalize_whitespace(d, tail)


def constraint_phrases(d: Dialect, x: str) -> str:
    every = d.concat(*(d.extract_all(x, "(?i)" + p) for p in L.CONSTRAINT_PATTERNS))
    return distinct_ignoring_case(d, d.transform(every, lambda c: clean_fragment(d, c), "c"))


def specific_terms(d: Dialect, x: str) -> str:
    """Distinct terms of four letters or more that carry meaning, longest first, then by place."""
    kept = d.distinct(d.filter(important_terms(d, f"lower({x})"), lambda t: f"length({t}) >= 4 AND NOT {d.is_in(t, L.BROWSECOMP_LOW_SIGNAL_TERMS)}", "s"))
    if d.spark:
        return f"transform(array_sort(transform({kept}, (la, li) -> struct(-length(la) AS n, li AS i, la AS t))), la -> la.t)"
    keyed = f"list_sort(list_transform({kept}, lambda la, li: {{'n': -length(la), 'i': li, 't': la}}))"
    return f"list_transform({keyed}, lambda la: la['t'])"


def exact_phrase(d: Dialect, x: str, phrase: str) -> str:
    """Whether the normalised text x (lower case) has the phrase with no word character at either end."""
    inner = r"\s+".join("".join(c if c.isalnum() else "\\" + c for c in word) for word in phrase.lower().split())
    return d.matches(x, r"(?:^|[^\p{L}\p{N}_])" + inner + r"(?:$|[^\p{L}\p{N}_])")


def any_exact_phrase(d: Dialect, x: str, phrases) -> str:
    return "(" + " OR ".join(exact_phrase(d, x, p) for p in phrases) + ")"


def count_exact_phrases(d: Dialect, x: str, phrases) -> str:
    return "(" + " + ".join(f"CASE WHEN {exact_phrase(d, x, p)} THEN 1 ELSE 0 END" for p in phrases) + ")"


def url_host(d: Dialect, url: str) -> str:
    """The network location in lower case without a leading www. (empty if the URL names none)."""
    return d.replace_all(f"lower({d.extract(f"coalesce({url}, '')", r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)})", r"^www\.")


def url_path(d: Dialect, url: str) -> str:
    return d.extract(f"coalesce({url}, '')", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)


def canonicalize_url(d: Dialect, url: str) -> str:
    """Host and path without scheme, www., query, fragment and trailing slashes."""
    return f"concat({url_host(d, url)}, {d.rtrim(url_path(d, url), '/')})"


def extract_source(d: Dialect, url: str) -> str:
    return f"coalesce(nullif({url_host(d, url)}, ''), 'unknown')"


def doi_candidates(d: Dialect, x: str) -> str:
    return distinct_ignoring_case(d, d.transform(d.extract_all(x, L.DOI_PATTERN), lambda m: d.rtrim(m, ").,;:"), "m"))


def primary_text(d: Dialect, url: str, title: str, content: str, most: int = L.FRONT_MATTER_CHAR_LIMIT) -> str:
    return normalize_whitespace(d, f"concat_ws(' ', nullif({url}, ''), nullif({title}, ''), nullif(left({content}, {most}), ''))")


def contains_primary_doi(d: Dialect, url: str, title: str, content: str, most: int = L.FRONT_MATTER_CHAR_LIMIT) -> str:
    return d.matches(primary_text(d, url, title, content, most), L.DOI_PATTERN)


def capitalized_entities(d: Dialect, x: str) -> str:
    """Title-case runs of at most five words that aren't blocked, short or function words."""
    found = d.transform(d.extract_all(normalize_whitespace(d, x), L.TITLECASE_ENTITY_PATTERN, 1), lambda e: d.trim(e, " ,;:.!?\"'()[]{}"), "e")

    def kept(e: str) -> str:
        words = d.split(e, " ")
        single = f"({d.size(words)} > 1 OR (length({e}) >= 4 AND NOT {d.is_in(f'lower({e})', L.STOPWORDS)}))"
        stops = d.filter(words, lambda w: f"NOT {d.is_in(f'lower({w})', L.STOPWORDS)}", "w")
        return f"{e} <> '' AND NOT {d.is_in(e, L.TITLECASE_ENTITY_BLOCKLIST)} AND {d.size(words)} <= 5 AND {single} AND {d.size(stops)} > 0"

    return distinct_ignoring_case(d, d.filter(found, kept, "e"))


def plausible_person_name(d: Dialect, x: str) -> str:
    def judged(name: str, bare: str) -> str:
        count = lambda values: d.size(d.filter(bare, lambda b: d.is_in(b, values), "b"))
        n, category = d.size(d.split(name, " ")), count(L.NON_PERSON_CATEGORY_HINTS)
        empty = d.size(d.filter(bare, lambda b: f"{b} = ''", "b"))
        upper = f"({name} = upper({name}) AND {name} <> lower({name}))"
        return f"({name} <> '' AND {n} BETWEEN 2 AND 4 AND {empty} = 0 AND {count(L.STOPWORDS)} = 0 AND {count(L.ORGANIZATION_NAME_HINTS)} = 0 AND {count(L.NON_PERSON_TITLE_HINTS)} = 0 AND {category} < 2 AND NOT ({n} >= 3 AND {category} >= {n} - 1) AND NOT {upper})"

    bare = lambda name: d.transform(d.split(name, " "), lambda w: d.trim(f"lower({w})", ".,;:!?()[]{}\"'"), "w")
    return d.let(normalize_whitespace(d, x), lambda name: d.let(bare(name), lambda words: judged(name, words), "pb"), "pn")


def person_names(d: Dialect, x: str) -> str:
    """Matches of the person pattern that are plausible names."""
    return d.filter(d.transform(d.extract_all(x, L.PERSON_NAME_PATTERN, 1), lambda m: normalize_whitespace(d, m), "m"), lambda m: plausible_person_name(d, m), "m")


def candidate_names(d: Dialect, a: str) -> str:
    """Names of two to four words without function words, not all capitals; distinct."""

    def kept(m: str) -> str:
        words = d.split(normalize_whitespace(d, m), " ")
        stops = d.filter(words, lambda w: d.is_in(f"lower({w})", L.STOPWORDS), "w")
        return f"{d.size(words)} BETWEEN 2 AND 4 AND {d.size(stops)} = 0 AND NOT ({m} = upper({m}) AND {m} <> lower({m}))"

    return distinct_ignoring_case(d, d.filter(a, kept, "m"))


def author_names(d: Dialect, x: str) -> str:
    clean = normalize_whitespace(d, x)
    return candidate_names(d, d.concat(*(d.extract_all(clean, p, 1) for p in L.AUTHOR_LINE_PATTERNS)))


def institutions(d: Dialect, x: str) -> str:
    clean = normalize_whitespace(d, x)
    return distinct_ignoring_case(d, d.filter(d.concat(*(d.extract_all(clean, p, 1) for p in L.INSTITUTION_ENTITY_PATTERNS)), lambda m: f"length({m}) <= 120", "m"))


def sentences(d: Dialect, x: str) -> str:
    """Pieces that end where white space follows a full stop, exclamation or question mark."""
    marked = d.replace_all(normalize_whitespace(d, x), r"([.!?]) +", d.group(1) + "\n")
    return d.filter(d.split(marked, r"\n"), lambda s: f"{s} <> ''", "s")


def years(d: Dialect, x: str) -> str:
    return d.distinct(d.extract_all(x, YEAR))


def share_an_item(d: Dialect, a: str, b: str) -> str:
    """Whether two lists (columns) have an item in common."""
    return f"({d.size(d.filter(a, lambda y: d.has(b, y), 'sy'))} > 0)"


def specificity_overlap(d: Dialect, terms: str, own: str, clean: str) -> str:
    """The share of the query's specific terms among the text's, and a bonus for long ones.

    Operands are columns: specific terms of the query, important terms of the lowered text, the lowered clean text."""
    hits = d.size(d.filter(terms, lambda t: d.has(own, t), "sp"))
    long = d.size(d.filter(d.head(terms, 4), lambda t: f"length({t}) >= 6 AND contains({clean}, {t})", "sp"))
    return f"CASE WHEN {d.size(terms)} = 0 OR {d.size(own)} = 0 THEN 0.0 ELSE least(1.0, CAST({hits} AS DOUBLE) / {d.size(terms)} + least(0.12, 0.03 * {long})) END"


def looks_like_reference(d: Dialect, x: str) -> str:
    clean = normalize_whitespace(d, x)
    signal = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    signals = [d.any_in(f"lower({clean})", L.REFERENCE_HINTS), d.matches(clean, L.REFERENCE_STYLE_YEAR_PATTERN), d.matches(clean, L.REFERENCE_STYLE_AUTHOR_PATTERN), d.matches(clean, r"(?i)\b\d+\(\d+\)|\bpp?\.\s*\d")]
    return f"({' + '.join(map(signal, signals))} >= 2)"


def domain_reliability(d: Dialect, url: str) -> str:
    host = extract_source(d, url)
    trusted = " OR ".join(d.ends(host, s) for s in (".edu", ".gov", ".ac.uk"))
    return f"CASE WHEN {host} = 'unknown' THEN 0.1 ELSE 0.2 + CASE WHEN {trusted} THEN 0.3 ELSE 0.0 END + CASE WHEN {d.any_in(host, ('repository', 'digitalcommons', 'scholarworks'))} THEN 0.2 ELSE 0.0 END END"


def document_type(d: Dialect, url: str, title: str, snippet: str) -> str:
    every = f"lower({normalize_whitespace(d, f'concat_ws({d.lit(' ')}, {url}, {title}, {snippet})')})"
    add = lambda c, w: f"CASE WHEN {c} THEN {w} ELSE 0.0 END"
    pdf = f"({d.ends(f'lower({url})', '.pdf')} OR {d.contains(every, 'application/pdf')})"
    parts = [add(pdf, 0.4), add(d.contains(every, "doi.org/"), 0.25), add(d.any_in(every, L.ACADEMIC_REPOSITORY_HINTS), 0.2), add(d.any_in(every, L.THESIS_CONTENT_HINTS), 0.2), add(d.any_in(every, L.ACKNOWLEDGEMENT_HINTS), 0.1), add(d.any_in(every, L.PAPER_CONTENT_HINTS), 0.15)]
    return f"least(1.0, {' + '.join(parts)})"
