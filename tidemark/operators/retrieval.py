"""Joins, merges, queues and evaluation of the retrieval engine as SQL over both dialects."""

from __future__ import annotations

from tidemark.functions import text as T
from tidemark.functions.dialect import Dialect


def first_by_key(d: Dialect, relation: str, key: str, order: str = "pos", within: str = "query_id") -> str:
    """The first row of every non-empty key: what a memory of seen queries, tasks, hits and URLs admits."""
    return f"(SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY {within}, k ORDER BY {order}) AS nth FROM (SELECT *, {key} AS k FROM {relation}) h WHERE k <> '') n WHERE nth = 1)"


def url_key(d: Dialect, url: str = "url") -> str:
    return f"coalesce(nullif({T.canonicalize_url(d, url)}, ''), {url})"


def merged_documents(d: Dialect, relation: str) -> str:
    """One document for each query and canonical URL: clues united in order, the highest score, the longest content (the first of equals), the first title that isn't blank."""
    key = f"coalesce(nullif({url_key(d)}, ''), title)"
    if d.spark:
        clues = "array_join(array_distinct(transform(array_sort(collect_list(struct(pos, clue))), s -> s.clue)), '|')"
        longest = "max_by(content, struct(length(content), -pos))"
        title = "coalesce(min_by(title, pos) FILTER (WHERE title <> ''), '')"
    else:
        clues = d.join(d.distinct("list(clue ORDER BY pos)"), "|")
        longest = "arg_max(content, length(content) * 10000000000 - pos)"
        title = "coalesce(arg_min(title, pos) FILTER (WHERE title <> ''), '')"
    return f"SELECT query_id, k AS doc_key, min(pos) AS first_pos, {clues} AS matched_clues, max(retrieval_score) AS retrieval_score, {longest} AS content, {title} AS title, count(*) AS n_hits FROM (SELECT *, {key} AS k FROM {relation}) h WHERE k <> '' GROUP BY query_id, k"


def normalized_scores(d: Dialect, relation: str, score: str = "retrieval_score") -> str:
    """Min-max over the candidates of a query; where all are alike, their value clipped to 0..1."""
    w = "OVER (PARTITION BY query_id)"
    return f"SELECT query_id, pos, CASE WHEN max({score}) {w} - min({score}) {w} < 1e-8 THEN greatest(0.0, least(1.0, first_value({score}) OVER (PARTITION BY query_id ORDER BY pos))) ELSE ({score} - min({score}) {w}) / (max({score}) {w} - min({score}) {w}) END AS normalized FROM {relation}"


def rank_scores(d: Dialect, relation: str) -> str:
    """The score that a provider's rank gives: 1 - index / (total + 1), at least 0.1, four decimals."""
    rows = f"SELECT *, row_number() OVER (PARTITION BY query_id, clue ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY query_id, clue) AS total FROM {relation}"
    return f"SELECT query_id, pos, clue, {T.extract_source(d, 'url')} AS source, round(greatest(CAST(0.1 AS DOUBLE), CAST(1 AS DOUBLE) - CAST(idx AS DOUBLE) / (total + 1)), 4) AS rank_score FROM ({rows}) r"


def frontier(d: Dialect, relation: str, limit: int, kind: str) -> str:
    """The next batch of tasks of a kind: highest priority first, then arrival; others stay queued."""
    return f"SELECT query_id, seq, kind, priority, CASE WHEN kind = {d.lit(kind)} AND turn <= {limit} THEN 'popped' ELSE 'queued' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY priority DESC, seq) AS turn FROM {relation}) t"


def evidence_graph(d: Dialect, mentions: str) -> str:
    """Nodes and edges of the graph of documents, entities and facts; repeated mentions are one edge."""
    nodes = f"SELECT query_id, concat('doc:', url) AS node FROM {mentions} UNION SELECT query_id, concat(kind, ':', value) FROM {mentions}"
    edges = f"SELECT DISTINCT query_id, url, kind, value FROM {mentions}"
    return f"SELECT n.query_id, n.nodes, e.edges FROM (SELECT query_id, count(*) AS nodes FROM ({nodes}) a GROUP BY query_id) n JOIN (SELECT query_id, count(*) AS edges FROM ({edges}) b GROUP BY query_id) e ON n.query_id = e.query_id"


def context_block(d: Dialect, evidence: str) -> str:
    """The numbered sources of each query as one text."""
    line = "concat('[Source ', CAST(n AS " + d.string + "), ']', {nl}, 'Title: ', title, {nl}, 'URL: ', url, {nl}, 'Snippet: ', snippet)".replace("{nl}", d.lit("\n"))
    gathered = "array_join(transform(array_sort(collect_list(struct(n, line))), s -> s.line), '\\n\\n')" if d.spark else f"string_agg(line, {d.lit(chr(10) * 2)} ORDER BY n)"
    numbered = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS n FROM {evidence} WHERE snippet <> ''"
    return f"SELECT query_id, concat({d.lit('CONTEXT SOURCES:' + chr(10) * 2)}, {gathered}) AS context FROM (SELECT query_id, n, {line} AS line FROM ({numbered}) e) l GROUP BY query_id"


# Configuration codes, and the orders of the evaluation's rows.
CONFIGURATIONS = {"C1": "LLM-only", "C2": "RAG", "C3": "TAG"}
CONFIG_ORDER = ("LLM-only", "RAG", "TAG")


def records(d: Dialect, relation: str) -> str:
    """Cleaned evaluation records: configuration codes, query types, tools, and what follows from them."""
    config = "CASE upper(trim(configuration)) " + " ".join(f"WHEN {d.lit(k)} THEN {d.lit(v)}" for k, v in CONFIGURATIONS.items()) + " ELSE coalesce(trim(configuration), 'Unknown') END"
    kind = "CASE WHEN query_type IN ('static', 'STATIC') THEN 'Static' WHEN query_type IN ('dynamic', 'DYNAMIC') THEN 'Dynamic' ELSE query_type END"
    tool = "coalesce(nullif(nullif(trim(tool_invoked), ''), '<NA>'), 'None')"
    return f"(SELECT query_id, model_name, {config} AS configuration, {kind} AS query_type, {tool} AS tool_invoked, lower(trim(query_refined)) = 'yes' AS refined, factual_accuracy, coherence_score, latency_total, num_documents, lower({tool}) <> 'none' OR coalesce(num_documents, 0) > 0 AS tool_used, coalesce(num_documents, 0) > 0 AS retrieved, CASE WHEN factual_accuracy = 0 THEN 1 ELSE 0 END AS is_error FROM {relation} WHERE model_name IS NOT NULL AND configuration IS NOT NULL AND query_type IS NOT NULL)"


def metrics(d: Dialect, relation: str) -> str:
    """All metrics of the evaluation in long form: metric, key1, key2, value; a category without records has a null."""
    r = "clean"
    orders = d.rows("o", ("configuration",), [(c,) for c in CONFIG_ORDER])
    by_config = " UNION ALL ".join(f"SELECT '{m}' AS metric, o.configuration AS key1, '' AS key2, avg({c}) AS value FROM {orders} o LEFT JOIN {r} ON {r}.configuration = o.configuration GROUP BY o.configuration" for m, c in (("overall_accuracy", "factual_accuracy"), ("overall_coherence", "coherence_score"), ("overall_latency", "latency_total")))
    mean = lambda m, k1, k2, c, where, group: f"SELECT '{m}', {k1}, {k2}, {c} FROM {r} WHERE {where} GROUP BY {group}"
    parts = [
        by_config,
        mean("query_accuracy", "query_type", "configuration", "avg(factual_accuracy)", "true", "query_type, configuration"),
        mean("error_rate", "model_name", "configuration", "100 * avg(is_error)", "true", "model_name, configuration"),
        mean("dynamic_accuracy_by_model", "model_name", "configuration", "avg(factual_accuracy)", "query_type = 'Dynamic'", "model_name, configuration"),
        mean("tag_tool_count", "tool_invoked", "''", "CAST(count(*) AS DOUBLE)", "configuration = 'TAG'", "tool_invoked"),
        f"SELECT 'tag_tool_share', tool_invoked, '', CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () FROM {r} WHERE configuration = 'TAG' GROUP BY tool_invoked",
        mean("dynamic_accuracy_by_tool", "tool_invoked", "''", "avg(factual_accuracy)", "configuration = 'TAG' AND query_type = 'Dynamic'", "tool_invoked"),
        mean("retrieval_rate", "configuration", "''", "avg(CASE WHEN retrieved THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)", "configuration IN ('RAG', 'TAG')", "configuration"),
        mean("retrieved_accuracy", "configuration", "''", "avg(factual_accuracy)", "(configuration = 'RAG' AND retrieved) OR (configuration = 'TAG' AND tool_used)", "configuration"),
        mean("refinement_accuracy", "CASE WHEN refined THEN 'Refined TAG' ELSE 'Unrefined TAG' END", "''", "avg(factual_accuracy)", "configuration = 'TAG'", "refined"),
        mean("tag_latency", "CASE WHEN tool_used THEN 'retrieval active' ELSE 'retrieval skipped' END", "''", "avg(latency_total)", "configuration = 'TAG'", "tool_used"),
        f"SELECT 'error_gap', model_name, '', 100 * (avg(CASE WHEN configuration = 'LLM-only' THEN is_error END) - avg(CASE WHEN configuration = 'TAG' THEN is_error END)) FROM {r} GROUP BY model_name",
    ]
    return f"WITH clean AS (SELECT * FROM {records(d, relation)} q) SELECT metric, key1, key2, round(CAST(value AS DOUBLE), 9) AS value FROM ({' UNION ALL '.join(parts)}) m"
