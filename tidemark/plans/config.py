"""Typed settings of the engine, read from the environment when asked for.

A setting's variable is PREFIX, an underscore and its name in capitals. A value that can't be read gives the default as
it is; read and default values are held to their bounds."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

PREFIX = "TIDEMARK"
# What counts as a truth value.
TRUTHS, FALSEHOODS = frozenset(["1", "true", "yes", "on"]), frozenset(["0", "false", "no", "off"])


def env_str(name: str, default: str = "", env: Mapping[str, str] | None = None) -> str:
    return (os.environ if env is None else env).get(name, default)


def _number(kind, name, default, minimum, maximum, env):
    raw = env_str(name, "", env)
    try:
        value = kind(raw) if raw else default
    except ValueError:
        return default
    if minimum is not None and value < minimum:
        return minimum
    return maximum if maximum is not None and value > maximum else value


def env_int(name: str, default: int, minimum: int | None = None, maximum: int | None = None, env: Mapping[str, str] | None = None) -> int:
    return _number(int, name, default, minimum, maximum, env)


def env_float(name: str, default: float, minimum: float | None = None, maximum: float | None = None, env: Mapping[str, str] | None = None) -> float:
    return _number(float, name, default, minimum, maximum, env)


def env_bool(name: str, default: bool, env: Mapping[str, str] | None = None) -> bool:
    said = env_str(name, "", env).strip().lower()
    return said in TRUTHS if said in TRUTHS | FALSEHOODS else default


def env_csv(name: str, default: Iterable[str], env: Mapping[str, str] | None = None) -> list[str]:
    raw = env_str(name, "", env)
    return [x.strip().lower() for x in (raw.split(",") if raw else default) if x and x.strip()]


def env_choice(name: str, default: str, choices: Iterable[str], env: Mapping[str, str] | None = None) -> str:
    said = env_str(name, default, env).strip().lower()
    return said if said in choices else default


@dataclass(frozen=True)
class EngineConfig:
    """All settings of planning, decomposition, ranking, follow-up, the agent's bounds, fetching, search and answers."""

    pipeline_mode: str
    max_iterations: int
    browse_max_iterations: int
    use_llm_decomposition: bool
    decomposition_max_attempts: int
    decomposition_timeout: float
    reranker_backend: str
    use_follow_up: bool
    use_llm_follow_up: bool
    follow_up_source_docs: int
    search_tasks: int
    fetch_tasks: int
    answer_documents: int
    link_candidates: int
    pivot_documents: int
    min_link_score: float
    fetch_timeout: float
    answer_timeout: float
    provider_order: tuple[str, ...]
    provider_strategy: str
    quota_cooldown: int
    failure_cooldown: int
    max_results: int = 5
    max_query_length: int = 1000
    top_sources: int = 5


def load_config(env: Mapping[str, str] | None = None, prefix: str = PREFIX) -> EngineConfig:
    v = lambda name: f"{prefix}_{name}"
    return EngineConfig(
        pipeline_mode=env_choice(v("PIPELINE_MODE"), "auto", ("auto", "simple", "decomposition", "multi-hop"), env),
        max_iterations=env_int(v("MAX_ITERATIONS"), 2, 1, 4, env),
        browse_max_iterations=env_int(v("BROWSE_MAX_ITERATIONS"), 3, 2, 5, env),
        use_llm_decomposition=env_bool(v("USE_LLM_DECOMPOSITION"), True, env),
        decomposition_max_attempts=env_int(v("DECOMPOSITION_MAX_ATTEMPTS"), 2, 1, None, env),
        decomposition_timeout=env_float(v("DECOMPOSITION_TIMEOUT_SECONDS"), 30.0, 1.0, None, env),
        reranker_backend=env_choice(v("RERANKER_BACKEND"), "auto", ("auto", "cross-encoder", "embeddings", "lexical"), env),
        use_follow_up=env_bool(v("USE_FOLLOW_UP_RETRIEVAL"), True, env),
        use_llm_follow_up=env_bool(v("USE_LLM_FOLLOW_UP"), True, env),
        follow_up_source_docs=env_int(v("FOLLOW_UP_SOURCE_DOC_COUNT"), 4, 1, 8, env),
        search_tasks=env_int(v("MAX_SEARCH_TASKS_PER_ITERATION"), 6, 1, 12, env),
        fetch_tasks=env_int(v("MAX_FETCH_TASKS_PER_ITERATION"), 8, 1, 20, env),
        answer_documents=env_int(v("MAX_ANSWER_DOCUMENTS"), 6, 1, 12, env),
        link_candidates=env_int(v("MAX_LINK_CANDIDATES"), 6, 1, 12, env),
        pivot_documents=env_int(v("MAX_PIVOT_DOCUMENTS"), 4, 1, 8, env),
        min_link_score=env_float(v("MIN_LINK_SCORE"), 0.42, 0.1, 0.95, env),
        fetch_timeout=env_float(v("FETCH_TIMEOUT_SECONDS"), 20.0, 1.0, None, env),
        answer_timeout=env_float(v("ANSWER_TIMEOUT_SECONDS"), 30.0, 1.0, None, env),
        provider_order=tuple(env_csv(v("PROVIDER_ORDER"), ("tavily", "serper", "serpapi", "google_custom_search", "duckduckgo"), env)),
        provider_strategy=env_choice(v("PROVIDER_STRATEGY"), "fallback", ("fallback", "round_robin"), env),
        quota_cooldown=env_int(v("QUOTA_COOLDOWN_SECONDS"), 3600, 60, 86_400, env),
        failure_cooldown=env_int(v("FAILURE_COOLDOWN_SECONDS"), 300, 30, 3600, env),
    )
