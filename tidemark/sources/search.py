"""Search providers: one interface, projections of their answers to hits, errors, and the fallback cascade.

Providers are injected callables, so nothing here opens a connection by itself; the offline provider searches a corpus."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import similarity as S
from tidemark.operators.staging import kept

# Where providers keep hits and their parts, and what a used-up quota looks like.
LAYOUTS = {
    "tavily": ("results", "title", "url", "content", "raw_content", "published_date"),
    "serper": ("organic", "title", "link", "snippet", "", "date"),
    "serpapi": ("organic_results", "title", "link", "snippet", "", "date"),
    "google_custom_search": ("items", "title", "link", "snippet", "", ""),
    "duckduckgo": ("results", "title", "href", "body", "", ""),
}
QUOTA_STATUS = (402, 429)
QUOTA_PHRASES = ("usage limit", "plan's set usage limit", "quota", "credit", "credits", "rate limit", "payment required", "insufficient balance", "exceeded your plan")


class SearchError(Exception):
    """A provider's failure, with its status and detail."""

    def __init__(self, provider: str, detail: str, status_code: int = 502):
        super().__init__(detail)
        self.provider, self.detail, self.status_code = provider, detail, status_code

    @property
    def quota(self) -> bool:
        return self.status_code in QUOTA_STATUS or any(p in self.detail.lower() for p in QUOTA_PHRASES)


def error_detail(body: str) -> str:
    """The message inside an error answer: detail.error, detail, error, or the body itself."""
    try:
        data = json.loads(body)
    except ValueError:
        return body
    if not isinstance(data, dict):
        return body
    detail = data.get("detail")
    if isinstance(detail, dict):
        return str(detail.get("error") or detail)
    return str(detail or data.get("error") or body)


def quota_issue(status: Column, detail: Column) -> Column:
    """The same rule over a table of calls."""
    said = F.lower(F.coalesce(detail, F.lit("")))
    out = status.isin(*QUOTA_STATUS)
    for phrase in QUOTA_PHRASES:
        out = out | said.contains(phrase)
    return F.coalesce(out, F.lit(False))


def rank_to_score(index: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.bround(F.greatest(F.lit(0.1), 1 - index / (total + 1)), 4))


def hits_of(answers: DataFrame, provider: str) -> DataFrame:
    """Hits of answers (query_id, clue, branch, body JSON) of a provider; rows without a link are dropped."""
    top, *names = LAYOUTS[provider]
    cell = lambda name: F.coalesce(F.get_json_object("item", f"$.{name}"), F.lit("")) if name else F.lit("")
    items = answers.select("query_id", "clue", "branch", F.posexplode(F.from_json(F.get_json_object("body", f"$.{top}"), "array<string>")).alias("idx", "item"))
    rows = items.select("query_id", "clue", "branch", "idx", *(cell(n).alias(a) for n, a in zip(names, ("title", "url", "snippet", "raw_content", "published_date"))), F.get_json_object("item", "$.score").cast("double").alias("score")).where("url <> ''")
    w = Window.partitionBy("query_id", "clue")
    ranked = rows.withColumn("idx", F.row_number().over(w.orderBy("idx")) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    score = rank_to_score(F.col("idx"), F.col("total"))
    return ranked.select("query_id", "clue", "branch", "idx", "title", "url", "snippet", "raw_content", "published_date", F.coalesce("score", score).alias("retrieval_score") if provider == "tavily" else score.alias("retrieval_score"), F.lit(provider).alias("provider"))


@dataclass
class Report:
    attempted: list[str] = field(default_factory=list)
    used: list[str] = field(default_factory=list)
    quota_exhausted: list[str] = field(default_factory=list)
    failures: list[str] = field(default_factory=list)
    retried_clues: int = 0
    remaining_clues: int = 0


class Cooldowns:
    """Providers that rest until a time, and why; the clock is injected."""

    def __init__(self, clock: Callable[[], float]):
        self.clock, self.until, self.reasons, self.cursor = clock, {}, {}, 0

    def mark(self, provider: str, seconds: float, reason: str) -> None:
        self.until[provider], self.reasons[provider] = self.clock() + seconds, reason

    def resting(self, provider: str) -> bool:
        if self.until.get(provider, 0.0) > self.clock():
            return True
        self.until.pop(provider, None)
        self.reasons.pop(provider, None)
        return False

    def rotated(self, providers: list[str]) -> list[str]:
        if not providers:
            return []
        k = self.cursor % len(providers)
        self.cursor += 1
        return providers[k:] + providers[:k]


def search_cascade(clues: Iterable[str], providers: dict[str, Callable[[str], list]], cooldowns: Cooldowns, strategy: str = "fallback", quota_seconds: int = 3600, failure_seconds: int = 300) -> tuple[list, Report]:
    """All hits of the clues: each provider gets the clues whose search failed before; an empty answer isn't a failure."""
    left, hits, report, first = list(clues), [], Report(), None
    names = [p for p in providers if not cooldowns.resting(p)]
    if not names:
        raise SearchError("search_pool", "all providers are resting", 503)
    for name in cooldowns.rotated(names) if strategy == "round_robin" else names:
        if not left:
            break
        report.attempted.append(name)
        again, got, failed, quota = [], False, False, False
        for clue in left:
            try:
                found = providers[name](clue)
            except Exception as error:
                failed, first = True, first or error
                quota = quota or (isinstance(error, SearchError) and error.quota)
                again += [clue] if isinstance(error, (SearchError, OSError, RuntimeError, ImportError)) else []
                continue
            got = got or bool(found)
            hits += found
        report.used += [name] if got else []
        if quota:
            report.quota_exhausted.append(name)
            cooldowns.mark(name, quota_seconds, "quota_exhausted")
        elif failed and not got:
            report.failures.append(name)
            cooldowns.mark(name, failure_seconds, "provider_failure")
        report.retried_clues += len(again)
        left = again
    report.remaining_clues = len(left)
    if hits or not (left or first):
        return hits, report
    if left:
        raise SearchError("search_pool", f"all providers failed: {', '.join(report.attempted)}", 503)
    raise first if isinstance(first, SearchError) else SearchError("search_pool", str(first))


#: Clues and documents that meet in one block, about.
CLUE_BLOCK, DOCUMENT_BLOCK = 500, 5000


def _fields(column: pa.Array) -> list[pa.Array]:
    """The fields of a column of lists of structs."""
    inner = column.flatten()
    return [inner.field(k) for k in range(inner.type.num_fields)]


def corpus_search(clues: DataFrame, corpus: DataFrame, top_k: int = 5) -> DataFrame:
    """The top_k corpus documents of each clue by shared terms: an inverted index made by a join on terms.

    clues: query_id, clue; corpus: doc_key, url, title, text. Terms are distinct on both sides; weights fall with the
    number of documents that have a term. Blocks of clues meet blocks of documents, and of each meeting only a clue's best
    documents go on: a clue shares some term with most documents, so the pairs are neither rows nor shuffled."""
    asked = kept(clues.select("query_id", "clue").distinct().withColumn("number", F.monotonically_increasing_id()))
    wants = asked.select("number", F.explode(F.array_distinct(S.terms(F.lower("clue")))).alias("term"))
    words = kept(wants.select("term").distinct().withColumn("word", F.monotonically_increasing_id()))
    told = corpus.select("doc_key", F.explode(F.array_distinct(S.terms(F.lower(F.concat_ws(" ", "title", "text"))))).alias("term"))
    told = kept(told.join(words, "term").select("doc_key", "word"))
    weight = told.groupBy("word").agg((1 / F.log1p(F.count(F.lit(1)).cast("double"))).alias("weight"))
    blocks, c_blocks = max(1, -(-corpus.count() // DOCUMENT_BLOCK)), max(1, -(-asked.count() // CLUE_BLOCK))
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    left = wants.join(words, "term").join(weight, "word").groupBy(block("number", c_blocks).alias("of")).agg(F.collect_list(F.struct("number", "word", "weight")).alias("asked"))
    right = told.where("doc_key IS NOT NULL").groupBy(block("doc_key", blocks).alias("at")).agg(F.collect_list(F.struct("doc_key", "word")).alias("held"))
    left, right = kept(left.repartitionByRange(min(c_blocks, 100), "of")), kept(right.repartitionByRange(min(blocks, 200), "at"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                number, word, weight = (x.to_numpy() for x in _fields(b.column("asked").slice(k, 1)))
                keys, held = _fields(b.column("held").slice(k, 1))
                named, held = pc.dictionary_encode(keys), held.to_numpy()
                names, of = named.dictionary, named.indices.to_numpy()
                by_name = np.empty(len(names), np.int64)
                by_name[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                order = np.argsort(held, kind="stable")
                held, of = held[order], of[order]
                order = np.lexsort((word, number))
                number, word, weight = number[order], word[order], weight[order]
                first, last = np.searchsorted(held, word), np.searchsorted(held, word, "right")
                own, start = np.unique(number, return_index=True)
                found: list[tuple[int, np.ndarray, np.ndarray]] = []
                for c, x, y in zip(own.tolist(), start, [*start[1:], len(number)]):
                    at = np.concatenate([of[i:j] for i, j in zip(first[x:y], last[x:y])])
                    score = np.bincount(at, np.repeat(weight[x:y], (last - first)[x:y]), minlength=len(names))
                    least = np.partition(score, -top_k)[-top_k] if len(score) > top_k else 0.0
                    best = np.flatnonzero((score > 0) & (score >= least))
                    best = best[np.lexsort((by_name[best], -score[best]))][:top_k]
                    found.append((c, best, score[best]))
                if found:
                    size = [len(best) for _, best, _ in found]
                    picks = pa.array(np.concatenate([best for _, best, _ in found]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([c for c, _, _ in found], size)), names.take(picks), pa.array(np.concatenate([score for _, _, score in found]))], ["number", "doc_key", "score"])

    kind = corpus.schema["doc_key"].dataType.simpleString()
    best = left.crossJoin(right).mapInArrow(kernel, f"number long, doc_key {kind}, score double")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "doc_key")
    best = best.withColumn("idx", F.row_number().over(order) - 1).where(F.col("idx") < top_k)
    total = F.count(F.lit(1)).over(Window.partitionBy("number"))
    best = best.withColumn("retrieval_score", rank_to_score(F.col("idx"), total)).join(asked, "number")
    return best.join(corpus, "doc_key").select("query_id", "clue", "idx", "doc_key", "url", "title", "text", "retrieval_score")
