"""Questions to ranked evidence and answers over a corpus, for a batch of questions at once.

Each hop searches the frontier's clues, remembers what is new, merges, ranks, looks for an answer and for gaps; follow-up
clues join the frontier. Questions advance together but leave one by one: when their answer is sure, when their frontier
is empty, or when their own budget is spent. What a question has found so far decides between its candidates: the one
that stands is kept unless a later one is clearly better."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import questions as Q
from tidemark.functions import similarity as S
from tidemark.functions.dialect import SPARK
from tidemark.operators import documents as O
from tidemark.operators.clues import novel
from tidemark.operators.grounding import named
from tidemark.operators.staging import kept
from tidemark.plans import clues as C
from tidemark.plans.config import EngineConfig, load_config
from tidemark.sources.search import corpus_search

# How much better another answer must be, how much worse the same one may be, and when an answer is sure.
BETTER, WORSE, SURE = 0.05, 0.02, 0.85
CANDIDATE = "struct<answer:string,evidence:string,source:string,confidence:double,score:double,hop:int>"


def frontier_batch(frontier: DataFrame, used: DataFrame, limit: int) -> DataFrame:
    """The next clues of each question that no hop has used, best first."""
    fresh = frontier.withColumn("key", F.lower(S.clean(F.col("clue")))).join(used, ["query_id", "key"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("priority"), "pos")
    once = fresh.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("priority"), "pos"))).where("nth = 1")
    return once.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= limit).select("query_id", "clue", "key")


def follow_up_clues(ranked: DataFrame, sources: int) -> DataFrame:
    """Clues for the next hop: the question's focus with the title or first words of its best documents."""
    best = ranked.where(F.col("rank") <= sources)
    head = F.array_join(F.slice(S.terms(F.coalesce(F.nullif(S.clean(F.col("title")), F.lit("")), F.left("content", F.lit(200)))), 1, 5), " ")
    focus = F.array_join(F.slice(S.terms(F.col("query")), 1, 6), " ")
    return best.select("query_id", F.col("rank").alias("pos"), F.concat_ws(" ", focus, head).alias("clue"), (1.0 - F.col("rank") / 100).alias("priority"))


def folded(candidates: Column) -> Column:
    """The answer that stands after candidates (an array of CANDIDATE) in order of hop; nothing changes a sure one."""
    same = lambda a, b: F.lower(S.clean(a["answer"])) == F.lower(S.clean(b["answer"]))

    def step(best: Column, new: Column) -> Column:
        stays = same(best, new) & ~((new["score"] >= best["score"] - WORSE) & (new["confidence"] >= best["confidence"]))
        weaker = ~same(best, new) & ~(new["score"] > best["score"] + BETTER)
        return F.when((new["answer"] == "") | ((best["answer"] != "") & ((best["confidence"] >= SURE) | stays | weaker)), best).otherwise(new)

    none = F.struct(*(F.lit("").alias(c) for c in ("answer", "evidence", "source")), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("score"), F.lit(0).alias("hop")).cast(CANDIDATE)
    return F.aggregate(candidates, none, step)


def standing(candidates: DataFrame) -> DataFrame:
    """query_id and the columns of CANDIDATE that stand after candidates (query_id, hop, answer, evidence, source, confidence, score)."""
    item = F.struct("hop", F.struct("answer", "evidence", "source", "confidence", "score", "hop").cast(CANDIDATE).alias("c"))
    ordered = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("every"))
    return ordered.select("query_id", folded(F.transform("every", lambda x: x["c"])).alias("c")).select("query_id", "c.*").where("answer <> ''")


def budgets(asked: DataFrame, config: EngineConfig) -> DataFrame:
    """query_id and budget: one hop for simple questions, the configuration's numbers for browsing questions and for others."""
    with named(asked.select(F.col("query_id").alias("id"), "query")) as q:
        plans = asked.sparkSession.sql(f"SELECT id, mode, is_open_domain_browsecomp FROM {Q.plans(SPARK, q)} g")
    return plans.select(F.col("id").alias("query_id"), F.when(F.col("mode") == "simple", 1).when(F.col("is_open_domain_browsecomp"), config.browse_max_iterations).otherwise(config.max_iterations).alias("budget"))


def extracted_answers(ranked: DataFrame) -> DataFrame:
    """query_id, answer, evidence, source, confidence and score of each question's best candidate, from ranked rows."""
    from tidemark.operators.answers import extracted

    rows = ranked.select(F.concat_ws(":", "query_id", "doc_key").alias("id"), "query_id", "query", F.col("rank").alias("place"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "rank_score", "retrieval_score")
    return extracted(rows).select("query_id", "answer", "evidence", F.col("id").alias("source"), "confidence", F.col("confidence").alias("score"))


def converged(questions: DataFrame, corpus: DataFrame, config: EngineConfig | None = None, per_clue: int = 5, extract: Callable[[DataFrame], DataFrame] | None = extracted_answers) -> tuple[DataFrame, DataFrame]:
    """The ranked documents of questions (query_id, query) from corpus (doc_key, url, title, text), and how each question ended.

    The second has query_id, hops, reason (sure, frontier, budget) and the answer that stands, null if there is none. extract
    makes a hop's candidates of the best ranked documents of the questions that still go on; without it none is looked for."""
    config = config or load_config()
    asked = kept(questions.select("query_id", "query").distinct())
    active = kept(budgets(asked, config))
    frontier = kept(C.question_clues(asked.select(F.col("query_id").alias("id"), "query")).select(F.col("id").alias("query_id"), F.col("pos").cast("long").alias("pos"), "clue", (1.0 - F.col("pos") / 100).alias("priority")))
    used = asked.select("query_id", F.lit("").alias("key")).limit(0)
    ends = asked.select("query_id", F.lit(0).alias("hops"), F.lit("").alias("reason")).limit(0)
    found = candidates = None
    hop = 0
    full = lambda rows: rows.join(corpus, "doc_key").join(asked, "query_id").withColumn("content", F.col("text")).withColumn("pos", F.col("doc_key"))
    left = lambda rows, reason: rows.select("query_id", F.lit(hop).alias("hops"), F.lit(reason).alias("reason"))
    while not active.isEmpty():
        batch = kept(frontier_batch(frontier.join(active, "query_id", "left_semi"), used, config.search_tasks))
        ends = kept(ends.union(left(active.join(batch, "query_id", "left_anti"), "frontier")))
        active = kept(active.join(batch, "query_id", "left_semi"))
        if active.isEmpty():
            break
        hop += 1
        used = kept(used.union(batch.select("query_id", "key")))
        rows = corpus_search(batch, corpus, per_clue).groupBy("query_id", "doc_key").agg(F.max("retrieval_score").alias("retrieval_score"), F.array_sort(F.collect_set("clue")).alias("matched_clues"))
        if found is not None:
            rows = found.unionByName(rows).groupBy("query_id", "doc_key").agg(F.max("retrieval_score").alias("retrieval_score"), F.array_distinct(F.flatten(F.collect_list("matched_clues"))).alias("matched_clues"))
        found = kept(rows)
        best = kept(O.ranked(full(found.join(active, "query_id", "left_semi"))).where(F.col("rank") <= max(config.answer_documents, config.follow_up_source_docs)))
        done = active.limit(0).select("query_id")
        if extract is not None:
            new = extract(best.where(F.col("rank") <= config.answer_documents)).select("query_id", F.lit(hop).alias("hop"), "answer", "evidence", "source", "confidence", "score")
            candidates = kept(new if candidates is None else candidates.unionByName(new))
            done = kept(standing(candidates).where(F.col("confidence") >= SURE).join(active, "query_id", "left_semi").select("query_id"))
        going = active.join(done, "query_id", "left_anti")
        ends = kept(ends.union(left(done, "sure")).union(left(going.where(F.col("budget") <= hop), "budget")))
        active = kept(going.where(F.col("budget") > hop))
        more = follow_up_clues(best.join(active, "query_id", "left_semi"), config.follow_up_source_docs)
        frontier = kept(frontier.unionByName(novel(more, frontier).select(frontier.columns)))
    none = asked.select("query_id", *(F.lit(None).cast(k).alias(c) for c, k in (("answer", "string"), ("evidence", "string"), ("source", "string"), ("confidence", "double"))))
    answers = none.limit(0) if candidates is None else standing(candidates).select("query_id", "answer", "evidence", "source", "confidence")
    if found is None:
        found = asked.select("query_id", F.lit(0.0).alias("retrieval_score"), F.array(F.lit("")).alias("matched_clues")).limit(0).crossJoin(corpus.select("doc_key").limit(0))
    return O.ranked(full(found)), ends.join(answers, "query_id", "left")


def research(questions: DataFrame, corpus: DataFrame, config: EngineConfig | None = None, per_clue: int = 5) -> DataFrame:
    """Evidence of questions (query_id, query) from corpus (doc_key, url, title, text): query_id, rank, doc_key, snippet, score."""
    config = config or load_config()
    ranked, _ = converged(questions, corpus, config, per_clue, None)
    best = kept(ranked.where(F.col("rank") <= config.top_sources))
    return O.evidence(best).join(best.select("query_id", "pos", "rank", "doc_key"), ["query_id", "pos"]).select("query_id", "rank", "doc_key", "snippet", "score")
