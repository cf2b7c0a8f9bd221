"""Query-aware PageRank over the documents of a request.

What costs is to compare texts, so every ordered pair of a request's documents is a row, dealt out whichever request it
is of; the matcher runs over batches of rows. The walk over a request's edges takes numbers alone, one kernel a request.
A request is as large as what one client sends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import similarity as S
from tidemark.functions.similarity import TextView
from tidemark.operators.staging import kept

DAMPING, ROUNDS, TOLERANCE = 0.85, 50, 1e-6
GRAPH_CHARS, TEXT_CHARS = 2500, 6000
OUT = "request_id long, pos int, id string, relevance double, pagerank double, final_score double, iterations int, rank int"


def distribution(values: np.ndarray, fallback: np.ndarray | None = None) -> np.ndarray:
    """Non-negative values scaled to sum one; the fallback, then equal shares, where they sum to nothing."""
    for v in (values, fallback):
        if v is not None and (v := np.maximum(v, 0)).sum() > 0:
            return v / v.sum()
    return np.full(len(values), 1 / max(len(values), 1))


def scaled(values: np.ndarray) -> np.ndarray:
    """Min-max; where all are alike, one if they are positive, else zero."""
    if not len(values):
        return values
    spread = values.max() - values.min()
    return (values - values.min()) / spread if spread > 1e-12 else np.full(len(values), float(values.max() > 0))


def ranks(weights: np.ndarray, teleport: np.ndarray) -> tuple[np.ndarray, int]:
    """The stationary ranks of a column-normalised weight matrix, and the rounds that they took."""
    n = len(teleport)
    total = weights.sum(0)
    walk = np.where(total > 0, weights / np.where(total > 0, total, 1), 1 / n)
    now, used = np.full(n, 1 / n), 0
    for used in range(1, ROUNDS + 1):
        new = distribution((1 - DAMPING) * teleport + DAMPING * (walk @ now), teleport)
        done = np.abs(new - now).sum() < TOLERANCE
        now = new
        if done:
            break
    return now, used


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The symmetric similarity of two texts, by pair; a text of a batch is cut into terms once."""
    views = {t: TextView(t) for t in {*a, *b}}
    return pd.Series([views[x].similarity(views[y]) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(DoubleType())
def relevance(query: pd.Series, title: pd.Series, body: pd.Series) -> pd.Series:
    """How relevant documents are to their request's query; null where there is none."""

    def of(asked: TextView, title: TextView, body: TextView) -> float | None:
        if not asked.text:
            return None
        return min(1.0, 0.55 * asked.lexical(body) + 0.3 * asked.specificity(body) + 0.15 * (asked.lexical(title) if title.text else 0)) if body.text else 0.0

    return pd.Series([of(TextView(q), TextView(t), TextView(c)) for q, t, c in zip(query, title, body)], dtype=float)


def pagerank_rerank(documents: DataFrame) -> DataFrame:
    """Scores of documents (request_id, pos, id, query, title, content, prior); a null id is doc- and the place in the request.

    A request's query is the first that one of its documents has. Without one, priors are the relevance."""
    order = Window.partitionBy("request_id").orderBy("pos", "title", "content")
    text = lambda most: F.trim(F.concat_ws(" ", S.clean(F.col("title")), F.left(S.clean(F.col("content")), F.lit(most))))
    asked = F.first(F.nullif(S.clean(F.col("query")), F.lit("")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = documents.withColumns({"n": F.row_number().over(order) - 1, "asked": F.coalesce(asked, F.lit("")), "graph": text(GRAPH_CHARS), "prior": F.greatest(F.coalesce("prior", F.lit(0.0)), F.lit(0.0))})
    rows = kept(rows.withColumn("told", relevance("asked", F.coalesce("title", F.lit("")), text(TEXT_CHARS))).select("request_id", "pos", "id", "n", "graph", "prior", "told", (F.col("asked") != "").alias("is_asked")))
    one = rows.select("request_id", F.col("n").alias("b"), F.col("graph").alias("text_b"))
    other = rows.select("request_id", F.col("n").alias("a"), F.col("graph").alias("text_a"))
    # each direction is computed: the matcher's ratio depends on which text comes first
    pairs = one.join(other, "request_id").where("a <> b").repartition("request_id", "a", "b")
    edges = pairs.select(F.col("request_id").alias("of"), "b", "a", likeness("text_b", "text_a").alias("weight"))

    def kernel(docs: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("n").reset_index(drop=True)
        n, priors = len(docs), docs["prior"].to_numpy(float)
        weights = np.zeros((n, n))
        weights[links["b"], links["a"]] = links["weight"]
        told = docs["told"].to_numpy(float) if docs["is_asked"].iloc[0] else priors.copy()
        now, used = ranks(weights, distribution(told, priors))
        final = np.clip(told * (0.75 + 0.25 * scaled(now)), 0, 1) if docs["is_asked"].iloc[0] else now
        place = np.empty(n, int)
        place[np.argsort(final, kind="stable")[::-1]] = np.arange(1, n + 1)
        ids = [i if isinstance(i, str) else f"doc-{k}" for k, i in enumerate(docs["id"])]
        return pd.DataFrame({"request_id": docs["request_id"], "pos": docs["pos"], "id": ids, "relevance": told, "pagerank": now, "final_score": final, "iterations": used, "rank": place})

    return rows.drop("graph").groupBy("request_id").cogroup(edges.groupBy("of")).applyInPandas(kernel, OUT)
