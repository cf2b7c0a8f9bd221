"""Best-first search over a graph of links, for many questions at once.

Every question has a queue of nodes that it has met but not opened. In each round it opens its `width` best ones; the
links of these are scored for the question, and the `most` best targets that it hasn't met join its queue. A node is met
once, with the score of the link that met it, so its place in the queue never changes. Questions advance together; what
has been met is one table, and each round joins the opened nodes with the links and takes what was met out again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.staging import kept


def expanded(seeds: DataFrame, links: DataFrame, score: Callable[[DataFrame], DataFrame], rounds: int = 3, width: int = 4, most: int = 6, depth: int = 3, least: float = 0.42) -> DataFrame:
    """query_id, node, score, depth, via and round of all nodes that the questions meet; round is that of opening, null if a node is still queued.

    seeds: query_id, node, score; links: source, target and what `score` needs, which adds link_score to rows of links with
    query_id. Links under `least` aren't followed, nodes at `depth` aren't opened. Of equal nodes the one met earlier comes
    first, then the smaller name."""
    w = lambda *keys: Window.partitionBy(*keys)
    met = seeds.groupBy("query_id", "node").agg(F.max("score").cast("double").alias("score")).withColumns({"depth": F.lit(0), "via": F.lit(None).cast("string"), "met": F.lit(0), "round": F.lit(None).cast("int")})
    met = kept(met)
    for now in range(1, rounds + 1):
        closed = F.col("round").isNull() & (F.col("depth") < depth)
        order = w("query_id", closed).orderBy(F.desc("score"), "met", "node")
        turn = F.row_number().over(order)
        met = kept(met.withColumn("round", F.when(closed & (turn <= width), now).otherwise(F.col("round"))))
        opened = met.where(F.col("round") == now)
        steps = opened.select("query_id", F.col("node").alias("source"), F.col("depth")).join(links.where("source <> target"), "source")
        fresh = steps.join(met.select("query_id", F.col("node").alias("target")), ["query_id", "target"], "left_anti")
        scored = score(fresh).where(F.col("link_score") >= least)
        one = scored.withColumn("nth", F.row_number().over(w("query_id", "target").orderBy(F.desc("link_score"), "source"))).where("nth = 1")
        best = one.withColumn("nth", F.row_number().over(w("query_id").orderBy(F.desc("link_score"), "target"))).where(F.col("nth") <= most)
        new = kept(best.select("query_id", F.col("target").alias("node"), F.col("link_score").cast("double").alias("score"), (F.col("depth") + 1).alias("depth"), F.col("source").alias("via"), F.lit(now).alias("met"), F.lit(None).cast("int").alias("round")))
        if new.isEmpty() and opened.isEmpty():
            break
        met = kept(met.unionByName(new))
    return met.select("query_id", "node", "score", "depth", "via", "round")
