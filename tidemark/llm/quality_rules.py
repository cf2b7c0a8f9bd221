"""Quality rules with host-level verdicts.

Every document gets base figures of its whole text. Rule failures are added up by host, host rates are
shrunk with a beta prior fitted to all hosts, and hosts that clearly fail reject their documents.

Defined cases: null or blank text has no words and fails the base rule; a null host is no host (its rows
fall under the base rule alone); repeated rows are judged one by one; an empty table gives an empty result;
other columns of the input are ignored."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, per_text, staged

SYMBOLS = b"#*$%&|<>"
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more, first occurrences included."""
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = end = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + width - max(at, end)
            end = at + width
    return covered


def base_figures(batch: list[bytes | None]) -> dict:
    rows = []
    for text in batch:
        text = text or b""
        words = text.split()
        solid = text.translate(None, SPACE)
        lines = [x for x in text.split(b"\n") if x.strip()]
        rows.append((len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)))
    columns = list(zip(*rows)) or [()] * 5
    return {name: pa.array(column, pa.int64()) for name, column in zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), columns)}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failures() -> Column:
    """The rules a document fails: too few words, repetition, symbols, duplicate lines or odd word lengths."""
    rules = [
        F.col("n_words") < 10,
        100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        10 * F.col("n_symbols") > 3 * F.col("n_words"),
        F.col("n_dup_lines") > 3,
        (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    ]
    return sum((F.when(rule, 1).otherwise(0) for rule in rules), F.lit(0))


def host_verdicts(figures: DataFrame, max_rate: float = 0.5, certainty: float = 2.0) -> DataFrame:
    """(host, host_docs, host_failures, host_rate, host_failed) of figures with columns host and rule_failures.

    A document fails if it breaks any rule. The prior Beta(a, b) has the mean and, by moments, the spread of
    the hosts' rates; a host fails if its posterior mean less `certainty` deviations exceeds max_rate."""
    hosts = figures.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(F.col("rule_failures") > 0).alias("host_failures"))
    hosts = staged(hosts)
    prior = hosts.agg((F.sum("host_failures") / F.sum("host_docs")).alias("m"), F.coalesce(F.var_pop(F.col("host_failures") / F.col("host_docs")), F.lit(0.0)).alias("v")).first()
    mean = min(max(prior["m"] if prior["m"] is not None else 0.5, 1e-3), 1 - 1e-3)
    strength = min(max(mean * (1 - mean) / max(prior["v"], 1e-6) - 1, 1.0), 1e4)
    a, b = mean * strength, (1 - mean) * strength
    n = F.col("host_docs") + F.lit(a + b)
    rate = (F.col("host_failures") + F.lit(a)) / n
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", rate - certainty * F.sqrt(rate * (1 - rate) / (n + 1)) > max_rate)


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the base figures, rule_failures, host_rate, base_failed and kept of every row of docs."""
    figures = per_text(docs.select("doc_id", "text", F.col(host).cast("string").alias("host")), base_figures, BASE_SCHEMA, ("doc_id", "host"))
    figures = staged(figures.withColumn("rule_failures", rule_failures()))
    judged = figures.join(host_verdicts(figures).select("host", "host_rate", "host_failed"), "host", "left")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))
