"""Sinks and sampled inputs: JSON results, response rows, CSV question sets, header search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The cells that mark the header row of an evaluation sheet, and the columns of a question set.
HEADER_CELLS = ("Query_ID", "Query_Type", "Query_Text", "Model_Name", "Configuration", "Factual_Accuracy", "Latency_Total (s)")
QUESTION_COLUMNS = ("problem", "answer", "url")


def save_results(results: DataFrame, folder: str, stamp: str, kind: str = "results") -> str:
    """Writes results as JSON lines in a folder named by kind and time stamp; returns its path."""
    path = f"{folder}/{kind}_{stamp}"
    results.write.mode("overwrite").json(path)
    return path


def save_both(raw: DataFrame, clean: DataFrame, folder: str, stamp: str) -> dict[str, str]:
    return {"raw": save_results(raw, folder, stamp, "raw"), "cleaned": save_results(clean, folder, stamp, "cleaned")}


def response(answer: Column, evidence: Column, source: Column, confidence: Column, sources: Column) -> Column:
    """One JSON answer a row; an empty answer is null at this edge."""
    return F.to_json(F.struct(F.nullif(answer, F.lit("")).alias("answer"), evidence.alias("evidence"), source.alias("source"), confidence.alias("confidence"), sources.alias("sources")))


def sampled_questions(spark: SparkSession, path: str, n: int = 50, seed: int = 0) -> DataFrame:
    """n rows of a CSV of questions, chosen by seed: problem, answer, url; header names in any case."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*(c.strip().lower() for c in rows.columns))
    return rows.select(*(F.col(c) if c in rows.columns else F.lit("").alias(c) for c in QUESTION_COLUMNS)).orderBy(F.rand(seed)).limit(n)


def header_row(cells: DataFrame) -> int:
    """The first row (of cells: row, value) that has every header cell."""
    wanted = F.array(*map(F.lit, HEADER_CELLS))
    found = cells.groupBy("row").agg(F.collect_set(F.trim("value")).alias("values")).where(F.size(F.array_except(wanted, "values")) == 0).agg(F.min("row")).first()[0]
    if found is None:
        raise ValueError("no row has all header cells")
    return int(found)
