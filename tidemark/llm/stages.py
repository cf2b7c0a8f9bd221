"""Filtering and rewriting forms of the operators: each takes documents and returns documents.

A row is known by its doc_id and a hash of its text. So a decision about a row without an id, or with an id that other
rows share, is about that row's text alone; rows that repeat both are judged alike. Every other column, extra ones and
ones with clashing names among them, passes through unchanged, and an empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontamination, language_id, pii, simhash
from .common import size_checked, staged, text_hash

#: Rows to drop are broadcast up to this many (about 30 MB); beyond it Spark shuffles both sides.
DROPPED_ROWS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text are in dropped (an id and a hash of the text)."""
    dropped = size_checked(staged(dropped.toDF("dropped", "text_h").distinct()), DROPPED_ROWS)
    same = F.col("_row.doc_id").eqNullSafe(F.col("dropped")) & (text_hash(F.col("_row.text")) == F.col("text_h"))
    return docs.select(F.struct("*").alias("_row")).join(dropped, same, "left_anti").select("_row.*")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs beside whole rows in `_row`, so that no other column can clash."""
    return docs.select(F.struct("*").alias("_row"), "doc_id", "text")


def in_a_language(docs: DataFrame) -> DataFrame:
    """Drops documents without a language (`und`); fills in a missing lang."""
    found = language_id.identify(packed(docs), language_id.fit(docs), ("_row",))
    lang = F.coalesce("_row.lang", "lang_pred")
    return found.where(F.col("lang_pred") != "und").select(F.col("_row").withField("lang", lang).alias("_row")).select("_row.*")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Keeps one row of each group of near duplicates: that of the smallest id (rows without one last), then text hash.

    Of rows that repeat both, the one whose other columns come first by a hash stays."""
    rows = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_h"))
    prints = staged(simhash.fingerprints(rows, ("doc_id", "text_h")))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_h")
    groups = simhash.component_firsts(prints, row)
    judged = prints.join(groups, "fp").select("doc_id", "text_h", row.eqNullSafe(F.col("first")).alias("first"))
    kept = without(docs, judged.where(~F.col("first")).select("doc_id", "text_h"))
    again = prints.groupBy("doc_id", "text_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_h")
    again = size_checked(staged(again.toDF("_repeated", "_text_h")), DROPPED_ROWS)
    if again.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("_repeated")) & (F.col("h") == F.col("_text_h"))
    keyed = packed(kept).withColumn("h", text_hash(F.col("text")))
    order = F.xxhash64(F.to_json("_row"))
    one = keyed.join(again, same, "left_semi").groupBy("doc_id", "h").agg(F.min_by("_row", order).alias("_row"))
    return keyed.join(again, same, "left_anti").select("_row").union(one.select("_row")).select("_row.*")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drops the rows that hold a benchmark item."""
    return without(docs, decontamination.held_items(docs, benchmark).select("doc_id", "text_h"))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the new text."""
    kind = docs.schema["n_chars"].dataType
    docs = packed(docs)
    narrow = staged(pii.base_spans(docs))
    extra = size_checked(staged(pii.discovered(docs, narrow).toDF("_h", "extra")), pii.EXTRA_ROWS)
    rows = pii.base_spans(docs, ("_row", "doc_id", "text")).join(extra, F.col("h") == F.col("_h"), "left")
    rows = rows.withColumn("extra", F.coalesce("extra", F.array().cast(pii.SPAN))).withColumn("_spans", pii.all_spans())
    rows = rows.withColumn("text", F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("_spans"))))
    size = F.when(F.size("_spans") > 0, F.length("text").cast(kind)).otherwise(F.col("_row.n_chars"))
    return rows.select(F.col("_row").withField("text", F.col("text")).withField("n_chars", size).alias("_row")).select("_row.*")
