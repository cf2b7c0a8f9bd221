"""Similarities that need a sequence matcher: Arrow-batched Python for the ratio alone, SQL for the rest."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import lexicons as L
from . import text as T


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matcher's ratio of two strings, by pair (1 for two empty ones)."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def clean(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)\s+", " "))


def terms(column: Column) -> Column:
    """Important terms of a lower-case column, repeats kept."""
    return F.filter(F.regexp_extract_all(column, F.lit(T.TERM.replace("'", r"\x27")), F.lit(0)), lambda t: ~F.lower(t).isin(*sorted(L.STOPWORDS)))


def _share(own: Column, other: Column) -> Column:
    """The share of own that is in other, null if either is empty; both are bound first, else other would be made anew for each of own."""
    share = lambda x: F.when((F.size(x["own"]) > 0) & (F.size(x["other"]) > 0), F.size(F.filter(x["own"], lambda t: F.array_contains(x["other"], t))).cast("double") / F.size(x["own"]))
    return F.get(F.transform(F.array(F.struct(own.alias("own"), other.alias("other"))), share), F.lit(0))


def lexical_relevance(query: Column, text: Column) -> Column:
    """0.6 of the query's terms found, 0.3 of the matcher's ratio over 800 characters, 0.1 if all its numbers are found."""
    digits = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    numbers = F.when((F.size(digits(query)) > 0) & (F.size(F.array_except(digits(query), digits(text))) == 0), 0.1).otherwise(0.0)
    ratio = sequence_ratio(F.lower(clean(query)), F.lower(F.left(clean(text), F.lit(800))))
    return F.least(F.lit(1.0), F.coalesce(0.6 * _share(terms(F.lower(query)), terms(F.lower(text))) + 0.3 * ratio + numbers, F.lit(0.0)))


def content_similarity(a: Column, b: Column) -> Column:
    """The larger of the ratio over 1200 characters and the Jaccard share of terms."""
    x, y = F.lower(clean(a)), F.lower(clean(b))
    tx, ty = F.array_distinct(terms(x)), F.array_distinct(terms(y))
    jaccard = F.when((F.size(tx) > 0) & (F.size(ty) > 0), F.size(F.array_intersect(tx, ty)).cast("double") / F.size(F.array_union(tx, ty))).otherwise(0.0)
    return F.when((x != "") & (y != ""), F.greatest(sequence_ratio(F.left(x, F.lit(1200)), F.left(y, F.lit(1200))), jaccard)).otherwise(0.0)


def clue_similarity(a: Column, b: Column) -> Column:
    return sequence_ratio(F.lower(clean(a)), F.lower(clean(b)))



class TextView:
    """One text as the pairwise measures see it, for grouped kernels that compare every pair of a small request."""

    _TERM = re.compile(T.TERM)
    _SPACE = re.compile(r"\s+")

    def __init__(self, text: str):
        self.text = self._SPACE.sub(" ", text or "").strip()
        self.low = self.text.lower()
        self.terms = [t for t in self._TERM.findall(self.low) if t not in L.STOPWORDS]
        self.vocabulary = set(self.terms)
        self.numbers = set(re.findall(r"\d+", self.text))
        order = {t: k for k, t in reversed(list(enumerate(self.terms)))}
        self.specific = sorted({t for t in self.terms if len(t) >= 4 and t not in L.BROWSECOMP_LOW_SIGNAL_TERMS}, key=lambda t: (-len(t), order[t]))

    def ratio(self, other: TextView, own: int | None, theirs: int | None) -> float:
        return SequenceMatcher(None, self.low[:own], other.low[:theirs]).ratio()

    def lexical(self, other: TextView) -> float:
        """How relevant `other` is to this query."""
        if not self.terms or not other.vocabulary:
            return 0.0
        share = sum(t in other.vocabulary for t in self.terms) / len(self.terms)
        numbers = bool(self.numbers) and self.numbers <= other.numbers
        return min(1.0, 0.6 * share + 0.3 * self.ratio(other, None, 800) + 0.1 * numbers)

    def specificity(self, other: TextView) -> float:
        if not self.specific or not other.vocabulary:
            return 0.0
        share = sum(t in other.vocabulary for t in self.specific) / len(self.specific)
        long = sum(len(t) >= 6 and t in other.low for t in self.specific[:4])
        return min(1.0, share + min(0.12, 0.03 * long))

    def similarity(self, other: TextView) -> float:
        """The symmetric similarity that weighs graph edges."""
        if not self.text or not other.text:
            return 0.0
        lexical = (self.lexical(other) + other.lexical(self)) / 2
        specific = (self.specificity(other) + other.specificity(self)) / 2
        return min(1.0, 0.4 * lexical + 0.3 * specific + 0.3 * self.ratio(other, 1200, 1200))
