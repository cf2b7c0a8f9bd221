"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled rows (`PER_CLASS` of each class, chosen by a hash of the id) gives the examples. Terms
are lower-case letter runs; every term of the examples is in the index, weighted by its frequency in all documents,
and every whole text is a query. Blocks of examples carry the largest weight
of each term; blocks that can't hold one of the k best are skipped, so the k nearest are exact.
Distance-weighted votes are mapped to probabilities by an isotonic fit on a part of the sample that the index
leaves out, weighted to the label's share in all labelled rows. The `TERMS` terms that tell the classes apart best
(log-likelihood ratio over the sample's documents) are only named as evidence; no score depends on them.

Defined cases: null, empty and term-less texts are near no example and get the calibrated score of such texts;
equal cosines are ordered by example; repeated rows are scored one by one; with one class of labels or none every
score is that class's share (0 without labels); other columns of the input are ignored."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, remainder, small_batches, texts
from .quality_classifier import isotonic

PER_CLASS = 2000
TERMS = 400
NEIGHBOURS = 20
BLOCK = 64
#: The most frequent terms, whose lists are kept as blocks; texts searched together; blocks that each text visits first.
DENSE, BATCH, FIRST = 2048, 250, 4
#: More than 32-bit sums of unit vectors are off by.
ROUNDING = 1e-4
_NOT_LETTER = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms (letters, ASCII folded to lower case) of a whole text in order."""
    return (text or b"").translate(_NOT_LETTER).split()


def term_counts(text: bytes | None) -> Counter:
    """How often each term is in a whole text."""
    return Counter(terms(text))


def telling_terms(counts: list[Counter], y: np.ndarray, most: int = TERMS, least_docs: int = 4) -> list[bytes]:
    """The terms with the largest log-likelihood ratio between the classes; ties by term."""
    df = [Counter(), Counter()]
    for c, label in zip(counts, y):
        df[int(label)].update(c.keys())
    n = [int((y == k).sum()) for k in (0, 1)]
    part = lambda k, e: k * math.log(k / e) if k else 0.0
    scored = []
    for term in df[0].keys() | df[1].keys():
        a, b = df[1][term], df[0][term]
        if a + b >= least_docs:
            p = (a + b) / (n[0] + n[1])
            g = part(a, n[1] * p) + part(n[1] - a, n[1] * (1 - p)) + part(b, n[0] * p) + part(n[0] - b, n[0] * (1 - p))
            if g > 8:
                scored.append((-g, term))
    return [t for _, t in sorted(scored)[:most]]


class BlockMaxIndex:
    """Inverted index of unit TF-IDF vectors of labelled examples, searched for a batch of texts at a time.

    Lists of the `DENSE` most frequent terms are kept block by block, as a matrix with the largest weight of each term
    in each block; those of all other terms as postings, which are short. The postings of a text's terms are added up
    in full. A block's bound is the largest such sum in it plus the text's weights times the block's largest weights;
    blocks whose bound can't reach the k-th best cosine so far are skipped. What may be among the k nearest within
    the rounding of 32-bit sums is then computed again from the vectors, in 64 bits and an order of its own."""

    def __init__(self, counts: list[Counter], labels: np.ndarray, vocabulary: list[bytes], block: int = BLOCK, df: np.ndarray | None = None, n: int = 0, dense: int = DENSE):
        """df and n: each term's document frequency and the number of documents; by default those of the examples."""
        self.at = {t: k for k, t in enumerate(vocabulary)}
        if df is None:
            n, df = len(counts), np.zeros(len(vocabulary))
            for c in counts:
                for t in c.keys() & self.at.keys():
                    df[self.at[t]] += 1
        self.idf = np.log1p(max(n, 1) / (df + 1))
        self.block, self.dense = block, dense
        vectors = [self.vector(c) for c in counts]
        used = [k for k, (t, _) in enumerate(vectors) if len(t)]
        # examples with like terms share blocks, which keeps bounds tight
        used.sort(key=lambda k: (int(vectors[k][0][np.argmax(vectors[k][1])]), labels[k], k))
        self.labels = np.array([labels[k] for k in used], float)
        self.size = np.array([len(vectors[k][0]) for k in used], np.int64)
        self.starts = np.cumsum(self.size) - self.size
        self.terms = np.concatenate([vectors[k][0] for k in used]).astype(np.int32) if used else np.zeros(0, np.int32)
        self.held = np.concatenate([vectors[k][1] for k in used]) if used else np.zeros(0)
        self.lists: tuple | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "lists": None}  # made again where they are used

    def opened(self) -> tuple:
        """(the dense number of each term or -1, dense lists, their block maxima, cuts, places and weights of postings)."""
        if self.lists is None:
            size, n = len(self.idf), len(self.labels)
            often = np.bincount(self.terms, minlength=size)
            chosen = np.sort(np.argsort(-often, kind="stable")[: self.dense])
            number = np.full(size, -1, np.int32)
            number[chosen] = np.arange(len(chosen))
            place = np.repeat(np.arange(n, dtype=np.int32), self.size)
            blocks = max(-(-n // self.block), 1)
            lists = np.zeros((len(chosen), blocks * self.block), np.float32)
            common = number[self.terms] >= 0
            lists[number[self.terms[common]], place[common]] = self.held[common]
            best = lists.reshape(len(chosen), blocks, self.block).max(2, initial=0)
            order = np.flatnonzero(~common)
            order = order[np.argsort(self.terms[order], kind="stable")]
            cuts = np.searchsorted(self.terms[order], np.arange(size + 1))
            self.lists = number, lists, best, cuts, place[order], self.held[order].astype(np.float32)
        return self.lists

    def _weighted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, n = np.unique(ids, return_counts=True)
        weights = (1 + np.log(n)) * self.idf[found]
        return found, weights / max(float(np.sqrt((weights * weights).sum())), 1e-12)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit TF-IDF weights of a text's counts."""
        found = [(self.at[t], counts[t]) for t in counts.keys() & self.at.keys()]
        return self._weighted(np.repeat(np.array([t for t, _ in found], np.int64), [c for _, c in found]))

    def text_vector(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit TF-IDF weights of a whole text."""
        words = terms(text)
        ids = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        return self._weighted(ids[ids >= 0])

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """For each vector the k examples of largest positive cosine, (cosine, example), best first; ties by example."""
        m, n = len(vectors), len(self.labels)
        if not m or not n:
            return [[] for _ in vectors]
        number, lists, best, cuts, places, held = self.opened()
        row = np.repeat(np.arange(m), [len(t) for t, _ in vectors])
        term, weight = (np.concatenate(x) for x in zip(*vectors))
        common = number[term] >= 0
        query = np.zeros((m, len(best)), np.float32)
        query[row[common], number[term[common]]] = weight[common]
        lo, size = cuts[term[~common]], cuts[term[~common] + 1] - cuts[term[~common]]
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        wide = lists.shape[1]
        dots = np.bincount(np.repeat(row[~common] * wide, size) + places[at], np.repeat(weight[~common], size) * held[at], m * wide).reshape(m, wide).astype(np.float32)
        bound = dots.reshape(m, -1, self.block).max(2) + query @ best
        k = min(k, n)
        seen = np.zeros(bound.shape, bool)
        todo = np.zeros(bound.shape, bool)
        np.put_along_axis(todo, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, 1)
        while todo.any():
            for b in np.flatnonzero(todo.any(0)).tolist():
                rows, part = np.flatnonzero(todo[:, b]), slice(b * self.block, (b + 1) * self.block)
                dots[rows, part] += query[rows] @ lists[:, part]
            seen |= todo
            known = np.where(np.repeat(seen, self.block, axis=1), dots, 0)
            kth = np.partition(known, wide - k, axis=1)[:, wide - k]
            todo = ~seen & (bound > 0) & (bound >= kth[:, None] - ROUNDING)
        out, own = [], np.zeros(len(self.idf))
        for r, (t, w) in enumerate(vectors):
            some = np.flatnonzero((known[r] > 0) & (known[r] >= kth[r] - ROUNDING))
            if not len(some):
                out.append([])
                continue
            own[t] = w
            size = self.size[some]
            at = np.repeat(self.starts[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            exact = np.add.reduceat(own[self.terms[at]] * self.held[at], np.cumsum(size) - size)
            own[t] = 0
            out.append([(float(exact[j]), int(some[j])) for j in np.lexsort((some, -exact))[:k] if exact[j] > 0])
        return out

    def nearest(self, counts: Counter, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        return self.nearest_of([self.vector(counts)], k)[0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of label 1 among the neighbours, weighted by 1 / distance; -1 without any."""
        if not near:
            return -1.0
        weight = np.array([1 / (1.02 - min(s, 1.0)) for s, _ in near])
        return float(weight @ self.labels[[j for _, j in near]] / weight.sum())


class ToxicityModel:
    """An index, and the calibration of its votes."""

    def __init__(self, counts: list[Counter], y: np.ndarray, share: float, frequencies: Callable[[list[bytes]], tuple[np.ndarray, int]]):
        spare = np.arange(len(y)) % 4 == 3
        fit = [k for k in range(len(y)) if not spare[k]]
        self.telling = set(telling_terms([counts[k] for k in fit], y[fit]))
        vocabulary = sorted(set().union(*(counts[k].keys() for k in fit)))
        df, n = frequencies(vocabulary)
        self.index = BlockMaxIndex([counts[k] for k in fit], y[fit], vocabulary, df=df, n=n)
        held = np.flatnonzero(spare)
        near = [x for at in range(0, len(held), BATCH) for x in self.index.nearest_of([self.index.vector(counts[k]) for k in held[at : at + BATCH]])]
        votes = np.array([self.index.vote(x) for x in near])
        weight = np.where(y[held] == 1, share / max((y[held] == 1).mean(), 1e-9), (1 - share) / max((y[held] == 0).mean(), 1e-9))
        order = np.argsort(votes, kind="stable")
        prior = 0.5
        self.votes = votes[order]
        self.levels = isotonic(self.votes, (weight * y[held])[order] + 1e-3 * prior, weight[order] + 1e-3)
        edges = np.unique(self.votes)
        self.grid = edges
        self.level = np.array([self.levels[self.votes == v].mean() for v in edges])

    def score(self, near: list[tuple[float, int]]) -> float:
        """The calibrated score of a text with these neighbours."""
        vote = self.index.vote(near)
        if not len(self.grid):
            return 0.0
        if vote < 0 or self.grid[0] >= 0:
            return float(self.level[0]) if vote < 0 else float(np.interp(vote, self.grid, self.level))
        return float(np.interp(vote, self.grid[1:], self.level[1:])) if len(self.grid) > 1 else float(self.level[0])


def document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all docs each term of vocabulary is, and the number of docs."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, df, n = shared.value, np.zeros(size, np.int64), 0
        for b in batches:
            for text in texts(b):
                found = [at[t] for t in term_counts(text).keys() & at.keys()]
                df[found] += 1
                n += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], ["term", "n"])

    df, n = np.zeros(size), 0
    for r in small_batches(docs).select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, n


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel | float:
    """Learns from labels whose fold mod 5 isn't 0; a constant share if they have fewer than two classes."""
    marks = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0))
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return float(next(iter(n), 0))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = marks.where(draw < F.when(F.col("y") == 1, min(1_000_000, 1_000_000 * per_class // n[1] + 1)).otherwise(min(1_000_000, 1_000_000 * per_class // n[0] + 1)))
    chosen = chosen.select(F.col("doc_id").alias("of"), "y").distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [term_counts(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([b" ".join(c) for c in rows], pa.binary()), pa.array([list(c.values()) for c in rows], pa.list_(pa.int32()))], ["of", "y", "terms", "counts"])

    kind = labels.schema["doc_id"].dataType.simpleString()
    # chosen has about 2 * per_class rows at any size of the corpus
    sample = small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("of", "y", "text").mapInArrow(counted, f"of {kind}, y int, terms binary, counts array<int>").toArrow().sort_by([("of", "ascending"), ("y", "ascending"), ("terms", "ascending")])
    counts = [Counter(dict(zip(t.split(), c))) for t, c in zip(sample["terms"].to_pylist(), sample["counts"].to_pylist())]
    y = np.array(sample["y"].to_pylist(), int)
    if len(set(y.tolist())) < 2:
        return n[1] / (n[0] + n[1])
    return ToxicityModel(counts, y, n[1] / (n[0] + n[1]), lambda vocabulary: document_frequencies(docs, vocabulary))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the telling terms found) and neighbours of every row of docs.

    neighbours has the cosine and the label of each nearest example, best first: what the score is made of."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))  # bounded by the terms of 2 * PER_CLASS examples

    def scored(batch: list[bytes | None]) -> dict:
        m = model.value
        scores, evidence, cosines, marks = [], [], [], []
        for at in range(0, len(batch), BATCH):
            part = batch[at : at + BATCH]
            if isinstance(m, float):
                near = [[] for _ in part]
                scores += [m] * len(part)
            else:
                near = m.index.nearest_of([m.index.text_vector(t) for t in part])
                scores += [m.score(x) for x in near]
            evidence += [sorted(t.decode("utf-8", "replace") for t in m.telling.intersection(terms(text))) if x else [] for text, x in zip(part, near)]
            cosines += [[c for c, _ in x] for x in near]
            marks += [[int(m.index.labels[j]) for _, j in x] for x in near]
        found = [[{"cosine": c, "label": y} for c, y in zip(*x)] for x in zip(cosines, marks)]
        return {"score": pa.array(np.clip(scores, 0, 1), pa.float64()), "evidence": pa.array(evidence, pa.list_(pa.string())), "neighbours": pa.array(found, pa.list_(pa.struct([("cosine", pa.float64()), ("label", pa.int32())])))}

    found = per_text(docs, scored, "score double, evidence array<string>, neighbours array<struct<cosine:double,label:int>>")
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence", "neighbours")
