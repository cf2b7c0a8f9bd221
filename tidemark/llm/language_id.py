"""Language identification in two steps: a family first, then one-versus-one linear SVMs within the family.

Features are hashed byte trigrams and tetragrams of the whole text, with ASCII folded to lower case and all
ASCII that isn't a letter made a space. A bounded sample of labelled rows trains: about `per_language` rows of
each language, chosen by a hash of the id against a rate that the language's row count sets.

Defined cases: a null text, or one without a letter, gets `und` and score 0; rows with a null language don't
train; with one learned language every other text gets it; with none every text gets `und`; a null doc_id
never trains and isn't held out; other columns of the input are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, remainder, small_batches, texts

WIDTH = 2048
PER_LANGUAGE = 800
# Language families by ISO 639-1 code. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru pl cs sk uk be bg sr hr sl mk bs".split(),
    "baltic": "lt lv".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-aryan": "hi ur bn mr gu pa ne si".split(),
    "dravidian": "ta te kn ml".split(),
    "semitic": "ar he mt am".split(),
    "iranian": "fa ku ps tg".split(),
    "austronesian": "id ms tl jv mg".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def features(text: bytes | None) -> np.ndarray:
    """Square roots of the counts of hashed byte n-grams, scaled to length one."""
    b = np.frombuffer(b"  " + (text or b"").translate(_FOLD) + b"  ", np.uint8).astype(np.uint32)
    tri = b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35
    tetra = tri[:-1] * 0x27D4EB2F + b[3:] * 0x165667B1
    half = WIDTH // 2
    counts = np.concatenate([np.bincount(tri >> 22, minlength=half), np.bincount(tetra >> 22, minlength=half)]).astype(np.float32)
    x = np.sqrt(counts)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def has_letter(text: bytes | None) -> bool:
    return bool(text) and LETTER.search(text.decode("utf-8", "replace")) is not None


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by accelerated gradient steps; y is +-1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (1.0 + 2 * c * 2.0)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        step = v - rate * (v - 2 * c * (x.T @ (share * y * slack)))
        v, w = step + k / (k + 3) * (step - w), step
    return w


class LanguageModel:
    """Family SVMs (one against the rest) and pairwise SVMs of the languages within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.family = [FAMILY_OF.get(z.split("-")[0].lower(), z) for z in self.langs]
        self.families = sorted(set(self.family))
        of = np.array([self.langs.index(z) for z in langs], int)
        fam = np.array([self.families.index(z) for z in self.family], int)
        plus = lambda hit: np.where(hit, 1, -1).astype(np.float32)
        self.top = [linear_svm(x, plus(fam[of] == f)) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        for a in range(len(self.langs)):
            for b in range(a + 1, len(self.langs)):
                if fam[a] == fam[b]:
                    rows = (of == a) | (of == b)
                    self.pairs[a, b] = linear_svm(x[rows], plus(of[rows] == a))
        self.members = [[a for a in range(len(self.langs)) if fam[a] == f] for f in range(len(self.families))]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row of x and a score: the family's share times the pairwise vote's share."""
        n = len(x)
        soft = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        family = np.stack([soft(x @ w[:-1] + w[-1]) for w in self.top], 1) if self.top else np.ones((n, 1))
        family = family / np.maximum(family.sum(1, keepdims=True), 1e-9)
        votes = np.ones((n, len(self.langs)))
        for (a, b), w in self.pairs.items():
            p = soft(x @ w[:-1] + w[-1])
            votes[:, a] *= np.maximum(p, 1e-9)
            votes[:, b] *= np.maximum(1 - p, 1e-9)
        out, score = [], np.zeros(n)
        chosen = family.argmax(1) if n else []
        for k, f in enumerate(chosen):
            own = self.members[f]
            v = votes[k, own]
            best = int(v.argmax())
            out.append(self.langs[own[best]])
            score[k] = family[k, f] * v[best] / v.sum()
        return out, np.clip(score, 0, 1)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Learns from text and lang of rows whose fold mod 4 isn't 2; None if there are none."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    rate = F.coalesce(*(F.when(F.col("lang") == lang, min(1_000_000, int(1_000_000 * per_language / n) + 1)) for lang, n in sorted(counts.items())))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(t, z) for t, z in zip(texts(b), b.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([features(t).astype(np.float16).tobytes() for t, _ in got], pa.binary()), pa.array([z for _, z in got], pa.string())], ["x", "lang"])

    table = small_batches(rows).where(draw < rate).select("text", "lang").mapInArrow(made, "x binary, lang string").toArrow()
    if not table.num_rows:
        return None
    order = np.argsort(np.array([x + z.encode() for x, z in zip(table["x"].to_pylist(), table["lang"].to_pylist())], object), kind="stable")
    x = np.stack([np.frombuffer(table["x"][int(k)].as_py(), np.float16) for k in order]).astype(np.float32)
    return LanguageModel(x, [table["lang"][int(k)].as_py() for k in order])


def identify(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred and score of every row of docs; only the text is looked at."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights per pair of languages

    def predict(batch: list[bytes | None]) -> dict:
        m = shared.value
        named = [k for k, t in enumerate(batch) if m is not None and has_letter(t)]
        lang, score = ["und"] * len(batch), [0.0] * len(batch)
        if named:
            got, value = m.predict(np.stack([features(batch[k]) for k in named]))
            for k, z, v in zip(named, got, value):
                lang[k], score[k] = z, float(v)
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    return per_text(docs, predict, "lang_pred string, score double", keep)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    found = identify(docs, fit(docs))
    return found.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
