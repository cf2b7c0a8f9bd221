import random

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; inputs may have them too.
CLASHES = ("h", "fp", "x", "score", "lang_pred", "extra", "window", "spans", "host", "y", "variant", "of", "_doc_id", "pattern")
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\r\x0b\x0c ", "en", None, 6),
    (4, "one", None, "a", 3),
    (5, "a b", "en", "b", 3),
    (6, "123 456 !!!", "en", "b", 11),
    (7, "naïve Ünï 漢字 \U0001d538 \x00 end", "fr", "b", 20),
    (8, "the cat sat on the mat and looked at the moon", "en", "a", 45),
    (8, "the cat sat on the mat and looked at the moon", "en", "a", 45),
    (9, "The CAT sat on the mat and looked at the moon", "en", "c", 45),
    (None, "the cat sat on the mat and looked at the moon", "en", "c", 45),
    (10, "x" * 6000, "en", "c", 6000),
    (11, "word " * 30000, "en", "c", 150000),
]


def documents(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, DOC)
    for name in CLASHES if clashes else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def prose(seed, n, words=("lorem", "ipsum", "dolor", "sit", "amet", "sed", "eiusmod", "tempor", "magna", "aliqua", "enim", "minim", "quis", "nostrud")):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) + draw.choice(("", "a", "en", "is", "o", "um", "ti")) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])
