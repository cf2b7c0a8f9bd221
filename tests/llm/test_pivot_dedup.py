"""The pivot index against brute force: planted groups, odd vectors, blocks of lists, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pivot_dedup as P

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows):
    """vec_id, n_links, component_id and kept of every row, from all pairs."""
    def usable(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    x = [np.array(v, np.float32).astype(float) if usable(v, label) else None for _, v, label in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= P.COSINE:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[find(k)] = min(least.get(find(k), row[0]), row[0])
    return sorted(((row[0], n[k], least.get(find(k)), row[0] == least.get(find(k))) for k, row in enumerate(rows)), key=str)


def by_index(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in P.embedding_duplicates(df).collect()), key=str)


def planted(seed, width=16, alone=150, groups=((40, 0.04), (12, 0.05), (2, 0.03)), labels=3):
    draw = np.random.default_rng(seed)
    points = [draw.normal(size=width) for _ in range(alone)]
    for size, noise in groups:
        middle = draw.normal(size=width)
        points += [middle + noise * draw.normal(size=width) * np.linalg.norm(middle) / 4 for _ in range(size)]
        points += [middle] * 3
    return [(k * 7 % 1009, [float(np.float32(c)) for c in x], k % labels) for k, x in enumerate(points)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = planted(seed)
    want = by_hand(rows)
    assert sum(r[1] for r in want) > 500
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert by_index(df) == want
    assert by_index(df.withColumns({c: F.lit("clash") for c in ("class", "v", "copies", "near", "pivot", "one", "two", "side", "n", "root", "least")})) == want


def test_blocks_of_a_list_make_no_difference(spark, monkeypatch):
    rows = planted(3, groups=((120, 0.05), (30, 0.02)), labels=1)
    monkeypatch.setattr(P, "BLOCK", 25)
    monkeypatch.setattr(P, "ROWS", 7)
    assert by_index(spark.createDataFrame(rows, SCHEMA).repartition(4)) == by_hand(rows)


def test_odd_vectors(spark, empty):
    inf, nan = float("inf"), float("nan")
    good = [1.0, 2.0, 3.0]
    rows = [(1, good, 1), (2, good, 1), (2, good, 1), (3, [2.0, 4.0, 6.0], 1), (4, good, 2), (5, good, None), (6, None, 1), (7, [], 1), (8, [0.0] * 3, 1), (9, [1.0, None, 3.0], 1), (10, [1.0, 2.0, nan], 1), (11, [inf, 2.0, 3.0], 1),
            (12, [1.0, 2.0], 1), (13, [1.0, 2.0, 3.0, 0.0], 1), (None, good, 1), (None, [-1.0, 0.0, 0.0], 3), (14, [-1.0, -0.0, 0.0], 3), (15, [1e30, 2e30, 3e30], 1), (16, [1e-30, 2e-30, 3e-30], 1), (17, None, None), (0, [-1.0, -2.0, -3.0], 1)]
    got = by_index(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == by_hand(rows)
    assert (1, 6, 1, True) in got and (15, 6, 1, False) in got and (13, 0, 13, True) in got
    assert by_index(spark.createDataFrame([], SCHEMA)) == []
    assert by_index(spark.createDataFrame([(1, None, 1)], SCHEMA)) == [(1, 0, 1, True)]


def test_far_scales_of_doubles(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [2e200, -1e200], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert by_index(df) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_recall_on_the_edge_of_the_cosine(spark):
    """Pairs of a cosine just above the bound are found, in 64 dimensions and among many vectors."""
    draw = np.random.default_rng(9)
    x = draw.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = draw.normal(size=(2000, 64))
    other -= (other * x[:2000]).sum(1, keepdims=True) * x[:2000]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.981 * x[:2000] + np.sqrt(1 - 0.981**2) * other
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.vstack([x, near]))]
    got = P.embedding_duplicates(spark.createDataFrame(rows, SCHEMA)).where("vec_id >= 6000 AND n_links > 0").count()
    assert got >= 0.99 * 2000
