import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtide.llm import knn, packing
from tests.llm.helpers import DOCS, documents


def test_bounds_have_least_padding():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        lengths, counts, k = np.sort(rng.choice(np.arange(1, 30), n, replace=False)), rng.integers(1, 9, n), int(rng.integers(1, 6))
        padding = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(padding([*inner, int(lengths[-1])]) for q in range(min(k, n)) for inner in itertools.combinations(lengths[:-1].tolist(), q))
        bounds, total = packing.best_bounds(lengths, counts, k)
        assert total == padding(bounds) == best and len(bounds) <= k


def test_pack_keeps_every_token(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 90, 200))] + [(7, 30), (7, 30), (None, 12), (500, 0), (501, None), (502, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("batch", F.lit("clash")).withColumn("row", F.lit(1))
    got = packing.pack(df, buckets=3, max_len=64, budget=200).collect()
    assert sum(r["n_tokens"] for r in got) == sum(n or 0 for _, n in rows)
    assert all(r["n_tokens"] <= r["bucket"] <= 64 and r["first_token"] == 64 * r["piece"] for r in got)
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] == 502) == [1000 % 64] + [64] * 15
    batches = defaultdict(list)
    for r in got:
        batches[r["bucket"], r["batch"]].append(r["place"])
    for bucket in {b for b, _ in batches}:
        room = max(1, 200 // bucket)
        sizes = [len(v) for (b, _), v in sorted(batches.items()) if b == bucket]
        assert all(s == room for s in sizes[:-1]) and 0 < sizes[-1] <= room
    assert all(sorted(v) == list(range(len(v))) for v in batches.values())
    assert len({b for b, _ in batches}) == 3


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_word_lengths(spark):
    texts = [None, "", "a", " a\tb\nc  d ", "é x y"]
    got = {r["doc_id"]: r["n_tokens"] for r in packing.word_lengths(documents(spark, texts)).collect()}
    assert got == {i: len((t or "").encode().split()) + 1 for i, t in enumerate(texts)}
    assert packing.word_lengths(spark.createDataFrame([], DOCS)).count() == 0


def brute(rows, k, every, scale=64):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(scale * x) for x in v]
            sound[i] = min(sound.get(i, w), w)
    out = []
    for q in sorted(i for i in sound if i % every == 0):
        score = lambda i: sum(a * b for a, b in zip(sound[q], sound[i], strict=False))  # noqa: B023, E731
        best = sorted((-score(i), i) for i in sound if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("pivots,block", [(1, 4096), (8, 7), (16, 4096)])
def test_top_k_equals_brute_force(spark, pivots, block):
    rng = np.random.default_rng(6)
    vectors = [np.float32(v).tolist() for v in rng.normal(0, 1, (90, 5)).round(1)]
    vectors += [vectors[3]] * 40 + [[0.0] * 5] * 3  # a large group of equal vectors, and ties
    rows = list(enumerate(vectors)) + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 5), (304, [float("inf")] * 5), (305, [1.5, 2.0]), (306, []), (None, vectors[0]), (10, vectors[50])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = knn.top_k(df, k=6, every=5, pivots=pivots, block=block).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 6, 5)


def test_top_k_of_few_and_none(spark):
    few = [(0, [1.0]), (1, [2.0]), (20, [3.0])]
    got = knn.top_k(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in got) == brute(few, 20, 20)
    assert knn.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [3.0e7, 1.0]), (1, [3.0e7, 2.0]), (2, [-3.0e7, 5.0]), (3, [3.0e7, 1.5])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, every=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 2)
