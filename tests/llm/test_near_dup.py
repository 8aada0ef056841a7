import numpy as np
from pyspark.sql import functions as F

from crowdtide.llm import components, near_dup
from crowdtide.llm.darts import signatures
from tests.llm.helpers import DOCS, documents, sentence, shingles


def classes(rows, least=0.8):
    """Least doc_id of every document's class, by comparing all pairs."""
    ids = sorted({i for i, _ in rows})
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and len(a & b) / len(a | b) >= least:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def edited(rng, text, share):
    w = text.split()
    for i in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[i] = f"e{rng.integers(0, 10**6)}"
    return " ".join(w)


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = sentence(rng, 150)
    texts = [sentence(rng, rng.integers(1, 200)) for _ in range(30)]
    texts += [edited(rng, base, s) for s in np.repeat([0.005, 0.01, 0.02, 0.03, 0.04], 8)] + [base] * 5 + [base.upper() + "!!"]
    texts += ["", None, "...", "one two", "one, TWO", "one two three"]
    docs = documents(spark, texts).withColumn("class_id", F.lit("clash"))
    got = near_dup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(list(enumerate(texts)))
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got) and len(got) == len(texts)


def test_block_comparison_finds_what_the_pivot_misses(spark):
    """A chain: neighbours are similar, the ends are not, and small blocks split the bucket."""
    rng = np.random.default_rng(9)
    w = sentence(rng, 300, 10**6).split()
    texts = []
    for i in range(12):
        w[20 * i : 20 * i + 4] = [f"c{i}x{k}" for k in range(4)]
        texts.append(" ".join(w))
    rng.shuffle(texts)
    got = near_dup.near_duplicates(documents(spark, texts), block=3).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(list(enumerate(texts)))


def test_repeated_and_missing_ids(spark):
    rows = [(4, "a b c d e f g"), (4, "a b c d e f g"), (9, "a b c d e f g"), (None, "a b c d e f g"), (7, "other words that are quite different here")]
    got = sorted(((r["doc_id"] or 0, r["class_id"], r["kept"]) for r in near_dup.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == [(0, None, True), (4, 4, True), (4, 4, True), (7, 7, True), (9, 4, False)]


def test_nothing(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.where(np.arange(300) < 60, rng.integers(0, 2**63, 300, dtype=np.uint64), a)
    wa, wb = rng.uniform(0.2, 4, 300), rng.uniform(0.2, 4, 300)
    both = np.minimum(wa, wb)[60:].sum()
    sig = signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, 300, 600, 600]), 4000)
    assert abs((sig[0] == sig[1]).mean() - both / (wa.sum() + wb.sum() - both)) < 0.03
    assert not sig[2].any() and sig[:2].all()
    one = signatures(np.array([7], np.uint64), np.ones(1), np.array([0, 1]), 64)
    assert one.all()


def test_counted_similarity():
    a, b = np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)
    assert near_dup.similarity(a, b) == 0.5
    assert near_dup.similarity(a, b, np.array([1, 2, 1]), np.array([1, 1, 2])) == 2 / 6


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(200 + i, 201 + i) for i in range(30)] + [(500, 600 + i) for i in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["least"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
