import numpy as np
from pyspark.sql import functions as F

from crowdtide.llm import decontaminate
from tests.llm.helpers import DOCS, documents, sentence, words


def slow_tiles(a, b, least):
    """Words of ``a`` covered by greedy string tiling, all positions compared."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0

    def match(i, j):
        n = 0
        while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
            n += 1
        return n

    while best := max((match(i, j) for i in range(len(a)) for j in range(len(b))), default=0):
        if best < least:
            break
        for i in range(len(a)):
            for j in range(len(b)):
                if match(i, j) >= best:
                    free_a[i : i + best] = free_b[j : j + best] = [False] * best
                    covered += best
    return covered


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, n)).astype(np.uint64) for n in (20, 25))
        assert decontaminate.tile(a, b, 2)[0] == slow_tiles(a.tolist(), b.tolist(), 2)


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [sentence(rng, n) for n in (8, 20, 40, 40)]
    cut = items[2].split()
    moved = " ".join(cut[20:] + ["gap"] + cut[:20])
    third = " ".join(cut[:13])
    texts = [sentence(rng, 30) + " " + x + " " + sentence(rng, 30) for x in [*items, moved, third, items[0].upper(), items[1] + " " + items[3]]]
    texts += [sentence(rng, 100) for _ in range(5)] + ["", None, "w1 w2", (items[1] + " ") * 300]
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*items, items[1], "too short", None, ""])] + [(None, items[0])], "item_id long, text string")
    docs = documents(spark, texts).withColumn("item_id", F.lit(1)).withColumn("doc", F.lit(1))
    want = set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            covered = slow_tiles(words(x), words(t), 5) if t and len(t) < 5000 else len(words(x)) * (t is not None and x in t)
            if covered >= 0.5 * len(words(x)):
                want.add((d, i, covered))
    got = decontaminate.leaks(docs, table).collect()
    assert {(r["doc_id"], r["item_id"], r["covered_words"]) for r in got} == want
    assert next(r["tiles"] for r in got if r["doc_id"] == 4 and r["item_id"] == 2) == 2


def test_repeated_ids_and_empty_tables(spark):
    item = spark.createDataFrame([(7, "a b c d e f g h")], "item_id long, text string")
    rows = [(1, "a b c d e f g h"), (1, "something else entirely of many words"), (None, "a b c d e f g h")]
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.leaks(documents(spark, rows), item).collect()] == [(1, 7, 1.0)]
    assert decontaminate.leaks(spark.createDataFrame([], DOCS), item).count() == 0
    assert decontaminate.leaks(documents(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_short_items_match_as_a_whole(spark):
    items = [(1, "Who wrote it?"), (2, "yes"), (3, "who  WROTE it"), (4, "four words are here"), (5, "a b c d e f g h"), (6, "?!"), (7, "never found")]
    table = spark.createDataFrame([*items, (None, "yes")], "item_id long, text string")
    texts = [(1, "so who wrote it, then"), (1, "Yes: yes"), (2, "who wrote that"), (3, "words are here four"), (4, "a b c d e f g h four words are here"), (5, None), (None, "yes")]
    got = decontaminate.leaks(documents(spark, texts), table).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 3, 3, 1, 1.0), (1, 2, 1, 1, 1, 1.0), (4, 4, 4, 4, 1, 1.0), (4, 5, 8, 8, 1, 1.0)]
