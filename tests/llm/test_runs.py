import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from crowdtide.llm import runs
from tests.llm.helpers import documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_runs(words, length=24, times=3):
    """For each period, the stretches in which words that far apart are equal; the least period of a stretch counts."""
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(length, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = slow_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for k, w in enumerate(words) if not any(i + q <= k < i + m for i, m, q in found)]
    listed = "".join(f"{i},{m},{q}\n" for i, m, q in found)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha(listed), sha(" ".join(kept)))


def fast_runs(words, length=24, times=3):
    return runs._runs_of([[str(w).encode() for w in words]], length, times)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 20), st.integers(0, 70), st.integers(3, 12), st.integers(3, 4))
def test_runs_equal_brute_force(body, period, more, length, times):
    words = body + [body[-period:][i % len(body[-period:])] for i in range(more)] if body else []
    assert fast_runs(words, length, times) == slow_runs(words, length, times)


def test_structured_words():
    fibonacci, thue = "a", "a"
    for _ in range(9):
        thue = thue + thue.translate(str.maketrans("ab", "ba"))
    before = "b"
    while len(fibonacci) < 400:
        fibonacci, before = fibonacci + before, fibonacci
    for words in (list(fibonacci), list(thue), ["a"] * 300, list("ab" * 90 + "c" + "ab" * 50), list("abc" * 40 + "abd" * 40), list(("ab" * 12 + "c") * 9)):
        assert fast_runs(words) == slow_runs(words)
        assert fast_runs(words, 6, 3) == slow_runs(words, 6, 3)


def test_several_texts_do_not_mix():
    texts = [list("ab" * 20), list("ab" * 30), list("xyz"), [], ["a"], list("q" * 40)]
    assert runs._runs_of([[w.encode() for w in t] for t in texts], 24, 3) == [slow_runs(t) for t in texts]


def test_long_run_is_near_linear():
    rng = np.random.default_rng(1)
    body = [f"w{i}" for i in rng.integers(0, 300, 700)]
    words = body * 200
    assert fast_runs(words) == [(0, 140_000, 700)]
    assert fast_runs(["a"] * 50_000) == [(0, 50_000, 1)]


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(7)
    some = lambda n, v: " ".join(f"w{i}" for i in rng.integers(0, v, n))
    texts = [None, "", " \t\n ", "one", "Spam spam " * 40, ("a b\nc " * 30) + "tail", some(900, 2), some(3000, 500), "é ü " * 20, "x y " * 30, "A a " * 12]
    texts += [some(int(n), 40) for n in rng.integers(1, 300, 150)]
    texts += ["Same line of words that repeats itself here. " * k + some(20, 9) for k in range(1, 7)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "x y " * 50), (None, "z " * 30), (None, None)]
    docs = documents(spark, rows).withColumnRenamed("lang", "runs")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op13_periodic_runs(spark, str(tmp_path)).collect()
    want = [slow_row(*r) for r in rows]
    assert sum(w[1] > 0 for w in want) >= 20
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    out = runs.periodic_runs(documents(spark, []))
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "runs", "collapsed"]
