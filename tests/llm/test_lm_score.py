import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtide.llm import lm_score
from crowdtide.llm.arrays import mix
from crowdtide.llm.mixing import BIT, END, FIRST, N_INPUTS, NODE, PLACES, RARE, STEP, Block, Memo, Model, Places, base
from tests.llm.helpers import DOCS, documents, sentence


def block(*texts):
    raw = [t.encode() for t in texts]
    return Block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def trained():
    rng = np.random.default_rng(3)
    texts = [sentence(rng, 60, 50) for _ in range(80)]
    raw = [t.encode() for t in texts]
    chunks = [(np.frombuffer(b"".join(raw[i : i + 8]), np.uint8), np.cumsum([0, *map(len, raw[i : i + 8])])) for i in range(0, 80, 8)]
    return Model().learn_all(iter(chunks)), sentence(rng, 60, 50)


def test_every_byte_and_end_is_scored():
    b = block("ab", "", "né\n")
    assert np.bincount(b.doc, minlength=3).tolist() == [3, 1, 5]
    assert b.byte[b.which].tolist() == [97, 98, END, END, *"né\n".encode(), END]


def test_contexts_do_not_cross_texts():
    one, two = block("abc", "xyz"), block("xyz")
    assert {*one.key[one.which[4:]].tolist()} == {*two.key[two.which].tolist()}


def test_probabilities_add_up_to_hardly_less_than_one():
    model, text = trained()
    b = block(text)
    at = len(b.byte) // 2
    every = b.only(np.full(256, at))
    every.byte = np.arange(256)
    total = (10.0 ** model.log10(every)).sum()
    assert 0.95 < total <= 1 + 1e-9  # a common byte could also be spelled out, and never is


def test_learning_helps_and_survives_exchange():
    model, text = trained()
    b = block(text)
    bits = lambda m: -(m.log10(b)[b.which].sum()) / math.log10(2) / len(b.which)
    assert bits(model) < 2.2 < 6 < bits(Model())
    again = Model.of(model.cells())
    assert abs(bits(again) - bits(model)) < 1e-3
    memo = Memo(model)
    assert np.allclose(memo.log10(b), model.log10(b), atol=1e-5) and np.allclose(memo.log10(b), model.log10(b), atol=1e-5)


def test_a_byte_four_places_back_is_used():
    rng = np.random.default_rng(5)
    texts = ["   ".join("!?"[i] * 40) for i in rng.integers(0, 2, 60)]
    raw = [t.encode() for t in texts]
    model = Model().learn_all(iter([(np.frombuffer(x, np.uint8), np.array([0, len(x)])) for x in raw]))
    b = block(texts[0])
    score = model.log10(b)[b.which]
    assert -score[4:157:4].mean() / math.log10(2) < 0.5  # without order 4 about one bit


def test_steps_do_not_depend_on_pieces():
    rng = np.random.default_rng(4)
    raw = [sentence(rng, 60, 50).encode() for _ in range(2800)]
    pieces = lambda n: iter([(np.frombuffer(b"".join(raw[i : i + n]), np.uint8), np.cumsum([0, *map(len, raw[i : i + n])])) for i in range(0, len(raw), n)])
    one, many = Model().learn_all(pieces(len(raw))), Model().learn_all(pieces(7))
    assert np.array_equal(one.counts, many.counts) and np.allclose(one.weights, many.weights)
    places = sum(map(len, raw)) + len(raw)
    assert one.used.reshape(13, -1).sum(axis=1)[0] == places  # every place is learned from once


def test_merged_blocks_count_alike():
    a, b = block("the cat"), block("the cat", "a dog")
    both = block("the cat", "the cat", "a dog")
    merged = Block.merged([a, b])
    assert dict(zip(merged.key.tolist(), merged.count.tolist(), strict=True)) == dict(zip(both.key.tolist(), both.count.tolist(), strict=True))


def test_counts_equal_those_of_every_decision_taken_alone():
    rng = np.random.default_rng(6)
    raw = [x.encode() for x in [*(sentence(rng, 90, 40) for _ in range(60)), "", "Née le 3.\n", "x" * 300]]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    places = Places(data, offsets)
    assert STEP < 2 * len(places.byte)
    model = Model().learn_all(iter([(data, offsets)]))
    recent, word, counts = places.recent.tolist(), mix(places.word), np.zeros(model.counts.size, np.float32)
    for i, byte in enumerate(places.byte.tolist()):
        contexts = [np.array([recent[i] & ((1 << 8 * k) - 1)], np.uint64) for k in range(5)] + [word[i : i + 1]]
        starts = [int(base(j, contexts[j])[0]) for j in range(N_INPUTS)]
        for t in range(PLACES if RARE[byte] else FIRST):
            for start in starts:
                counts[start ^ int(2 * NODE[byte, t] + BIT[byte, t])] += 1
    assert np.array_equal(model.counts.reshape(-1), counts)


def test_a_short_context_is_read_once_a_step():
    rng = np.random.default_rng(8)
    b = block(*(sentence(rng, 60, 200) for _ in range(40)))
    sizes = []
    for k, (first, run, start) in enumerate(b.runs()):
        same = list(zip((b.recent & np.uint64((1 << 8 * k) - 1)).tolist(), b.byte.tolist(), strict=True))
        assert len(first) == len(start) == len(set(same))
        assert [same[i] for i in first[run]] == same
        sizes.append(len(first))
    assert sizes[0] < sizes[1] < sizes[2] < sizes[3] < len(b.byte) / 2 < len(b.byte)


def test_tokens_are_those_of_split():
    texts = [None, "", " ", "\tA b\x0b", "éÉ x\x1cy", " z", "q ", " "]
    for own in (texts, texts[2:6], texts[:2]):
        raw = [(x or "").encode() for x in own]
        token, doc = lm_score.tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        token.validate(full=True)
        assert [*zip(doc.tolist(), token.to_pylist(), strict=True)] == [(i, w.decode()) for i, x in enumerate(raw) for w in [*x.lower().split(), b""]]


def expected(rows):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    tokens = lambda t: [x.decode() for x in (t or "").encode().lower().split()] + [""]
    counts = Counter(x for i, t in rows if fold(i) != 2 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = tokens(t)
        out.append((i, fold(i) == 2, len(own), sum(counts[x] > 0 for x in own), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own)))
    return out


@pytest.mark.parametrize("frequent", [3, 1 << 16])
def test_base_equals_brute_force(spark, frequent):
    rng = np.random.default_rng(7)
    texts = [sentence(rng, int(n), 80) for n in rng.integers(0, 40, 60)] + [None, "", "ÉTÉ Été x\x1cy THE the", "z" * 5000, "z" * 5000, "only once here", "w1 " * 3000]
    rows = [*enumerate(texts), (None, "w1 w2"), (3, "w1"), (3, "w1")]
    docs = documents(spark, rows).withColumn("score", F.lit("clash")).withColumn("row", F.lit(0))
    got = lm_score.score_texts(docs, frequent=frequent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=key), sorted(expected(rows), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6
    assert all(r["score"] < 0 for r in got)
    fewer = [r["score"] / (len(texts[r["doc_id"]].encode()) + 1) for r in got if r["doc_id"] is not None and r["doc_id"] < 60 and r["held_out"]]
    assert np.mean(fewer) > -8 * math.log10(2) * 0.6


def test_nothing(spark):
    assert lm_score.score_texts(spark.createDataFrame([], DOCS)).count() == 0
    got = lm_score.score_texts(documents(spark, [(2, "held out alone?"), (3, None)])).collect()
    assert len(got) == 2


def test_bits_per_byte(spark):
    texts = ["the cat sat on the mat", "", None, "né", "a dog " * 50]
    got = lm_score.score_texts(documents(spark, [*enumerate(texts)])).collect()
    for r in got:
        size = len((texts[r["doc_id"]] or "").encode()) + 1
        assert abs(r["bits_per_byte"] + r["score"] / math.log10(2) / size) < 1e-9
