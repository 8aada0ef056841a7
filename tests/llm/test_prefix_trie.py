import hashlib
import re
import zlib

import numpy as np
import pytest

from crowdtide.llm import prefix_trie as trie

WORD = re.compile("[^\x20\x09-\x0d]+")
TURNS = "conv_id long, turn long, role string, text string, lang string"


def slow_turns(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[3] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def slow_nodes(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    rows = []
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = own + sum(saved[q] for q in below)
        leaves[p] = sum(leaves[q] for q in below) if below else 1
    for p, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        parent = min(members[p[:-1]]) if p else None
        rows.append((min(m), len(p), parent, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    assert df.columns == trie.NODE
    return sorted(map(tuple, df.collect()), key=str)


def some_rows(seed, n, longest, alphabet=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        size = int(rng.integers(0, longest + 1))
        for t in range(size):
            # the second half mostly copies the first turns, so that long openings are shared
            word = int(rng.integers(0, alphabet)) if rng.random() < 0.15 or t < 2 else 0
            rows.append((c, t, "user" if t % 2 else "bot", " ".join(["x"] * (t % 5)) + f" w{word}", "en"))
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


@pytest.mark.parametrize("segment,block", [(4, 3), (3, 50), (1, 2), (1024, 8192), (1024, 2)])
def test_trie_equals_brute_force(spark, segment, block):
    rows = some_rows(segment, 60, 14)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert got(trie.build_trie(df, segment, block)) == slow_nodes(slow_turns(rows))


def test_copies_across_blocks(spark):
    """A third of all conversations are the same, others extend it; one conversation is much longer than a segment."""
    body = [(t, "r", f"turn {t}") for t in range(9)]
    rows = [(c, *t, "") for c in range(40) for t in body] + [(100 + c, *t, "") for c in range(20) for t in [*body, (9, "r", f"more {c % 3}")]]
    rows += [(300, t, "r", f"turn {t}", "") for t in range(75)] + [(301, t, "r", f"turn {t}", "") for t in range(72)] + [(200 + c, *t, "") for c in range(9) for t in body[:c]]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    want = slow_nodes(slow_turns(rows))
    for segment, block in ((5, 4), (8, 7), (9, 1000), (1024, 6)):
        assert got(trie.build_trie(df, segment, block)) == want


ODD = [
    (0, None, "user", "first of all", ""), (0, 1, None, "a b", ""), (0, 2, "bot", None, ""), (0, 2, "bot", None, ""), (0, 5, "bot", "x\ty\nz", ""),
    (7, 1, "user", "a b", ""), (8, None, None, None, ""), (9, 3, "", "", ""), (20, 1, "u", "ser", ""), (21, 1, "us", "er", ""), (33, 1, "us", "er", ""), (None, 1, "user", "lost", ""),
    (-3, 1, "us", "er", ""), (2**62, 1, "us", "er", ""), (1007, 1, "a", "only one turn of an absent first conversation", ""), (41, 0, "r", "y " * 50_000, ""),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, TURNS).withColumnRenamed("lang", "depth")
    want = slow_nodes(slow_turns(ODD))
    assert got(trie.build_trie(df)) == want
    assert got(trie.build_trie(df, 2, 2)) == want


def test_empty_table(spark):
    assert trie.build_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_last_turns(spark):
    rows = [r for r in ODD if r[0] in (0, 7, 20, 21)]
    df = spark.createDataFrame(rows, TURNS)
    convs = slow_turns(rows)
    for r in trie.with_last_turn(trie.build_trie(df), df).collect():
        assert (r["role"], r["text"]) == (convs[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None))


def test_query_equals_brute_force(spark, tmp_path):
    rows = [r for r in ODD if r[0] is None or r[0] >= 0] + [(c + 50, *r) for c, *r in some_rows(11, 140, 8)]
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    nodes = trie.op12_prefix_trie(spark, str(tmp_path))
    assert got(nodes) == slow_nodes(rebuilt(slow_turns(rows)))


@pytest.mark.parametrize("segment,block", [(2, 3), (3, 2), (1, 100)])
def test_rebuilt_conversations_in_segments(spark, segment, block):
    rows = [(c, *r) for c, *r in some_rows(5, 90, 9)]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    pieces = trie.numbered_pieces(trie.digested_turns(df), segment)
    assert got(trie.trie_nodes(trie.rebuilt_parts(pieces), segment, block)) == slow_nodes(rebuilt(slow_turns(rows)))
