import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdtide.llm import line_dedup, token_counts
from tests.llm.helpers import DOCS, documents

SPACE = " \t\n\x0b\f\r"


def expected_lines(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(SPACE).translate(lower)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) > 1 and min(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = ["Shared line number one", "  shared LINE number one\t", "ÉTÉ très été long", "été très été long", "short", "", "a longer line\r", "nine char"]
    texts = ["\n".join(rng.choice(pool, rng.integers(0, 6))) for _ in range(60)]
    texts += [None, "", "\n\n", "Shared line number one\n" * 3, "x" * 50_000 + "\nShared line number one"]
    rows = list(enumerate(texts))
    docs = documents(spark, texts).withColumn("n_lines", F.lit("clash"))
    got = line_dedup.dedup_lines(docs, batches=4, fanout=2)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    found = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect())
    assert found == expected_lines(rows)
    assert [r["text"] for r in got.where("doc_id = 60").collect()] == [None]


def test_line_dedup_repeated_and_missing_ids(spark):
    rows = [(1, "the same line here"), (1, "other text\nthe same line here"), (2, "the same line here"), (None, "the same line here\nown"), (None, "zz")]
    got = line_dedup.dedup_lines(documents(spark, rows), batches=2).select("doc_id", "text", "n_dropped").collect()
    assert sorted((r["doc_id"] or 99, r["text"], r["n_dropped"]) for r in got) == [
        (1, "other text\nthe same line here", 0), (1, "the same line here", 0), (2, "", 1), (99, "own", 1), (99, "zz", 0),
    ]


def test_line_dedup_with_mostly_null_and_very_large_ids(spark):
    same = "the same line here"
    rows = [(None, f"{same}\nown {i}") for i in range(8)] + [(2**63 - 2, same), (2**63 - 3, same), (-(2**63), same)]
    got = line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "text").collect()
    want = [(None, f"own {i}") for i in range(8)] + [(2**63 - 2, ""), (2**63 - 3, ""), (-(2**63), same)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = documents(spark, [(None, same), (None, same)])
    assert [r["text"] for r in line_dedup.dedup_lines(none).collect()] == [same, same]


def test_line_runs_leave_the_catalog_after_a_failure(spark, monkeypatch):
    def fail(self, name):
        raise RuntimeError("lost")

    monkeypatch.setattr(line_dedup._Runs, "add", fail)
    with pytest.raises(RuntimeError):
        line_dedup.dedup_lines(documents(spark, ["one and the same line", "one and the same line"]))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_query_hash(spark, tmp_path):
    documents(spark, ["one line of text\nx", None]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: hashlib.sha256(b"one line of text\nx").hexdigest(), 1: hashlib.sha256(b"").hexdigest()}


TEXTS = [
    None, "", "plain words here", "it's they'll I'm we've you'd don't", "tabs\t\tand  double   spaces \n\n lines\r\n ", "1234 5,6 x7y _under_score__",
    "café naïve ÀÉÎ ñandú ßtraße", "2² x³ ½ cup ¼", "non breaking", "\x1cseparators\x1d", "<|endoftext|>", "before <|endoftext|> after", "日本語 と emoji 🎉🎉",
    "a" * 3000, "ab " * 2000, "!!! ??? ...", " leading", "trailing ", "'s 't", "é combining", " line", "ſ long s",
]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    alphabet = list("abcdeXYZ 019'._-\n\té²ß ")
    texts = TEXTS + ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(300)]
    docs = documents(spark, texts).withColumn("n_tokens", F.lit(-1))
    tokenizer = Tokenizer.from_file(token_counts.byte_bpe_path())
    want = {i: (len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in enumerate(texts)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, limit=20, frequent=50).collect()}
    assert got == want


def test_small_cache_changes_nothing(spark, monkeypatch):
    lengths = token_counts.Lengths(open(token_counts.byte_bpe_path(), encoding="utf-8").read(), {"the": 1})
    monkeypatch.setattr(token_counts, "CACHED", 3)
    assert [lengths[p] for p in ["the", " one", " two", " unbelievably", " one", " three", "the"]] == [1, 1, 1, lengths.encoded(" unbelievably"), 1, 1, 1]
    assert len(lengths) <= 4


def test_token_counts_of_nothing(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "x y"), (5, "x y"), (5, "x y")]
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count_tokens(documents(spark, rows)).collect()) == [(0, 2), (5, 2), (5, 2)]
