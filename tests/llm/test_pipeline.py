import subprocess
import sys

import numpy as np

import corpus_pipeline
from crowdtide.llm.catalog import ORACLES, QUERIES
from tests.llm.helpers import documents, sentence
from tests.llm.test_decontaminate import slow_tiles
from tests.llm.test_lines_and_tokens import expected_lines
from tests.llm.test_near_dup import classes
from tests.llm.helpers import words


def corpus(tmp_path, spark):
    rng = np.random.default_rng(21)
    item = sentence(rng, 30)
    shared = "This line of text is shared by several documents."
    base = sentence(rng, 120)
    texts = [sentence(rng, 80) + "\n" + (shared if i % 4 == 0 else sentence(rng, 9)) for i in range(60)]
    texts += [base, base + " end", base, sentence(rng, 40) + " " + item + " tail", None, ""]
    texts += [sentence(rng, 30) + " vile rotten vile " + sentence(rng, 10) for _ in range(40)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i >= 66)) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return texts, item


def test_every_stage_does_its_work(spark, tmp_path, monkeypatch):
    from crowdtide.llm import toxicity

    learn = toxicity.ftrl
    monkeypatch.setattr(toxicity, "ftrl", lambda e, y: learn(e, y, l1=2.0))
    texts, item = corpus(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, steps = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert i == 4 or docs.columns == columns
        steps.append(docs.collect())
    kept = [{r["doc_id"]: r for r in step} for step in steps]
    held = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "documents.parquet")).where(toxicity.fold("doc_id", 5) == 0).collect()}
    assert set(kept[0]) >= set(range(66)) and len([i for i in kept[0] if i >= 66 and i not in held]) <= 2
    lines = {i: t for i, _, _, t in expected_lines([(i, r["text"]) for i, r in kept[0].items()])}
    assert {i: r["text"] or "" for i, r in kept[1].items()} == lines
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept[1].values())
    named = classes([(i, r["text"]) for i, r in kept[1].items()])
    assert set(kept[2]) == {i for i, c in named.items() if i == c}
    leaking = {i for i, r in kept[2].items() if slow_tiles(words(item), words(r["text"]), 5) >= 15}
    assert leaking == {63} and set(kept[3]) == set(kept[2]) - leaking
    assert sum(r["n_tokens"] for r in steps[4]) == sum(len((r["text"] or "").encode().split()) + 1 for r in kept[3].values())
    monkeypatch.undo()


def test_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "piece", "first_token", "n_tokens", "bucket", "batch", "place"]
    n = got.select("doc_id").distinct().count()
    assert 0 < n < docs.count()


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) == {"op2_line_dedup", "op8_exact_top_k", "op12_prefix_trie"}


def test_entry_without_this_package(tmp_path):
    """The entry module imports, and keeps its other queries, where this package is gone."""
    code = (
        "import sys, importlib.machinery as m\n"
        "find = m.PathFinder.find_spec\n"
        "def hide(name, path=None, target=None):\n"
        "    return None if name in ('crowdtide.llm', 'corpus_pipeline') else find(name, path, target)\n"
        "m.PathFinder.find_spec = staticmethod(hide)\n"
        "import __spark_entry__ as e\n"
        "assert 'chat_buckets' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())\n"
        "assert 'pipeline' not in e.queries() and 'crowdtide.llm' not in sys.modules\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
