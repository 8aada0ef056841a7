import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "filter_messages", "chat_buckets", "reaction_scores", "attach_peaks", "transcript_buckets", "align", "lag_pairs", "signal_events", "insight_summary",
    "session_evaluation", "cohort_summary", "compare_to_baseline", "peak_first_sample", "upsert", "validate_envelope", "review_queue_filter", "transcript_target",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"session_id", "type", "severity"} <= set(df.columns) and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


@pytest.mark.parametrize("gone", [("crowdtide/llm", "tests/llm"), ("crowdtide/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_training_text_package(tmp_path, gone):
    """A real copy of the repository, less these folders, imports and keeps its other queries."""
    root = Path(__file__).resolve().parents[1]
    away = {str(root / g) for g in gone}

    def leave_out(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or n.startswith(".") or f"{folder}/{n}" in away]

    copy = shutil.copytree(root, tmp_path / "repo", ignore=leave_out)
    assert not any((copy / g).exists() for g in gone)
    code = (
        "import sys, __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'chat_buckets' in names and 'pipeline' not in names and not any(n[:2] == 'op' and n[2].isdigit() for n in names)\n"
        "assert set(e.oracle_sql()) <= set(names)\n"
        f"assert e.__file__.startswith({str(copy)!r})\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
