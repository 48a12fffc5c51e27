import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tallybrook.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def value(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(value(r[c]) for c in columns) for r in df.collect()]
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert ordered(got) == ordered(tuple(value(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("permutation", "redact_pii", "pii_totals", "title_match", "dedupe_two_key"):
        assert registry.queries()[name](spark, DIR).count() > 0


def test_the_rest_works_without_the_training_data_folders(tmp_path):
    """A copy without them, and without their tests, gives every other query and SQL; with the pipeline's file and without."""
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "tallybrook", tmp_path / "tallybrook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sorted(q))"
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
        assert out.returncode == 0, out.stderr
        assert out.stdout.strip().splitlines()[-1] == str(sorted(registry.queries()))
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
