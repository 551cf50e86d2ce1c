"""Registered queries against their SQL on the smallest tables, and the entry without the optional part."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql()])
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "gridloom", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "gridloom").mkdir()
    for p in (ROOT / "gridloom").iterdir():
        if p.name != "llm":
            (tmp_path / "gridloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 60 and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
