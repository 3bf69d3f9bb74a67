"""The registry: names, shapes and SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from subtide.plans import registry

SF = "/root/testdata/sf0.001"

LIGHT = ("c3_runs", "c6_find_mistimed", "c9_segment_report", "d3_fix_mistimed", "d6_splice", "a11_classify_media", "e1_plan_batches", "e9_check_counts")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["media_id", "group_ix"] and df.count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) > 70


@pytest.mark.parametrize("name", LIGHT)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations", "documents", "pages"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_library_does_not_import_llm():
    import pathlib

    root = pathlib.Path(entry.REPO) / "subtide"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "subtide.llm" not in path.read_text()
