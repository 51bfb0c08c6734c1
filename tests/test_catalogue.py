import os

import duckdb
import pytest
from compare import assert_same

from quarry.plans import catalogue

#: Large enough that every branch of a query has rows.
MORE = os.environ.get("TEST_CATALOGUE_DIR", "/root/testdata/sf0.01")
#: Columns that hold one value in all rows of these tables: one edit is all that candidates may have, every section is
#: used on every day, lists and days are cut alike. Their queries say nothing about these columns.
CONSTANT = {
    "copied_assignments": {"shift"}, "counter_breaks": {"step"}, "golden_compare": {"compared", "extra", "missing"}, "levenshtein_candidates": {"edits"}, "month_matrix": {"d31"},
    "names_by_recent_use": {"last_day"}, "split_padded": {"a"}, "target_gap": {"days", "days_since", "last_day"}, "union_of_days": {"sections"},
}


@pytest.fixture(scope="module")
def more():
    con = duckdb.connect()
    for f in os.listdir(MORE):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{MORE}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(name, spark, more):
    df = catalogue.QUERIES[name](spark, MORE).persist()
    try:
        assert_same(df, more, catalogue.ORACLES[name])
        rows = df.collect()
    finally:
        df.unpersist()
    assert rows, "no rows: the comparison says nothing"
    same = {c for c in df.columns if len({str(r[c]) for r in rows}) == 1} if len(rows) > 1 else set()
    assert same <= CONSTANT.get(name, set()), f"one value in all rows: {sorted(same)}"


def test_entry_point_registers_everything():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
