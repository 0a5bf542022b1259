"""A stored run is compared where it lies."""

from corpuswarden.operators import findings as fnd
from corpuswarden.schema import FINDINGS
from corpuswarden.sources import findings_table as ft


def findings_of(spark, *rows):
    return spark.createDataFrame([(r, c, f, n, s, "CONFIRMED", "") for r, c, f, n, s in rows], FINDINGS)


OLD = [("a", "S1", "x", 1, "s"), ("a", "S1", "x", 1, "t"), ("a", "R2", "x", 2, "s"), ("b", "S1", "y", 1, "s")]
NEW = [("a", "S1", "x", 1, "u"), ("a", "R2", "x", 3, "s"), ("a", "R2", "x", 3, "s"), ("c", "O1", "z", 9, "s")]


def rows(df):
    return sorted(map(tuple, df.collect()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_diff_equals_that_of_two_runs_and_moves_one(spark, tmp_path):
    old, new = findings_of(spark, *OLD * 30), findings_of(spark, *NEW)
    ft.store(old, "kept_a", str(tmp_path / "a b"), 4)
    diff = ft.diff(spark.table("kept_a"), new)
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 4 out of 4" in plan and "SortMergeJoin" in plan
    assert exchanges(diff) == 1  # of the new run alone
    stored_side = plan[plan.index("SortMergeJoin"):plan.index("FileScan")]
    assert "Exchange" not in stored_side
    assert rows(diff) == rows(fnd.run_diff(old, new))


def test_a_session_that_does_not_know_the_table_attaches_it(spark, tmp_path):
    old, new = findings_of(spark, *OLD), findings_of(spark, *NEW)
    ft.store(old, "kept_b", str(tmp_path / "t"), 4)
    spark.sql("drop table kept_b")  # the files of a table with a place of its own stay
    again = ft.attach(spark, "kept_b2", str(tmp_path / "t"), 4)
    diff = ft.diff(again, new)
    assert exchanges(diff) == 1 and rows(diff) == rows(fnd.run_diff(old, new))


def test_storing_again_replaces(spark, tmp_path):
    for part in (OLD, NEW):
        ft.store(findings_of(spark, *part), "kept_c", str(tmp_path / "t"), 4)
    assert spark.table("kept_c").count() == 3
    assert rows(ft.diff(spark.table("kept_c"), findings_of(spark))) == rows(
        fnd.run_diff(findings_of(spark, *NEW), findings_of(spark)))
