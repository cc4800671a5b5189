import pytest
from pyspark.sql import functions as F

from spanveil import Quota, merge_profiles, profile, profile_sketches, save_profile, saved_profile, stats
from spanveil.operators.limits import stop_at_quota, stopped_error
from spanveil.operators.stats import mark_rows


def mails(spark, first, last):
    return spark.range(first, last).select(F.format_string("to u%d@x.org or 10.0.0.%d", F.col("id") % 20_000, F.col("id") % 7).alias("t"))


def exact(rows):
    return {(r.column, r.pii_type): (r.n, r.n_values) for r in rows.collect()}


def test_merged_sketches_are_near_the_exact_counts(spark):
    whole = mails(spark, 0, 30_000)
    want = exact(profile(whole))
    parts = profile_sketches(whole.withColumn("part", F.xxhash64("t") % 5), ["t"], by=["part"])
    got = exact(merge_profiles(parts))
    assert got.keys() == want.keys()
    for key, (n, values) in want.items():
        assert got[key][0] == n and abs(got[key][1] - values) <= 0.05 * values


def test_runs_add_up_and_a_repeated_run_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "profiles")
    for run, first, last in (("a", 0, 500), ("b", 300, 900), ("b", 300, 800)):
        save_profile(mails(spark, first, last), path, run)
    got = exact(saved_profile(spark, path))
    assert got["t", "Email Address"][0] == 1000 and abs(got["t", "Email Address"][1] - 800) <= 0.05 * 800
    assert got["t", "IP Address"] == (1000, 7)
    with pytest.raises(ValueError):
        save_profile(mails(spark, 0, 1), path, "a/b")


def test_nothing_found_has_no_profile(spark):
    assert profile_sketches(spark.createDataFrame([(None,), ("",)], "t string")).count() == 0


def test_files_stop_one_row_after_the_quota(spark):
    sizes = {"none over": 3, "exact": 5, "over": 6, "far over": 5000}
    rows = spark.createDataFrame([(f, i) for f, n in sizes.items() for i in range(n)], "file string, i int").repartition(8)
    quota = Quota(max_rows_per_file=5)
    stopped = stop_at_quota(rows, quota, ["i"])
    got = {r.file: r for r in stopped.groupBy("file").agg(F.count("*").alias("n"), F.max("i").alias("last")).withColumn("error", stopped_error(F.col("n"), quota)).collect()}
    assert {f: r.n for f, r in got.items()} == {f: min(n, 6) for f, n in sizes.items()}
    assert {f for f, r in got.items() if r.error} == {"over", "far over"} and got["far over"].last == 5
    assert stop_at_quota(rows, Quota(), ["i"]).count() == sum(sizes.values())


def test_the_limit_lies_below_the_exchange(spark):
    plan = stop_at_quota(spark.range(100).selectExpr("id % 3 as file", "id"), Quota(max_rows_per_file=2), ["id"])
    lines = plan._jdf.queryExecution().sparkPlan().toString().splitlines() + plan._jdf.queryExecution().executedPlan().toString().splitlines()
    text = "\n".join(lines[lines.index(next(x for x in lines if "Exchange" in x)) :])
    assert "WindowGroupLimit" in text and "Partial" in text


def test_totals_count_spans_and_no_types(spark):
    rows = spark.createDataFrame(
        [("f", "a@b.com 1.2.3.4", None), ("f", None, "x"), ("g", "", "555-123-4567")], "file string, a string, b string"
    )
    totals = stats(rows, by=["file"])
    assert {tuple(r) for r in totals.collect()} == {("f", 2, 2, 1, 1), ("g", 1, 1, 1, 1)}
    assert [tuple(r) for r in stats(rows.where("false"), ["a"]).collect()] == [(0, 0, 0, 0)]
    assert "by_type" not in totals._jdf.queryExecution().optimizedPlan().toString()


def test_marks_of_rows_with_and_without_spans(spark):
    rows = spark.createDataFrame([("a@b.com 1.2.3.4 c@d.org", "x"), ("", None)], "a string, b string")
    marked = mark_rows(rows, types=["email", "ip_address"]).collect()
    marks = [(m.pii.found, m.pii.cells, m.pii.by_type) for m in marked]
    assert sorted(marks) == [(0, 0, [0, 0]), (3, 1, [2, 1])]
