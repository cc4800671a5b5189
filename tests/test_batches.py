import shutil

import pytest
from pyspark.sql import functions as F

from spanveil import scrub, stats, type_counts
from spanveil.streaming.batches import (
    batch_progress,
    batch_rows,
    dead_letters,
    running_totals,
    running_types,
    scrub_batches,
    stream_files,
)

SCHEMA = "id int, t string"
FILES = {
    "a.csv": "1,mail a@b.com\n2,nothing\nbad,x@y.org\n",
    "b.csv": "3,10.0.0.1 and c@d.org\n4,e@f.net\n",
    "c.csv": "5,none\n6,g@h.io,extra\n",
    "d.csv": "7,i@j.com\n",
}
GOOD = [("a", 1, "mail a@b.com"), ("a", 2, "nothing"), ("b", 3, "10.0.0.1 and c@d.org"), ("b", 4, "e@f.net"), ("c", 5, "none"), ("d", 7, "i@j.com")]


def name(column="file"):
    return F.regexp_extract(column, r"([^/]+)\.csv$", 1).alias("file")


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for f, body in FILES.items():
        (folder / f).write_text(body)
    return folder


def start(spark, source, tmp_path, **more):
    stream = stream_files(spark, str(source), SCHEMA, maxFilesPerTrigger=1)
    scrub_batches(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["t"], **more).awaitTermination()


def check(spark, out):
    good = spark.createDataFrame(GOOD, "file string, id int, t string")
    got = batch_rows(spark, out).select(name(), "id", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scrub(good, ["t"]).collect()))
    dead = dead_letters(spark, out).select(name(), "_corrupt", "error").collect()
    assert sorted((r.file, r._corrupt) for r in dead) == [("a", "bad,x@y.org"), ("c", "6,g@h.io,extra")]
    want = stats(good, ["t"], by=["file"])
    got = running_totals(spark, out).select(name(), *[c for c in want.columns if c != "file"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = running_types(spark, out).select(name(), "pii_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, type_counts(good, ["t"], by=["file"]).collect()))


def test_batches_equal_one_job_and_replays_replace(spark, source, tmp_path):
    start(spark, source, tmp_path)
    out = str(tmp_path / "out")
    check(spark, out)
    # A batch whose commit was lost is run again under its number.
    last = max((tmp_path / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    kept = tmp_path / "kept"
    shutil.copytree(tmp_path / "ckpt", kept, ignore=lambda folder, names: [n for n in names if n.endswith("commits") or last.name in n and "commits" in folder])
    (kept / "commits").mkdir()
    for commit in (tmp_path / "ckpt" / "commits").iterdir():
        if last.name not in commit.name:
            shutil.copy(commit, kept / "commits" / commit.name)
    stream = stream_files(spark, str(source), SCHEMA, maxFilesPerTrigger=1)
    scrub_batches(stream, out, str(kept), ["t"]).awaitTermination()
    check(spark, out)


def test_own_reasons_and_clean_streams(spark, source, tmp_path):
    start(spark, source, tmp_path, error=F.when(F.length("t") > 15, F.lit("too long")), method="remove")
    out = str(tmp_path / "out")
    dead = dead_letters(spark, out).groupBy("error").count().collect()
    assert {r.error: r["count"] for r in dead} == {"too long": 1, "The record does not fit the schema": 2}
    assert batch_rows(spark, out).count() == 5


def test_progress_rises_to_every_byte_and_row(spark, source, tmp_path):
    (source / "empty.csv").write_text("")
    start(spark, source, tmp_path)
    steps = batch_progress(spark, str(tmp_path / "out"), [str(source)]).orderBy("batch").collect()
    percents = [s.percent for s in steps]
    assert percents == sorted(percents) and percents[-1] == 100.0
    assert [s.phase for s in steps] == ["scanning"] * 3 + ["complete"]
    assert steps[-1].files == len(FILES) + 1 and steps[-1].bytes == sum(map(len, FILES.values()))
    assert steps[-1].rows_processed == len(GOOD)
    (source / "late.csv").write_text("8,more@x.org\n")
    late = batch_progress(spark, str(tmp_path / "out"), [str(source)]).orderBy("batch").collect()
    assert late[-1].phase == "scanning" and late[-1].percent < 100.0
