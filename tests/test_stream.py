import shutil

from pyspark.sql import functions as F

from spanveil import running_type_counts, scrub, scrub_stream
from spanveil.operators.scrub import scrub_marked
from spanveil.operators.stats import mark_rows
from spanveil.plans.queries import QUERIES
from spanveil.streaming.progress import ProgressListener, observe_batch, observe_stream
from spanveil.streaming.scrub import stream_lines, stream_table, write_stream

LINES = ["mail a@b.com", "nothing", "10.0.0.1 and 10.0.0.2", "c@d.org"]


def test_lines_equal_batch_and_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.txt").write_text("\n".join(LINES[:2]))
    out, mark = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for name, body in [(None, None), ("two.txt", "\n".join(LINES[2:]))]:
        if name:
            (source / name).write_text(body)
        write_stream(scrub_stream(stream_lines(spark, str(source)), ["value"]), out, mark, fmt="text").awaitTermination()
    batch = scrub(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert sorted(spark.read.text(out).collect()) == sorted(batch.collect())


def test_csv_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("id,t\n1,a@b.com\n2,none\n")
    stream = stream_table(spark, str(source), "id string, t string", "csv", "*.csv", header=True)
    write_stream(scrub_stream(stream, ["t"]), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("1", "***@b.com"), ("2", "none")}


def test_running_counts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, line in enumerate(LINES):
        (source / f"{i}.txt").write_text(line)
    counts = running_type_counts(spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("running").collect()} == {("Email Address", 2), ("IP Address", 2)}


def test_progress(spark, tmp_path):
    rows = spark.createDataFrame([(x,) for x in LINES], "value string")
    watched, seen = observe_batch(scrub_marked(rows))
    watched.write.format("noop").mode("overwrite").save()
    want = {"rows_processed": 4, "rows_affected": 3, "pii_found": 4, "cells_affected": 3}
    assert seen.get == want
    source = tmp_path / "in"
    source.mkdir()
    for i, line in enumerate(LINES):
        (source / f"{i}.txt").write_text(line)
    listener = ProgressListener("watched")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.option("maxFilesPerTrigger", 2).text(str(source))
        q = (
            observe_stream(mark_rows(stream), "watched")
            .writeStream.format("noop")
            .trigger(availableNow=True)
            .option("checkpointLocation", str(tmp_path / "ckpt"))
            .start()
        )
        q.awaitTermination()
        for _ in range(100):
            if listener.progress.phase == "complete":
                break
            spark.range(1).select(F.expr("reflect('java.lang.Thread', 'yield')")).collect()
    finally:
        spark.streams.removeListener(listener)
    p = listener.progress
    assert (p.phase, p.rows_processed, p.pii_found, p.rows_affected) == ("complete", 4, 4, 3)


def test_document_streams_read_a_file_and_a_folder_of_parts(spark, tmp_path):
    rows = [(i, LINES[i % len(LINES)], "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder, single = tmp_path / "folder", tmp_path / "single"
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    docs.limit(2).write.parquet(str(folder / "pages.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    single.mkdir()
    shutil.copy(next((tmp_path / "one").glob("part-*.parquet")), single / "documents.parquet")
    for root in (folder, single):
        scrubbed = scrub(docs.select(F.col("doc_id").alias("id"), "text"), ["text"])
        assert sorted(QUERIES["stream_table"](spark, str(root)).collect()) == sorted(scrubbed.collect())
        counts = {r.pii_type: r.n for r in QUERIES["stream_type_counts"](spark, str(root)).collect()}
        assert counts == {"Email Address": 20, "IP Address": 20}
