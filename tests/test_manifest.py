import pytest
from pyspark.sql import functions as F

from spanveil import scrub_files
from spanveil.sources.manifest import damaged_parts, read_by_manifest, read_manifest


def saved(spark, tmp_path, **more):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("".join(f"line {i} a@b.com\n" for i in range(300)))
    (source / "b.txt").write_text("one\n\nthree\n")
    (source / "t.csv").write_text("id,m\n1,x@y.org\n")
    out = str(tmp_path / "out")
    run = scrub_files(spark, [str(source)], types=["email"], text_mode="line")
    return run, out


def test_lines_come_back_in_order(spark, tmp_path):
    run, out = saved(spark, tmp_path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        run.save_with_manifest(out)
        rows = read_by_manifest(spark, out).orderBy("out_file", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in rows:
        got.setdefault((r["shape"], r.out_file.split("_")[0].split(".")[0]), []).append((r.line_no, r.line))
    want = {"a": [f"line {i} ***@b.com" for i in range(300)], "b": ["one", "", "three"], "t": ["id,m", "1,***@y.org"]}
    found = {name: [line for _, line in lines] for (_, name), lines in got.items()}
    assert found == want
    assert all([n for n, _ in lines] == list(range(len(lines))) for lines in got.values())
    assert damaged_parts(spark, out).count() == 0
    assert read_manifest(spark, out).agg(F.sum("rows")).first()[0] == 305


def test_damage_is_seen_and_no_manifest_is_an_error(spark, tmp_path):
    run, out = saved(spark, tmp_path)
    run.save_successful(out)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_by_manifest(spark, out)
    run.save_with_manifest(out + "2")
    part = next(p for p in (tmp_path / "out2" / "lines").rglob("part-*.txt") if "one" in p.read_text())
    part.write_text(part.read_text().replace("three", "thref"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert [r.part for r in damaged_parts(spark, out + "2").collect()] == [part.name]
