import re

import pytest
from pyspark.sql import functions as F

from spanveil import LIMITED, Quota, register, scrub_files
from spanveil.functions.catalog import TypeNotAllowed, parse_method, parse_types, type_catalog
from spanveil.functions.naming import file_kind, output_name, preview, reported_extension
from spanveil.operators.limits import cell_error, split_by_status, validate_files
from spanveil.plans.fixtures import workbook_bytes
from spanveil.sources.files import (
    csv_cells, kind_of, number_lines, read_csv, read_csv_checked, read_lines, read_numbered_lines, read_texts, split_by_kind,
)
from spanveil.sources.sinks import preview_records, write_csv
from spanveil.sources.workbook import read_workbooks
from spanveil.sources.workspace import shared_dir, small_side, staged

NAMES = {
    "a/Data.CSV": ("csv", "csv", "Data_scrubbed.csv"),
    "book.xlsx": ("xlsx", "xlsx", "book_scrubbed.csv"),
    "old.XLS": ("xls", "xls", "old_scrubbed.csv"),
    "x.y.json": ("json", "json", "x.y_scrubbed.json"),
    "notes.md": ("txt", "md", "notes_scrubbed.md"),
    "dir.v2/README": ("txt", "txt", "README_scrubbed.csv"),
    ".hidden": ("txt", "txt", ".hidden_scrubbed.csv"),
    "end.": ("txt", "", "end_scrubbed."),
}


def test_names(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = rows.select("n", file_kind("n").alias("k"), reported_extension("n").alias("r"), output_name("n").alias("o"))
    assert {r.n: (r.k, r.r, r.o) for r in got.collect()} == NAMES
    assert all(kind_of(n) == want[0] for n, want in NAMES.items())


def test_preview(texts):
    long = "é" * 2001
    got = texts(["é" * 2000, long, ""], preview("t"))
    assert got == ["é" * 2000, "é" * 2000 + "...\n\n[Truncated - 2001 total characters]", ""]


def test_type_and_method_options(spark):
    assert parse_types(["DOB", "nope", "Email", "creditcard", "dob"]) == ("date_of_birth", "email", "credit_card")
    assert len(parse_types()) == len(parse_types(["nope"])) == 12
    assert parse_types(["creditcard"], LIMITED.allowed_types) == ("credit_card",)
    assert parse_types([], LIMITED.allowed_types) == ("email", "phone", "ssn", "credit_card")
    with pytest.raises(TypeNotAllowed):
        parse_types(["ip"], LIMITED.allowed_types)
    assert [parse_method(m) for m in ("HASH", "shred", "Fake")] == ["hash", "mask", "fake"]
    assert type_catalog(spark, LIMITED.allowed_types).where("available").count() == 4


def test_csv_cells_are_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v,w\n007,"a, ""b""",\n1,"two\nlines",x\n\n')
    got = read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in got] == [("007", 'a, "b"', ""), ("1", "two\nlines", "x")]
    write_csv(read_csv(spark, str(tmp_path / "a.csv")), str(tmp_path / "out"))
    assert sorted(read_csv(spark, str(tmp_path / "out")).collect()) == sorted(got)


def test_headers_of_one_call_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n")
    (tmp_path / "b.csv").write_text("id,other\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["id", "v"]).collect()


def test_ragged_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n1,2\n1,2,3,4\n,,\n")
    rows = read_csv_checked(spark, str(tmp_path / "a.csv"))
    assert rows.agg(F.count_if("_ragged")).first()[0] == 2
    assert rows.count() == 4


def test_texts_and_lines(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes(b"one\r\ntwo\n\nthree\xff")
    whole = read_texts(spark, str(tmp_path / "a b.txt")).first()
    assert whole.text == "one\r\ntwo\n\nthree�" and whole.file.endswith("a b.txt")
    assert [r.line for r in read_lines(spark, str(tmp_path / "a b.txt")).collect()] == ["one", "two", "", "three�"]
    rows = spark.createDataFrame([("f", "x\r\ny\n\nz\n"), ("g", ""), ("h", "q")], "file string, text string")
    assert [(r.file, r.line_no, r.line) for r in number_lines(rows).collect()] == [
        ("f", 0, "x"),
        ("f", 1, "y"),
        ("f", 2, ""),
        ("f", 3, "z"),
        ("h", 0, "q"),
    ]


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes([["id", "mail"], ["1", "a@b.com & <c>"], ["2", ""]]))
    (tmp_path / "b.xlsx").write_bytes(b"not a workbook")
    rows = read_workbooks(spark, str(tmp_path / "*.xlsx")).collect()
    good = sorted((r.row_idx, r.cells) for r in rows if r.error is None)
    assert good == [(0, ["id", "mail"]), (1, ["1", "a@b.com & <c>"]), (2, ["2", ""])]
    assert [r.file[-6:] for r in rows if r.error] == ["b.xlsx"]


@pytest.fixture
def batch(tmp_path):
    files = {
        "a.csv": 'id,ab@joe.com,note\n1,"call 555-123-4567, now",x\n2,,"multi\nline a@b.io"\n',
        "bad.csv": "id,c,note\n1,2\n",
        "empty.csv": "id,c\n",
        "t.txt": "hello a@b.com\nsecond 10.0.0.1",
        "big.TXT": "l1 a@b.com\r\nl2\n" * 100,
        "j.json": '{"e":"q@w.org"}',
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode())
    (tmp_path / "w.xlsx").write_bytes(workbook_bytes([["h@x.io"], ["1.2.3.4"], ["plain"]]))
    return tmp_path, [str(tmp_path / n) for n in [*files, "w.xlsx"]]


@pytest.mark.parametrize("stage", [False, True])
def test_one_call(spark, batch, stage):
    folder, paths = batch
    run = scrub_files(spark, paths, text_mode="line", stage=stage)
    got = {r.file.rsplit("/", 1)[1]: r for r in run.report.collect()}
    counts = {k: (r.success, r.pii_found, r.rows_processed, r.rows_affected, r.cells_affected) for k, r in got.items()}
    assert counts == {
        "a.csv": (True, 3, 2, 2, 2),
        "bad.csv": (False, 0, 0, 0, 0),
        "empty.csv": (True, 0, 0, 0, 0),
        "t.txt": (True, 2, 2, 2, 2),
        "big.TXT": (True, 100, 200, 100, 100),
        "j.json": (True, 1, 1, 1, 1),
        "w.xlsx": (True, 2, 2, 1, 1),
    }
    assert got["t.txt"].preview == "hello ***@b.com\nsecond ***.***.***.***\n"
    assert got["a.csv"].preview == 'id,***@joe.com,note\n1,"call ***-***-4567, now",x\n2,,"multi\nline ***@b.io"\n'
    long = "l1 ***@b.com\nl2\n" * 100
    assert len(long) < 2000 and got["big.TXT"].preview == long and got["w.xlsx"].preview == "***@x.io\n***.***.***.***\nplain\n"
    assert got["bad.csv"].error.startswith("CSV error") and got["w.xlsx"].out_file == "w_scrubbed.csv"
    by_type = {(r.file.rsplit("/", 1)[1], r.pii_type): r.n for r in run.type_report.collect()}
    assert by_type[("big.TXT", "Email Address")] == 100 and by_type[("w.xlsx", "IP Address")] == 1
    run.save_successful(str(folder / f"out{stage}"))
    written = {p.parent.name for p in (folder / f"out{stage}").rglob("part-*")}
    assert "out_file=a_scrubbed.csv" in written and "out_file=bad_scrubbed.csv" not in written
    sheet = next((folder / f"out{stage}").rglob("out_file=w_scrubbed.csv/part-*")).read_text()
    assert sheet == "***@x.io\n***.***.***.***\nplain\n"
    text = next((folder / f"out{stage}").rglob("out_file=a_scrubbed.csv/part-*")).read_text()
    assert text == 'id,***@joe.com,note\n1,"call ***-***-4567, now",x\n2,,"multi\nline ***@b.io"\n'


def test_preview_of_a_long_table(spark, tmp_path):
    body = "id,t\n" + "".join(f"{i},line {i}\n" for i in range(5000))
    (tmp_path / "l.csv").write_text(body)
    got = scrub_files(spark, [str(tmp_path / "l.csv")], types=["email"]).report.first()
    assert got.preview == body[:2000] + f"...\n\n[Truncated - {len(body)} total characters]"
    rows = read_lines(spark, str(tmp_path / "l.csv"))
    plan = preview_records(rows, F.col("line"), "_at")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_workbook_with_model(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook_bytes([["who", "where"], ["John Smith", "a@b.com"], ["plain", "Mary Jones"]]))

    def names():
        return lambda texts: [[("PER", m.start(), m.end(), 0.9) for m in re.finditer("[A-Z][a-z]+ [A-Z][a-z]+", t)] for t in texts]

    run = scrub_files(spark, [str(tmp_path / "w.xlsx")], factory=names)
    cells = [r.cells for r in run.workbooks.orderBy("row_idx").collect()]
    assert cells == [["who", "where"], ["*" * 10, "***@b.com"], ["plain", "*" * 10]]
    report = run.report.first()
    assert (report.pii_found, report.rows_affected, report.cells_affected) == (3, 2, 3)


def test_quotas_fail_files_alone(spark, batch):
    _, paths = batch
    run = scrub_files(spark, paths, quota=Quota(max_file_bytes=300, max_rows_per_file=1), types=["email"])
    errors = {r.file.rsplit("/", 1)[1]: r.error for r in run.report.collect() if not r.success}
    assert errors["big.TXT"] == "File size (0.00 MB) exceeds the limit (0.00 MB)"
    assert errors["a.csv"] == "Row count (2) exceeds the limit (1)"
    run = scrub_files(spark, paths[:4], quota=LIMITED)
    assert {r.error for r in run.report.collect()} == {"Batch size (4 files) exceeds the limit (3 files)"}
    run = scrub_files(spark, paths[:2], types=["ip"], quota=LIMITED)
    assert {r.error for r in run.report.collect()} == {"PII type 'ip_address' is not among the allowed types"}


def test_limit_helpers(spark):
    files = spark.createDataFrame([("a", 10), ("b", 6 * 1024 * 1024)], "file string, size_bytes long")
    got = {r.file: (r.success, r.error) for r in validate_files(files, LIMITED).collect()}
    assert got == {"a": (True, None), "b": (False, "File size (6.00 MB) exceeds the limit (5.00 MB)")}
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file string, v int")
    good, bad = split_by_status(rows, validate_files(files, LIMITED))
    assert sorted(r.v for r in good.collect()) == [1, 3] and [r.file for r in bad.collect()] == ["b"]
    assert spark.range(1).select(cell_error(F.lit(7), Quota(max_cells_per_file=6))).first()[0] == "Cell count (7) exceeds the limit (6)"


def test_sql_functions(spark):
    register(spark)
    got = spark.sql(
        "select pii_scrub('x a@b.com', 'hash') a, pii_mask('x a@b.com') b, size(pii_spans('10.0.0.1 a@b.com')) c, "
        "pii_is_luhn('4111-1111-1111-1111') d, pii_is_ssn('000-12-3456') e, pii_replace('IP Address', '1.1.1.1', 'remove') f"
    ).first()
    assert re.fullmatch("x #[0-9a-f]{12}", got.a) and got[1:] == ("x ***@b.com", 2, True, False, "[IP ADDRESS REMOVED]")


def test_workspace(spark, tmp_path):
    assert shared_dir(spark) == shared_dir(spark)
    frame = spark.range(10)
    assert staged(frame, "t").count() == 10
    small = small_side(frame, 5)._jdf.queryExecution().logical().toString()
    assert "hint" not in small.lower() and "hint" in small_side(frame)._jdf.queryExecution().logical().toString().lower()
    assert split_by_kind(["a.csv", "b.TXT", "c"]) == {"csv": ["a.csv"], "txt": ["b.TXT", "c"]}


def test_mixed_folder_by_its_listing(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    files = {
        "a.csv": "id,m\n1,x@y.io\n2,plain\n",
        "deep/b.CSV": "m,id\nq@w.org,7\n",
        "deep/head.csv": "a@b.com,c\n",
        "names.csv": 'id,,id,"a ""b"", c"\n1,2,3,"5 ""6"""\n',
        "one.csv": "only\nv@x.io\n\"v,2\"\n",
        "none.csv": "",
        "deep/t.log": "call 10.0.0.1",
        "old.xls": "x",
    }
    for name, body in files.items():
        (tmp_path / "in" / name).write_text(body)
    (tmp_path / "in" / "w.xlsx").write_bytes(workbook_bytes([["h@x.io"]]))
    for multiline in (True, False):
        run = scrub_files(spark, [str(tmp_path / "in")], multiline=multiline)
        got = {r.file.rsplit("/", 1)[1]: r for r in run.report.collect()}
        assert {k: (r.file_type, r.success, r.pii_found, r.rows_processed, r.rows_affected, r.cells_affected) for k, r in got.items()} == {
            "a.csv": ("csv", True, 1, 2, 1, 1),
            "b.CSV": ("csv", True, 1, 1, 1, 1),
            "head.csv": ("csv", True, 1, 0, 0, 0),
            "names.csv": ("csv", True, 0, 1, 0, 0),
            "one.csv": ("csv", True, 1, 2, 1, 1),
            "none.csv": ("csv", True, 0, 0, 0, 0),
            "t.log": ("txt", True, 1, 1, 1, 1),
            "old.xls": ("xls", False, 0, 0, 0, 0),
            "w.xlsx": ("xlsx", True, 1, 0, 0, 0),
        }
        assert got["head.csv"].preview == "***@b.com,c\n" and got["b.CSV"].preview == "m,id\n***@w.org,7\n"
        run.save_successful(str(tmp_path / f"out{multiline}"))
        written = {p.parent.name: p.read_text() for p in (tmp_path / f"out{multiline}").rglob("part-*")}
        assert written["out_file=a_scrubbed.csv"] == "id,m\n1,***@y.io\n2,plain\n"
        assert written["out_file=head_scrubbed.csv"] == "***@b.com,c\n" and written["out_file=names_scrubbed.csv"] == files["names.csv"]
        assert {(r.file.rsplit("/", 1)[1], r.pii_type): r.n for r in run.type_report.collect()}[("head.csv", "Email Address")] == 1


def test_the_model_sees_headers(spark, tmp_path):
    (tmp_path / "h.csv").write_text("John Smith,id\nplain,1\n")

    def names():
        return lambda texts: [[("PER", m.start(), m.end(), 0.9) for m in re.finditer("[A-Z][a-z]+ [A-Z][a-z]+", t)] for t in texts]

    run = scrub_files(spark, [str(tmp_path)], factory=names)
    assert run.report.first().pii_found == 1 and run.report.first().preview == "**********,id\nplain,1\n"


@pytest.mark.parametrize("record", ['a,b', '"a,b",c', '"a ""b"", c",', ',', '""', '"x\ny",z', 'a"b,c', '\x01,\x02,"q,\x01,\x02"', ',"",""""', '"' + 'x""' * 5000 + '",y'])
def test_cells_of_a_record(spark, record):
    import csv
    import io

    if 'a"b' not in record:
        want = next(csv.reader(io.StringIO(record, newline="")))
    else:
        want = ['a"b,c']
    got = spark.createDataFrame([(record,)], "r string").select(csv_cells(F.col("r")).alias("c")).first().c
    assert got == want


def test_line_numbers_of_split_files(spark, tmp_path):
    bodies = {"a.txt": "".join(f"line {i} {'x' * (i % 90)}\n" for i in range(900)), "b.txt": "one\r\n\nthree", "c.txt": "", "d.txt": "\n\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = read_numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(name, i, line) for name, body in bodies.items() for i, line in enumerate(re.split("\r?\n", body)) if body and (i < len(re.split("\r?\n", body)) - 1 or line)]
    assert got == sorted(want)
