import hashlib
import re

import pytest
from brute import spans
from pyspark.sql import functions as F

from spanveil import ALL_TYPES, scrub, scrub_marked, scrub_names, scrub_text, splice
from spanveil.functions.catalog import PATTERN_TYPES, display_name
from spanveil.functions.replace import replacement
from spanveil.operators.stats import batch_totals, profile, stats, type_counts

MASKS = [
    ("Email Address", "john@email.com", "j***@email.com"),
    ("Email Address", "ab@x.io", "***@x.io"),
    ("Email Address", "abc@x.io", "a***@x.io"),
    ("Email Address", "no at", "***@***.***"),
    ("Phone Number", "(555) 123-4567", "***-***-4567"),
    ("Phone Number", "12", "***-***-****"),
    ("Social Security Number", "123-45-6789", "***-**-****"),
    ("Credit Card Number", "4111111111111111", "****-****-****-1111"),
    ("IP Address", "10.0.0.1", "***.***.***.***"),
    ("Date of Birth", "1/2/1990", "**/**/****"),
    ("Street Address", "12 Oak é", "*" * 9),
    ("Person Name", "x" * 30, "*" * 20),
    ("Passport Number", "A123456", "*" * 7),
    ("Driver's License", "A12345", "*" * 6),
    ("Bank Account Number", "1234567890123456", "*" * 16),
]


def test_masks(spark):
    rows = spark.createDataFrame(MASKS, "kind string, value string, want string")
    for r in rows.select("kind", "value", "want", replacement("kind", "value").alias("got")).collect():
        assert r.got == r.want, r


def test_remove_and_hash(spark):
    rows = spark.createDataFrame([("Email Address", "john@email.com")], "k string, v string")
    r = rows.select(replacement("k", "v", "Remove").alias("r"), replacement("k", "v", "hash").alias("h")).first()
    assert r.r == "[EMAIL ADDRESS REMOVED]"
    assert r.h == "#" + hashlib.sha256(b"john@email.com").hexdigest()[:12]


SHAPES = {
    "email": r"[a-z]+\.[a-z]+@example\.(com|net|org)",
    "phone": r"\(\d{3}\) \d{3}-\d{4}",
    "ssn": r"[1-8]\d{2}-\d{2}-\d{4}",
    "credit_card": r"4\d{3}-\d{4}-\d{4}-\d{4}",
    "ip_address": r"\d+\.\d+\.\d+\.\d+",
    "date_of_birth": r"(0[1-9]|1[01])/(0[1-9]|1\d|2[0-7])/(19[5-9]\d|200[0-4])",
    "address": r"(Apt\.|Suite) \d{3}",
    "name": r"[A-Z][a-z]+ [A-Z][a-z]+",
    "passport": r"P\d{8}",
    "drivers_license": r"DL\d{7}",
    "bank_account": r"\d{12}",
    "organization": r"[A-Z].*",
}


@pytest.mark.parametrize("type_id", ALL_TYPES)
def test_fakes_have_their_shape_and_repeat(spark, type_id):
    rows = spark.range(300).select(F.lit(display_name(type_id)).alias("k"), F.col("id").cast("string").alias("v"))
    fake = rows.select(replacement("k", "v", "fake", "a").alias("x"), replacement("k", "v", "fake", "b").alias("y"))
    first, again = fake.collect(), fake.collect()
    assert first == again
    assert all(re.fullmatch(SHAPES[type_id], r.x) for r in first)
    assert any(r.x != r.y for r in first)
    assert len({r.x for r in first}) > 50


def test_splice_positions(texts):
    rows = ["a@b.com and 10.0.0.1", "10.0.0.1", "é 555-123-4567 ü", "none", None, ""]
    got = texts(rows, scrub_text("t", method="remove"))
    assert got == [
        "[EMAIL ADDRESS REMOVED] and [IP ADDRESS REMOVED]",
        "[IP ADDRESS REMOVED]",
        "é [PHONE NUMBER REMOVED] ü",
        "none",
        None,
        "",
    ]


def test_splice_over_many_chunks(texts):
    text = "é call 555-123-4567 " * 900
    want, at = "", 0
    for s, e, *_ in spans(text):
        want += text[at:s] + "***-***-4567"
        at = e
    assert texts([text], scrub_text("t"))[0] == want + text[at:]


def test_occurrence_fakes_differ_by_place(spark):
    rows = spark.createDataFrame([(1, "a@b.com a@b.com"), (2, "a@b.com a@b.com")], "id int, t string")
    by_value = [r[0] for r in rows.select(scrub_text("t", method="fake")).collect()]
    by_place = [r[0] for r in rows.select(scrub_text("t", method="fake", row_key="id")).collect()]
    assert by_value[0] == by_value[1] and len(set(by_value[0].split())) == 1
    assert by_place[0] != by_place[1] and len(set(by_place[0].split())) == 2


def test_splice_keeps_text_without_spans(spark):
    rows = spark.createDataFrame([("x a@b.com", None)], "t string, s array<struct<start:int,end:int,ord:int,pii_type:string,value:string>>")
    assert rows.select(splice("t", "s")).first()[0] == "x a@b.com"


WIDE = [
    (1, "a@b.com", "x", None, "10.0.0.1 10.0.0.2", "q"),
    (2, "none", "y", "z", "", "555-123-4567"),
    (3, None, None, None, None, None),
]
WIDE_SCHEMA = "id int, a string, b string, c string, d string, `odd name` string"


def test_wide_table_equals_narrow(spark):
    rows = spark.createDataFrame(WIDE, WIDE_SCHEMA)
    wide = scrub(rows).orderBy("id").collect()
    for c in ("a", "b", "c", "d", "odd name"):
        assert [r[c] for r in wide] == [r[c] for r in scrub(rows, [c]).orderBy("id").collect()]
    marked = scrub_marked(rows).orderBy("id").collect()
    assert [r[:6] for r in marked] == [r[:6] for r in wide]
    assert [(r.pii.found, r.pii.cells) for r in marked] == [(3, 2), (1, 1), (0, 0)]


def test_counts(spark):
    rows = spark.createDataFrame(WIDE, WIDE_SCHEMA)
    assert stats(rows).first().asDict() == {"pii_found": 4, "rows_processed": 3, "rows_affected": 2, "cells_affected": 3}
    assert {tuple(r) for r in type_counts(rows).collect()} == {("Email Address", 1), ("IP Address", 2), ("Phone Number", 1)}
    assert ("d", "IP Address", 2, 2) in {tuple(r) for r in profile(rows).collect()}
    grouped = stats(rows.withColumn("file", F.lit("f")), by=["file"]).withColumn("success", F.lit(True))
    assert {(r.file, r.pii_found, r.files) for r in batch_totals(grouped).collect()} == {("f", 4, 1), (None, 4, 1)}


def test_counts_of_nothing(spark):
    rows = spark.createDataFrame([], "t string")
    assert stats(rows).first().asDict() == {"pii_found": 0, "rows_processed": 0, "rows_affected": 0, "cells_affected": 0}
    assert type_counts(rows).count() == 0


def test_header_names(spark):
    rows = spark.createDataFrame([(1, 2, 3)], ["ab@x.io", "cd@x.io", "plain"])
    renamed, found = scrub_names(rows)
    assert renamed.columns == ["***@x.io", "***@x.io_2", "plain"] and found == 2


def test_no_shuffle_and_one_evaluation(spark, tmp_path):
    spark.createDataFrame(WIDE, WIDE_SCHEMA).write.parquet(str(tmp_path / "w"))
    rows = spark.read.parquet(str(tmp_path / "w"))
    plans = {
        "scrub": scrub(rows, ["a"]),
        "wide": scrub(rows),
        "marked": scrub_marked(rows),
    }
    for name, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
        assert "Python" not in plan and "Arrow" not in plan, name
    # one cut per pattern type: nothing is evaluated twice
    narrow = scrub(rows, ["a"]).select("id", "a")
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "ReadSchema: struct<id:int,a:string>" in narrow._jdf.queryExecution().executedPlan().toString()
    for df in (narrow, scrub_marked(rows), stats(rows), type_counts(rows)):
        plan = df._jdf.queryExecution().optimizedPlan()
        text = plan.toString().replace("...", "")
        count = sum(1 for _ in re.finditer(r"cut, if", text))
        assert count in (0, len(PATTERN_TYPES)), count
