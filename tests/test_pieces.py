import random

import pytest
from brute import spans
from pyspark.sql import functions as F

from spanveil import findings, scrub
from spanveil.functions.pieces import pieces_sql
from spanveil.operators.pieces import findings_in_files, findings_in_pieces, scrub_in_pieces

PARTS = [
    "555-123-4567", "(555) 123", "4567", "1 (555)", "123 45 6789", "123", "45", "6789", "1234", "a.b+c@d.org", "x@y.co", "@", "AB1234567",
    "12/31/1999", "1999-12-31", "4111111111111111", "10.0.0.1", "中文", "word", "١٢٣", "K", "ſ@d.org", "(", ")", "_", "é",
    "\U0001f600", "é", "\u0001", "5" * 23,
]
JOINTS = ["", " ", " ", "\n", "\n", "\t", "  ", "\r\n", "\n\n", ",", "-", ".", "/", " ", "。", "; "]


def mixed(seed, n=60):
    rng = random.Random(seed)
    return "".join(rng.choice(PARTS) + rng.choice(JOINTS) for _ in range(rng.randrange(n)))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("size", [1, 40])
def test_pieces_find_what_the_whole_text_holds(spark, size):
    data = [(i, mixed(i)) for i in range(300)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(data, "id int, t string").repartition(4)
    want = sorted((i, *s) for i, t in data if t for s in spans(t))
    columns = ("id", "start", "end", "ord", "pii_type", "value")
    assert rows(findings(df, ["t"], keys=["id"]), *columns) == want
    assert rows(findings_in_pieces(df, "t", keys=["id"], piece_chars=size), *columns) == want


def test_pieces_make_up_the_text(spark):
    df = spark.createDataFrame([(mixed(i),) for i in range(100)], "t string")
    cut = df.select("t", F.expr(pieces_sql("t", 5)).alias("p"))
    wrong = F.array_join(F.transform("p", lambda x: x["piece"]), "") != F.col("t")
    off = F.exists("p", lambda x: F.substring("t", x["start"] + 1, F.length(x["piece"])) != x["piece"])
    assert cut.where(wrong | off).count() == 0
    assert cut.agg(F.max(F.size("p"))).first()[0] > 20


def test_scrub_in_pieces_keeps_rows_and_columns(spark):
    data = [(i, None if i % 9 == 0 else mixed(i), f"n{i}", None) for i in range(120)]
    df = spark.createDataFrame(data, "id int, t string, _piece string, start string")
    got = scrub_in_pieces(df, "t", ["id"], piece_chars=11, method="remove")
    assert got.schema.simpleString() == df.schema.simpleString()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in scrub(df, ["t"], method="remove").collect()}
    assert scrub_in_pieces(df.where("false"), "t", ["id"]).count() == 0


def test_scrub_in_pieces_refuses_keys_that_repeat(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l")], "id int, t string")
    with pytest.raises(Exception, match="tell them apart"):
        scrub_in_pieces(df, "t", ["id"], piece_chars=3).collect()


@pytest.mark.parametrize("split", [1 << 10, 160])
def test_files_split_anywhere(spark, tmp_path, split):
    texts = {f"{i}.txt": mixed(1000 + i, 150) for i in range(4)} | {
        "digits.txt": "\n".join(["555", "123", "4567"] * 12),
        "ends.txt": "\n\n555 123\n4567\n\n",
        "plain.txt": "nothing here\n" * 20,
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = findings_in_files(spark, str(tmp_path))
        got = rows(got.withColumn("file", F.regexp_extract("file", "[^/]+$", 0)), "file", "start", "end", "ord", "pii_type", "value")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted((name, *s) for name, text in texts.items() for s in spans(text))
