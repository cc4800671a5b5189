import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanveil import detect_with_model, predict
from spanveil.operators.model import (
    cell_offsets,
    decode_tokens,
    join_cells,
    merge_spans,
    model_spans,
    predict_distinct,
    spans_to_cells,
)
from spanveil.operators.scrub import scrub_detected

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENS = "id int, tokens array<struct<start:int,end:int,label:string,prob:double>>"


def names_model():
    def found(texts):
        return [[("PER", m.start(), m.end(), 0.9) for m in re.finditer("[A-Z][a-z]+ [A-Z][a-z]+", t)] for t in texts]

    return found


def broken_factory():
    raise OSError("no weights")


def decode(spark, *token_lists):
    rows = spark.createDataFrame(list(enumerate(token_lists)), TOKENS)
    got = rows.select("id", decode_tokens("tokens").alias("e")).orderBy("id").collect()
    return [[(e.entity, e.start, e.end, round(e.confidence, 6)) for e in r.e] for r in got]


def test_decoding_rules(spark):
    got = decode(
        spark,
        # specials at both ends; B then I; O gap; B after B of one type; change without B; I without B
        [
            (0, 0, "O", 0.9),
            (0, 4, "B-PER", 0.8),
            (5, 9, "I-PER", 0.6),
            (10, 12, "O", 0.9),
            (13, 15, "B-LOC", 0.9),
            (16, 18, "B-LOC", 0.7),
            (19, 22, "I-ORG", 0.5),
            (23, 25, "I-ORG", 0.7),
            (26, 28, "B-MISC", 0.5),
            (0, 0, "B-PER", 0.9),
        ],
        [(0, 0, "B-PER", 0.9), (0, 0, "I-PER", 0.9)],
        [],
        [(0, 2, "O", 0.1)],
        [(0, 2, "B-PER", 1.0), (0, 0, "O", 0.5), (3, 4, "I-PER", 0.5), (4, 5, "I-PER", 0.25)],
    )
    assert got == [
        [("PER", 0, 9, 0.7), ("LOC", 13, 15, 0.9), ("LOC", 16, 18, 0.7), ("ORG", 19, 25, 0.6), ("MISC", 26, 28, 0.5)],
        [],
        [],
        [],
        [("PER", 0, 5, 0.5)],
    ]


def test_model_spans_filter_and_merge(spark):
    entities = [("PER", 0, 10, 0.7), ("LOC", 11, 15, 0.69), ("MISC", 0, 3, 0.9), ("ORG", 16, 23, 0.9)]
    rows = spark.createDataFrame(
        [("John Smith Rome a@b.com", entities), ("ab", [("PER", 0, 2, 0.9)])],
        "t string, e array<struct<entity:string,start:int,end:int,confidence:double>>",
    )
    every = [[(s.start, s.pii_type) for s in r.m] for r in rows.select(model_spans("t", "e").alias("m")).collect()]
    assert every == [[(0, "Person Name"), (16, "Organization Name")], []]
    names = [[s.pii_type for s in r.m] for r in rows.select(model_spans("t", "e", ["name", "email"]).alias("m")).collect()]
    assert names == [["Person Name"], []]


def test_merge_is_resolved_in_two_steps(spark):
    span = "array<struct<start:int,end:int,ord:int,pii_type:string,value:string>>"
    regex = [(5, 9, 0, "A", "x")]
    model = [(0, 6, 12, "B", "y"), (5, 7, 13, "C", "z"), (9, 12, 12, "B", "w")]
    rows = spark.createDataFrame([(regex, model), (regex, [(5, 9, 12, "B", "y")]), (None, model), (regex, None)], f"a {span}, b {span}")
    got = [[(s.start, s.pii_type) for s in r.m] for r in rows.select(merge_spans("a", "b").alias("m")).collect()]
    assert got == [[(0, "B"), (9, "B")], [(5, "A")], [(0, "B"), (9, "B")], [(5, "A")]]


PEOPLE = [
    (1, "I met John Smith at a@b.com", "Mary Jones"),
    (2, "x", None),
    (3, "Ann", "Lee Poe"),
    (4, "I met John Smith at a@b.com", "Mary Jones"),
]


@pytest.mark.parametrize("options", [{}, {"unit": "cell"}, {"distinct": True}, {"unit": "cell", "distinct": True}])
def test_detect_with_model(spark, options):
    rows = spark.createDataFrame(PEOPLE, "id int, a string, b string")
    got = detect_with_model(rows, names_model, **options).orderBy("id").collect()
    flat = [[(s.value, s.start) for s in r.a_spans] + [(s.value, s.start) for s in r.b_spans] for r in got]
    met = [("John Smith", 6), ("a@b.com", 20), ("Mary Jones", 0)]
    assert flat == [met, [], [("Lee Poe", 0)], met]
    scrubbed = scrub_detected(detect_with_model(rows, names_model, **options), ["a", "b"]).orderBy("id").collect()
    assert scrubbed[0].a == "I met ********** at ***@b.com" and scrubbed[0].b == "*" * 10
    assert (scrubbed[0].pii.found, scrubbed[0].pii.by_type[7], scrubbed[1].b) == (3, 2, None)


def test_no_model_stage_without_model_types(spark):
    rows = spark.createDataFrame(PEOPLE, "id int, a string, b string")
    plan = detect_with_model(rows, broken_factory, types=["email"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_failures_are_reported_not_raised(spark):
    rows = spark.createDataFrame([("Some Text",), ("ab",), ("   ",), (None,)], "t string")
    got = rows.select(predict("t", broken_factory).alias("p")).collect()
    assert [(r.p.entities, r.p.error) for r in got] == [([], "no weights"), ([], None), ([], None), ([], None)]


def test_a_short_answer_is_an_error(spark):
    rows = spark.createDataFrame([("Some Text",), ("Other Text",)], "t string").coalesce(1)
    got = rows.select(predict("t", lambda: lambda texts: [[]]).alias("p")).collect()
    assert all(r.p.entities == [] and "zip()" in r.p.error for r in got)


def test_repeated_texts_in_a_task_are_remembered(spark, tmp_path):
    log = str(tmp_path / "calls")

    def counting():
        def found(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[("PER", 0, 4, 0.9)] for _ in texts]

        return found

    rows = spark.range(25000).select(F.concat(F.lit("text "), F.col("id") % 7).alias("t")).coalesce(1)
    rows.select(predict("t", counting).alias("p")).agg(F.sum(F.size("p.entities"))).collect()
    assert len(open(log).read().split("\n")[:-1]) == 7


def test_distinct_texts_reach_the_model_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def counting():
        def found(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[("PER", 0, 3, 0.9)] for _ in texts]

        return found

    hot = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), F.col("id") % 50)).alias("t"))
    got = predict_distinct(hot.repartition(8), "t", counting).select("id", F.size("prediction.entities").alias("n"))
    assert got.agg(F.count("*"), F.sum("n")).first()[:] == (5000, 5000)
    calls = open(log).read().split("\n")[:-1]
    assert len(calls) == len(set(calls)) or len(calls) == 2 * len(set(calls))  # two actions may run it twice


def test_cells_and_offsets(spark):
    rows = spark.createDataFrame([("ab", None, "cde")], "a string, b string, c string")
    r = rows.select(join_cells(["a", "b", "c"]).alias("j"), cell_offsets(["a", "b", "c"]).alias("o")).first()
    assert r.j == "ab |  | cde" and [tuple(x) for x in r.o] == [(0, 2), (5, 5), (8, 11)]
    span = "array<struct<start:int,end:int,ord:int,pii_type:string,value:string>>"
    placed = spark.createDataFrame(
        [([(0, 2, 0, "A", "ab"), (1, 9, 0, "A", "cross"), (9, 11, 0, "A", "de")], [(0, 2), (5, 5), (8, 11)])],
        f"s {span}, o array<struct<start:int,end:int>>",
    )
    cells = placed.select(spans_to_cells("s", "o").alias("c")).first().c
    assert [[(s.start, s.end, s.value) for s in c] for c in cells] == [[(0, 2, "ab")], [], [(1, 3, "de")]]
