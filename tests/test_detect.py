import pytest
from brute import candidates, spans
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanveil import candidate_spans, detect, find_spans, findings
from spanveil.functions.catalog import PATTERN_TYPES, display_name
from spanveil.functions.exprs import kept_greedily, let
from spanveil.functions.patterns import CODE_MARK, LONG_MARK, PAIR_MARK
from spanveil.functions.spans import spans_sql

CASES = {
    "email": [
        ("write to john.doe@example.com.", ["john.doe@example.com"]),
        ("a@b.c", []),
        ("A_b%+-.1@Sub-domain.example.ORG,", ["A_b%+-.1@Sub-domain.example.ORG"]),
        ("a@b.com.c@d.com", ["a@b.com", ".c@d.com"]),
        ("@b.com and a@@b.com", []),
        ("K@x.io mſ@x.io", ["K@x.io", "mſ@x.io"]),
        ("ı@x.io", []),
    ],
    "phone": [
        ("(555) 123-4567", ["(555) 123-4567"]),
        ("+1 555.123.4567x", ["+1 555.123.4567"]),
        ("15551234567", ["15551234567"]),
        ("4111111111111111", ["4111111111"]),
        ("555-12-4567", []),
        ("555 123 4567", ["555 123 4567"]),
    ],
    "ssn": [
        ("123-45-6789", ["123-45-6789"]),
        ("123456789 123 45 6789", ["123456789", "123 45 6789"]),
        ("000-12-3456 666-12-3456 900-12-3456", []),
        ("123-00-6789 123-45-0000", []),
        ("é123-45-6789", []),
        ("١٢٣-45-6789", []),
        ("x123-45-6789", []),
    ],
    "credit_card": [
        ("4111111111111111", ["4111111111111111"]),
        ("4111111111111112", []),
        ("4111-1111-1111-1111", []),
        ("378282246310005 5555555555554444 6011111111111117", ["378282246310005", "5555555555554444", "6011111111111117"]),
    ],
    "ip_address": [("10.0.0.1 256.1.1.1 1.2.3", ["10.0.0.1"]), ("1.2.3.4.5", ["1.2.3.4"]), ("255.255.255.255", ["255.255.255.255"])],
    "date_of_birth": [
        ("01/02/1990 13/01/1990", ["01/02/1990"]),
        ("1990-12-31 2/3/99", ["1990-12-31", "2/3/99"]),
        ("1990/13/01", []),
    ],
    "passport": [("A123456 AB123456789 a123456 ABC123456", ["A123456", "AB123456789"]), ("A12345", [])],
    "drivers_license": [("A12345 A123456789", ["A12345"])],
    "bank_account": [
        ("1234-5678-9012-3456 1234567890123456", ["1234-5678-9012-3456", "1234567890123456"]),
        ("12345678901234567", []),
    ],
}


@pytest.mark.parametrize("type_id", PATTERN_TYPES)
def test_each_pattern(texts, type_id):
    inputs = [c[0] for c in CASES[type_id]]
    got = texts(inputs, find_spans("t", [type_id]))
    for (text, want), found in zip(CASES[type_id], got, strict=True):
        assert [s.value for s in found] == want, text
        assert all(s.pii_type == display_name(type_id) and text[s.start : s.end] == s.value for s in found)


def test_null_and_empty(texts):
    assert texts([None, "", "no digits"], find_spans("t")) == [[], [], []]


def test_ties_follow_the_type_order(texts):
    tie = ["A123456", "4111111111111111"]
    default = texts(tie, find_spans("t"))
    assert [[s.pii_type for s in r] for r in default] == [["Passport Number"], ["Phone Number"]]
    flipped = texts(tie, find_spans("t", ["drivers_license", "passport", "bank_account", "credit_card", "phone"]))
    assert [[s.pii_type for s in r] for r in flipped] == [["Driver's License"], ["Bank Account Number"]]


def test_text_that_holds_the_inner_mark(texts):
    plain = "call 555-123-4567, a@b.com or 10.0.0.1 now"
    marked = "\u0001" + plain + "\u0001"
    got = texts([marked], find_spans("t"))[0]
    assert [tuple(s) for s in got] == spans(marked)


def test_more_hits_than_a_block(texts):
    text = "x 555-123-4567, 10.0.0.1 é\n" * 700
    got = texts([text], find_spans("t"))[0]
    assert [tuple(s) for s in got] == spans(text)
    assert len(got) == 1400


ALPHABET = "0123456789aAbZ@.-+() /_éKſ١ \n\u0001"
PARTS = st.one_of(
    st.text(ALPHABET, max_size=8),
    st.sampled_from(
        ["a@b.co", "555-123-4567", "123-45-6789", "4111111111111111", "1.2.3.4", "1/2/1990", "A123456", "1234 5678 9012 3456"]
    ),
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PARTS, max_size=8).map("".join), min_size=40, max_size=60), st.permutations(PATTERN_TYPES))
def test_equals_brute_force(texts, inputs, order):
    found = texts(inputs, find_spans("t", order))
    every = texts(inputs, candidate_spans("t", order))
    for text, got, raw in zip(inputs, found, every, strict=True):
        assert [tuple(s) for s in got] == spans(text, order), repr(text)
        assert [tuple(s) for s in raw] == candidates(text, order), repr(text)
        ends = [0, *[s.end for s in got]]
        assert all(s.start >= e for s, e in zip(got, ends, strict=False))


def test_long_unbroken_run_stays_linear(texts, spark):
    long = spark.range(1).select(F.expr("concat('@', repeat('a', 2000000))").alias("t"))
    assert long.select(F.size(find_spans("t")).alias("n")).first().n == 0


def test_findings_over_columns(spark):
    rows = spark.createDataFrame([(1, "a@b.com", "10.0.0.1", 5), (2, None, "x", 6)], "id int, a string, b string, n int")
    got = {tuple(r) for r in findings(rows, keys=["id"]).collect()}
    assert got == {
        (1, "a", 0, 7, 0, "Email Address", "a@b.com"),
        (1, "b", 0, 8, 4, "IP Address", "10.0.0.1"),
    }
    assert detect(rows).columns == ["id", "a", "b", "n", "a_spans", "b_spans"]
    with pytest.raises(ValueError):
        detect(rows, ["n"])


def test_gates_pass_every_match_and_spare_plain_numbers(texts):
    hits = [
        "(555) 123-4567", "(555) 123 4567", "123 45 6789", "4111111111111111", "378282246310005",
        "١٢٣٤-١٢٣٤-١٢٣٤-١٢٣٤",
        "1.2.3.4", "255.255.255.255", "1/2/99", "1990-1-2", "A123456", "D12345", "kK@x.io",
    ]
    plain = ["in 1998 and 2004-2010", "3.14 or 12-34", "12345 67", "ABC 1234 x 56.7"]
    for text, got in zip(hits + plain, texts(hits + plain, find_spans("t")), strict=True):
        assert [tuple(s) for s in got] == spans(text), text
    for mark in (LONG_MARK, CODE_MARK, PAIR_MARK):
        assert not any(texts(plain, F.rlike(F.col("t"), F.lit(mark)))), mark


@pytest.mark.parametrize("n", [7, 8, 30, 31])
def test_spans_about_the_short_forms(texts, n):
    """Hits of one type by few widths or a running sum, kept spans by bits or by a fold."""
    text = "é 4111111111111111, A123456 " + " ".join(f"555-123-{i:04d}" for i in range(n))
    got, raw = texts([text], find_spans("t"))[0], texts([text], candidate_spans("t"))[0]
    assert [tuple(s) for s in got] == spans(text)
    assert [tuple(s) for s in raw] == candidates(text)


def test_kept_spans_fold_into_a_long(spark):
    """Few spans build no array and no struct at each step of the fold."""
    rows = spark.range(1).select(
        F.expr("transform(sequence(0, 29), k -> named_struct('start', k * 70000000, 'end', k * 70000000 + if(k % 3 = 0, 70000001, 5)))").alias("r")
    )
    kept = rows.select(F.expr(f"transform({let('spans', 'r', kept_greedily('spans'))}, x -> x.start div 70000000)").alias("k")).first().k
    assert kept == [k for k in range(30) if k % 3 != 1]


def test_a_local_name_hands_its_result_on_uncopied():
    """transform copies each text and struct that it returns; a fold hands its result on."""
    assert "transform" not in let("a", "t", "a")
    assert "transform(array(" not in spans_sql("t", ["email"])


def test_findings_take_spans_from_the_scan_as_they_are(spark):
    rows = spark.createDataFrame(
        [(1, "a@b.com 1.2.3.4", None, 7), (2, None, "call 555-123-4567", 8), (3, "x", "", 9)], "id int, a string, b string, _at int"
    )
    found = findings(rows, ["b", "a"], keys=["_at", "id"])
    assert found.columns == ["_at", "id", "column", "start", "end", "ord", "pii_type", "value"]
    cells = {(r._at, r.id, c): r[c] or "" for r in rows.collect() for c in ("b", "a")}
    assert {tuple(r) for r in found.collect()} == {(*k, *s) for k, text in cells.items() for s in spans(text)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(column" not in plan
