import pytest

LONG = " ".join(f"word{i} of a very long text" for i in range(4000))
LINE = "one line that has more than eight words in it today"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (5, "Call me at +1 (212) 555-0147 or write to ann.lee@mail.example.org today, please do.\n" + LINE),
    (2, LINE + "\n\nsomething else that is short\n" + LINE),
    (1, LINE.replace("today", "tonight")),
    (9, None),
    (8, ""),
    (7, "   \n \t "),
    (3, LONG),
    (4, LONG + " end"),
    (6, "Été à Noël, don't: 1½ <|endoftext|> 日本語 ΣΑΣ x̂\r\n" + LINE),
    (6, "Été à Noël, don't: 1½ <|endoftext|> 日本語 ΣΑΣ x̂\r\n" + LINE),
    (None, LINE),
    (11, "card 4111 1111 1111 1111 and host 10.0.0.255, not 10.0.0.256; ref 4111 1111 1111 1112"),
]


@pytest.fixture(scope="session")
def shared(spark):
    return spark


@pytest.fixture(scope="session")
def docs(shared):
    """Nulls, empty, blank and long texts, repeated rows and a row without an id; columns whose names could clash."""
    frame = shared.createDataFrame([(i, t, None, "s", None) for i, t in ROWS], DOC)
    return frame.selectExpr("*", "1 as rep", "'x' as place", "2 as h1", "3 as line", "array(1) as piece", "'z' as component_id").repartition(3)


@pytest.fixture(scope="session")
def nothing(shared):
    return shared.createDataFrame([], DOC)
