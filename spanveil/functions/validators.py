"""Checks that a matched value has to pass (card and social security numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import let


def digits_sql(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


# Card length 13 to 19; areas 000, 666 and 900-999, group 00 and
# serial 0000 are never issued.
LUHN_SQL = "(length({d}) between 13 and 19 and luhn_check({d}))"
SSN_SQL = (
    "(length({d}) = 9 and substring({d}, 1, 3) not in ('000', '666') and substring({d}, 1, 1) <> '9' "
    "and substring({d}, 4, 2) <> '00' and substring({d}, 6, 4) <> '0000')"
)

# SQL text per validated type, with ``{v}`` standing for the value.
VALID_SQL = {
    "credit_card": LUHN_SQL.format(d=digits_sql("{v}")),
    "ssn": SSN_SQL.format(d=digits_sql("{v}")),
}


def valid_once(type_id: str, v: str) -> str:
    """SQL text of a type's check of the value ``v``, whose digits are cut out once."""
    rule = {"credit_card": LUHN_SQL, "ssn": SSN_SQL}[type_id]
    return let("digits", digits_sql(v), rule.format(d="digits"))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits_only(col: str | Column) -> Column:
    """ASCII digits of a string, in order."""
    return F.regexp_replace(_col(col), "[^0-9]", "")


def is_luhn(col: str | Column) -> Column:
    """13 to 19 digits (others ignored) with a Luhn sum divisible by ten."""
    d = digits_only(col)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def is_ssn(col: str | Column) -> Column:
    """Nine digits with an issued area, group and serial."""
    d = digits_only(col)
    return (
        (F.length(d) == 9)
        & ~F.substring(d, 1, 3).isin("000", "666")
        & (F.substring(d, 1, 1) != "9")
        & (F.substring(d, 4, 2) != "00")
        & (F.substring(d, 6, 4) != "0000")
    )


def is_valid(pii_type: str | Column, value: str | Column) -> Column:
    """Dispatch by display name: only cards and social security numbers are checked."""
    kind = _col(pii_type)
    return (
        F.when(kind == "Credit Card Number", is_luhn(value))
        .when(kind == "Social Security Number", is_ssn(value))
        .otherwise(F.lit(True))
    )
