"""SQL functions for ``spark.sql``: the same expressions, under names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .catalog import ALL_TYPES, METHODS
from .exprs import sql_str
from .replace import replacement_sql
from .spans import SPANS_TYPE, spans_sql
from .splice import scrub_sql
from .validators import LUHN_SQL, SSN_SQL, digits_sql


def register(spark: SparkSession, types=ALL_TYPES, salt: str = "") -> list[str]:
    """Create temporary SQL functions and return their names.

    ``pii_spans(text)``, ``pii_scrub(text, method)``, one ``pii_<method>(text)``
    per method, ``pii_replace(type_name, value, method)``, ``pii_is_luhn(value)`` and
    ``pii_is_ssn(value)``. They are SQL functions, inlined by Catalyst, not UDFs.
    """
    methods = " ".join(f"when {sql_str(m)} then {scrub_sql('txt', types, m, salt)}" for m in METHODS if m != "mask")
    swaps = " ".join(
        f"when {sql_str(m)} then {replacement_sql('kind', 'val', types, m, salt)}" for m in METHODS if m != "mask"
    )
    bodies = {
        "pii_spans": ("txt string", SPANS_TYPE, spans_sql("txt", types)),
        "pii_scrub": (
            "txt string, method string",
            "string",
            f"case lower(method) {methods} else {scrub_sql('txt', types, 'mask', salt)} end",
        ),
        "pii_replace": (
            "kind string, val string, method string",
            "string",
            f"case lower(method) {swaps} else {replacement_sql('kind', 'val', types, 'mask', salt)} end",
        ),
        "pii_is_luhn": ("val string", "boolean", LUHN_SQL.format(d=digits_sql("val"))),
        "pii_is_ssn": ("val string", "boolean", SSN_SQL.format(d=digits_sql("val"))),
    }
    for m in METHODS:
        bodies[f"pii_{m}"] = ("txt string", "string", scrub_sql("txt", types, m, salt))
    for name, (args, kind, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    return list(bodies)
