"""Inputs that Spark derives from the shared tables, and the stub model."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import spread, table
from .oracle import PEOPLE_COLUMNS, STUB


def people(spark: SparkSession, root: str) -> DataFrame:
    """One value of every pattern type per customer, some of them invalid on purpose.

    A row takes some hundred times its bytes' worth of scanning, so customers are spread over tasks first.
    """
    key = "cast(c_custkey as string)"

    def padded(expr: str, width: int) -> str:
        return f"lpad(cast({expr} as string), {width}, '0')"

    return spread(table(spark, root, "customer").select("c_custkey", "c_mktsegment")).selectExpr(
        "c_custkey as id",
        f"concat('user', {key}, '@mail', cast(c_custkey % 9 as string), '.example.com') as email",
        f"concat('(', {padded('200 + c_custkey % 700', 3)}, ') 555-', {padded('c_custkey % 10000', 4)}) as phone",
        f"concat_ws('-', {padded('c_custkey % 1000', 3)}, {padded('c_custkey % 100', 2)}, "
        f"{padded('c_custkey % 10000', 4)}) as ssn",
        f"concat('4', {padded('c_custkey', 15)}) as card",
        "concat('10.', cast(c_custkey % 300 as string), '.0.1') as ip",
        "concat_ws('/', cast(1 + c_custkey % 13 as string), cast(1 + c_custkey % 31 as string), "
        "cast(1950 + c_custkey % 60 as string)) as dob",
        f"concat('AB', {padded('c_custkey', 7)}) as passport",
        f"concat('D', {padded('c_custkey', 5)}) as license",
        f"concat('1234-5678-', {padded('c_custkey % 10000', 4)}, '-0001') as bank",
        "c_mktsegment as note",
    )


def documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """One text per person, page and document: ``id``, ``text``."""
    persons = people(spark, root).select(
        F.concat(F.lit("c"), "id").alias("id"), F.concat_ws(" | ", *PEOPLE_COLUMNS).alias("text")
    )
    pages = table(spark, root, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")
    )
    docs = documents(spark, root).select(F.concat(F.lit("d"), "id").alias("id"), "text")
    return reduce(DataFrame.union, [persons, pages, docs])


def people_values(spark: SparkSession, root: str) -> DataFrame:
    """People as (id, type_id, value), one row per pattern-typed cell."""
    kinds = dict(
        zip(
            ("email", "phone", "ssn", "credit_card", "ip_address", "date_of_birth", "passport", "drivers_license", "bank_account"),
            PEOPLE_COLUMNS,
            strict=False,
        )
    )
    pairs = ", ".join(f"'{t}', {c}" for t, c in kinds.items())
    return people(spark, root).selectExpr("id", f"stack({len(kinds)}, {pairs}) as (type_id, value)")


def stub_model():
    """A predictor for the queries: two capitalised words, kind and confidence by length."""
    words = re.compile(STUB)
    kinds = ("PER", "LOC", "ORG", "MISC")

    def found(text: str) -> list[tuple]:
        return [
            (kinds[len(m.group()) % 4], m.start(), m.end(), (50 + len(m.group()) % 50) / 100.0)
            for m in words.finditer(text)
        ]

    return lambda texts: [found(t) for t in texts]


def naming_model():
    """A predictor that takes every text it is given for a name."""
    return lambda texts: [[("PER", 0, len(t), 0.99)] for t in texts]


def failing_model():
    """A predictor whose call fails for any batch."""

    def fail(texts):
        raise RuntimeError("model unavailable")

    return fail


def workbook_bytes(rows: list[list[str]]) -> bytes:
    """A minimal workbook: one sheet of inline strings."""

    def cell(v: str) -> str:
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{i + 1}">{"".join(map(cell, r))}</row>' for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="People" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def as_workbooks(df: DataFrame, rows_per_book: int = 1000) -> DataFrame:
    """Pack rows into workbooks of bounded size: ``file``, ``content``."""
    header = df.columns

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), rows_per_book):
                part = frame.iloc[at : at + rows_per_book].astype(str).values.tolist()
                name = f"book-{part[0][0]}.xlsx"
                yield pd.DataFrame({"file": [name], "content": [workbook_bytes([header, *part])]})

    return df.mapInPandas(pack, "file string, content binary")
