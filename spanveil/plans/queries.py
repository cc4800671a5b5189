"""Registered queries: each operator over whole tables, with its expected result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.catalog import (
    ALIASES,
    ALL_TYPES,
    PATTERN_TYPES,
    PII_TYPES,
    display_name,
    method_column,
    type_catalog,
    type_id_column,
)
from ..functions.naming import file_kind, output_name, preview, reported_extension
from ..functions.replace import replacement, replacement_by_method
from ..functions.spans import candidate_spans, find_spans
from ..functions.splice import scrub_text
from ..functions.validators import digits_only, is_luhn, is_ssn, is_valid
from ..operators.detect import as_text, explode_spans, findings
from ..operators.limits import (
    Quota,
    batch_error,
    cell_error,
    row_error,
    size_error,
    split_by_status,
    stop_at_quota,
    stopped_error,
    type_error,
)
from ..operators.model import (
    cell_offsets,
    decode_tokens,
    detect_with_model,
    join_cells,
    merge_spans,
    model_spans,
    predict,
    predict_distinct,
    spans_to_cells,
)
from ..operators.pieces import findings_in_files, findings_in_pieces, scrub_in_pieces
from ..operators.scrub import scrub, scrub_marked
from ..operators.stats import batch_totals, merge_profiles, profile, profile_sketches, stats, type_counts
from ..sources.files import (
    named_cells,
    number_lines,
    read_csv,
    read_csv_checked,
    read_lines,
    read_numbered_lines,
    read_texts,
    route_units,
    without_files,
)
from ..sources.manifest import damaged_parts, read_by_manifest
from ..sources.sinks import failed, successful, write_csv, write_lines, write_texts
from ..sources.workbook import parse_workbooks
from ..sources.workspace import fresh_path, small_side, spread, table
from ..streaming.batches import batch_progress, batch_rows, dead_letters, running_totals, running_types, scrub_batches, stream_files
from ..streaming.progress import observe_batch
from ..streaming.scrub import running_type_counts, scrub_stream, stream_lines, stream_table, write_stream
from . import oracle as o
from .fixtures import as_workbooks, corpus, documents, failing_model, naming_model, people, people_values, stub_model
from .file_run import scrub_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# ---------------------------------------------------------------- detection

SPAN_COLUMNS = ("id", "start", "end", "ord", "pii_type", "value")


def span_rows(df: DataFrame, spans, keys=("id",)) -> DataFrame:
    return explode_spans(df, {"text": spans}, keys).drop("column")


def _detect_query(types) -> Query:
    return lambda spark, root: span_rows(corpus(spark, root), find_spans("text", types))


for _t in PATTERN_TYPES:
    query(
        f"detect_{_t}",
        o.with_(o.CORPUS, o.spans("corpus", [_t])) + f"select {o.SPAN_ROWS} from kept",
    )(_detect_query([_t]))


@query("detect_candidates", o.with_(o.CORPUS, o.candidates("corpus", PATTERN_TYPES)) + f"select {o.SPAN_ROWS} from cand")
def detect_candidates(spark, root):
    """All validated matches of all pattern types, overlaps included."""
    return span_rows(corpus(spark, root), candidate_spans("text", PATTERN_TYPES))


@query("resolve_spans", o.with_(o.CORPUS, o.spans("corpus", ALL_TYPES)) + f"select {o.SPAN_ROWS} from kept")
def resolve_spans(spark, root):
    """Candidates sorted and thinned to disjoint spans, default type order."""
    return span_rows(corpus(spark, root), find_spans("text"))


_REVERSED = tuple(reversed(PATTERN_TYPES))


@query("resolve_reversed_order", o.with_(o.CORPUS, o.spans("corpus", _REVERSED)) + f"select {o.SPAN_ROWS} from kept")
def resolve_reversed_order(spark, root):
    """The requested type order decides ties."""
    return span_rows(corpus(spark, root), find_spans("text", _REVERSED))


@query("default_selection", o.with_(o.DOCS, o.spans("docs", ALL_TYPES)) + f"select {o.SPAN_ROWS} from kept")
def default_selection(spark, root):
    """No types, or only unknown ones, mean every type."""
    return span_rows(documents(spark, root), find_spans("text", ["no such type"]))


@query(
    "findings_table",
    o.with_(o.CELLS, o.spans("cells", ALL_TYPES))
    + 'select c.pid as id, c.col as "column", k.s as start, k.e as "end", k.o as ord, k.k as pii_type, k.v as value '
    "from kept k join cells c using (id)",
)
def findings_table(spark, root):
    """Findings over every string column of a table, as an audit table."""
    return findings(people(spark, root), keys=["id"])


_ORDER_TEXT = (
    "cells as (select concat(cast(o_orderkey as varchar(20)), ':', c) as id, cast(o_orderkey as varchar(20)) as pid, c as col, t as text from ("
    "select o_orderkey, unnest(['o_orderkey','o_custkey','o_orderdate','o_orderpriority']) as c, "
    "unnest([cast(o_orderkey as varchar(20)), cast(o_custkey as varchar(20)), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]) as t from orders))"
)


@query(
    "column_selection",
    o.with_(_ORDER_TEXT, o.spans("cells", ALL_TYPES))
    + 'select c.pid as "key", c.col as "column", k.s as start, k.e as "end", k.o as ord, k.k as pii_type, k.v as value '
    "from kept k join cells c using (id)",
)
def column_selection(spark, root):
    """Typed columns scanned after a cast to text on request."""
    orders = table(spark, root, "orders").select(
        "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority"
    )
    texts = as_text(orders).withColumn("key", F.col("o_orderkey"))
    columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"]
    return findings(texts, columns, keys=["key"])


# --------------------------------------------------------------- validators

_VALUES = f"""{o.PEOPLE},
vals as ({' union all '.join(
    f"select id, '{t}' as type_id, {o.lit(display_name(t))} as pii_type, {c} as value from people"
    for t, c in zip(PATTERN_TYPES, o.PEOPLE_COLUMNS, strict=False))})"""


def _named_values(spark, root):
    lookup = F.create_map(*[F.lit(x) for t in PATTERN_TYPES for x in (t, display_name(t))])
    return people_values(spark, root).withColumn("pii_type", lookup[F.col("type_id")])


@query("luhn_check", o.with_(o.PEOPLE) + f"select id, card, {o.luhn('card')} as valid from people")
def luhn_check(spark, root):
    return people(spark, root).select("id", "card", is_luhn("card").alias("valid"))


@query("ssn_check", o.with_(o.PEOPLE) + f"select id, ssn, {o.ssn('ssn')} as valid from people")
def ssn_check(spark, root):
    return people(spark, root).select("id", "ssn", is_ssn("ssn").alias("valid"))


@query(
    "validate_by_type",
    o.with_(_VALUES)
    + "select pii_type, count(*)::bigint as n, count(*) filter (case pii_type when 'Credit Card Number' then "
    + f"{o.luhn('value')} when 'Social Security Number' then {o.ssn('value')} else true end)::bigint as n_valid "
    "from vals group by pii_type",
)
def validate_by_type(spark, root):
    valued = _named_values(spark, root).withColumn("ok", is_valid("pii_type", "value"))
    return valued.groupBy("pii_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_valid"))


@query(
    "digits_only",
    o.with_(_VALUES) + "select id, type_id, regexp_replace(value, '[^0-9]', '', 'g') as digits from vals",
)
def digits_of_values(spark, root):
    return people_values(spark, root).select("id", "type_id", digits_only("value").alias("digits"))


# ------------------------------------------------------------- type options

_SPELLINGS = [f for t in (*ALL_TYPES, *ALIASES, "shoe_size") for f in (t, t.upper())]


def _spelling_sql(lookup: str) -> str:
    names = "[" + ", ".join(o.lit(s) for s in _SPELLINGS) + "]"
    return (
        f"select c_custkey as id, {names}[1 + c_custkey % {len(_SPELLINGS)}] as raw, {lookup} as type_id from customer"
    )


_LOOKUP = {t: t for t in ALL_TYPES} | ALIASES


@query(
    "parse_type_names",
    "select id, raw, case lower(raw) "
    + " ".join(f"when {o.lit(k)} then {o.lit(v)}" for k, v in _LOOKUP.items())
    + f" end as type_id from ({_spelling_sql('null')})",
)
def parse_type_names(spark, root):
    """Spellings (derived per customer) to type ids; unknown ones give NULL."""
    names = F.array(*[F.lit(s) for s in _SPELLINGS])
    raw = F.element_at(names, (1 + F.col("c_custkey") % len(_SPELLINGS)).cast("int"))
    rows = table(spark, root, "customer").select(F.col("c_custkey").alias("id"), raw.alias("raw"))
    return rows.withColumn("type_id", type_id_column(F.col("raw")))


_CATALOG = " union all ".join(
    f"select {i} as ord, {o.lit(t)} as type_id, {o.lit(n)} as name, {o.lit(d)} as description, "
    f"{str(t in ('name', 'address', 'organization')).lower()} as uses_model, true as available"
    for i, (t, (n, d)) in enumerate(PII_TYPES.items())
)


@query(
    "catalog_with_counts",
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES), f"cat as ({_CATALOG})")
    + "select ord::integer as ord, type_id, name, description, uses_model, available, "
    "(select count(*) from kept where k = name)::bigint as n from cat",
)
def catalog_with_counts(spark, root):
    """The twelve types with their findings in the documents."""
    counts = type_counts(documents(spark, root).select("text"), ["text"]).withColumnRenamed("pii_type", "name")
    catalog = type_catalog(spark)
    return catalog.join(F.broadcast(counts), "name", "left").select(
        "ord", "type_id", "name", "description", "uses_model", "available", F.coalesce("n", F.lit(0)).alias("n")
    )


# -------------------------------------------------------------- replacement


def _scrub_query(method: str, salt: str = "") -> Query:
    return lambda spark, root: corpus(spark, root).select("id", scrub_text("text", None, method, salt).alias("text"))


for _m in ("mask", "remove", "hash", "fake"):
    query(
        f"scrub_{_m}",
        o.with_(o.CORPUS, o.spans("corpus", ALL_TYPES), o.spliced("corpus", "kept", _m, "s1"))
        + "select id, text from scrubbed",
    )(_scrub_query(_m, "s1"))


def _value_query(method: str, types) -> Query:
    def run(spark, root):
        rows = _named_values(spark, root).where(F.col("type_id").isin(*types))
        return rows.select("id", "type_id", replacement("pii_type", "value", method, "s1").alias("out"))

    return run


def _value_sql(method: str, types) -> str:
    listed = ", ".join(o.lit(t) for t in types)
    return (
        o.with_(_VALUES)
        + f"select id, type_id, {o.replaced('pii_type', 'value', method, 's1', types)} as out from vals "
        f"where type_id in ({listed})"
    )


for _name, _method, _types in [
    ("mask_email", "mask", ["email"]),
    ("mask_phone", "mask", ["phone"]),
    ("mask_ssn_ip_dob", "mask", ["ssn", "ip_address", "date_of_birth"]),
    ("mask_card", "mask", ["credit_card"]),
    ("mask_by_length", "mask", ["passport", "drivers_license", "bank_account"]),
    ("remove_values", "remove", list(PATTERN_TYPES)),
    ("hash_values", "hash", list(PATTERN_TYPES)),
    (
        "fake_numeric",
        "fake",
        ["ssn", "credit_card", "ip_address", "date_of_birth", "passport", "drivers_license", "bank_account"],
    ),
    ("fake_email_phone", "fake", ["email", "phone"]),
]:
    query(_name, _value_sql(_method, _types))(_value_query(_method, _types))


def _as_kind(type_id: str, method: str) -> Query:
    def run(spark, root):
        rows = table(spark, root, "customer").select(
            F.col("c_custkey").alias("id"), F.lit(display_name(type_id)).alias("kind"), F.col("c_name").alias("value")
        )
        return rows.select("id", replacement("kind", "value", method, "s1").alias("out"))

    return run


for _name, _kind, _method in [
    ("mask_organization", "organization", "mask"),
    ("fake_organization", "organization", "fake"),
    ("fake_name", "name", "fake"),
    ("fake_address", "address", "fake"),
    ("mask_name", "name", "mask"),
    ("mask_address", "address", "mask"),
]:
    _make = o.mask if _method == "mask" else o.fake
    query(_name, f"select c_custkey as id, {_make(_kind, 'c_name', 's1')} as out from customer")(
        _as_kind(_kind, _method)
    )

_METHOD_NAMES = ["mask", "Remove", "HASH", "fake", "shred"]


@query(
    "method_dispatch",
    o.with_(_VALUES, "raw as (select *, ['mask', 'Remove', 'HASH', 'fake', 'shred'][1 + id % 5] as method from vals)")
    + "select id, type_id, case when lower(method) in ('remove', 'hash', 'fake', 'mask') then lower(method) else 'mask' end as method, "
    "case lower(method) "
    + " ".join(f"when '{m}' then {o.replaced('pii_type', 'value', m, 's1', PATTERN_TYPES)}" for m in ("remove", "hash", "fake"))
    + f" else {o.replaced('pii_type', 'value', 'mask', 's1', PATTERN_TYPES)} end as out from raw",
)
def method_dispatch(spark, root):
    """The method as a column; unknown spellings mask."""
    named = F.element_at(F.array(*[F.lit(m) for m in _METHOD_NAMES]), (1 + F.col("id") % 5).cast("int"))
    rows = _named_values(spark, root).withColumn("method", named)
    return rows.select(
        "id",
        "type_id",
        method_column(F.col("method")).alias("method"),
        replacement_by_method("method", "pii_type", "value", "s1").alias("out"),
    )


@query(
    "occurrence_fakes",
    o.with_(
        o.CORPUS,
        o.spans("corpus", ALL_TYPES),
        o.spliced("corpus", "kept", "fake", "s1", value="(v || '|' || id || '|' || s::varchar)"),
    )
    + "select id, text from scrubbed",
)
def occurrence_fakes(spark, root):
    """Stand-ins that depend on row and offset instead of the value alone."""
    return corpus(spark, root).select("id", scrub_text("text", None, "fake", "s1", row_key="id").alias("text"))


# ------------------------------------------------------------------- tables


@query(
    "scrub_table",
    o.with_(o.CELLS, o.spans("cells", ALL_TYPES), o.spliced("cells", "kept", "mask"))
    + "select c.pid as id, "
    + ", ".join(f"max(s.text) filter (c.col = '{c}') as {c}" for c in o.PEOPLE_COLUMNS)
    + " from scrubbed s join cells c using (id) group by c.pid",
)
def scrub_table(spark, root):
    return scrub(people(spark, root))


_NAMES = "names as (select c_custkey as id, concat(c_name, ' user', cast(c_custkey as varchar(20)), '@mail.example.com') as text from customer)"


@query(
    "scrub_header",
    o.with_(_NAMES, o.spans("names", ALL_TYPES), o.spliced("names", "kept", "mask"))
    + "select id, text as name, (select count(*) from kept k where k.id = scrubbed.id)::integer as found from scrubbed",
)
def scrub_header(spark, root):
    """Header cells as rows, as ``scrub_names`` treats them."""
    names = spread(table(spark, root, "customer").select("c_custkey", "c_name")).select(
        F.col("c_custkey").alias("id"),
        F.concat("c_name", F.lit(" user"), "c_custkey", F.lit("@mail.example.com")).alias("name"),
    )
    return scrub_marked(names, ["name"]).select("id", "name", F.col("pii.found").alias("found"))


@query(
    "scrub_documents",
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES), o.spliced("docs", "kept", "mask")) + "select id, text from scrubbed",
)
def scrub_documents(spark, root):
    return scrub(documents(spark, root).select("id", "text"), ["text"])


@query(
    "flagship_mask_emails",
    o.with_(o.DOCS, o.spans("docs", ["email"]), o.spliced("docs", "kept", "mask"))
    + "select id, text from scrubbed",
)
def flagship_mask_emails(spark, root):
    """Mask every email in the documents."""
    return scrub(documents(spark, root).select("id", "text"), ["text"], ["email"])


_DOC_LINES = (
    "dl as (select doc_id, unnest(string_split(body, chr(10))) as text, "
    "unnest(range(0, len(string_split(body, chr(10))))) as line_no "
    "from (select doc_id, regexp_replace(text, '\\n$', '') as body from documents where text <> '')),\n"
    "numbered as (select concat(cast(doc_id as varchar(20)), ':', cast(line_no as varchar(20))) as id, doc_id, "
    "line_no::integer as line_no, text from dl)"
)


@query("number_lines", o.with_(_DOC_LINES) + "select doc_id as id, line_no, text as line from numbered")
def number_document_lines(spark, root):
    return number_lines(documents(spark, root), keys=("id",))


@query(
    "scrub_lines",
    o.with_(_DOC_LINES, o.spans("numbered", ALL_TYPES), o.spliced("numbered", "kept", "mask"))
    + "select n.doc_id as id, n.line_no, s.text as line from scrubbed s join numbered n using (id)",
)
def scrub_document_lines(spark, root):
    return scrub(number_lines(documents(spark, root), keys=("id",)), ["line"])


@query(
    "route_by_kind",
    o.with_(
        _DOC_LINES,
        """routed as (
  select concat('d', cast(doc_id as varchar(20))) as id, doc_id, 'document' as unit, 0 as line_no, text
  from documents where lang = 'en'
  union all select n.id, n.doc_id, 'line', n.line_no, n.text from numbered n join documents d using (doc_id)
  where lang <> 'en')""",
        o.spans("routed", ALL_TYPES),
        o.spliced("routed", "kept", "mask"),
    )
    + "select r.doc_id as id, r.unit, r.line_no::integer as line_no, s.text from scrubbed s join routed r using (id)",
)
def route_by_kind(spark, root):
    """Texts of one kind as one value each, all others line by line."""
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return scrub(route_units(docs, F.col("lang") != "en", keys=("id",)), ["text"])


# ----------------------------------------------------------------- counting

_PEOPLE_KEPT = o.with_(o.CELLS, o.spans("cells", ALL_TYPES))


@query("total_found", o.with_(o.CORPUS, o.spans("corpus", ALL_TYPES)) + "select count(*)::bigint as pii_found from kept")
def total_found(spark, root):
    return stats(corpus(spark, root), ["text"]).select("pii_found")


@query(
    "found_by_type",
    o.with_(o.CORPUS, o.spans("corpus", ALL_TYPES)) + "select k as pii_type, count(*)::bigint as n from kept group by k",
)
def found_by_type(spark, root):
    return type_counts(corpus(spark, root), ["text"])


@query(
    "rows_and_cells",
    _PEOPLE_KEPT
    + ", hit as (select distinct id from kept) select (select count(*) from kept)::bigint as pii_found, "
    "(select count(*) from people)::bigint as rows_processed, "
    "(select count(distinct pid) from cells join hit using (id))::bigint as rows_affected, "
    "(select count(*) from hit)::bigint as cells_affected",
)
def rows_and_cells(spark, root):
    return stats(people(spark, root))


@query(
    "totals_by_source",
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES))
    + "select d.source, coalesce(sum(n), 0)::bigint as pii_found, count(*)::bigint as rows_processed, "
    "count(n)::bigint as rows_affected, count(n)::bigint as cells_affected "
    "from documents d left join (select id, count(*) as n from kept group by id) k on k.id = d.doc_id group by d.source",
)
def totals_by_source(spark, root):
    return stats(documents(spark, root), ["text"], by=["source"])


@query(
    "types_by_source",
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES))
    + "select d.source, k.k as pii_type, count(*)::bigint as n from kept k join documents d on d.doc_id = k.id group by all",
)
def types_by_source(spark, root):
    return type_counts(documents(spark, root), ["text"], by=["source"])


_PER_FILE = (
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES))
    + ", per_file as (select d.source as file, coalesce(sum(n), 0)::bigint as pii_found, count(n)::bigint as rows_affected, "
    "count(*) <= 50 as success from documents d "
    "left join (select id, count(*) as n from kept group by id) k on k.id = d.doc_id group by d.source) "
)


@query(
    "batch_totals",
    _PER_FILE
    + "select file, sum(pii_found)::bigint as pii_found, sum(rows_affected)::bigint as rows_affected, "
    "count(*) filter (success)::bigint as files_ok, count(*)::bigint as files from per_file group by rollup (file)",
)
def totals_of_batch(spark, root):
    """Totals per file and over all files; a file passes when within the row quota."""
    per_file = stats(documents(spark, root).withColumnRenamed("source", "file"), ["text"], by=["file"])
    ok = row_error(F.col("rows_processed"), Quota(max_rows_per_file=50)).isNull()
    return batch_totals(per_file.withColumn("success", ok))


@query(
    "profile_columns",
    _PEOPLE_KEPT
    + 'select c.col as "column", k.k as pii_type, count(*)::bigint as n, count(distinct k.v)::bigint as n_values '
    "from kept k join cells c using (id) group by all",
)
def profile_columns(spark, root):
    return profile(people(spark, root))


@query(
    "profile_merged_sketches",
    _PEOPLE_KEPT
    + 'select c.col as "column", k.k as pii_type, count(*)::bigint as n, count(distinct k.v)::bigint as n_values, true as within_error '
    "from kept k join cells c using (id) group by all",
)
def profile_merged_sketches(spark, root):
    """Sketches of nine parts of the table, merged: whether their estimates lie within 5 % of the exact counts."""
    rows = people(spark, root).withColumn("part", (F.col("id") % 9).cast("int"))
    parts = profile_sketches(rows, [c for c in rows.columns if c not in ("id", "part")], by=["part"])
    merged = merge_profiles(parts).withColumnRenamed("n_values", "estimate").withColumnRenamed("n", "n_merged")
    both = profile(people(spark, root)).join(merged, ["column", "pii_type"], "full")
    close = (F.abs(F.col("estimate") - F.col("n_values")) <= F.col("n_values") * 0.05) & (F.col("n") == F.col("n_merged"))
    return both.select("column", "pii_type", "n", "n_values", close.alias("within_error"))


# -------------------------------------------------------------------- quotas


@query(
    "quota_file_size",
    "select doc_id as id, strlen(text)::integer as size_bytes, strlen(text) <= 4096 as success, "
    "case when strlen(text) > 4096 then printf('File size (%.2f MB) exceeds the limit (%.2f MB)', "
    "strlen(text) / 1048576.0, 4096 / 1048576.0) end as error from documents",
)
def quota_file_size(spark, root):
    """Every document as a file of its byte length."""
    size = F.octet_length("text")
    error = size_error(F.col("size_bytes"), Quota(max_file_bytes=4096))
    sized = table(spark, root, "documents").select(F.col("doc_id").alias("id"), size.alias("size_bytes"))
    return sized.select("id", "size_bytes", error.isNull().alias("success"), error.alias("error"))


@query(
    "quota_rows",
    "select source as file, count(*)::bigint as n_rows, count(*) <= 50 as success, "
    "case when count(*) > 50 then printf('Row count (%d) exceeds the limit (%d)', count(*), 50) end as error "
    "from documents group by source",
)
def quota_rows(spark, root):
    counted = table(spark, root, "documents").groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    error = row_error(F.col("n_rows"), Quota(max_rows_per_file=50))
    return counted.select("file", "n_rows", error.isNull().alias("success"), error.alias("error"))


@query(
    "quota_batch",
    "select lang as batch, count(distinct source)::bigint as n_files, count(distinct source) <= 19 as success, "
    "case when count(distinct source) > 19 then printf('Batch size (%d files) exceeds the limit (%d files)', "
    "count(distinct source), 19) end as error from documents group by lang",
)
def quota_batch(spark, root):
    """Sources per language as batches of files."""
    batches = table(spark, root, "documents").groupBy(F.col("lang").alias("batch"))
    counted = batches.agg(F.count_distinct("source").alias("n_files"))
    error = batch_error(F.col("n_files"), Quota(max_files=19))
    return counted.select("batch", "n_files", error.isNull().alias("success"), error.alias("error"))


@query(
    "quota_cells",
    "select source as file, (count(*) * 5)::bigint as n_cells, count(*) * 5 <= 250 as success from documents group by source",
)
def quota_cells(spark, root):
    docs = table(spark, root, "documents")
    counted = docs.groupBy(F.col("source").alias("file")).agg((F.count(F.lit(1)) * len(docs.columns)).alias("n_cells"))
    error = cell_error(F.col("n_cells"), Quota(max_cells_per_file=250))
    return counted.select("file", "n_cells", error.isNull().alias("success"))


@query(
    "quota_types",
    "select id, raw, type_id, case when type_id not in ('email', 'phone', 'ssn', 'credit_card') "
    "then printf('PII type ''%s'' is not among the allowed types', type_id) end as error from ("
    + ORACLES["parse_type_names"]
    + ")",
)
def quota_types(spark, root):
    """Requested types against the limited tier, compared by canonical id."""
    limited = Quota(allowed_types=("email", "phone", "ssn", "credit_card"))
    return parse_type_names(spark, root).withColumn("error", type_error(F.col("type_id"), limited))


# Files of the median size and below pass, at any scale.
_MEDIAN_SOURCES = (
    "(select source from documents group by source having count(*) <= "
    "(select quantile_disc(n, 0.5) from (select count(*) as n from documents group by source)))"
)


def _rows_by_source(spark, root) -> DataFrame:
    return table(spark, root, "documents").groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def _median_rows(spark, root) -> int:
    median = F.expr("percentile_disc(0.5) within group (order by n_rows)").alias("m")
    return int(_rows_by_source(spark, root).agg(median).first()["m"])


def _within_median(spark, root) -> DataFrame:
    """Status of sources against a row quota of their median size."""
    counted = _rows_by_source(spark, root)
    error = row_error(F.col("n_rows"), Quota(max_rows_per_file=_median_rows(spark, root)))
    return counted.select("file", "n_rows", error.isNull().alias("success"), error.alias("error"))


@query(
    "quota_early_stop",
    "with m as (select quantile_disc(n, 0.5)::bigint as most from (select count(*) as n from documents group by source)) "
    "select source as file, least(count(*), any_value(most) + 1)::bigint as rows_read, count(*) <= any_value(most) as success, "
    "case when count(*) > any_value(most) then printf('Row count exceeds the limit (%d)', any_value(most)) end as error "
    "from documents, m group by source",
)
def quota_early_stop(spark, root):
    """The statuses of a row quota, from no more than one row beyond it of each file."""
    quota = Quota(max_rows_per_file=_median_rows(spark, root))
    rows = table(spark, root, "documents").select(F.col("source").alias("file"), "doc_id")
    counted = stop_at_quota(rows, quota, ["doc_id"]).groupBy("file").agg(F.count(F.lit(1)).alias("rows_read"))
    error = stopped_error(F.col("rows_read"), quota)
    return counted.select("file", "rows_read", error.isNull().alias("success"), error.alias("error"))


@query("isolate_failed_files", f"select doc_id as id, source as file from documents where source in {_MEDIAN_SOURCES}")
def isolate_failed_files(spark, root):
    """Rows of files within the row quota; failing files drop out as a whole."""
    rows = table(spark, root, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"))
    good, _ = split_by_status(rows, _within_median(spark, root))
    return good.select("id", "file")


@query("successful_results", f"select * from ({ORACLES['quota_file_size']}) where success")
def successful_results(spark, root):
    return successful(quota_file_size(spark, root))


@query("failed_results", f"select * from ({ORACLES['quota_file_size']}) where not success")
def failed_results(spark, root):
    return failed(quota_file_size(spark, root))


# --------------------------------------------------------------------- model


def _predicted(spark, root) -> DataFrame:
    docs = documents(spark, root).select("id", "text")
    return docs.withColumn("p", predict("text", stub_model)).withColumn("entities", F.col("p.entities"))


def _entity_rows(df: DataFrame, column: str = "entities", keys=("id",)) -> DataFrame:
    rows = df.select(*keys, F.explode_outer(column).alias("e")).where("e is not null")
    return rows.select(*keys, "e.entity", "e.start", "e.end", "e.confidence")


@query(
    "model_predict",
    o.with_(o.DOCS, o.stub_entities("docs"))
    + 'select id, ent as entity, s as start, e as "end", conf as confidence from ents',
)
def model_predict(spark, root):
    """Batched inference with a stub predictor."""
    return _entity_rows(_predicted(spark, root))


_LABELS = ["B-PER", "I-PER", "I-PER", "B-ORG", "I-ORG", "I-LOC", "B-LOC", "I-LOC", "B-MISC", "I-MISC", "O"]


def _tokens(spark, root) -> DataFrame:
    """Token labels per document, from word lengths and positions; both ends are special tokens."""
    labels = "array(" + ", ".join(f"'{x}'" for x in _LABELS) + ")"
    token = (
        "(w, i) -> named_struct('start', if(i = 0 or i = size(words) - 1, 0, 10 * i), "
        "'end', if(i = 0 or i = size(words) - 1, 0, 10 * i + length(w)), "
        f"'label', {labels}[(length(w) * 5 + i div 2) % {len(_LABELS)}], "
        "'prob', cast((37 * i + 11 * length(w)) % 100 as double) / 100)"
    )
    words = documents(spark, root).selectExpr("id", "split(text, ' ', -1) as words")
    return words.selectExpr("id", f"transform(words, {token}) as tokens")


_TOKENS = f"""words as (select doc_id as id, string_split(text, ' ') as ws from documents),
raw_tokens as (select id, unnest(ws) as w, unnest(range(0, len(ws)))::integer as i, len(ws) as n from words),
tokens as (
  select id, i, case when i = 0 or i = n - 1 then 0 else 10 * i end as s,
    case when i = 0 or i = n - 1 then 0 else 10 * i + length(w) end as e,
    [{', '.join(o.lit(x) for x in _LABELS)}][1 + (length(w) * 5 + i // 2) % {len(_LABELS)}] as label,
    ((37 * i + 11 * length(w)) % 100)::double / 100 as prob from raw_tokens),
typed as (
  select *, case when label = 'O' then null else substr(label, 3) end as ent from tokens where not (s = 0 and e = 0 and i > 0)),
flagged as (
  select *, case when ent is null then 1 when label like 'B-%' then 1
    when ent is distinct from lag(ent) over w then 1 else 0 end as fresh
  from typed window w as (partition by id order by i)),
islands as (select *, sum(fresh) over (partition by id order by i) as island from flagged),
decoded as (
  select id, any_value(ent) as entity, arg_min(s, i)::integer as s, arg_max(e, i)::integer as e,
    list_reduce(list(prob order by i), lambda a, b: (a + b) / 2) as confidence
  from islands where ent is not null group by id, island having arg_max(e, i) > arg_min(s, i))"""


@query(
    "decode_tokens",
    o.with_(_TOKENS) + 'select id, entity, s as start, e as "end", confidence from decoded',
)
def decode_token_labels(spark, root):
    decoded = _tokens(spark, root).select("id", decode_tokens("tokens").alias("entities"))
    return _entity_rows(decoded)


@query(
    "confident_entities",
    o.with_(o.DOCS, o.stub_entities("docs"), o.model_spans("ents")) + f"select {o.SPAN_ROWS} from mspans",
)
def confident_entities(spark, root):
    """Entities mapped to types and filtered by confidence."""
    return span_rows(_predicted(spark, root), model_spans("text", "entities"))


@query(
    "length_gate",
    "select role as id, count(*)::bigint as n, "
    "count(*) filter (strlen(w) >= 3 and trim(w, ' ' || chr(10) || chr(13) || chr(9)) <> '')::bigint as n_long from "
    "(select role, unnest(string_split(text, ' ')) as w from conversations) group by role",
)
def length_gate(spark, root):
    """Words that reach the model: one that takes any text for a name shows which."""
    words = table(spark, root, "conversations").select(F.col("role").alias("id"), F.explode(F.split("text", " ", -1)).alias("w"))
    seen = words.withColumn("n_found", F.size(predict("w", naming_model)["entities"]))
    return seen.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_found") > 0).alias("n_long"))


@query(
    "reuse_duplicate_texts",
    o.with_("docs as (select doc_id as id, text from documents)", o.stub_entities("docs"))
    + 'select id, ent as entity, s as start, e as "end", conf as confidence from ents',
)
def reuse_duplicate_texts(spark, root):
    """Each distinct text predicted once, answers joined back to every row."""
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text")
    answered = predict_distinct(docs, "text", stub_model)
    return _entity_rows(answered.withColumn("entities", F.col("prediction.entities")))


@query(
    "join_row_cells",
    o.with_(o.PEOPLE)
    + f"select id, concat_ws(' | ', {', '.join(o.PEOPLE_COLUMNS)}) as joined, "
    + ", ".join(
        "("
        + " + ".join([f"length({c})" for c in o.PEOPLE_COLUMNS[:i]] + [str(3 * i)])
        + f")::integer as s{i}, ("
        + " + ".join([f"length({c})" for c in o.PEOPLE_COLUMNS[: i + 1]] + [str(3 * i)])
        + f")::integer as e{i}"
        for i in range(len(o.PEOPLE_COLUMNS))
    )
    + " from people",
)
def join_row_cells(spark, root):
    names = list(o.PEOPLE_COLUMNS)
    rows = people(spark, root).select("id", join_cells(names).alias("joined"), cell_offsets(names).alias("at"))
    parts = [F.col("at")[i][k].alias(f"{k[0]}{i}") for i in range(len(names)) for k in ("start", "end")]
    return rows.select("id", "joined", *parts)


_ROW_TEXT = """rowtext as (
  select c_custkey as id, c_name as a, concat('Dr', substr(lower(c_mktsegment), 1, 3), ' Ann') as b,
    concat('Leopoldina', ' ', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) as c from customer),
joined as (select id, concat_ws(' | ', a, b, c) as text, length(a) as la, length(b) as lb, length(c) as lc from rowtext),
offs as (
  select id, 'a' as col, 0 as cs, la as ce from joined union all
  select id, 'b', la + 3, la + 3 + lb from joined union all
  select id, 'c', la + lb + 6, la + lb + 6 + lc from joined)"""


def _row_texts(spark, root) -> DataFrame:
    return table(spark, root, "customer").selectExpr(
        "c_custkey as id",
        "c_name as a",
        "concat('Dr', substring(lower(c_mktsegment), 1, 3), ' Ann') as b",
        "concat('Leopoldina', ' ', upper(substring(c_mktsegment, 1, 1)), lower(substring(c_mktsegment, 2))) as c",
    )


@query(
    "spans_to_cells",
    o.with_(_ROW_TEXT, o.stub_entities("joined"), o.model_spans("ents"))
    + 'select m.id, f.col as "column", (m.s - f.cs)::integer as start, (m.e - f.cs)::integer as "end", m.o as ord, '
    "m.k as pii_type, m.v as value from mspans m join offs f on f.id = m.id and m.s >= f.cs and m.e <= f.ce",
)
def row_spans_to_cells(spark, root):
    """One prediction per row, spans mapped back to the cells they lie in."""
    rows = _row_texts(spark, root)
    names = ["a", "b", "c"]
    joined = rows.select("id", join_cells(names).alias("text"), cell_offsets(names).alias("offsets"))
    joined = joined.withColumn("p", predict("text", stub_model)).withColumn("entities", F.col("p.entities"))
    joined = joined.withColumn("spans", model_spans("text", "entities"))
    cells = joined.select("id", spans_to_cells("spans", "offsets").alias("cells"))
    return explode_spans(cells, {c: F.col("cells")[i] for i, c in enumerate(names)}, ["id"])


# Documents, and for each customer a name that runs into an address: the model's span overlaps the pattern's.
_CROSSING = "concat('Maximiliane Anna', lower(c_mktsegment), '@mail', cast(c_custkey as varchar(20)), '.example.com')"


def _crossing_texts(spark, root) -> DataFrame:
    persons = table(spark, root, "customer").selectExpr("-c_custkey as id", f"{_CROSSING} as text")
    return documents(spark, root).select("id", "text").union(persons)


@query(
    "merge_span_sources",
    o.with_(
        f"docs as (select doc_id as id, text from documents union all select -c_custkey, {_CROSSING} from customer)",
        o.spans("docs", ALL_TYPES),
        o.stub_entities("docs"),
        o.model_spans("ents"),
        "pooled as (select * from kept union all select id, s, e, o::integer, k, v from mspans)",
        o.resolved("pooled", "merged"),
    )
    + f"select {o.SPAN_ROWS} from merged",
)
def merge_span_sources(spark, root):
    """Resolved pattern spans and model spans, merged and resolved again."""
    rows = _crossing_texts(spark, root).withColumn("p", predict("text", stub_model)).withColumn("entities", F.col("p.entities"))
    return span_rows(rows.withColumns({"a": find_spans("text"), "b": model_spans("text", "entities")}), merge_spans("a", "b"))


@query("general_detect", ORACLES["merge_span_sources"])
def general_detect(spark, root):
    """Pattern and model detection in one call."""
    return span_rows(detect_with_model(_crossing_texts(spark, root), stub_model, ["text"], unit="cell"), F.col("text_spans"))


@query(
    "model_failure",
    "select count(*)::bigint as n_texts, count(*) filter (strlen(text) >= 3 and trim(text, ' ' || chr(10) || chr(9)) <> '')::bigint as n_errors, "
    "0::bigint as n_entities from documents",
)
def model_failure(spark, root):
    """A failing model gives no entities; the errors are counted and the job goes on."""
    docs = documents(spark, root).select(predict("text", failing_model).alias("p"))
    return docs.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count("p.error").alias("n_errors"),
        F.sum(F.size("p.entities")).alias("n_entities"),
    )


# ------------------------------------------------------------ files: sources


@query(
    "csv_scan",
    o.with_(o.PEOPLE)
    + f"select cast(id as varchar(20)) as id, {', '.join(o.PEOPLE_COLUMNS[:-1])}, "
    "concat(note, ', \"', email, '\"', chr(10), phone) as note from people",
)
def csv_scan(spark, root):
    """Write as CSV with awkward cells, read back as strings."""
    path = fresh_path(spark, "csv")
    awkward = F.concat("note", F.lit(', "'), "email", F.lit('"\n'), "phone")
    write_csv(people(spark, root).withColumn("note", awkward), path)
    return read_csv(spark, path)


@query(
    "csv_ragged_guard",
    "select c_nationkey::varchar as file, count(*)::bigint as n_rows, "
    "count(*) filter (c_custkey % 97 = 0)::bigint as n_ragged, count(*) filter (c_custkey % 97 = 0) = 0 as success "
    "from customer group by c_nationkey",
)
def csv_ragged_guard(spark, root):
    """Records of the wrong width make their file fail. Some records get one cell too many."""
    path = fresh_path(spark, "ragged")
    cells = F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment")
    record = F.when(F.col("c_custkey") % 97 == 0, F.concat(cells, F.lit(",extra"))).otherwise(cells)
    records = table(spark, root, "customer").select("c_nationkey", record.alias("line"))
    write_lines(records, path, partition_by=["c_nationkey"])
    rows = read_csv_checked(
        spark, f"{path}/c_nationkey=*/*", ["key", "name", "segment"], multiline=False, has_header=False
    )
    named = rows.withColumn("file", F.regexp_extract("file", "c_nationkey=([^/]+)", 1))
    checked = named.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_ragged").alias("n_ragged"))
    return checked.withColumn("success", F.col("n_ragged") == 0)


_ENDED = "concat(regexp_replace(text, '\\n$', ''), chr(10))"


@query("whole_text_scan", f"select cast(item_id as varchar) as id, {_ENDED} as text from benchmark")
def whole_text_scan(spark, root):
    """One file per item, each read back as one value (written texts end with a line feed)."""
    path = fresh_path(spark, "texts")
    items = table(spark, root, "benchmark").select(F.col("item_id").cast("string").alias("out_file"), "text")
    write_texts(items, path)
    back = read_texts(spark, f"{path}/out_file=*/*")
    return back.select(F.regexp_extract("file", "out_file=([^/]+)", 1).alias("id"), "text")


_LINE_COUNTS = (
    "select line, count(*)::bigint as n from (select unnest(string_split(text, chr(10))) as line from documents) group by line"
)


@query("line_scan", _LINE_COUNTS)
def line_scan(spark, root):
    """Texts written as lines and scanned line by line, split between tasks."""
    path = fresh_path(spark, "lines")
    write_lines(documents(spark, root), path, "text")
    return read_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


_EVENT_JSON = (
    "concat('{\"event\": ', cast(event_id as varchar(20)), ', \"user\": \"user', cast(user_id as varchar(20)), "
    "'@mail.example.com\", \"props\": ', props, '}')"
)


@query(
    "json_as_text",
    o.with_(
        f"src as (select event_id as id, {_EVENT_JSON} as text from events)",
        o.spans("src", ALL_TYPES),
        o.spliced("src", "kept", "mask"),
    )
    + "select text as line from scrubbed",
)
def json_as_text(spark, root):
    """JSON scrubbed as text, unparsed."""
    path = fresh_path(spark, "json")
    events = table(spark, root, "events").selectExpr(f"{_EVENT_JSON} as line")
    write_lines(events, path)
    return scrub(read_lines(spark, path).select("line"), ["line"])


@query(
    "workbook_rows",
    "select cast(c_custkey as varchar) as id, c_name as name, c_mktsegment as segment from customer",
)
def workbook_rows(spark, root):
    """Rows packed into workbooks and parsed back; the first row of each is its header."""
    rows = table(spark, root, "customer").selectExpr("cast(c_custkey as string) id", "c_name name", "c_mktsegment segment")
    books = as_workbooks(rows)
    cells = parse_workbooks(books).where("row_idx > 0 and error is null")
    return cells.select(*[F.col("cells")[i].alias(n) for i, n in enumerate(("id", "name", "segment"))])


_URL_NAME = "string_split(url, '/')[-1]"


@query(
    "file_kinds",
    f"""select page_id as id, case when ext in ('csv', 'xlsx', 'xls', 'txt', 'json') then ext else 'txt' end as kind,
  case when has then ext else 'txt' end as reported from (
  select page_id, regexp_matches({_URL_NAME}, '.\\.[^.]*$') as has, lower(regexp_extract({_URL_NAME}, '.\\.([^.]*)$', 1)) as ext
  from (select page_id, concat(url, ['.CSV', '.json', '', '.Xlsx', '.txt', '.dat'][1 + page_id % 6]) as url from pages))""",
)
def file_kinds(spark, root):
    """Kinds and reported extensions by file name, names derived from page addresses."""
    names = _names_of_pages(spark, root)
    return names.select("id", file_kind("name").alias("kind"), reported_extension("name").alias("reported"))


def _names_of_pages(spark, root):
    endings = F.array(*[F.lit(x) for x in (".CSV", ".json", "", ".Xlsx", ".txt", ".dat")])
    ending = F.element_at(endings, (1 + F.col("page_id") % 6).cast("int"))
    return table(spark, root, "pages").select(F.col("page_id").alias("id"), F.concat("url", ending).alias("name"))


@query(
    "output_names",
    f"""select page_id as id, concat(case when stem = '' then 'output' else stem end, '_scrubbed.',
  case when not has then 'csv' when ext in ('xlsx', 'xls') then 'csv' else ext end) as out_file from (
  select page_id, regexp_matches(n, '.\\.[^.]*$') as has, lower(regexp_extract(n, '.\\.([^.]*)$', 1)) as ext,
    case when regexp_matches(n, '.\\.[^.]*$') then regexp_replace(n, '\\.[^.]*$', '') else n end as stem
  from (select page_id, string_split(concat(url, ['.CSV', '.json', '', '.Xlsx', '.txt', '.dat'][1 + page_id % 6]), '/')[-1] as n from pages))""",
)
def output_names(spark, root):
    return _names_of_pages(spark, root).select("id", output_name("name").alias("out_file"))


@query(
    "multi_file_batch",
    "select source as file, count(*)::bigint as n_rows, sum(n_chars)::bigint as n_chars from documents "
    "where source <> 'src0' group by source",
)
def multi_file_batch(spark, root):
    """Many files in one read, one of them dropped by name."""
    path = fresh_path(spark, "batch")
    docs = table(spark, root, "documents").select("source", "doc_id", "lang", "n_chars")
    write_csv(docs, path, partition_by=["source"])
    rows = read_csv(spark, f"{path}/source=*/*.csv", ["doc_id", "lang", "n_chars"], with_file=True)
    named = rows.withColumn("file", F.regexp_extract("file", "source=([^/]+)", 1))
    kept = without_files(named, ["src0"])
    return kept.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("n_chars").cast("long")).alias("n_chars"))


# -------------------------------------------------------------- files: sinks


@query(
    "csv_write",
    o.with_(o.CELLS, o.spans("cells", ALL_TYPES), o.spliced("cells", "kept", "remove"))
    + "select cast(c.pid as varchar) as id, "
    + ", ".join(f"max(s.text) filter (c.col = '{c}') as {c}" for c in o.PEOPLE_COLUMNS)
    + " from scrubbed s join cells c using (id) group by c.pid",
)
def csv_write(spark, root):
    """Scrubbed table written as CSV and read back."""
    path = fresh_path(spark, "out")
    write_csv(scrub(people(spark, root), method="remove"), path)
    return read_csv(spark, path, multiline=False)


@query(
    "text_write",
    o.with_(
        "src as (select row_number() over () as id, line as text from (select unnest(string_split(text, chr(10))) as line from documents))",
        o.spans("src", ALL_TYPES),
        o.spliced("src", "kept", "hash"),
    )
    + "select text as line, count(*)::bigint as n from scrubbed group by text",
)
def text_write(spark, root):
    """Scrubbed lines written as text and read back."""
    path = fresh_path(spark, "out")
    lines = documents(spark, root).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    write_lines(scrub(lines, ["line"], method="hash"), path)
    return read_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "preview_texts",
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES), o.spliced("docs", "kept", "mask"))
    + "select id, case when length(text) > 2000 then concat(substring(text, 1, 2000), '...', chr(10), chr(10), "
    "'[Truncated - ', cast(length(text) as varchar), ' total characters]') else text end as preview from scrubbed",
)
def preview_texts(spark, root):
    return scrub_documents(spark, root).select("id", preview("text").alias("preview"))


@query(
    "save_successful",
    f"select source as file, count(*)::bigint as n_rows from documents where source in {_MEDIAN_SOURCES} group by source",
)
def save_successful(spark, root):
    """Only the files that passed are written."""
    path = fresh_path(spark, "saved")
    docs = table(spark, root, "documents").select(F.col("source").alias("file"), "doc_id", "lang")
    ok = successful(_within_median(spark, root)).select("file")
    write_csv(docs.join(small_side(ok), "file", "left_semi"), path, partition_by=["file"])
    back = read_csv(spark, f"{path}/file=*/*.csv", ["doc_id", "lang"], with_file=True)
    named = back.withColumn("file", F.regexp_extract("file", "file=([^/]+)", 1))
    return named.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))


_NATION_FILES = (
    o.with_(o.CELLS, o.spans("cells", ALL_TYPES))
    + ", hit as (select id, count(*) as n from kept group by id), per as (select c.pid, sum(h.n) as n, count(h.n) as cells "
    "from cells c left join hit h using (id) group by c.pid) "
    "select c_nationkey::varchar as file, coalesce(sum(n), 0)::bigint as pii_found, count(*)::bigint as rows_processed, "
    "count(n)::bigint as rows_affected, sum(cells)::bigint as cells_affected, true as success "
    "from per join customer on c_custkey = pid group by c_nationkey"
)


@query("file_report", _NATION_FILES)
def file_report(spark, root):
    """The one-call run over CSV files, one per nation, with its report."""
    path = fresh_path(spark, "people")
    nations = table(spark, root, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    rows = people(spark, root).join(nations, "id")
    # A nation's rows go to a few tasks, never to one: bounded file counts without a hot task.
    write_csv(rows.repartition("c_nationkey", F.col("id") % 4), path, partition_by=["c_nationkey"])
    run = scrub_files(spark, [path], multiline=False)
    report = run.report.withColumn("file", F.regexp_extract("file", "c_nationkey=([^/]+)", 1))
    sums = ("pii_found", "rows_processed", "rows_affected", "cells_affected")
    return report.groupBy("file").agg(
        *[F.sum(c).alias(c) for c in sums], F.bool_and("success").alias("success")
    )


@query(
    "mixed_folder_report",
    "select 'plain' as folder, 'csv' as file_type, count(*)::bigint as pii_found, count(*)::bigint as rows_processed, "
    "count(*)::bigint as rows_affected, count(*)::bigint as cells_affected, true as success from customer where c_custkey % 2 = 0 "
    "union all select 'swapped', 'csv', count(*), count(*), count(*), count(*), true from customer where c_custkey % 2 = 1 "
    "union all select 'headers', 'csv', 1, 0, 0, 0, true "
    "union all select 'notes', 'log', count(*), count(*), count(*), count(*), true from supplier",
)
def mixed_folder_report(spark, root):
    """One folder, one call: tables with their columns in either order, a table of a header alone, and logs."""
    path = fresh_path(spark, "mixed")
    rows = table(spark, root, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("user"), "c_custkey", F.lit("@mail.example.com")).alias("mail")
    )
    write_csv(rows.where("id % 2 = 0"), f"{path}/plain")
    write_csv(rows.where("id % 2 = 1").select("mail", "id"), f"{path}/deep/swapped")
    write_csv(rows.where("false").select(F.col("mail").alias("ann.lee@mail.example.com"), F.col("id").alias("n")), f"{path}/headers")
    notes = table(spark, root, "supplier").select(F.concat(F.lit("mail to s"), "s_suppkey", F.lit("@mail.example.com")).alias("value"))
    notes.write.option("compression", "none").text(f"{path}/notes")
    run = scrub_files(spark, [path], types=["email"], multiline=False, text_mode="line")
    folder = F.regexp_extract("file", "/([^/]+)/[^/]+$", 1)
    kind = F.when(F.col("file_type") == "txt", F.lit("log")).otherwise(F.col("file_type"))
    sums = ("pii_found", "rows_processed", "rows_affected", "cells_affected")
    written = run.report.where(~F.element_at(F.split("file", "/"), -1).startswith("_"))
    return written.groupBy(folder.alias("folder"), kind.alias("file_type")).agg(
        *[F.sum(c).alias(c) for c in sums], F.bool_and("success").alias("success")
    )


@query(
    "csv_columns_by_file",
    "select c_custkey as id, 'u***@mail.example.com' as mail from customer",
)
def csv_columns_by_file(spark, root):
    """Files with columns in either order, scrubbed in one scan; each file's own header says which cell is which."""
    path = fresh_path(spark, "orders")
    rows = table(spark, root, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("user"), "c_custkey", F.lit("@mail.example.com")).alias("mail")
    )
    write_csv(rows.where("id % 2 = 0"), f"{path}/plain")
    write_csv(rows.where("id % 2 = 1").select("mail", "id"), f"{path}/swapped")
    run = scrub_files(spark, [path], types=["email"], multiline=False)
    named = named_cells(run.tables, ["id", "mail"])
    return named.select(F.col("id").cast("long").alias("id"), "mail")


@query(
    "file_line_numbers",
    "select item_id as id, (generate_subscripts(l, 1) - 1)::bigint as line_no, unnest(l) as line from "
    "(select item_id, string_split(replace(text, ' ', chr(10)), chr(10)) as l from benchmark)",
)
def file_line_numbers(spark, root):
    """Lines with their number in their file, though files may be split between tasks."""
    path = fresh_path(spark, "numbered")
    words = F.replace("text", F.lit(" "), F.lit("\n"))
    write_texts(table(spark, root, "benchmark").select(F.col("item_id").cast("string").alias("out_file"), words.alias("text")), path)
    rows = read_numbered_lines(spark, f"{path}/out_file=*/*")
    return rows.select(F.regexp_extract("file", "out_file=([^/]+)", 1).cast("long").alias("id"), "line_no", "line")


@query("scrub_csv_files", ORACLES["csv_write"].replace("cast(c.pid as varchar) as id", "cast(c.pid as varchar) as id"))
def scrub_csv_files(spark, root):
    """A CSV table of any size: read by splits, scrubbed in place."""
    path = fresh_path(spark, "large")
    write_csv(people(spark, root), path)
    return scrub(read_csv(spark, path, multiline=False), list(o.PEOPLE_COLUMNS), method="remove")


# ----------------------------------------------------------------- streaming


# Documents above this many characters are cut into pieces that many tasks scan.
_LONG = 2000


@query(
    "piece_findings",
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES))
    + 'select k.id, k.s as start, k.e as "end", k.o as ord, k.k as pii_type, k.v as value from kept k',
)
def piece_findings(spark, root):
    """Findings of documents, the long ones cut where no match can lie across; the rows are those of whole texts."""
    return findings_in_pieces(documents(spark, root), "text", keys=["id"], piece_chars=_LONG).drop("column")


@query("piece_scrub", ORACLES["scrub_documents"])
def piece_scrub(spark, root):
    """Documents scrubbed, the long ones piece by piece in many tasks."""
    return scrub_in_pieces(documents(spark, root).select("id", "text"), "text", ["id"], piece_chars=_LONG)


@query(
    "huge_file_findings",
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES))
    + "select k as pii_type, v as value, count(*)::bigint as n from kept group by k, v",
)
def huge_file_findings(spark, root):
    """Files of many documents each, split between tasks, with values that cross lines found as in a whole text."""
    path = fresh_path(spark, "huge")
    ended = F.concat(F.coalesce("text", F.lit("")), F.lit("\n##"))
    write_lines(documents(spark, root).select(ended.alias("line")), path)
    return findings_in_files(spark, path).groupBy("pii_type", "value").agg(F.count(F.lit(1)).alias("n"))



def _saved_with_manifest(spark, root) -> str:
    """Customers as one text file for each nation, scrubbed by line and saved with a manifest; gives the folder."""
    source, saved = fresh_path(spark, "in"), fresh_path(spark, "saved")
    line = F.concat_ws(" ", F.lit("nation"), "c_nationkey", F.lit("customer"), "c_custkey", F.lit("mail a@b.com"))
    rows = table(spark, root, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", line.alias("line"))
    write_lines(rows.repartition("nation").sortWithinPartitions("nation", "c_custkey"), source, partition_by=["nation"])
    scrub_files(spark, [source], types=["email"], text_mode="line").save_with_manifest(saved)
    return saved


@query(
    "manifest_lines",
    "select c_nationkey::bigint as nation, (row_number() over (partition by c_nationkey order by c_custkey) - 1)::bigint as line_no, "
    "'nation ' || c_nationkey || ' customer ' || c_custkey || ' mail ***@b.com' as line from customer",
)
def manifest_lines(spark, root):
    """Lines of saved files in the order of their input, by the manifest."""
    lines = read_by_manifest(spark, _saved_with_manifest(spark, root))
    return lines.select(F.regexp_extract("line", "nation ([0-9]+)", 1).cast("long").alias("nation"), "line_no", "line")


@query("manifest_check", "select c_nationkey::bigint as nation, count(*)::bigint as n from customer group by 1")
def manifest_check(spark, root):
    """Lines by nation of the saved parts that are as the manifest has them."""
    saved = _saved_with_manifest(spark, root)
    sound = read_by_manifest(spark, saved).join(damaged_parts(spark, saved), "part", "left_anti")
    return sound.groupBy(F.regexp_extract("line", "nation ([0-9]+)", 1).cast("long").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_lines",
    ORACLES["text_write"].replace("'#' || sha256(v)[1:12]", "'[' || upper(k) || ' REMOVED]'"),
)
def stream_text_lines(spark, root):
    """Lines scrubbed as a stream; the result equals the batch job's."""
    source, out, mark = (fresh_path(spark, n) for n in ("in", "out", "ckpt"))
    write_lines(documents(spark, root).select(F.explode(F.split("text", "\n", -1)).alias("line")), source)
    scrubbed = scrub_stream(stream_lines(spark, source), ["value"], method="remove")
    write_stream(scrubbed, out, mark, fmt="text").awaitTermination()
    return read_lines(spark, out).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def _document_stream(spark, root):
    # A class around the last letter makes the path a glob, which names a table that is one file as well as one that
    # is a folder of parts; a plain path has to be a folder, and a name filter would be held against the parts.
    schema = table(spark, root, "documents").schema
    return stream_table(spark, f"{root}/documents.parque[t]", schema)


@query("stream_table", ORACLES["scrub_documents"])
def stream_documents(spark, root):
    """A parquet table scrubbed as a stream."""
    out, mark = fresh_path(spark, "out"), fresh_path(spark, "ckpt")
    stream = _document_stream(spark, root).select(F.col("doc_id").alias("id"), "text")
    write_stream(scrub_stream(stream, ["text"]), out, mark).awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_type_counts",
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES)) + "select k as pii_type, count(*)::bigint as n from kept group by k",
)
def stream_type_counts(spark, root):
    """Running counts per type, kept as streaming state of one row per type."""
    out, mark = fresh_path(spark, "out"), fresh_path(spark, "ckpt")
    counts = running_type_counts(_document_stream(spark, root).select("text"), ["text"])

    def keep_latest(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    running = counts.writeStream.outputMode("complete").foreachBatch(keep_latest)
    running.option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(
    "progress_totals",
    o.with_(o.DOCS, o.spans("docs", ALL_TYPES))
    + "select (select count(*) from documents)::bigint as rows_processed, count(distinct id)::bigint as rows_affected, "
    "count(*)::bigint as pii_found, count(distinct id)::bigint as cells_affected from kept",
)
def progress_totals(spark, root):
    """Totals observed while the scrub job writes; no second pass."""
    marked = scrub_marked(documents(spark, root).select("id", "text"), ["text"])
    watched, seen = observe_batch(marked)
    watched.write.parquet(fresh_path(spark, "observed"))
    got = seen.get
    names = ("rows_processed", "rows_affected", "pii_found", "cells_affected")
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


def _customer_batches(spark, root, at_once: int = 100) -> tuple[str, str]:
    """Customers as CSV files by nation, every seventh record broken, scrubbed as a stream; gives its folder and theirs."""
    source, out, mark = (fresh_path(spark, n) for n in ("in", "out", "ckpt"))
    mail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("to user"), "c_custkey", F.lit("@mail.example.com from 10.0.0.1")))
    record = F.concat(F.when(F.col("c_custkey") % 7 == 0, F.lit("no")).otherwise(F.lit("")), "c_custkey", F.lit(","), F.coalesce(mail, F.lit("none")))
    lines = table(spark, root, "customer").select(F.col("c_nationkey").alias("nation"), record.alias("line"))
    write_lines(lines, source, partition_by=["nation"])
    stream = stream_files(spark, f"{source}/nation=*", "id long, t string", maxFilesPerTrigger=at_once)
    scrub_batches(stream, out, mark, ["t"]).awaitTermination()
    return out, source


def _nation():
    return F.regexp_extract("file", "nation=([0-9]+)", 1).cast("long").alias("nation")


_GOOD = "from customer where c_custkey % 7 <> 0"


@query(
    "stream_good_rows",
    "select c_nationkey::bigint as nation, c_custkey::bigint as id, case when c_custkey % 3 = 0 then 'to u***@mail.example.com from ***.***.***.***' "
    f"else 'none' end as t {_GOOD}",
)
def stream_good_rows(spark, root):
    """The rows of a stream that could be read, scrubbed; broken records among them stop nothing."""
    return batch_rows(spark, _customer_batches(spark, root)[0]).select(_nation(), "id", "t")


@query(
    "stream_dead_letters",
    "select c_nationkey::bigint as nation, 'no' || c_custkey || ',' || case when c_custkey % 3 = 0 then 'to user' || c_custkey || "
    "'@mail.example.com from 10.0.0.1' else 'none' end as record, 'The record does not fit the schema' as error "
    "from customer where c_custkey % 7 = 0",
)
def stream_dead_letters(spark, root):
    """The records of a stream that could not be read, as they came."""
    return dead_letters(spark, _customer_batches(spark, root)[0]).select(_nation(), F.col("_corrupt").alias("record"), "error")


@query(
    "stream_file_totals",
    "select c_nationkey::bigint as nation, 2 * sum((c_custkey % 3 = 0)::int)::bigint as pii_found, count(*)::bigint as rows_processed, "
    f"sum((c_custkey % 3 = 0)::int)::bigint as rows_affected, sum((c_custkey % 3 = 0)::int)::bigint as cells_affected {_GOOD} group by 1",
)
def stream_file_totals(spark, root):
    """Totals by file of a stream: what each batch added, summed."""
    totals = running_totals(spark, _customer_batches(spark, root)[0]).withColumn("nation", _nation())
    names = ("pii_found", "rows_processed", "rows_affected", "cells_affected")
    return totals.groupBy("nation").agg(*[F.sum(n).alias(n) for n in names])


@query(
    "stream_file_types",
    f"select c_nationkey::bigint as nation, k as pii_type, count(*)::bigint as n from (select *, unnest(['Email Address', 'IP Address']) as k {_GOOD} "
    "and c_custkey % 3 = 0) group by 1, 2",
)
def stream_file_types(spark, root):
    """Findings of a stream by file and type."""
    types = running_types(spark, _customer_batches(spark, root)[0]).withColumn("nation", _nation())
    return types.groupBy("nation", "pii_type").agg(F.sum("n").alias("n"))


@query(
    "stream_progress",
    "select true as rises, 100.0::double as percent, 'complete' as phase, count(*)::bigint as rows_processed, "
    f"2 * sum((c_custkey % 3 = 0)::int)::bigint as pii_found {_GOOD}",
)
def stream_progress(spark, root):
    """Progress by batch, nine files at a time: it only rises, and ends with every byte and every good row."""
    out, source = _customer_batches(spark, root, at_once=9)
    steps = batch_progress(spark, out, [f"{source}/nation=*"])
    before = F.coalesce(F.lag("percent").over(Window.orderBy("batch")), F.lit(0.0))
    checked = steps.withColumn("rises", F.col("percent") > before)
    return checked.agg(
        F.every("rises").alias("rises"), F.max("percent").alias("percent"), F.max_by("phase", "batch").alias("phase"),
        F.max("rows_processed").alias("rows_processed"), F.max("pii_found").alias("pii_found"),
    )
