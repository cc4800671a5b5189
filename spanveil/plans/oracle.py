"""DuckDB statements that state each registered query's expected result.

Written apart from the Spark expressions: plain patterns, unnested spans,
windows and list functions, so that agreement means something. Only word lists
and display names are shared.
"""

from __future__ import annotations

from ..functions import words
from ..functions.catalog import ALL_TYPES, display_name

# Search patterns as first defined (ASCII meaning of classes).
PLAIN = {
    "email": r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}"
    r"|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})\b",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "date_of_birth": r"\b(?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12][0-9]|3[01])[/\-](?:19|20)?\d{2}\b"
    r"|\b(?:19|20)\d{2}[/\-](?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12][0-9]|3[01])\b",
    "passport": r"\b[A-Z]{1,2}[0-9]{6,9}\b",
    "drivers_license": r"\b[A-Z]{1,2}[0-9]{5,8}\b",
    "bank_account": r"\b(?:\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}|\d{16})\b",
}

# Two capitalised words: what the stub model of the queries calls a person.
STUB = r"[A-Z][a-z]+ [A-Z][a-z]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    term = (
        "lambda c, i: case when i % 2 = 0 then (case when c::int > 4 then c::int * 2 - 9 else c::int * 2 end) else c::int end"
    )
    total = f"list_sum(list_transform(string_split(reverse({d}), ''), {term}))"
    return f"(case when length({d}) between 13 and 19 then {total} % 10 = 0 else false end)"


def ssn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return (
        f"(case when length({d}) <> 9 then false else {d}[1:3]::int not in (0, 666) and {d}[1:3]::int < 900 "
        f"and {d}[4:5]::int <> 0 and {d}[6:9]::int <> 0 end)"
    )


def candidates(src: str, types, name: str = "cand") -> str:
    """CTEs from ``src(id, text)`` to ``name(id, s, e, o, k, v)``: validated matches."""
    parts = []
    for o, t in enumerate(types):
        if t not in PLAIN:
            continue
        p = lit(PLAIN[t])
        parts.append(
            f"select id, {o} as o, {lit(display_name(t))} as k, regexp_extract_all(text, {p}, 0) as m, "
            f"regexp_split_to_array(text, {p}) as g from {src} where regexp_matches(text, {p})"
        )
    length = "lambda x: length(x)"
    return f"""{name}_hits as ({' union all '.join(parts)}),
{name}_pos as (
  select id, o, k, m[i] as v,
    (coalesce(list_sum(list_transform(g[1:i], {length})), 0)
     + coalesce(list_sum(list_transform(m[1:i - 1], {length})), 0))::integer as s
  from (select *, unnest(range(1, len(m) + 1)) as i from {name}_hits)),
{name} as (
  select id, s, (s + length(v))::integer as e, o, k, v from {name}_pos
  where case k when 'Credit Card Number' then {luhn('v')} when 'Social Security Number' then {ssn('v')} else true end)"""


def resolved(cand: str, name: str = "kept") -> str:
    """CTE ``name(id, s, e, o, k, v)``: greedy non-overlapping spans of ``cand``."""
    return f"""{name}_l as (select id, list({{'s': s, 'e': e, 'o': o, 'k': k, 'v': v}} order by s, o) as l from {cand} group by id),
{name}_r as (
  select id, unnest(list_reduce(list_transform(l, lambda x: [x]),
    lambda a, b: case when b[1].s >= a[-1].e then list_concat(a, b) else a end)) as r from {name}_l),
{name} as (select id, r.s as s, r.e as e, r.o as o, r.k as k, r.v as v from {name}_r)"""


def spans(src: str, types=ALL_TYPES, name: str = "kept") -> str:
    return candidates(src, types, f"{name}_c") + ",\n" + resolved(f"{name}_c", name)


def slot(d: str, at: int, low: int, count: int) -> str:
    return f"({low} + ('0x' || substr({d}, {8 * at + 1}, 8))::bigint % {count})"


def pick(d: str, at: int, options) -> str:
    return "[" + ", ".join(lit(o) for o in options) + f"][{slot(d, at, 1, len(options))}]"


def fake(type_id: str, v: str, salt: str = "") -> str:
    d = f"sha256({lit(salt + '|' + type_id + '|')} || {v})"

    def num(at, low, count, width=0):
        n = f"{slot(d, at, low, count)}::varchar"
        return f"lpad({n}, {width}, '0')" if width else n

    first, last = pick(d, 0, words.FIRST_NAMES), pick(d, 1, words.LAST_NAMES)
    if type_id == "email":
        return f"lower({first}) || '.' || lower({last}) || '@example.' || {pick(d, 2, words.EMAIL_ENDINGS)}"
    if type_id == "phone":
        return f"'(' || {num(0, 200, 800)} || ') ' || {num(1, 200, 800)} || '-' || {num(2, 0, 10000, 4)}"
    if type_id == "ssn":
        return f"{num(0, 100, 799)} || '-' || {num(1, 1, 98, 2)} || '-' || {num(2, 1, 9998, 4)}"
    if type_id == "credit_card":
        return f"'4' || {num(0, 0, 999, 3)}" + "".join(f" || '-' || {num(i, 0, 9999, 4)}" for i in (1, 2, 3))
    if type_id == "ip_address":
        return f"{num(0, 1, 254)} || '.' || {num(1, 0, 255)} || '.' || {num(2, 0, 255)} || '.' || {num(3, 1, 254)}"
    if type_id == "date_of_birth":
        return f"{num(0, 1, 11, 2)} || '/' || {num(1, 1, 27, 2)} || '/' || {num(2, 1950, 55)}"
    if type_id == "address":
        return f"{pick(d, 0, words.UNIT_WORDS)} || ' ' || {num(1, 100, 900)}"
    if type_id == "name":
        return f"{first} || ' ' || {last}"
    if type_id == "passport":
        return f"'P' || {num(0, 10000000, 89999999)}"
    if type_id == "drivers_license":
        return f"'DL' || {num(0, 1000000, 8999999)}"
    if type_id == "bank_account":
        return f"(100000000000 + ('0x' || substr({d}, 1, 15))::bigint % 899999999999)::varchar"
    a, b, c = (pick(d, i, words.LAST_NAMES) for i in (0, 1, 2))
    return (
        f"case {slot(d, 3, 0, 3)} when 0 then {a} || ' ' || {pick(d, 4, words.COMPANY_SUFFIXES)} "
        f"when 1 then {a} || '-' || {b} else {a} || ', ' || {b} || ' and ' || {c} end"
    )


def mask(type_id: str, v: str, salt: str = "") -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    if type_id == "email":
        local = f"string_split({v}, '@')[1]"
        domain = f"substr({v}, instr({v}, '@'))"
        return f"case when strlen({local}) > 2 then {v}[1:1] || '***' || {domain} else '***' || {domain} end"
    if type_id == "phone":
        return f"'***-***-' || right({d}, 4)"
    if type_id == "credit_card":
        return f"'****-****-****-' || right({d}, 4)"
    fixed = {"ssn": "***-**-****", "ip_address": "***.***.***.***", "date_of_birth": "**/**/****"}
    if type_id in fixed:
        return lit(fixed[type_id])
    if type_id == "organization":
        return fake(type_id, v, salt)
    return f"repeat('*', least(strlen({v}), 20)::bigint)"


def replaced(k: str, v: str, method: str, salt: str = "", types=ALL_TYPES) -> str:
    if method == "remove":
        return f"'[' || upper({k}) || ' REMOVED]'"
    if method == "hash":
        return f"'#' || sha256({v})[1:12]"
    make = fake if method == "fake" else mask
    return f"case {k} " + " ".join(f"when {lit(display_name(t))} then {make(t, v, salt)}" for t in types) + " end"


def spliced(src: str, kept: str, method: str, salt: str = "", name: str = "scrubbed", value: str = "v") -> str:
    """CTE ``name(id, text)``: every row of ``src`` with the spans of ``kept`` replaced.

    ``value`` is what the replacement is made from.
    """
    return f"""{name}_p as (
  select id, s, e, {replaced('k', value, method, salt)} as r,
    coalesce(lag(e) over (partition by id order by s), 0) as b from {kept}),
{name}_j as (
  select p.id, string_agg(substring(t.text, p.b + 1, p.s - p.b) || p.r, '' order by p.s)
    || substring(any_value(t.text), max(p.e) + 1) as text
  from {name}_p p join {src} t using (id) group by p.id),
{name} as (select t.id, coalesce(j.text, t.text) as text from {src} t left join {name}_j j using (id))"""


PEOPLE = """people as (
  select c_custkey as id,
    concat('user', cast(c_custkey as varchar(20)), '@mail', cast(c_custkey % 9 as varchar(20)), '.example.com') as email,
    concat('(', lpad(cast(200 + c_custkey % 700 as varchar(20)), 3, '0'), ') 555-', lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0')) as phone,
    concat(lpad(cast(c_custkey % 1000 as varchar(20)), 3, '0'), '-', lpad(cast(c_custkey % 100 as varchar(20)), 2, '0'), '-', lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0')) as ssn,
    concat('4', lpad(cast(c_custkey as varchar(20)), 15, '0')) as card,
    concat('10.', cast(c_custkey % 300 as varchar(20)), '.0.1') as ip,
    concat(cast(1 + c_custkey % 13 as varchar(20)), '/', cast(1 + c_custkey % 31 as varchar(20)), '/', cast(1950 + c_custkey % 60 as varchar(20))) as dob,
    concat('AB', lpad(cast(c_custkey as varchar(20)), 7, '0')) as passport,
    concat('D', lpad(cast(c_custkey as varchar(20)), 5, '0')) as license,
    concat('1234-5678-', lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0'), '-0001') as bank,
    c_mktsegment as note
  from customer)"""
PEOPLE_COLUMNS = ("email", "phone", "ssn", "card", "ip", "dob", "passport", "license", "bank", "note")

# One text per person, page and document.
CORPUS = f"""{PEOPLE},
corpus as (
  select concat('c', cast(id as varchar(20))) as id, concat_ws(' | ', {', '.join(PEOPLE_COLUMNS)}) as text from people
  union all select concat('p', cast(page_id as varchar(20))), html from pages
  union all select concat('d', cast(doc_id as varchar(20))), text from documents)"""

DOCS = "docs as (select doc_id as id, text from documents)"

# Every cell of the people table: one row per person and column.
CELLS = f"""{PEOPLE},
cells as ({' union all '.join(
    f"select concat(cast(id as varchar(20)), ':{c}') as id, id as pid, '{c}' as col, {c} as text from people"
    for c in PEOPLE_COLUMNS)})"""

LINES = """lines as (
  select doc_id, unnest(string_split(text, chr(10))) as text from documents),
src_lines as (select row_number() over () as id, doc_id, text from lines)"""

SPAN_ROWS = "id, s as start, e as \"end\", o as ord, k as pii_type, v as value"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def stub_entities(src: str, name: str = "ents") -> str:
    """The stub model: PER for two capitalised words, confidence by text length."""
    p = lit(STUB)
    length = "lambda x: length(x)"
    return f"""{name}_h as (
  select id, regexp_extract_all(text, {p}, 0) as m, regexp_split_to_array(text, {p}) as g
  from {src} where regexp_matches(text, {p}) and strlen(text) >= 3),
{name} as (
  select id, s::integer as s, (s + length(v))::integer as e, v,
    case length(v) % 4 when 0 then 'PER' when 1 then 'LOC' when 2 then 'ORG' else 'MISC' end as ent,
    (50 + length(v) % 50) / 100.0::double as conf
  from (select id, m[i] as v, coalesce(list_sum(list_transform(g[1:i], {length})), 0)
    + coalesce(list_sum(list_transform(m[1:i - 1], {length})), 0) as s
    from (select *, unnest(range(1, len(m) + 1)) as i from {name}_h)))"""


def model_spans(ents: str, types=ALL_TYPES, name: str = "mspans") -> str:
    kinds = {"PER": "name", "LOC": "address", "ORG": "organization"}
    k = " ".join(f"when '{e}' then {lit(display_name(t))}" for e, t in kinds.items())
    o = " ".join(f"when '{e}' then {len(types) + list(types).index(t)}" for e, t in kinds.items())
    return (
        f"{name} as (select id, s, e, case ent {o} end as o, case ent {k} end as k, v from {ents} "
        "where ent <> 'MISC' and conf >= 0.70)"
    )
