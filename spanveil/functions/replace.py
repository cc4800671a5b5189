"""Replacement values: remove, hash, mask, and seeded stand-ins.

Each builder returns Spark SQL text over ``kind`` (display name) and ``v``
(matched value) fragments. Stand-ins are drawn from a keyed SHA-256 of the
value instead of a random generator, so a retried task writes the same output
and equal values stay equal (joins on scrubbed keys keep working).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words
from .catalog import ALL_TYPES, METHODS, display_name, parse_method
from .exprs import let, sql_str
from .validators import digits_sql


def remove_sql(kind: str) -> str:
    return f"concat('[', upper({kind}), ' REMOVED]')"


def hash_sql(v: str) -> str:
    return f"concat('#', substring(sha2({v}, 256), 1, 12))"


def _last_four(v: str, head: str, short: str) -> str:
    d = digits_sql(v)
    return f"if(length({d}) >= 4, concat('{head}', right({d}, 4)), '{short}')"


def _mask_email(v: str) -> str:
    domain = f"substring({v}, instr({v}, '@'))"
    keep = f"octet_length(substring_index({v}, '@', 1)) > 2"
    return (
        f"if(instr({v}, '@') = 0, '***@***.***', "
        f"if({keep}, concat(substring({v}, 1, 1), '***', {domain}), concat('***', {domain})))"
    )


def _draw(digest: str, slot: int, low: int, count: int) -> str:
    """A number in [low, low + count) from one 32-bit slot of the digest."""
    return f"({low} + pmod(cast(conv(substring({digest}, {8 * slot + 1}, 8), 16, 10) as bigint), {count}L))"


def _pick(digest: str, slot: int, options) -> str:
    # One literal instead of an array of many: the optimizer folds the split away.
    listed = f"split({sql_str('|'.join(options))}, '[|]')"
    return f"element_at({listed}, cast({_draw(digest, slot, 1, len(options))} as int))"


def _padded(digest: str, slot: int, low: int, count: int, width: int) -> str:
    return f"lpad(cast({_draw(digest, slot, low, count)} as string), {width}, '0')"


def _company(d: str) -> str:
    first, second, third = (_pick(d, i, words.LAST_NAMES) for i in (0, 1, 2))
    shape = _draw(d, 3, 0, 3)
    return (
        f"case {shape} when 0 then concat({first}, ' ', {_pick(d, 4, words.COMPANY_SUFFIXES)}) "
        f"when 1 then concat({first}, '-', {second}) else concat({first}, ', ', {second} , ' and ', {third}) end"
    )


def _stand_in(type_id: str, d: str) -> str:
    # The ranges each stand-in is drawn from.
    if type_id == "email":
        names = f"concat(lower({_pick(d, 0, words.FIRST_NAMES)}), '.', lower({_pick(d, 1, words.LAST_NAMES)})"
        return f"{names}, '@example.', {_pick(d, 2, words.EMAIL_ENDINGS)})"
    if type_id == "phone":
        area, office = _draw(d, 0, 200, 800), _draw(d, 1, 200, 800)
        return f"concat('(', {area}, ') ', {office}, '-', {_padded(d, 2, 0, 10000, 4)})"
    if type_id == "ssn":
        group, serial = _padded(d, 1, 1, 98, 2), _padded(d, 2, 1, 9998, 4)
        return f"concat({_draw(d, 0, 100, 799)}, '-', {group}, '-', {serial})"
    if type_id == "credit_card":
        rest = ", '-', ".join(_padded(d, i, 0, 9999, 4) for i in (1, 2, 3))
        return f"concat('4', {_padded(d, 0, 0, 999, 3)}, '-', {rest})"
    if type_id == "ip_address":
        parts = [_draw(d, 0, 1, 254), _draw(d, 1, 0, 255), _draw(d, 2, 0, 255), _draw(d, 3, 1, 254)]
        return "concat_ws('.', " + ", ".join(f"cast({p} as string)" for p in parts) + ")"
    if type_id == "date_of_birth":
        return f"concat({_padded(d, 0, 1, 11, 2)}, '/', {_padded(d, 1, 1, 27, 2)}, '/', {_draw(d, 2, 1950, 55)})"
    if type_id == "address":
        return f"concat({_pick(d, 0, words.UNIT_WORDS)}, ' ', {_draw(d, 1, 100, 900)})"
    if type_id == "name":
        return f"concat({_pick(d, 0, words.FIRST_NAMES)}, ' ', {_pick(d, 1, words.LAST_NAMES)})"
    if type_id == "passport":
        return f"concat('P', {_draw(d, 0, 10000000, 89999999)})"
    if type_id == "drivers_license":
        return f"concat('DL', {_draw(d, 0, 1000000, 8999999)})"
    if type_id == "bank_account":
        wide = f"pmod(cast(conv(substring({d}, 1, 15), 16, 10) as bigint), 899999999999L)"
        return f"cast(100000000000L + {wide} as string)"
    return _company(d)


def _fake_sql(type_id: str, v: str, salt: str, occurrence: str | None) -> str:
    parts = [sql_str(f"{salt}|{type_id}|"), v]
    if occurrence:
        parts += ["'|'", occurrence]
    return let("dg", f"sha2(concat({', '.join(parts)}), 256)", _stand_in(type_id, "dg"))


def _mask_sql(type_id: str, v: str, salt: str, occurrence: str | None) -> str:
    # The mask of every type.
    if type_id == "email":
        return _mask_email(v)
    if type_id == "phone":
        return _last_four(v, "***-***-", "***-***-****")
    if type_id == "ssn":
        return "'***-**-****'"
    if type_id == "credit_card":
        return _last_four(v, "****-****-****-", "****-****-****-****")
    if type_id == "ip_address":
        return "'***.***.***.***'"
    if type_id == "date_of_birth":
        return "'**/**/****'"
    if type_id == "organization":
        return _fake_sql(type_id, v, salt, occurrence)
    return f"repeat('*', least(octet_length({v}), 20))"


def replacement_sql(
    kind: str, v: str, types=ALL_TYPES, method: str = "mask", salt: str = "", occurrence: str | None = None
) -> str:
    """SQL text of the replacement for a value ``v`` whose display name is ``kind``."""
    method = parse_method(method)
    if method == "remove":
        return remove_sql(kind)
    if method == "hash":
        return hash_sql(v)
    make = _mask_sql if method == "mask" else _fake_sql
    whens = [f"when {sql_str(display_name(t))} then {make(t, v, salt, occurrence)}" for t in types]
    return f"case {kind} {' '.join(whens)} else {v} end" if whens else v


def replacement(kind: str, value: str, method: str = "mask", salt: str = "") -> Column:
    """Replacement column for a display-name column and a value column."""
    text = replacement_sql("kd", "vl", method=method, salt=salt)
    return F.expr(let("kd", f"`{kind}`", let("vl", f"`{value}`", text)))


def replacement_by_method(method: str, kind: str, value: str, salt: str = "") -> Column:
    """Like :func:`replacement`, with the method itself a column (unknown masks)."""
    branches = " ".join(
        f"when '{m}' then {replacement_sql('kd', 'vl', method=m, salt=salt)}" for m in METHODS if m != "mask"
    )
    masked = replacement_sql("kd", "vl", method="mask", salt=salt)
    body = f"case lower(`{method}`) {branches} else {masked} end"
    return F.expr(let("kd", f"`{kind}`", let("vl", f"`{value}`", body)))
