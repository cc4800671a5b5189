"""Personal data by candidate gradient boosting, in DataFrame and SQL operations only.

Fixed patterns give the base spans, which always stay. High-recall generators propose further spans, which may
overlap: numbers and addresses in looser spellings. Boosted trees score each proposal by its format and by the
words around it; a threshold for each kind, calibrated on held-out proposals, selects those to redact.

There are no labels for personal data, so the trees learn from weak ones. A proposal that is a base span of its kind
is an example, as are its rewritten spellings (no plus sign, other separators, spelt-out signs). A proposal that
is a base span of another kind, fails a check of its kind, or is part of a longer token is a counterexample. All other
proposals are left out of the fit. The fit uses a bounded sample; detection covers every whole text, row by row,
with the trees written out as SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.exprs import let, running_scan, sql_str
from spanveil.functions.splice import splice_sql
from spanveil.sources.workspace import staged

KINDS = ("email", "ip", "card", "phone")

# Proposals used to fit the trees and to calibrate, at most; and the share held out.
FIT_ROWS = 20_000
HELD_OUT = 4
TREES = 12
DEPTH = 4
# Precision on held-out proposals that a threshold must reach, with so many examples above it.
PRECISION = 0.98
LEAST_EXAMPLES = 20

# Base patterns. They match what the plain forms in the comments match; look-behinds and possessive
# repeats only keep long runs linear.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": "{v} rlike " + sql_str(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": f"length({_DIGITS}) between 16 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def _check(kind: str, value: str) -> str:
    return CHECKS[kind].replace("{v}", value)


# Looser spellings. A doubled bound keeps each proposal short.
LOOSE = {
    "email": (
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:\x20?@\x20?|\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20at\x20(?=[a-z0-9-]{1,63}\x20dot\x20))"
        r"[a-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}+){1,8}+"
    ),
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\x20?[\[({]\.[\])}]\x20?|\x20\.\x20|\.\x20?|[\[({]dot[\])}]|,)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/\x{00A0}-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?[\x20]?\(?[0-9]{1,4}\)?(?:[\x20./\x{00A0}-]{0,2}\(?[0-9]{2,4}\)?){2,5}(?![0-9])",
}

_CUES = {
    "email": "(?:mail|contact|write|reach|address)[^a-z]*$",
    "ip": "(?:\\bip|ipv4|host|server|addr|address|from|node)[^a-z]*$",
    "card": "(?:card|visa|master|amex|credit|debit|carte|karte|tarjeta)[^a-z]*$",
    "phone": "(?:tel|phone|call|fax|mobile|cell|whatsapp|sms|anruf|appel)[^a-z]*$",
}

_BEFORE, _AFTER = 24, 4
FEATURES = (
    "kind", "characters", "digits", "letters", "separators", "plus", "brackets", "dots", "at_sign", "spelt_sign", "groups",
    "longest_group", "shortest_group", "luhn", "octets", "glued_before", "glued_after", "assigned", "cue_email", "cue_ip", "cue_card", "cue_phone",
)


@dataclass
class PiiModel:
    """Boosted trees as one SQL expression over ``f`` (an array of features), and a threshold for each kind.

    Without trees nothing is added to the base spans.
    """

    margin_sql: str | None = None
    thresholds: dict[str, float] = field(default_factory=dict)


def _found(text: str, pattern: str, kind: int) -> str:
    """Matches of ``pattern`` as an array of (kind, start, end, value), from the lengths of gaps and hits."""
    cut = "concat(flatten(zip_with(slice(gaps, 1, size(hits)), hits, (gap, hit) -> array(gap, hit))), array(element_at(gaps, -1)))"
    starts = running_scan("transform(cut, c -> length(c))", "0", "acc.s + x", "acc.s")
    spans = (
        f"transform(sequence(1, size(cut) - 2, 2), k -> named_struct('kind', {kind}, 'start', starts[k], 'end', starts[k + 1], 'value', cut[k]))"
    )
    some = let("gaps", f"split({text}, {sql_str(pattern)}, -1)", let("cut", cut, let("starts", starts, spans)))
    none = "cast(array() as array<struct<kind:int,start:int,end:int,value:string>>)"
    return let("hits", f"regexp_extract_all({text}, {sql_str(pattern)}, 0)", f"if(size(hits) = 0, {none}, {some})")


def _gate(kind: str) -> str:
    return "contains(txt, '@')" if kind == "email" else "dig"


def _all_found(patterns: dict[str, str], checks: dict[str, str], loose: bool = False) -> str:
    """Spans of every kind over ``txt``, by kind and start."""
    none = "cast(array() as array<struct<kind:int,start:int,end:int,value:string>>)"
    parts = []
    for k, kind in enumerate(KINDS):
        gate = "true" if loose and kind == "email" else _gate(kind)
        if loose and kind == "email":
            gate = "(contains(txt, '@') or txt rlike '(?i)[\\\\[({\\\\x20]at[\\\\x20\\\\])}]')"
        spans = _found("txt", patterns[kind], k)
        if checks.get(kind, "true") != "true":
            spans = f"filter({spans}, c -> {_check(kind, 'c.value')})"
        parts.append(f"if({gate}, {spans}, {none})")
    return let("dig", "txt rlike '[0-9]'", f"concat({', '.join(parts)})")


def base_spans_sql(text: str) -> str:
    return let("txt", f"coalesce({text}, '')", _all_found(BASE, CHECKS))


def _features(c: str) -> str:
    """Feature array of a proposal ``c`` (kind, value, before, after)."""
    v, digits = f"{c}.value", f"regexp_replace({c}.value, '[^0-9]', '')"
    groups = f"transform(regexp_extract_all({v}, '[0-9]+', 0), g -> length(g))"
    count = lambda chars: f"length(regexp_replace({v}, '[^{chars}]', ''))"
    flag = lambda test: f"if({test}, 1, 0)"
    values = [
        f"{c}.kind", f"length({v})", f"length({digits})", count("A-Za-z"), count("\\\\x20./_,-"), flag(f"startswith({v}, '+')"),
        count("(){}\\\\[\\\\]"), count("."), count("@"), flag(f"{v} rlike '(?i)[\\\\[({{\\\\x20](?:at|dot|\\\\.|@)[\\\\x20\\\\])}}]'"),
        f"size({groups})", f"coalesce(array_max({groups}), 0)", f"coalesce(array_min({groups}), 0)",
        flag(f"length({digits}) between 13 and 19 and luhn_check({digits})"),
        flag(f"size({groups}) = 4 and forall(regexp_extract_all({v}, '[0-9]+', 0), g -> g rlike '^{_OCTET}$')"),
        flag(f"{c}.before rlike '[A-Za-z0-9_]$'"), flag(f"{c}.after rlike '^[A-Za-z0-9_]'"), flag(f"{c}.before rlike '[=:\"#/][\\\\x20\"]*$'"),
        *(flag(f"lower({c}.before) rlike {sql_str(_CUES[k])}") for k in KINDS),
    ]
    return "array(" + ", ".join(f"cast({x} as double)" for x in values) + ")"


def _proposals_sql() -> str:
    """Proposals over ``txt`` with context."""
    spans = _all_found(LOOSE, {}, loose=True)
    return (
        f"transform({spans}, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'value', c.value, "
        f"'before', substring(txt, greatest(c.start - {_BEFORE}, 0) + 1, least(c.start, {_BEFORE})), 'after', substring(txt, c.end + 1, {_AFTER})))"
    )


def _tree_sql(text: str) -> list[str]:
    """The trees of a model's description as nested CASE expressions over ``f``."""
    trees: list[list[str]] = []
    for line in text.splitlines():
        if line.strip().startswith("Tree "):
            trees.append([])
        elif trees:
            trees[-1].append(line.strip())

    def read(lines: list[str]) -> str:
        head = lines.pop(0)
        if m := re.match(r"Predict: (\S+)", head):
            return f"{float(m[1])!r}D"
        test = re.match(r"If \(feature (\d+) <= (\S+)\)", head)
        if not test:
            raise ValueError(f"a tree with {head!r}")
        low = read(lines)
        lines.pop(0)  # Else
        return f"if(f[{test[1]}] <= {float(test[2])!r}D, {low}, {read(lines)})"

    return [read(lines) for lines in trees]


def _overlaps(c: str, spans: str, same_kind: str = "") -> str:
    return f"exists({spans}, b -> b.start < {c}.end and {c}.start < b.end{same_kind})"


def _weak_labels(docs: DataFrame) -> DataFrame:
    """(id_hash, kind, label, f): labelled proposals and the rewritten spellings of examples."""
    own = "exists(base, b -> b.kind = c.kind and b.start = c.start and b.end = c.end)"
    failing = " or ".join(
        f"(c.kind = {k} and not ({_check(kind, 'c.value')}))" for k, kind in enumerate(KINDS) if CHECKS[kind] != "true"
    )
    bad = f"{_overlaps('c', 'base', ' and b.kind <> c.kind')} or {failing} or c.before rlike '[A-Za-z0-9_]$' or c.after rlike '^[A-Za-z0-9_]'"
    # A base span that no generator proposes still is an example.
    example = "named_struct('kind', b.kind, 'start', b.start, 'end', b.end, 'value', {v}, 'before', {before}, 'after', substring(txt, b.end + 1, 4))"
    before = f"substring(txt, greatest(b.start - {_BEFORE}, 0) + 1, least(b.start, {_BEFORE}))"
    spellings = (
        "case b.kind when 0 then array(b.value, replace(replace(b.value, '@', ' (at) '), '.', ' (dot) '), replace(b.value, '@', '[at]'), "
        "replace(replace(b.value, '@', ' at '), '.', ' dot ')) "
        "when 1 then array(b.value, replace(b.value, '.', '[.]'), replace(b.value, '.', ' . ')) "
        "when 2 then array(b.value, regexp_replace(regexp_replace(b.value, '[^0-9]', ''), '(.{4})(?=.)', '$1.'), "
        "regexp_replace(regexp_replace(b.value, '[^0-9]', ''), '(.{4})(?=.)', '$1 - ')) "
        "else array(b.value, substring(b.value, 2), regexp_replace(b.value, '^.[0-9]+[\\\\x20.-]*', ''), replace(b.value, ' ', '.')) end"
    )
    # Their counterparts that fail the check of their kind are counterexamples.
    broken = (
        "case b.kind when 1 then array(regexp_replace(b.value, '^[0-9]+', '999')) "
        "when 2 then array(concat(substring(b.value, 1, length(b.value) - 1), pmod(cast(right(b.value, 1) as int) + 1, 10))) "
        "else cast(array() as array<string>) end"
    )
    failed = f"flatten(transform(base, b -> transform({broken}, w -> {example.format(v='w', before=before)})))"
    written = f"flatten(transform(base, b -> transform({spellings}, w -> {example.format(v='w', before=before)})))"
    return (
        docs.where("text rlike '[0-9]' or contains(text, '@')")
        .select("doc_id", F.col("text").alias("txt"))
        .withColumn("base", F.expr(_all_found(BASE, CHECKS)))
        .withColumn("made", F.expr(f"transform({written}, c -> named_struct('kind', c.kind, 'label', 1, 'f', {_features('c')}))"))
        .withColumn("wrong", F.expr(f"transform({failed}, c -> named_struct('kind', c.kind, 'label', 0, 'f', {_features('c')}))"))
        .withColumn(
            "met",
            F.expr(
                f"transform(filter({_proposals_sql()}, c -> not {own} and ({bad})), c -> named_struct('kind', c.kind, 'label', 0, 'f', {_features('c')}))"
            ),
        )
        .select("doc_id", F.explode(F.concat("made", "wrong", "met")).alias("x"))
        .select(F.xxhash64("doc_id", "x.f").alias("deal"), "x.kind", F.col("x.label").cast("double").alias("label"), "x.f")
    )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS) -> PiiModel:
    """Fit and calibrate on at most ``most`` weakly labelled proposals (those of smallest hash)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = staged(_weak_labels(slim).orderBy("deal", "kind", "label").limit(most), "proposals")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < LEAST_EXAMPLES:
        return PiiModel()
    held = F.pmod("deal", F.lit(HELD_OUT)) == 0
    rows = sample.select("kind", "label", "f", held.alias("held"), array_to_vector("f").alias("features"))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=7, maxMemoryInMB=64)
    model = trees.fit(rows.where("not held").coalesce(2))
    margin = " + ".join(f"{w!r}D * {t}" for w, t in zip(model.treeWeights, _tree_sql(model.toDebugString), strict=True))
    scored = rows.where("held").select("kind", "label", F.expr(margin).alias("margin")).collect()  # a bounded sample
    return PiiModel(margin, _calibrate([(KINDS[r["kind"]], r["margin"], r["label"]) for r in scored]))


def _calibrate(scored: list[tuple[str, float, float]]) -> dict[str, float]:
    """For each kind the lowest margin above which enough examples are right; none if no margin does."""
    thresholds = {}
    for kind in KINDS:
        rows = sorted(((m, y) for k, m, y in scored if k == kind), reverse=True)
        right = 0
        for i, (margin, label) in enumerate(rows, 1):
            right += label > 0
            last = i == len(rows) or rows[i][0] < margin
            if last and right >= LEAST_EXAMPLES and right / i >= PRECISION and margin > 0:
                thresholds[kind] = margin
    return thresholds


def _added_sql(model: PiiModel) -> str:
    """Selected proposals over ``txt`` and ``base``: scored, clear of base spans, best first where they overlap."""
    none = "cast(array() as array<struct<kind:int,start:int,end:int,value:string>>)"
    if not model.margin_sql or not model.thresholds:
        return none
    cut = " ".join(f"when c.kind = {KINDS.index(k)} then {m!r}D" for k, m in model.thresholds.items())
    free = f"filter({_proposals_sql()}, c -> not {_overlaps('c', 'base')})"
    margin = let("f", _features("c"), model.margin_sql)
    scored = f"transform({free}, c -> named_struct('margin', {margin}, 'c', c))"
    passed = f"filter({scored}, x -> {let('c', 'x.c', f'x.margin >= (case {cut} else double(1e300) end)')})"
    better = "y.margin > x.margin or (y.margin = x.margin and (y.c.kind < x.c.kind or (y.c.kind = x.c.kind and y.c.start < x.c.start)))"
    best = f"filter(passed, x -> not exists(passed, y -> y.c.start < x.c.end and x.c.start < y.c.end and ({better})))"
    plain = f"transform({best}, x -> named_struct('kind', x.c.kind, 'start', x.c.start, 'end', x.c.end, 'value', x.c.value))"
    gated = f"if(txt rlike '[0-9]' or contains(txt, '@') or txt rlike '(?i)[\\\\[({{\\\\x20]at[\\\\x20\\\\])}}]', {let('passed', passed, plain)}, {none})"
    return gated


def spans_sql(text: str, model: PiiModel) -> str:
    """(base, added): the base spans and the spans that the trees add, each by kind and start."""
    added = f"array_sort({_added_sql(model)})"
    return let("txt", f"coalesce({text}, '')", let("base", _all_found(BASE, CHECKS), f"named_struct('base', base, 'added', {added})"))


def detect(docs: DataFrame, model: PiiModel, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with a struct column ``out`` of two span arrays, base and added.

    A span is (kind, start, end, value); kind counts KINDS from 0, offsets count code points, end exclusive. A null
    or empty text has no spans. Every row is judged alone, so repeated rows and ids do not matter.
    """
    if out in docs.columns:
        raise ValueError(f"the column {out} is there already")
    return docs.withColumn(out, F.expr(spans_sql(f"cast(`{text_col}` as string)", model)))


def redact(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one.

    A null text stays null.
    """
    furthest = running_scan("transform(sorted, r -> r.end)", "0", "greatest(acc.s, x)", "greatest(acc.s, x)")
    heads = "filter(transform(sorted, (r, i) -> if(i = 0 or r.start >= far[i - 1], i, -1)), i -> i >= 0)"
    merged = (
        "transform(heads, (h, i) -> named_struct('start', sorted[h].start, 'end', "
        "far[if(i + 1 < size(heads), heads[i + 1], size(sorted)) - 1], 'kind', sorted[h].kind))"
    )
    both = "array_sort(transform(concat(pii.base, pii.added), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    names = "array(" + ", ".join(sql_str(f"[{k.upper()}]") for k in KINDS) + ")"
    body = let("found", let("far", furthest, let("heads", heads, merged)), splice_sql("src", "found", f"element_at({names}, s.kind + 1)"))
    text = f"cast(`{text_col}` as string)"
    work = let("src", text, let("pii", spans_sql("src", model), let("sorted", both, f"if(size(sorted) = 0, src, {body})")))
    return docs.withColumn(text_col, F.expr(f"if({text} is null, cast(null as string), {work})"))


def report(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256 and all spans as text, for each row."""
    found = detect(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    names = "array(" + ", ".join(sql_str(k) for k in KINDS) + ")"
    written = "array_join(transform({s}, s -> concat_ws(':', element_at(" + names + ", s.kind + 1), s.start, s.end)), ',')"
    count = "cast(size(filter(pii.base, s -> s.kind = {k})) as bigint)"
    everything = "array_sort(transform(concat(pii.base, pii.added), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)))"
    return found.select(
        "doc_id",
        *(F.expr(count.format(k=k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.expr(f"sha2({written.format(s='pii.base')}, 256)").alias("base_sha256"),
        F.expr(written.format(s=everything)).alias("spans"),
        F.expr("cast(size(pii.added) as bigint)").alias("n_added"),
    )
