"""Names, addresses and organizations, found by a model the caller supplies.

The model runs inside one iterator pandas UDF; everything around it (length
gate, label decoding, confidence floor, merging with pattern spans, mapping
row-level spans back to cells) is Spark expressions over arrays in the row, so
the only Python boundary is the prediction itself and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import MODEL_LABELS, display_name, parse_types
from ..functions.exprs import let, running_scan, sql_str
from ..functions.spans import SPANS_TYPE, free_name, merge_spans_sql, quoted
from .detect import detect, text_columns

ENTITY_TYPE = "struct<entity:string,start:int,end:int,confidence:double>"
PREDICTION_TYPE = f"struct<entities:array<{ENTITY_TYPE}>,error:string>"

# Confidence floor, texts per model call, shortest text in bytes, cell separator.
MIN_CONFIDENCE = 0.70
BATCH_TEXTS = 128
MIN_BYTES = 3
SEPARATOR = " | "

# A predictor takes a list of texts and gives, per text, (entity, start, end, confidence)
# tuples with entity one of PER, LOC, ORG, MISC and character offsets.
Predictor = Callable[[list], list]


# Predictors of this Python worker by digest of their pickled factory: each is made once, whatever the number of tasks.
_MADE: dict[str, Predictor] = {}


def _predictor(digest: str, factory: Callable[[], Predictor]) -> Predictor:
    if digest not in _MADE:
        _MADE[digest] = factory()
    return _MADE[digest]


def _answers(factory: Callable[[], Predictor], cache_texts: int):
    """A function from texts (with nulls and repeats) to their entities and errors, in order."""
    digest = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()
    recent: OrderedDict[bytes, list] = OrderedDict()  # by digest of the text: texts may be long

    def answer(texts: list) -> tuple[list, list]:
        from spanveil.operators import model as worker  # the module itself, not a pickled copy of its globals

        known: dict[str, list] = {}
        errors: dict[str, str] = {}
        wanted = [t for t in dict.fromkeys(texts) if t is not None and t.strip() and len(t.encode()) >= MIN_BYTES]
        keys = {t: hashlib.sha256(t.encode()).digest() for t in wanted}
        for t in wanted:
            if keys[t] in recent:
                recent.move_to_end(keys[t])
                known[t] = recent[keys[t]]
        todo = [t for t in wanted if t not in known]
        for at in range(0, len(todo), BATCH_TEXTS):
            part = todo[at : at + BATCH_TEXTS]
            try:
                answers = dict(zip(part, worker._predictor(digest, factory)(part), strict=True))
            except Exception as exc:  # the job goes on without this batch's entities, and says so
                errors.update(dict.fromkeys(part, str(exc) or type(exc).__name__))
                continue
            known.update(answers)
            recent.update((keys[t], found) for t, found in answers.items())
        while len(recent) > cache_texts:
            recent.popitem(last=False)
        fields = ("entity", "start", "end", "confidence")
        return [[dict(zip(fields, e, strict=True)) for e in known.get(t, ())] for t in texts], [errors.get(t) for t in texts]

    return answer


def predict(column: str, factory: Callable[[], Predictor], cache_texts: int = 4096) -> Column:
    """Model entities of a text column: ``STRUCT<entities, error>``.

    ``factory`` is called once per Python worker. Texts below the
    length gate and blank texts never reach the model. A failing batch gives no
    entities and its message in ``error``; other batches go on. Repeated texts
    within a task are answered from a bounded memory of recent ones.
    """

    answers = _answers(factory, cache_texts)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            entities, errors = answers([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"entities": entities, "error": errors})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, PREDICTION_TYPE)(F.col(quoted(column)))


def predict_cells(columns: list[str], factory: Callable[[], Predictor], cache_texts: int = 4096) -> Column:
    """:func:`predict` for each of several text columns, as one array in their order and one Python stage."""
    answers = _answers(factory, cache_texts)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            lists = [[t if isinstance(t, str) else None for t in row] for row in rows]
            entities, errors = answers([t for row in lists for t in row])
            found = iter(zip(entities, errors, strict=True))
            yield pd.Series([[dict(zip(("entities", "error"), next(found), strict=True)) for _ in row] for row in lists])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, f"array<{PREDICTION_TYPE}>")(F.array(*[F.col(quoted(c)) for c in columns]))


def predict_distinct(
    df: DataFrame, column: str, factory: Callable[[], Predictor], out: str = "prediction", slots: int = 64
) -> DataFrame:
    """Add model entities, running the model once per distinct text of the whole input.

    Rows are keyed by the text's digest plus a slot number hashed from the row's
    narrow columns, and distinct (digest, slot) pairs are made before anything is
    joined. A text that fills a third of the table is thus spread over ``slots``
    tasks in the row join, and meets at most ``slots`` pairs in the digest join.
    The slot depends on the row alone, so a retried task assigns it again.
    """
    key = F.sha2(F.coalesce(F.col(quoted(column)), F.lit("")), 256)
    slot = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in _slot_columns(df)]), F.lit(slots))
    clash = {"_key", "_slot", out} & set(df.columns)
    if clash:
        raise ValueError(f"the columns {sorted(clash)} are there already")
    keyed = df.withColumns({"_key": key, "_slot": slot})
    pairs = keyed.select("_key", "_slot").distinct()
    # distinct() on the text itself hashes map-side; grouping by digest would have to sort.
    texts = df.select(F.col(quoted(column)).alias("_text")).where("_text is not null").distinct()
    answers = texts.select(F.sha2("_text", 256).alias("_key"), predict("_text", factory).alias(out))
    per_slot = pairs.join(answers, "_key", "left")
    return keyed.join(per_slot, ["_key", "_slot"], "left").select(*[quoted(c) for c in df.columns], out)


def _slot_columns(df: DataFrame) -> list[str]:
    """Numeric and time columns if there are any, so that making pairs reads little."""
    narrow = (T.NumericType, T.DatetimeType)
    fields = df.schema.fields
    chosen = [f.name for f in fields if isinstance(f.dataType, narrow)]
    return chosen or [f.name for f in fields if not isinstance(f.dataType, T.MapType)]


def decode_tokens(tokens: str) -> Column:
    """Entities from a row's token labels (``ARRAY<STRUCT<start, end, label, prob>>``).

    Begin/inside/outside decoding: tokens at offsets (0, 0) after the first are
    skipped; an entity starts at a ``B-`` label or a change of type, runs on
    through tokens of its type, and ends at ``O``. Its confidence starts at the
    first token's and is averaged with each further one. Empty entities are dropped.
    """
    entity = "if({t}.label rlike '^[BI]-', substring({t}.label, 3), null)"
    kept = f"filter({quoted(tokens)}, (t, i) -> not (t.start = 0 and t.end = 0 and i > 0))"
    typed = (
        f"transform({kept}, t -> named_struct('entity', {entity.format(t='t')}, "
        "'begins', t.label like 'B-%', 'start', t.start, 'end', t.end, 'prob', t.prob))"
    )
    # Indexes where a run ends: an outside token or the start of another entity.
    opens = "toks[p].entity is not null and (toks[p].begins or p = 0 or not (toks[p - 1].entity <=> toks[p].entity))"
    breaks = f"filter(sequence(0, size(toks) - 1), p -> toks[p].entity is null or {opens})"
    runs = (
        "transform(brk, (p, k) -> slice(toks, p + 1, "
        "if(k + 1 < size(brk), brk[k + 1], size(toks)) - p))"
    )
    merged = (
        f"transform(filter({runs}, r -> r[0].entity is not null), r -> named_struct("
        "'entity', r[0].entity, 'start', r[0].start, 'end', element_at(r, -1).end, "
        "'confidence', aggregate(slice(r, 2, size(r)), r[0].prob, (c, t) -> (c + t.prob) / 2)))"
    )
    body = f"filter({let('brk', breaks, merged)}, e -> e.end > e.start)"
    none = f"cast(array() as array<{ENTITY_TYPE}>)"
    return F.expr(let("toks", typed, f"if(size(toks) = 0, {none}, {body})"))


def model_spans(column: str, entities: str, types=None, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """Confident entities of the requested types as spans.

    Their ``ord`` lies after every pattern type, so patterns win equal starts.
    """
    chosen = parse_types(types)
    kinds = {label: t for label, t in MODEL_LABELS.items() if t in chosen}
    if not kinds:
        return F.expr(f"cast(array() as {SPANS_TYPE})")
    listed = ", ".join(sql_str(label) for label in kinds)
    name = " ".join(f"when {sql_str(label)} then {sql_str(display_name(t))}" for label, t in kinds.items())
    ords = " ".join(f"when {sql_str(label)} then {len(chosen) + chosen.index(t)}" for label, t in kinds.items())
    keep = f"e.entity in ({listed}) and e.confidence >= {min_confidence}D and e.end > e.start"
    text = quoted(column)
    span = (
        f"named_struct('start', e.start, 'end', e.end, 'ord', case e.entity {ords} end, "
        f"'pii_type', case e.entity {name} end, 'value', substring({text}, e.start + 1, e.end - e.start))"
    )
    listed_entities = f"coalesce({quoted(entities)}, cast(array() as array<{ENTITY_TYPE}>))"
    gate = f"octet_length({text}) >= {MIN_BYTES}"
    spans = f"transform(filter({listed_entities}, e -> {keep}), e -> {span})"
    return F.expr(f"if({gate}, {spans}, cast(array() as {SPANS_TYPE}))")


def merge_spans(first: str, second: str) -> Column:
    """Two span columns merged, sorted and resolved again.

    ``first`` has been resolved on its own already; a span it lost there does
    not come back, which one pass over all spans would allow.
    """
    none = f"cast(array() as {SPANS_TYPE})"
    a, b = (f"coalesce({quoted(c)}, {none})" for c in (first, second))
    return F.expr(merge_spans_sql(a, b))


def join_cells(columns: list[str]) -> Column:
    """A row's cells as one text, joined by the cell separator (NULL as empty)."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(quoted(c)), F.lit("")) for c in columns])


def cell_offsets(columns: list[str]) -> Column:
    """Where each cell lies in the joined text: ``ARRAY<STRUCT<start, end>>``."""
    return F.expr(_offsets_sql("array(" + ", ".join(quoted(c) for c in columns) + ")"))


def _offsets_sql(cells: str) -> str:
    widths = f"transform({cells}, c -> length(coalesce(c, '')))"
    starts = running_scan("widths", state="0", next_state=f"acc.s + x + {len(SEPARATOR)}", emit="acc.s")
    pairs = "transform(widths, (w, i) -> named_struct('start', starts[i], 'end', starts[i] + w))"
    return let("widths", widths, let("starts", starts, pairs))


def join_cell_array(cells: str = "cells") -> Column:
    """:func:`join_cells` for cells held in one array column."""
    return F.array_join(F.col(quoted(cells)), SEPARATOR, "")


def cell_array_offsets(cells: str = "cells") -> Column:
    """:func:`cell_offsets` for cells held in one array column."""
    return F.expr(_offsets_sql(quoted(cells)))


def spans_to_cells(spans: str, offsets: str) -> Column:
    """Spans of the joined text, per cell and rebased.

    A containment join inside the row: a span stays when it lies in one cell;
    spans across a separator are dropped.
    """
    moved = (
        "named_struct('start', s.start - o.start, 'end', s.end - o.start, 'ord', s.ord, "
        "'pii_type', s.pii_type, 'value', s.value)"
    )
    inside = f"filter({quoted(spans)}, s -> s.start >= o.start and s.end <= o.end)"
    return F.expr(f"transform({quoted(offsets)}, o -> transform({inside}, s -> {moved}))")


def model_cell_spans(
    df: DataFrame, factory: Callable[[], Predictor], cells: str = "cells", types=None, out: str = "_model", error: str | None = None
) -> DataFrame:
    """Model spans per cell, for rows that hold their cells in one array column.

    ``error`` names a column for the message of a model that failed on the row (null: it didn't).
    """
    joined, offsets, answer, entities, spans = (free_name(df.columns, c) for c in ("_joined", "_offsets", "_p", "_e", "_m"))
    found = df.withColumns({joined: join_cell_array(cells), offsets: cell_array_offsets(cells)})
    found = found.withColumn(answer, predict(joined, factory)).withColumn(entities, F.col(answer)["entities"])
    found = found.withColumn(spans, model_spans(joined, entities, types)).withColumn(out, spans_to_cells(spans, offsets))
    failed = [F.col(answer)["error"].alias(error)] if error else []
    return found.select(*[quoted(c) for c in df.columns], out, *failed)


def detect_with_model(
    df: DataFrame,
    factory: Callable[[], Predictor],
    columns=None,
    types=None,
    unit: str = "row",
    suffix: str = "_spans",
    distinct: bool = False,
    error: str | None = None,
) -> DataFrame:
    """Pattern and model spans merged, one spans column per scanned column.

    ``unit="row"`` joins a row's cells and predicts once per row; ``"cell"``
    predicts per cell (the form for single-column texts). The model stage is
    left out of the plan when no model type is requested. ``distinct`` predicts
    each distinct text of the whole input once, at the price of two joins.
    ``error`` names a column for the message of a model that failed on the row
    (null: it didn't); without it, a row on which the model failed has its pattern spans only.
    """
    names = text_columns(df, columns)
    chosen = parse_types(types)
    originals = df.columns
    out = detect(df, names, chosen, suffix)
    if not any(t in MODEL_LABELS.values() for t in chosen):
        return out.withColumn(error, F.lit(None).cast("string")) if error else out
    taken = [*out.columns, *([error] if error else [])]
    joined, offsets, answer, entities, spans, cells = (free_name(taken, c) for c in ("_joined", "_offsets", "_p", "_e", "_m", "_cells"))
    per_column = [(free_name(taken, f"_e{i}"), free_name(taken, f"_m{i}")) for i in range(len(names))]

    if unit == "cell" and not distinct:
        out = out.withColumn(answer, predict_cells(names, factory))
        out = out.withColumns({e: F.col(answer)[i]["entities"] for i, (e, _) in enumerate(per_column)})
        out = out.withColumns({m: model_spans(c, e, chosen) for c, (e, m) in zip(names, per_column, strict=True)})
        failed = F.element_at(F.filter(F.transform(answer, lambda p: p["error"]), lambda m: m.isNotNull()), 1) if names else F.lit(None)
        failed = F.when(F.exists(answer, lambda p: p["error"].isNotNull()), failed)
    elif unit == "cell":
        messages = []
        for i, (c, (e, m)) in enumerate(zip(names, per_column, strict=True)):
            one = free_name(taken, f"_p{i}")
            out = predict_distinct(out, c, factory, one).withColumn(e, F.col(one)["entities"])
            out = out.withColumn(m, model_spans(c, e, chosen))
            messages.append(F.col(one)["error"])
        failed = F.coalesce(*messages)
    else:
        out = out.withColumn(joined, join_cells(names)).withColumn(offsets, cell_offsets(names))
        out = predict_distinct(out, joined, factory, answer) if distinct else out.withColumn(answer, predict(joined, factory))
        out = out.withColumn(entities, F.col(answer)["entities"]).withColumn(spans, model_spans(joined, entities, chosen))
        out = out.withColumn(cells, spans_to_cells(spans, offsets))
        out = out.withColumns({m: F.col(cells)[i] for i, (_, m) in enumerate(per_column)})
        failed = F.col(answer)["error"]
    merged = {f"{c}{suffix}": merge_spans(f"{c}{suffix}", m) for c, (_, m) in zip(names, per_column, strict=True)}
    if error:
        merged[error] = failed.cast("string")
    return out.withColumns(merged).select(*[quoted(c) for c in originals], *[quoted(f"{c}{suffix}") for c in names], *([error] if error else []))
