"""Small builders for Spark SQL expression text.

Span work needs local names and running state inside one row. Spark SQL has
both as higher-order functions; these helpers only spell them out.
"""

from __future__ import annotations

# Elements folded per block in running_scan. A fold copies its accumulator at every
# step, so one flat fold over n elements moves n*n/2 values; blocks bring that down to
# n*BLOCK/2 + n*n/(2*BLOCK), small integers all of them.
BLOCK = 512


def sql_str(value: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NOTHING = "cast(array() as array<int>)"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it by ``name`` in ``body``.

    A lambda variable, unlike an alias in a projection, is never inlined by
    the optimizer, so an expensive value is not computed again per use. It is the
    result of a fold over nothing: a fold hands its result on as it is, where
    transform copies every text and struct it returns, once for each let around it.
    """
    return f"aggregate({_NOTHING}, {value}, (same, none) -> same, {name} -> {body})"


def running_scan(items: str, state: str, next_state: str, emit: str) -> str:
    """Walk an array left to right with an integer state; one integer out per element.

    ``state`` is the initial state; ``next_state`` and ``emit`` see the current
    state as ``acc.s`` and the element as ``x``. Only integers are accumulated:
    the fold copies its accumulator, and texts or structs in it would be copied
    over and over.
    """
    none = "cast(array() as array<int>)"
    step = f"(acc, x) -> named_struct('s', {next_state}, 'o', concat(acc.o, array({emit})))"
    flat = f"aggregate(run_items, named_struct('s', {state}, 'o', {none}), {step}, done -> done.o)"
    blocks = (
        f"aggregate(sequence(0, (size(run_items) - 1) div {BLOCK}), "
        f"named_struct('s', {state}, 'o', cast(array() as array<array<int>>)), "
        f"(total, blk) -> aggregate(slice(run_items, blk * {BLOCK} + 1, {BLOCK}), "
        f"named_struct('s', total.s, 'o', {none}), {step}, "
        "done -> named_struct('s', done.s, 'o', concat(total.o, array(done.o)))), "
        "total -> flatten(total.o))"
    )
    return let("run_items", items, f"if(size(run_items) <= {BLOCK}, {flat}, {blocks})")


# Spans whose flags fit in the upper half of one long, next to the end of the last kept span.
FLAG_BITS = 30


def kept_greedily(spans: str) -> str:
    """SQL text of the spans (a variable, sorted by start) that start at or after the end of the last one kept.

    Few spans are folded into one long: a bit for each span above, the end of the last kept span below. That spares
    the arrays and structs that a fold over more spans builds at each step.
    """
    last, bits = "(acc & 4294967295L)", "shiftright(acc, 32)"
    few = (
        f"aggregate({spans}, 0L, (acc, x) -> if(x.start >= {last}, shiftleft({bits} * 2 + 1, 32) + x.end, "
        f"shiftleft({bits} * 2, 32) + {last}))"
    )
    few = let("kept_bits", few, f"filter({spans}, (r, i) -> (shiftright(kept_bits, 31 + size({spans}) - i) & 1L) = 1L)")
    flags = running_scan(
        f"transform({spans}, r -> named_struct('start', r.start, 'end', r.end))",
        state="0",
        next_state="if(x.start >= acc.s, x.end, acc.s)",
        emit="if(x.start >= acc.s, 1, 0)",
    )
    many = let("flags", flags, f"filter({spans}, (r, i) -> flags[i] = 1)")
    return f"if(size({spans}) <= {FLAG_BITS}, {few}, {many})"
