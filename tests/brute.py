"""Plain-Python restatement of detection, for small inputs only."""

import regex

from spanveil.functions.catalog import ALL_TYPES, display_name
from spanveil.plans.oracle import PLAIN

COMPILED = {t: regex.compile(p) for t, p in PLAIN.items()}


def luhn(value):
    d = [int(c) for c in value if c in "0123456789"]
    if not 13 <= len(d) <= 19:
        return False
    total = sum(n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2) for i, n in enumerate(reversed(d)))
    return total % 10 == 0


def ssn(value):
    d = "".join(c for c in value if c in "0123456789")
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def candidates(text, types=ALL_TYPES):
    found = []
    for o, t in enumerate(types):
        for m in COMPILED[t].finditer(text) if t in COMPILED else ():
            ok = {"credit_card": luhn, "ssn": ssn}.get(t, lambda v: True)(m.group())
            if ok:
                found.append((m.start(), m.end(), o, display_name(t), m.group()))
    return sorted(found, key=lambda s: (s[0], s[2]))


def spans(text, types=ALL_TYPES):
    kept, last = [], 0
    for s in candidates(text, types):
        if s[0] >= last:
            kept.append(s)
            last = s[1]
    return kept
