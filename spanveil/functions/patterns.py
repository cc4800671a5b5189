"""Search patterns and the cheap row gates in front of them.

``(?U)`` gives digits, spaces and word boundaries their Unicode meaning in
Java's regex engine. Each pattern opens with a one-character lookahead, so
the engine rejects most positions before it looks at word boundaries.

The email pattern takes its local part in one possessive step and only where
no local-part character precedes it (or right after the previous match). That
finds the same matches as the plain form and stays linear on long unbroken runs,
where the plain form rescans the run from each of its characters.
"""

from __future__ import annotations

from string import ascii_letters, digits

# The search pattern of every type.
# Letters and digits are listed one by one where a scan tests every character: Java looks listed ones up in one table,
# and compares with each range in turn.
_ALNUM = ascii_letters + digits
# U+017F and U+212A are the two non-ASCII letters that fold to ASCII ones.
_LOCAL = _ALNUM + r"._%+\-ſK"
_DOMAIN = _ALNUM + r".\-ſK"
_TLD = ascii_letters + r"ſK"

PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_DOMAIN}]+\.[{_TLD}]{{2,}}",
    "phone": rf"(?U)(?=[{digits}+(])" r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "ssn": r"(?U)(?=\d)\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"(?U)(?=\d{4})\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}"
    r"|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})\b",
    "ip_address": r"(?U)(?=[0-9])\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    # No match starts right after a letter or digit (\b); seeing that first spares both branches.
    "date_of_birth": rf"(?U)(?=[0-9])(?<![{_ALNUM}_])(?:"
    r"\b(?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12][0-9]|3[01])[/\-](?:19|20)?\d{2}\b"
    r"|\b(?:19|20)\d{2}[/\-](?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12][0-9]|3[01])\b)",
    "passport": r"(?U)(?=[A-Z]{1,2}[0-9])\b[A-Z]{1,2}[0-9]{6,9}\b",
    "drivers_license": r"(?U)(?=[A-Z]{1,2}[0-9])\b[A-Z]{1,2}[0-9]{5,8}\b",
    "bank_account": r"(?U)(?=\d{4})\b(?:\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}|\d{16})\b",
}

# Row gates. Every email holds an at-sign and every other type a decimal digit, so a row
# with neither is passed over with one byte search and one single-class scan.
EMAIL_MARK = "@"
DIGIT_MARK = r"\p{Nd}"

# Second gates, for rows with a digit: addresses and dates hold three groups of digits with a separator between
# each two, all others a run of four digits.
PAIR_MARK = r"\p{Nd}[-/.]\p{Nd}{1,3}[-/.]\p{Nd}"
RUN_MARK = r"\p{Nd}{4}"

# Third gates, for rows with a run: numbers of nine digits or more, at most two separators between each two of them,
# and letters before five digits. Years and prices pass neither.
LONG_MARK = r"(?U)\d(?:[-.\s)]{0,2}+\d){8}"
CODE_MARK = r"[A-Z][0-9]{5}"
GATE_OF = {
    "email": "has_at",
    "phone": "has_long",
    "ssn": "has_long",
    "credit_card": "has_long",
    "ip_address": "has_pair",
    "date_of_birth": "has_pair",
    "passport": "has_code",
    "drivers_license": "has_code",
    "bank_account": "has_long",
}
