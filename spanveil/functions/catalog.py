"""The twelve kinds of personal data, their names, and option parsing.

Everything here is a driver-side constant; nothing grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers, display names and descriptions, in canonical order.
PII_TYPES = {
    "email": ("Email Address", "Email addresses (e.g., john.doe@example.com)"),
    "phone": ("Phone Number", "Phone numbers in various formats"),
    "ssn": ("Social Security Number", "US Social Security Numbers (XXX-XX-XXXX)"),
    "credit_card": ("Credit Card Number", "Credit/debit card numbers (Visa, MasterCard, Amex, etc.)"),
    "ip_address": ("IP Address", "IPv4 addresses"),
    "date_of_birth": ("Date of Birth", "Dates that may represent birth dates"),
    "address": ("Street Address", "Physical street addresses"),
    "name": ("Person Name", "Names with common titles (Mr., Mrs., Dr., etc.)"),
    "passport": ("Passport Number", "Passport identification numbers"),
    "drivers_license": ("Driver's License", "Driver's license numbers"),
    "bank_account": ("Bank Account Number", "Bank account numbers"),
    "organization": ("Organization Name", "Company and institution names"),
}

# Other spellings accepted for a type.
ALIASES = {
    "creditcard": "credit_card",
    "ipaddress": "ip_address",
    "ip": "ip_address",
    "dateofbirth": "date_of_birth",
    "dob": "date_of_birth",
    "driverslicense": "drivers_license",
    "bankaccount": "bank_account",
    "org": "organization",
}

# The types a token-classification model finds, by entity label.
MODEL_LABELS = {"PER": "name", "LOC": "address", "ORG": "organization"}

MODEL_TYPES = tuple(MODEL_LABELS.values())
ALL_TYPES = tuple(PII_TYPES)
PATTERN_TYPES = tuple(t for t in ALL_TYPES if t not in MODEL_TYPES)

METHODS = ("remove", "hash", "fake", "mask")


class TypeNotAllowed(ValueError):
    """A requested type lies outside the quota's allowed types."""


def display_name(type_id: str) -> str:
    return PII_TYPES[type_id][0]


def canonical_type(raw: str) -> str | None:
    """Identifier for a user's spelling, or ``None`` when it names no type."""
    low = raw.lower()
    low = ALIASES.get(low, low)
    return low if low in PII_TYPES else None


def parse_types(requested=None, allowed=None) -> tuple[str, ...]:
    """Resolve a requested type list.

    Unknown names are ignored and the requested order is kept, because it
    decides ties between findings that start at the same character. An empty
    result means every type. Types outside ``allowed`` raise.
    """
    known = [t for t in (canonical_type(r) for r in requested or ()) if t]
    chosen = tuple(dict.fromkeys(known))
    if allowed is not None:
        for t in chosen:
            if t not in allowed:
                raise TypeNotAllowed(f"PII type '{t}' is not among the allowed types")
        return chosen or tuple(t for t in ALL_TYPES if t in allowed)
    return chosen or ALL_TYPES


def parse_method(raw: str) -> str:
    """Scrub method for a user's spelling; anything unknown masks."""
    low = raw.lower()
    return low if low in METHODS else "mask"


def type_id_column(raw: Column) -> Column:
    """Column form of :func:`canonical_type`: NULL for unknown names."""
    known = {t: t for t in ALL_TYPES} | ALIASES
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(known.items())])
    return F.try_element_at(lookup, F.lower(raw))


def method_column(raw: Column) -> Column:
    """Column form of :func:`parse_method`."""
    low = F.lower(raw)
    return F.when(low.isin(*METHODS), low).otherwise(F.lit("mask"))


@dataclass(frozen=True)
class CatalogRow:
    ord: int
    type_id: str
    name: str
    description: str
    uses_model: bool
    available: bool


def catalog_rows(allowed=None) -> list[CatalogRow]:
    return [
        CatalogRow(i, t, name, text, t in MODEL_TYPES, allowed is None or t in allowed)
        for i, (t, (name, text)) in enumerate(PII_TYPES.items())
    ]


def type_catalog(spark, allowed=None):
    """The catalogue as a DataFrame: always twelve rows."""
    return spark.createDataFrame(
        [(r.ord, r.type_id, r.name, r.description, r.uses_model, r.available) for r in catalog_rows(allowed)],
        "ord int, type_id string, name string, description string, uses_model boolean, available boolean",
    )
