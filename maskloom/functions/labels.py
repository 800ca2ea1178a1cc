"""The label vocabulary (entity types in BIO form)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven entity types.
ENTITY_TYPES = (
    "EMAIL",
    "ID_NUM",
    "NAME_STUDENT",
    "PHONE_NUM",
    "STREET_ADDRESS",
    "URL_PERSONAL",
    "USERNAME",
)
# Inside-labels that never occur.
REMOVED_LABELS = ("I-EMAIL", "I-USERNAME", "I-URL_PERSONAL")


def build_vocabulary(types=ENTITY_TYPES, remove=REMOVED_LABELS, bio: bool = True) -> list[str]:
    """Sorted label names; a label goes when any removed name is a substring of it."""
    names = [f"{p}-{t}" for t in types for p in "BI"] if bio else list(types)
    kept = [n for n in names if not any(r in n for r in remove)]
    return sorted(kept + ["O"])


LABELS = build_vocabulary()
ENTITY_LABELS = [name for name in LABELS if name != "O"]


def label_id(c: Column, vocabulary=None) -> Column:
    """Position of a label in the vocabulary, null when unknown."""
    names = F.array(*[F.lit(n) for n in (vocabulary or LABELS)])
    pos = F.array_position(names, c)
    return F.when(pos > 0, (pos - 1).cast("int"))


def label_name(c: Column, vocabulary=None) -> Column:
    names = F.array(*[F.lit(n) for n in (vocabulary or LABELS)])
    return F.element_at(names, (c + 1).cast("int"))


def strip_bio(c: Column) -> Column:
    """`B-X` / `I-X` to `X`."""
    return F.element_at(F.split(c, "-"), -1)
