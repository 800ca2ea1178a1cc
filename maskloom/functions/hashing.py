"""Repeatable pseudo-randomness.

Every "random" choice is a function of (seed, key), so a retried task, another
partitioning or another engine makes the same choice. `rand()` is never used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(seed: str, *keys) -> Column:
    """32-bit non-negative integer from the seed and the key columns."""
    parts = [F.lit(seed)] + [_col(k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash01(seed: str, *keys) -> Column:
    """Uniform draw in [0, 1) from 32 bits."""
    return hash_int(seed, *keys) / F.lit(float(1 << 32))


def hash_pct(seed: str, *keys) -> Column:
    """Uniform integer in 0..999, for exact comparisons."""
    return hash_int(seed, *keys) % 1000


def pick(seed: str, values, *keys) -> Column:
    """One value of a short constant list."""
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (hash_int(seed, *keys) % len(values) + 1).cast("int"))


def random_text(seed: str, alphabet: str, length: Column, *keys) -> Column:
    """`length` characters of `alphabet`, each drawn by its own hash."""
    letters = F.lit(alphabet)
    draw = F.transform(
        F.sequence(F.lit(1), length.cast("int")),
        lambda i: letters.substr(
            (hash_int(seed, *keys, i) % len(alphabet) + 1).cast("int"), F.lit(1)
        ),
    )
    return F.array_join(draw, "")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
