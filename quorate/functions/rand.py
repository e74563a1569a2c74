"""Deterministic draws: md5 of ``seed:key``, equal on every engine and on every retry."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_digest(key: Column, seed: int) -> Column:
    """Hex digest that orders the rows of a draw."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def draw_unit(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) with 32 random bits."""
    head = F.conv(F.substring(draw_digest(key, seed), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def permute(values: list[int], seed: int) -> list[int]:
    """Seeded permutation of a short parameter list, by the same digest."""
    return sorted(values, key=lambda v: hashlib.md5(f"{seed}:{v}".encode()).hexdigest())
