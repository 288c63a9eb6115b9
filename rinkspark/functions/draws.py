"""Reproducible uniform draws: bits of a hash of row key and seed, so a retried task repeats them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of the hash that make one draw; the hash has 32.
DIGITS = 8


def uniform_draws(n: int, seed: int, *keys: Column) -> list[Column]:
    """Up to four columns in [0, 1), independent of each other and between rows and seeds. A NULL key is written as ``NULL``.

    All are cut from one digest, which generated code computes once.
    """
    if not 0 < n <= 32 // DIGITS:
        raise ValueError(f"one digest holds {32 // DIGITS} draws")
    parts = [F.coalesce(k.cast("string"), F.lit("NULL")) for k in keys]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))
    return [F.conv(F.substring(digest, 1 + DIGITS * k, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS)) for k in range(n)]
