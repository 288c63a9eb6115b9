"""Joins on keys where NULL is a value like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Like ``left.join(right, keys, how)``, but NULL keys match NULL keys."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = left.join(other, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    key = [F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in keys]
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return joined.select(*key, *rest)
