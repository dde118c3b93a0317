"""Deterministic order keys, equal on every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, *cols: str | Column) -> Column:
    """md5 of seed:col:col..., the shuffled order of all splits and samples."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))
