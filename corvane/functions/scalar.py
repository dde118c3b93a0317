"""Scalar expressions that several families share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN to null: undefined values are null everywhere in this library."""
    return F.when(F.isnan(c), None).otherwise(c)


def to_bool(c: Column) -> Column:
    """true/1/yes/y and false/0/no/n in any case and padding; anything else is null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def presence(slots: Column) -> Column:
    """Which slots of an array hold something: neither null, blank nor the word MISSING."""
    return F.transform(slots, lambda s: s.isNotNull() & ~F.upper(F.trim(F.coalesce(s, F.lit("")))).isin("MISSING", ""))


def human_size(n: Column) -> Column:
    """Bytes with a binary unit and one digit; null stays null."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.round(n / F.lit(float(1024**k)), 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
