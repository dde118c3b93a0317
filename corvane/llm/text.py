"""Column helpers that the text operators share. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; no other character changes."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The maximal runs without ASCII white space; null and blank texts give an empty array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def windows3(words: Column) -> Column:
    """64-bit hashes of the runs of three words, in order; empty below three words."""
    n = F.size(words)
    return F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


#: Items of a block of running().
RUN_BLOCK = 128


def running(items: Column, zero: Column, add: Callable[[Column, Column], Column], tell: Callable[[Column, Column], Column], kind: str) -> Column:
    """tell(state, item) of every item, in order, as an array of kind; state is zero and what add made of it and the items before.

    Arrays are appended to within blocks only, and once a block, so the time is in proportion to the items, not to
    their square. items and zero are computed once.
    """

    def whole(a: Column) -> Column:
        count = F.size(a["items"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / RUN_BLOCK).cast("int")), lambda b: F.slice(a["items"], b * RUN_BLOCK + 1, RUN_BLOCK))
        first = F.struct(a["zero"].alias("now"), F.slice(F.array(a["zero"]), 1, 0).alias("out"))
        starts = F.aggregate(blocks, first, lambda s, b: F.struct(F.aggregate(b, s["now"], add).alias("now"), F.array_append(s["out"], s["now"]).alias("out")), lambda s: s["out"])

        def block(x: Column) -> Column:
            begin = F.struct(x["start"].alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
            return F.aggregate(x["block"], begin, lambda s, i: F.struct(add(s["now"], i).alias("now"), F.array_append(s["out"], tell(s["now"], i)).alias("out")), lambda s: s["out"])

        told = F.flatten(F.transform(F.array(F.struct(blocks.alias("blocks"))), lambda h: F.flatten(F.transform(F.arrays_zip(h["blocks"].alias("block"), starts.alias("start")), block))))
        return F.when(count > 0, told).otherwise(F.array().cast(f"array<{kind}>"))

    return F.get(F.transform(F.array(F.struct(items.alias("items"), zero.alias("zero"))), whole), 0)
