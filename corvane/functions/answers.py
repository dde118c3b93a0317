"""What a model's free text answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_answer(text: Column, positive: Sequence[str], negative: Sequence[str], neither: int = -1) -> Column:
    """1 if the text, in lower case, contains a positive word, else 0 if it contains a negative one, else neither; null texts are neither.

    Positive words are looked for first, so a text with both is positive.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: low.contains(w))
    return F.when(any_of(positive), 1).when(any_of(negative), 0).otherwise(neither)
