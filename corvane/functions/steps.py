"""Named steps over tables, chained by spec strings, with results kept by the specs' digest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from corvane.sources.tables import cached

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Registers a step: a function of a table and named text values."""

    def register(f: Step) -> Step:
        if name in STEPS:
            raise ValueError(f"step {name} is there already")
        STEPS[name] = f
        return f

    return register


def parse(spec: str) -> tuple[str, dict[str, str]]:
    """name:key=value;key=value as the name and its values. Unknown names and pairs without = are errors."""
    name, _, rest = spec.partition(":")
    pairs = [p for p in rest.split(";") if p.strip()]
    bad = [p for p in pairs if "=" not in p]
    if bad or name.strip() not in STEPS:
        raise ValueError(f"no such step or value: {spec}")
    return name.strip(), {k.strip(): v.strip() for k, v in (p.split("=", 1) for p in pairs)}


def apply(df: DataFrame, specs: Sequence[str]) -> DataFrame:
    """df through the steps in order."""
    for spec in specs:
        name, values = parse(spec)
        df = STEPS[name](df, **values)
    return df


def digest(specs: Sequence[str]) -> str:
    """One name for equal chains: order counts, blanks and the order of a step's values don't."""
    plain = [f"{n}:{';'.join(f'{k}={v}' for k, v in sorted(p.items()))}" for n, p in map(parse, specs)]
    return hashlib.sha1("|".join(plain).encode()).hexdigest()


def kept(spark: SparkSession, folder: str, df: DataFrame, specs: Sequence[str]) -> DataFrame:
    """apply(), kept under folder by digest: an equal chain is read back, not worked out again."""
    return cached(spark, f"{folder.rstrip('/')}/{digest(specs)}", lambda: apply(df, specs))
