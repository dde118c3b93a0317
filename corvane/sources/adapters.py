"""What catalogues of different layouts need before a Spec applies: labels, boxes and groups from records of many kinds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def box_of_list(text: Column) -> Column:
    """[x, y, w, h], as text, as a box; null where it is no list of four numbers."""
    v = F.from_json(text, "array<double>")
    box = F.struct(*[c.cast("int").alias(n) for n, c in (("x0", F.get(v, 0)), ("y0", F.get(v, 1)), ("x1", F.get(v, 0) + F.get(v, 2)), ("y1", F.get(v, 1) + F.get(v, 3)))])
    return F.when((F.size(v) == 4) & F.forall(v, lambda x: x.isNotNull()), box)


def box_of_circle(x: Column, y: Column, radius: Column, height: int | None = None) -> Column:
    """The box around a circle; with height, y counts from the bottom of an image of that height."""
    cy = F.lit(height) - y if height is not None else y
    return F.when(radius.isNotNull() & x.isNotNull() & y.isNotNull(), F.struct(*[c.cast("int").alias(n) for n, c in (("x0", x - radius), ("y0", cy - radius), ("x1", x + radius), ("y1", cy + radius))]))


def box_around(df: DataFrame, by: Sequence[str], box: str) -> DataFrame:
    """by, box: the smallest box that holds all of by's."""
    return df.where(F.col(box).isNotNull()).groupBy(*by).agg(F.struct(F.min(f"{box}.x0").alias("x0"), F.min(f"{box}.y0").alias("y0"), F.max(f"{box}.x1").alias("x1"), F.max(f"{box}.y1").alias("y1")).alias(box))


def box_of_pixels(pixels: DataFrame, by: Sequence[str], where: Column) -> DataFrame:
    """by, box, n: around the pixels (y, x) that meet a condition."""
    return pixels.where(where).groupBy(*by).agg(F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")).alias("box"), F.count("*").alias("n"))


def padded_box(box: Column, pad: int, least: int, width: Column, height: Column, mirror: Column | None = None) -> Column:
    """box with pad on all sides, grown to least pixels around its middle, within the image; mirrored left to right where mirror is true."""
    def axis(lo: Column, hi: Column, size: Column) -> tuple[Column, Column]:
        lo, hi = lo - pad, hi + pad
        more = F.greatest(F.lit(least) - (hi - lo), F.lit(0))
        lo = lo - F.floor(more / 2).cast("int")
        return F.greatest(lo, F.lit(0)), F.least(F.greatest(hi, lo + F.greatest(hi - lo, F.lit(least))), size)

    (x0, x1), (y0, y1) = axis(box["x0"], box["x1"], width), axis(box["y0"], box["y1"], height)
    flip = F.coalesce(mirror, F.lit(False)) if mirror is not None else F.lit(False)
    return F.when(box.isNotNull(), F.struct(F.when(flip, width - x1).otherwise(x0).cast("int").alias("x0"), y0.cast("int").alias("y0"), F.when(flip, width - x0).otherwise(x1).cast("int").alias("x1"), y1.cast("int").alias("y1")))


def label_by_lines(lines: DataFrame, image: str, order: str, mark: str, labels: Mapping[str, int], default: int | None, finding: str) -> DataFrame:
    """image, label, findings: several lines an image; the first line with a known mark gives the label, else default.

    findings are the distinct values of finding, sorted and joined by |.
    """
    known = F.coalesce(*[F.when(F.col(mark) == k, v) for k, v in labels.items()])
    return lines.groupBy(image).agg(F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col(order))), F.lit(default).cast("int")).alias("label"), F.concat_ws("|", F.array_sort(F.collect_set(finding))).alias("findings"))


def label_by_priority(findings: DataFrame, image: str, kind: str, priority: Sequence[tuple[str, str]], default: str, normal: str) -> DataFrame:
    """image, label_name, n_findings (normal aside), kinds: of an image's kinds the first of priority names it; normal alone is normal, anything else default."""
    kinds = F.collect_set(kind)
    held = findings.groupBy(image).agg(kinds.alias("_k"), F.count_if(F.col(kind) != normal).alias("n_findings"))
    name = F.coalesce(*[F.when(F.array_contains("_k", k), label) for k, label in priority], F.when(F.col("_k") == F.array(F.lit(normal)), F.lit("normal")), F.lit(default))
    return held.select(image, name.alias("label_name"), "n_findings", F.concat_ws("|", F.array_sort("_k")).alias("kinds"))


def unpivoted(df: DataFrame, keys: Sequence[str], groups: Sequence[Mapping[str, str]], valid: str, values: Sequence) -> DataFrame:
    """keys, ordinal (from 1) and the fields of each repeated group of columns; groups whose field valid has another value go."""
    fields = list(groups[0])
    rows = F.array(*[F.struct(F.lit(k).alias("ordinal"), *[F.col(g[f]).alias(f) for f in fields]) for k, g in enumerate(groups, 1)])
    return df.select(*keys, F.explode(rows).alias("_x")).select(*keys, "_x.*").where(F.col(valid).isin(list(values)))


def side_letter(text: Column) -> Column:
    """L or R by the first letter; null for anything else."""
    c = F.upper(F.substring(F.trim(text), 1, 1))
    return F.when(c.isin("L", "R"), c)


def smallest_and_largest(files: DataFrame, folder: str, size: Column, path: str) -> DataFrame:
    """folder, smallest, largest: of the files of a folder, ties to the first path; one file alone is the smallest only."""
    out = files.groupBy(folder).agg(F.min_by(path, F.struct(size, F.col(path))).alias("smallest"), F.max_by(path, F.struct(size, F.col(path))).alias("largest"), F.count("*").alias("_n"))
    return out.select(folder, "smallest", F.when(F.col("_n") > 1, F.col("largest")).alias("largest"))


def indexed_paths(df: DataFrame, columns: Sequence[str], part: int, name: str = "folder") -> DataFrame:
    """df once for each of the columns' paths, with the part (from 1, or from -1 back) of that path as name; rows of equal name once."""
    rows = df.select("*", F.explode(F.array_distinct(F.array(*[F.try_element_at(F.split(c, "/"), F.lit(part)) for c in columns]))).alias(name))
    return rows.where(F.col(name).isNotNull())


def any_positive(df: DataFrame, by: Sequence[str], flag: Column, name: str = "malignant") -> DataFrame:
    """by, name, n: whether some row of by has the flag."""
    return df.groupBy(*by).agg(F.max(F.coalesce(flag, F.lit(False))).alias(name), F.count("*").alias("n"))


def frame_name(prefix: Column, number: Column, width: int) -> Column:
    """prefix and a number with leading zeros."""
    return F.concat(prefix, F.lpad(number.cast("string"), width, "0"))


def parsed_key(c: Column) -> Column:
    """What lies between the first _ and the first @ after it; a key without them stays whole."""
    return F.regexp_replace(F.regexp_replace(c, r"^[^_]*_", ""), r"@.*$", "")


def tidy_codes(df: DataFrame, image: str, code: str, fixes: Mapping[str, str], pattern: str = r"(?i)^img\d+$") -> DataFrame:
    """Rows whose image fits the pattern, with the code trimmed, in upper case and with known misspellings mended."""
    tidy = F.upper(F.trim(F.col(code)))
    mended = reduce(lambda c, kv: F.when(tidy == kv[0], F.lit(kv[1])).otherwise(c), fixes.items(), tidy)
    return df.where(F.trim(F.col(image)).rlike(pattern)).withColumn(image, F.trim(F.col(image))).withColumn(code, mended)


def peak_rows(df: DataFrame, by: Sequence[str], size: str, at: str) -> DataFrame:
    """The row of each by with the largest size, the smaller at of equal ones."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(-F.col(size), F.col(at))).alias("_x")).select(*by, "_x.*").select(*df.columns)


def with_modality(df: DataFrame, source: str, modalities: DataFrame) -> DataFrame:
    """df with the modality of its source by a small table (source, modality)."""
    return df.join(F.broadcast(modalities.select(source, "modality")), source, "left")


def years_of_days(days: Column) -> Column:
    return days / F.lit(365.25)


def recoded(c: Column, codes: Mapping[int, int]) -> Column:
    """The code that each value stands for; other values are null."""
    return F.coalesce(*[F.when(c == k, v) for k, v in codes.items()])
