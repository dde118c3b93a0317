"""Masks as relations of runs: components, holes, geometry, glyphs and lines of text.

A run is a stretch of set pixels in a line: image, y, x0 and x1 (inclusive). Runs of neighbouring lines meet in a join on
image and line; components are those of the graph of runs that touch, all images at once. No image is held whole
by Python, and a mask costs rows in proportion to its outline.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scalar import ratio
from corvane.operators.graph import components_within, cut

GLYPHS = 1 << 18  # in one task, on average


def sorted_side(df: DataFrame) -> DataFrame:
    """df, joined by sorting: what grows with the images is never collected by the driver to be broadcast."""
    return df.hint("merge")


def mask_runs(df: DataFrame, image: str, mask: Column, width: Column | int) -> DataFrame:
    """image, y, x0, x1: the runs of mask, an array of booleans line by line; null entries are not set."""
    width = F.lit(width) if isinstance(width, int) else width
    held = df.select(F.col(image).alias("image"), F.transform(mask, lambda v: F.coalesce(v, F.lit(False))).alias("m"), width.cast("int").alias("w"))
    lines = held.where(F.size("m") > 0).select("image", F.posexplode(F.transform(F.sequence(F.lit(0), (F.floor((F.size("m") - 1) / F.col("w"))).cast("int")), lambda y: F.slice("m", y * F.col("w") + 1, F.col("w")))).alias("y", "line"))
    places = lambda beside: F.filter(F.transform("line", lambda v, x: F.when(v & ~F.coalesce(F.get("line", x + beside), F.lit(False)), x)), lambda x: x.isNotNull())
    return lines.select("image", "y", F.explode(F.arrays_zip(places(-1).alias("x0"), places(1).alias("x1"))).alias("r")).select("image", "y", "r.x0", "r.x1")


def labelled(runs: DataFrame, diagonal: bool = False) -> DataFrame:
    """runs with y0 and left: line and first pixel of the run that its component begins with.

    Runs touch where they share a column in neighbouring lines, or, with diagonal, where columns are neighbours.
    """
    reach = 1 if diagonal else 0
    at = lambda s: F.shiftleft(F.col(f"{s}.y").cast("long"), 32) + F.col(f"{s}.x0")
    runs = cut(runs)
    pairs = runs.alias("r").join(sorted_side(runs).alias("s"), F.expr(f"r.image <=> s.image and s.y = r.y + 1 and s.x0 <= r.x1 + {reach} and s.x1 >= r.x0 - {reach}"))
    roots = components_within(pairs.select(F.col("r.image").alias("image"), at("r").alias("a"), at("s").alias("b")), "image", "a", "b")
    x = lambda c: F.shiftright(F.shiftleft(F.col(c), 32), 32).cast("int")
    y = lambda c: F.shiftright(F.col(c) - x(c), 32).cast("int")
    named = roots.select(F.col("group").alias("_i"), y("node").alias("_y"), x("node").alias("_x"), y("root").alias("_ry"), x("root").alias("_rx"))
    held = runs.join(sorted_side(named), F.col("image").eqNullSafe(F.col("_i")) & (F.col("y") == F.col("_y")) & (F.col("x0") == F.col("_x")), "left")
    return held.select("image", "y", "x0", "x1", F.coalesce("_ry", "y").alias("y0"), F.coalesce("_rx", "x0").alias("left"))


def component_table(parts: DataFrame) -> DataFrame:
    """image, component (from 0, in the order in which they begin), y0, left, area, top, bottom, first, last (inclusive) of labelled() runs."""
    n = F.col("x1") - F.col("x0") + 1
    table = parts.groupBy("image", "y0", "left").agg(F.sum(n).alias("area"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x0").alias("first"), F.max("x1").alias("last"))
    return table.withColumn("component", F.row_number().over(Window.partitionBy("image").orderBy("y0", "left")) - 1)


def _of(parts: DataFrame, table: DataFrame) -> DataFrame:
    """The runs of the components that table(image, y0, left) has."""
    named = table.select(F.col("image").alias("_i"), F.col("y0").alias("_y"), F.col("left").alias("_l"))
    return parts.join(sorted_side(named), F.col("image").eqNullSafe(F.col("_i")) & (F.col("y0") == F.col("_y")) & (F.col("left") == F.col("_l")), "left_semi")


def largest_component(runs: DataFrame) -> DataFrame:
    """The runs of each image's largest component, the one that begins first of equal ones."""
    parts = cut(labelled(runs))
    best = component_table(parts).groupBy("image").agg(F.min_by(F.struct("y0", "left"), F.struct(-F.col("area"), F.col("y0"), F.col("left"))).alias("b")).select("image", "b.y0", "b.left")
    return _of(parts, best).select("image", "y", "x0", "x1")


def within_areas(runs: DataFrame, least: int, most: int, diagonal: bool = False) -> DataFrame:
    """The runs of components of least to most pixels."""
    parts = cut(labelled(runs, diagonal))
    return _of(parts, component_table(parts).where(F.col("area").between(least, most))).select("image", "y", "x0", "x1")


def inverted(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The runs of what is not set, within images of sizes(image, width, height)."""
    lines = sizes.select(F.col("image").alias("_i"), "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("_y"))
    own = runs.groupBy("image", "y").agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("r"))
    held = lines.join(sorted_side(own), F.col("image").eqNullSafe(F.col("_i")) & (F.col("y") == F.col("_y")), "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<x0:int,x1:int>>")))
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), F.col("r.x1")), F.concat(F.col("r.x0"), F.array(F.col("width"))), lambda a, b: F.struct((a + 1).alias("x0"), (b - 1).alias("x1")))
    return held.select(F.col("_i").alias("image"), F.col("_y").alias("y"), F.explode(F.filter(gaps, lambda g: g["x0"] <= g["x1"])).alias("g")).select("image", "y", "g.x0", "g.x1")


def filled(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """runs with all holes set: parts of the rest that do not reach the edge of their image."""
    rest = cut(labelled(inverted(runs, sizes)))
    table = component_table(rest).join(sorted_side(sizes.select(F.col("image").alias("_s"), "width", "height")), F.col("image").eqNullSafe(F.col("_s")))
    holes = _of(rest, table.where("top > 0 and first > 0 and bottom < height - 1 and last < width - 1")).select("image", "y", "x0", "x1")
    return _merged(runs.unionByName(holes))


def _merged(runs: DataFrame) -> DataFrame:
    """Runs of a line that touch or overlap made one."""
    w = Window.partitionBy("image", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.withColumn("_new", F.coalesce(F.col("x0") > reach + 1, F.lit(True)).cast("int")).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return begun.groupBy("image", "y", "_k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select("image", "y", "x0", "x1")


def dilated(runs: DataFrame, sizes: DataFrame, times: int = 1) -> DataFrame:
    """runs grown by all pixels within times steps along lines and columns, inside their images."""
    each = runs.select("image", "y", "x0", "x1", F.explode(F.sequence(F.lit(-times), F.lit(times))).alias("d"))
    grown = each.select("image", (F.col("y") + F.col("d")).alias("y"), (F.col("x0") - times + F.abs("d")).alias("x0"), (F.col("x1") + times - F.abs("d")).alias("x1"))
    held = grown.join(sorted_side(sizes.select(F.col("image").alias("_i"), "width", "height")), F.col("image").eqNullSafe(F.col("_i"))).where("y >= 0 and y < height")
    return _merged(held.select("image", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.col("width") - 1).alias("x1")))


def eroded(runs: DataFrame, sizes: DataFrame, times: int = 1) -> DataFrame:
    """Pixels whose whole neighbourhood of times steps is set; what lies outside the image is not set."""
    frame = sizes.select("image", (F.col("width") + 2 * times).alias("width"), (F.col("height") + 2 * times).alias("height"))
    moved = runs.select("image", (F.col("y") + times).alias("y"), (F.col("x0") + times).alias("x0"), (F.col("x1") + times).alias("x1"))
    kept = inverted(dilated(inverted(moved, frame), frame, times), frame)
    return kept.select("image", (F.col("y") - times).alias("y"), (F.col("x0") - times).alias("x0"), (F.col("x1") - times).alias("x1"))


def opened(runs: DataFrame, sizes: DataFrame, times: int = 1) -> DataFrame:
    return dilated(eroded(runs, sizes, times), sizes, times)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """The runs of pixels that are set in both."""
    other = b.select(F.col("image").alias("_i"), F.col("y").alias("_y"), F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    held = a.join(sorted_side(other), F.col("image").eqNullSafe(F.col("_i")) & (F.col("y") == F.col("_y")) & (F.col("_a") <= F.col("x1")) & (F.col("_b") >= F.col("x0")))
    return held.select("image", "y", F.greatest("x0", "_a").alias("x0"), F.least("x1", "_b").alias("x1"))


def content_region(runs: DataFrame, sizes: DataFrame, least: float = 0.02) -> DataFrame:
    """The runs of each image's content: opened twice, its largest component with holes filled; the whole image if that
    is less than the share least of it."""
    kept = cut(filled(cut(largest_component(cut(opened(runs, sizes, 2)))), sizes))
    area = kept.groupBy("image").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    ends = sizes.join(area.withColumnRenamed("image", "_i"), F.col("image").eqNullSafe(F.col("_i")), "left")
    small = ends.where(F.coalesce("n", F.lit(0)) < least * F.col("width") * F.col("height"))
    whole = small.select("image", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(0).alias("x0"), (F.col("width") - 1).alias("x1"))
    rest = kept.join(small.select(F.col("image").alias("_i")), F.col("image").eqNullSafe(F.col("_i")), "left_anti")
    return rest.unionByName(whole)


def geometry(runs: DataFrame, sizes: DataFrame, region: DataFrame | None = None) -> DataFrame:
    """A row for each image with a set pixel: area, area_share, components, box_width, box_height, cx and cy (shares of the
    image's sides), box_fill, outside (share of pixels outside region), edge (pixels that lack one of four
    neighbours) and compactness, edge^2 / (4 pi area)."""
    runs = cut(runs)
    n = F.col("x1") - F.col("x0") + 1
    facts = runs.groupBy("image").agg(
        F.sum(n).alias("area"), (F.max("x1") - F.min("x0") + 1).alias("box_width"), (F.max("y") - F.min("y") + 1).alias("box_height"),
        (F.sum(n * (F.col("x0") + F.col("x1")) / 2) / F.sum(n)).alias("mx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("my"),
    )
    inner = eroded(runs, sizes).groupBy("image").agg(F.sum(n).alias("inner"))
    parts = component_table(labelled(runs)).groupBy("image").agg(F.count("*").alias("components"))
    inside = overlap(runs, region if region is not None else runs).groupBy("image").agg(F.sum(n).alias("inside"))
    out = sizes.join(sorted_side(facts.withColumnRenamed("image", "_f")), F.col("image").eqNullSafe(F.col("_f")))
    for k, part in enumerate((inner, parts, inside)):
        out = out.join(sorted_side(part.withColumnRenamed("image", f"_p{k}")), F.col("image").eqNullSafe(F.col(f"_p{k}")), "left")
    edge = F.col("area") - F.coalesce("inner", F.lit(0))
    return out.select(
        "image", "area", (F.col("area") / (F.col("width") * F.col("height"))).alias("area_share"), "components", "box_width", "box_height", (F.col("mx") / F.col("width")).alias("cx"), (F.col("my") / F.col("height")).alias("cy"),
        ratio(F.col("area"), F.col("box_width") * F.col("box_height")).alias("box_fill"), (1 - F.coalesce("inside", F.lit(0)) / F.col("area")).alias("outside"), edge.alias("edge"), (edge * edge / (4 * math.pi * F.col("area"))).alias("compactness"),
    )


def local_means(df: DataFrame, image: str, pixels: Column, width: int, size: int) -> DataFrame:
    """image, y, x, v, mean: each pixel beside the mean of size x size pixels around it, the edge mirrored with its pixels repeated.

    Sums over the square are differences of running sums along lines and then along columns (a summed-area table).
    """
    half = size // 2
    whole = df.select(F.col(image).alias("image"), F.posexplode(pixels).alias("i", "v")).select("image", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), F.col("v").cast("double").alias("v"))
    height = whole.groupBy("image").agg((F.max("y") + 1).alias("h"))
    mirrored = lambda k, n: F.array_distinct(F.filter(F.array(k, -k - 1, 2 * n - 1 - k), lambda p: (p >= -half) & (p < n + half)))
    spread = whole.join(height.withColumnRenamed("image", "_i"), F.col("image").eqNullSafe(F.col("_i"))).select("image", "h", "v", F.explode(mirrored(F.col("y"), F.col("h"))).alias("y"), "x").select("image", "h", "v", "y", F.explode(mirrored(F.col("x"), F.lit(width))).alias("x"))
    along = Window.partitionBy("image", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("image", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    table = spread.withColumn("s", F.sum("v").over(along)).withColumn("s", F.sum("s").over(down))
    at = lambda c, k, w: F.coalesce(F.lag(c, k).over(w), F.lit(0.0))
    by_x, by_y = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    lines = table.withColumn("d", F.lead("s", half).over(by_x) - at("s", half + 1, by_x))
    square = lines.withColumn("d", F.lead("d", half).over(by_y) - at("d", half + 1, by_y))
    return square.where((F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") >= 0) & (F.col("x") < width)).select("image", "y", "x", "v", (F.col("d") / (size * size)).alias("mean"))


def runs_of_pixels(pixels: DataFrame, where: Column) -> DataFrame:
    """image, y, x0, x1 of the pixels(image, y, x, ...) that meet a condition."""
    set_ = pixels.where(where).select("image", "y", "x")
    at = F.col("x") - F.row_number().over(Window.partitionBy("image", "y").orderBy("x"))
    return set_.withColumn("_g", at).groupBy("image", "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select("image", "y", "x0", "x1")


def bright_overlays(df: DataFrame, image: str, pixels: Column, width: int, size: int = 15, above: float = 30.0, bright: float = 200.0) -> DataFrame:
    """Runs of pixels brighter than bright and than their surroundings' mean by more than above."""
    return runs_of_pixels(local_means(df, image, pixels, width, size), (F.col("v") > bright) & (F.col("v") > F.col("mean") + above))


# ---------------------------------------------------------------- glyphs and lines of text

# Least and most height, width and ink (share of the box) of a letter; and, in heights of the first of
# two letters, how far the second may begin behind it, lie above or below it, and differ in height.
GLYPH_HEIGHT, GLYPH_WIDTH, GLYPH_INK = (6, 24), (2, 20), (0.15, 0.85)
LINE_GAP, LINE_SHIFT, LINE_CHANGE = 1.2, 0.3, 0.4
# Of a drawn cross, least and most side, width over height, pixels over both sides, share of a side from
# which a line is a bar, how many bars each way, and how far the longest may be from the middle.
CROSS_SIDE, CROSS_SHAPE, CROSS_INK = (7, 30), (0.6, 1.6), 2.2
BAR_SHARE, BARS, BAR_OFF = 0.7, (1, 3), 0.25


def text_lines(boxes: DataFrame, image: str, least: int = 3) -> DataFrame:
    """image, lines: how many runs of at least least glyphs share a line, of boxes(image, x0, x1, y0, y1, area) with ends exclusive.

    Glyphs have the size and the ink of letters. One follows another if it begins at most 1.2 heights behind its end,
    their middles differ by at most 0.3 and their heights by at most 0.4 of the first one's height. Boxes meet
    within bands of 12 lines and strips of 48 columns, so an image's boxes are never all compared. Images without a
    line have no row.
    """
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    named = boxes.select(F.col(image).alias("image"), "x0", "x1", h.alias("h"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.struct("x0", "y0", "x1", "y1").alias("box"), (F.col("area") / (h * w)).alias("ink"), w.alias("w"))
    numbered = lambda d: d.withColumn("id", F.dense_rank().over(Window.partitionBy("image").orderBy("box"))).drop("box")
    glyphs = cut(numbered(named.where(F.col("h").between(*GLYPH_HEIGHT) & F.col("w").between(*GLYPH_WIDTH) & F.col("ink").between(*GLYPH_INK))))
    # what follows begins between the glyph's own start and 1.2 heights (28.8 at most) behind its end, and lies within 7.2 lines
    strip, band = lambda c: F.floor(c / 48).cast("int"), lambda c: F.floor(c / 12).cast("int")
    first = glyphs.withColumn("s", F.explode(F.sequence(strip(F.col("x0")), strip(F.col("x1") + LINE_GAP * F.col("h"))))).withColumn("b", F.explode(F.sequence(band(F.col("cy") - LINE_SHIFT * F.col("h")), band(F.col("cy") + LINE_SHIFT * F.col("h")))))
    then = glyphs.select(F.col("image").alias("_i"), F.col("id").alias("j"), F.col("x0").alias("_x0"), F.col("h").alias("_h"), F.col("cy").alias("_cy"), strip(F.col("x0")).alias("_s"), band(F.col("cy")).alias("_b"))
    met = first.join(sorted_side(then), F.col("image").eqNullSafe(F.col("_i")) & (F.col("s") == F.col("_s")) & (F.col("b") == F.col("_b")))
    after = (F.col("_x0") > F.col("x0")) | ((F.col("_x0") == F.col("x0")) & (F.col("j") > F.col("id")))
    follows = after & (F.col("_x0") - F.col("x1") <= LINE_GAP * F.col("h")) & (F.abs(F.col("cy") - F.col("_cy")) <= LINE_SHIFT * F.col("h")) & (F.abs(F.col("h") - F.col("_h")) <= LINE_CHANGE * F.col("h"))
    links = met.where(follows).select("image", F.col("id").alias("a"), F.col("j").alias("b"))
    lines = components_within(links, "image", "a", "b").groupBy("group", "root").agg(F.count("*").alias("n"))
    return lines.where(F.col("n") >= least).groupBy(F.col("group").alias(image)).agg(F.count("*").alias("lines"))


def cross_glyphs(parts: DataFrame) -> DataFrame:
    """image, y0, left, h, w of the components of labelled() runs that are drawn crosses: 7 to 30 pixels a side, thin, one to
    three wide lines and tall columns, the widest line and the tallest column near the middle."""
    n = F.col("x1") - F.col("x0") + 1
    table = component_table(parts).select("image", "y0", "left", "area", "top", "first", (F.col("bottom") - F.col("top") + 1).alias("h"), (F.col("last") - F.col("first") + 1).alias("w"))
    thin = cut(table.where(F.col("h").between(*CROSS_SIDE) & F.col("w").between(*CROSS_SIDE) & (F.col("w") / F.col("h")).between(*CROSS_SHAPE) & (F.col("area") <= CROSS_INK * (F.col("h") + F.col("w")))))
    own = _of(parts, thin)
    keys = ["image", "y0", "left"]
    rows = own.groupBy(*keys, "y").agg(F.sum(n).alias("n"))
    columns = own.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x")).groupBy(*keys, "x").agg(F.count("*").alias("n"))
    sizes = thin.select(F.col("image").alias("_i"), F.col("y0").alias("_y"), F.col("left").alias("_l"), "h", "w", "top", "first")
    same = F.col("image").eqNullSafe(F.col("_i")) & (F.col("y0") == F.col("_y")) & (F.col("left") == F.col("_l"))

    def bars(lines: DataFrame, at: str, begin: str, length: str, across: str, name: str) -> DataFrame:
        """How many lines are at least 0.7 as long as the glyph, and how far the longest (the first of them) is from the middle."""
        held = lines.join(sizes, same)
        place = F.min_by(F.col(at) - F.col(begin), F.struct(-F.col("n"), F.col(at)))
        return held.groupBy(*keys).agg(F.count_if(F.col("n") >= BAR_SHARE * F.col(length)).alias(f"{name}_n"), (F.abs(place - F.first(across) / 2) / F.first(across)).alias(f"{name}_off"))

    wide, tall = bars(rows, "y", "top", "w", "h", "wide"), bars(columns, "x", "first", "h", "w", "tall")
    named = lambda t, s: t.select(*[F.col(k).alias(f"_{s}{k}") for k in keys], *[c for c in t.columns if c not in keys])
    on = lambda s: F.col("image").eqNullSafe(F.col(f"_{s}image")) & (F.col("y0") == F.col(f"_{s}y0")) & (F.col("left") == F.col(f"_{s}left"))
    both = thin.join(named(wide, "a"), on("a")).join(named(tall, "b"), on("b"))
    return both.where(F.col("wide_n").between(*BARS) & F.col("tall_n").between(*BARS) & (F.col("wide_off") <= BAR_OFF) & (F.col("tall_off") <= BAR_OFF)).select(*keys, "h", "w")


def paired_glyphs(glyphs: DataFrame, near: int = 4) -> DataFrame:
    """image, calipers: glyphs(image, h, w) that have a partner in their image whose height and width differ by at most near.

    Counts by size meet, not glyphs, so many of one size cost one row; a size is kept or not by whether it meets one, so
    what meets is never gathered. The image is held in a struct, in which nulls are equal: one shuffle by it serves
    the counts, the join and the sums. Its parts hold GLYPHS glyphs on average, however many there are.
    """
    parts = max(glyphs.sparkSession.sparkContext.defaultParallelism, -(-glyphs.count() // GLYPHS))
    sizes = glyphs.select(F.struct("image").alias("_k"), "h", "w").repartition(parts, "_k").groupBy("_k", "h", "w").agg(F.count("*").alias("n"))
    other = sizes.select(F.col("_k").alias("_i"), F.col("h").alias("_h"), F.col("w").alias("_w"))
    near_by = (F.abs(F.col("h") - F.col("_h")) <= near) & (F.abs(F.col("w") - F.col("_w")) <= near)
    met = sorted_side(sizes).join(sorted_side(other), (F.col("_k") == F.col("_i")) & near_by & ((F.col("n") > 1) | (F.col("h") != F.col("_h")) | (F.col("w") != F.col("_w"))), "left_semi")
    return met.groupBy("_k").agg(F.sum("n").alias("calipers")).select("_k.image", "calipers")


def artifact_flags(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """df with named flags; unknown is not set."""
    return df.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in flags.items()})


def colour_parts(df: DataFrame, image: str, red: Column, green: Column, blue: Column, width: int, least_saturation: float, least_value: float) -> DataFrame:
    """Runs of pixels (0 to 255 a channel) whose saturation and value both exceed their bounds (shares of 255)."""
    rgb = df.select(F.col(image).alias("image"), F.arrays_zip(red.alias("r"), green.alias("g"), blue.alias("b")).alias("p"))
    most = lambda p: F.greatest(p["r"], p["g"], p["b"])
    grey = lambda p: most(p) - F.least(p["r"], p["g"], p["b"])
    mask = F.transform("p", lambda p: (most(p) > 255 * least_value) & (grey(p) > least_saturation * most(p)))
    return mask_runs(rgb, "image", mask, width)


def area_of(runs: DataFrame) -> DataFrame:
    """image, area."""
    return runs.groupBy("image").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def colour_shares(runs: DataFrame, sizes: DataFrame, region: DataFrame, least_share: float) -> DataFrame:
    """image, colour_share, blob_share (pixels of large blobs within region, of region) and small_blobs, for all images of sizes.

    A blob is large from least_share of its image on.
    """
    parts = cut(labelled(runs))
    table = component_table(parts).join(sizes.select(F.col("image").alias("_i"), (F.col("width") * F.col("height")).alias("pixels")), F.col("image").eqNullSafe(F.col("_i")))
    large = F.col("area") >= least_share * F.col("pixels")
    blobs = table.groupBy("image").agg(F.sum("area").alias("n"), F.count_if(~large).alias("small"))
    inside = area_of(overlap(_of(parts, table.where(large)).select("image", "y", "x0", "x1"), region))
    out = sizes
    for k, (part, name) in enumerate(((blobs, None), (inside, "inside"), (area_of(region), "roi"))):
        out = out.join((part if name is None else part.withColumnRenamed("area", name)).withColumnRenamed("image", f"_p{k}"), F.col("image").eqNullSafe(F.col(f"_p{k}")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("image", (zero("n") / (F.col("width") * F.col("height"))).alias("colour_share"), (zero("inside") / F.greatest(zero("roi"), F.lit(1))).alias("blob_share"), zero("small").alias("small_blobs"))


def outside_labels(runs: DataFrame, region: DataFrame, sizes: DataFrame, away: int = 10, least: int = 20, most: int = 20000) -> DataFrame:
    """image, labels, label_share of all images: components of least to most pixels of what is set further than away from region."""
    grown = dilated(region, sizes, away)
    outside = overlap(runs, inverted(grown, sizes))
    held = component_table(labelled(outside)).where(F.col("area").between(least, most)).groupBy("image").agg(F.count("*").alias("labels"), F.sum("area").alias("area"))
    out = sizes.join(held.withColumnRenamed("image", "_i"), F.col("image").eqNullSafe(F.col("_i")), "left")
    return out.select("image", F.coalesce("labels", F.lit(0)).alias("labels"), (F.coalesce("area", F.lit(0)) / (F.col("width") * F.col("height"))).alias("label_share"))


def channel_summary(df: DataFrame, image: str, channels: Sequence[str]) -> DataFrame:
    """image, means (of each channel's array), peak_channel (from 0, the first of equal ones) and enhancement (the largest mean over the first, null unless that is positive)."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(c)
    held = df.select(image, F.array(*[mean(F.col(c)) for c in channels]).alias("means"))
    first = F.get("means", 0)
    return held.select(image, "means", F.when(first > 0, (F.array_position("means", F.array_max("means")) - 1).cast("int")).alias("peak_channel"), F.when(first > 0, F.array_max("means") / first).alias("enhancement"))
