"""Queries of masks, glyphs and channels, each with SQL of its own: an embedding is an image of 8 x 8 pixels."""

from pyspark.sql import functions as F

from corvane.operators import cases as C
from corvane.operators import masks as M
from corvane.sources.tables import table

LEVEL = 0.05  # a pixel above it is set


def _runs(spark, sf, level=LEVEL):
    return M.mask_runs(table(spark, sf, "embeddings"), "vec_id", F.transform("embedding", lambda v: v.cast("double") > level), 8)


def _sizes(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"))


def _left_half(spark, sf):
    return _sizes(spark, sf).select("image", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"), F.lit(0).alias("x0"), F.lit(3).alias("x1"))


def mask_components(spark, sf):
    """Components of each mask, in the order in which they begin."""
    out = M.component_table(M.labelled(_runs(spark, sf)))
    return out.select(F.col("image").alias("vec_id"), F.col("component").cast("long").alias("component"), "area", "top", "bottom", "first", "last")


def mask_components_diagonal(spark, sf):
    out = M.component_table(M.labelled(_runs(spark, sf, 0.12), True))
    return out.groupBy(F.col("image").alias("vec_id")).agg(F.count("*").alias("parts"), F.max("area").alias("largest"))


def mask_geometry(spark, sf):
    out = M.geometry(_runs(spark, sf), _sizes(spark, sf), _left_half(spark, sf))
    return out.select(F.col("image").alias("vec_id"), "area", "components", "edge", *[F.round(c, 9).alias(c) for c in ("area_share", "cx", "cy", "box_fill", "outside", "compactness")])


def mask_region(spark, sf):
    """Pixels of the largest component with holes filled."""
    kept = M.filled(M.largest_component(_runs(spark, sf)), _sizes(spark, sf))
    return M.area_of(kept).withColumnRenamed("image", "vec_id")


def mask_opened(spark, sf):
    """Runs of each mask opened by one step."""
    return M.opened(_runs(spark, sf, -0.1), _sizes(spark, sf)).withColumnRenamed("image", "vec_id")


def local_means(spark, sf):
    out = M.local_means(table(spark, sf, "embeddings"), "vec_id", F.col("embedding"), 8, 3)
    return out.select(F.col("image").alias("vec_id"), "y", "x", F.round("mean", 9).alias("mean"))


def bright_overlays(spark, sf):
    """Pixels above 0.1 and by 0.1 above the mean around them."""
    out = M.bright_overlays(table(spark, sf, "embeddings"), "vec_id", F.col("embedding"), 8, 3, 0.1, 0.1)
    return out.withColumnRenamed("image", "vec_id")


def text_lines(spark, sf):
    """Lines of glyphs among boxes whose places come from order lines."""
    li = table(spark, sf, "lineitem")
    x0, y0 = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 1500, (F.col("l_orderkey") % 40) * 30 + F.col("l_linenumber") % 3
    w, h = 2 + F.col("l_linenumber") * 2, 8 + (F.col("l_quantity") % 6).cast("long")
    boxes = li.select("l_suppkey", x0.alias("x0"), (x0 + w).alias("x1"), y0.alias("y0"), (y0 + h).alias("y1"), F.floor(w * h / 2).alias("area")).distinct()
    return M.text_lines(boxes, "l_suppkey")


def glyph_partners(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_quantity").cast("int").alias("h"), (F.col("l_linenumber") * 3).alias("w"))
    return M.paired_glyphs(li).withColumnRenamed("image", "l_orderkey")


def channel_summary(spark, sf):
    """Four channels of sixteen values."""
    e = table(spark, sf, "embeddings").select("vec_id", *[F.slice("embedding", 16 * k + 1, 16).alias(f"c{k}") for k in range(4)])
    out = M.channel_summary(e, "vec_id", [f"c{k}" for k in range(4)])
    return out.select("vec_id", "peak_channel", F.round("enhancement", 6).alias("enhancement"))


def lesion_rows(spark, sf):
    """Stretches of consecutive lines over a quantity of 15, an order a case; orders with a line twice give an error."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.col("l_quantity") - 15, F.lit(0)).alias("area"))
    return C.lesion_rows(li, "l_orderkey", "l_linenumber", "area").select("l_orderkey", "lesion", *[F.col(c).cast("int").alias(c) for c in ("first", "last", "peak")], F.round("total", 6).alias("total"), F.col("error").isNotNull().alias("bad"))


_PX = "px as (select vec_id, i // 8 as y, i % 8 as x, v::double as v from (select vec_id, unnest(range(0, 64)) as i, unnest(embedding) as v from embeddings))"
_BESIDE = "abs(a.y - b.y) + abs(a.x - b.x) = 1"
_AROUND = "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1"


def _labels(name: str, where: str, beside: str = _BESIDE) -> str:
    """name(vec_id, y, x, root): pixels with the first pixel that they reach; root is 8 y + x of it."""
    return (
        f"{name}_px as (select * from px where {where}), {name}_way as (select vec_id, 8 * y + x as p, 8 * y + x as q from {name}_px union select w.vec_id, w.p, 8 * b.y + b.x from {name}_way w join {name}_px a on a.vec_id = w.vec_id and 8 * a.y + a.x = w.q join {name}_px b on b.vec_id = a.vec_id and {beside}),"
        f" {name} as (select vec_id, p // 8 as y, p % 8 as x, min(q) as root from {name}_way group by vec_id, p)"
    )


_SET = f"v > {LEVEL}"
_TABLE = "select vec_id, root, count(*) as area, min(y)::int as top, max(y)::int as bottom, min(x)::int as first, max(x)::int as last from parts group by vec_id, root"
_EDGE = f"(select vec_id, count(*) as inner_n from (select a.vec_id, a.y, a.x from parts a join parts b on a.vec_id = b.vec_id and {_BESIDE} group by all having count(*) = 4) group by vec_id)"
_TRACE = "select vec_id, y::int as y, min(x)::int as x0, max(x)::int as x1 from (select *, x - row_number() over (partition by vec_id, y order by x) as g from {0}) group by vec_id, y, g"
_BOXES = "boxes as (select distinct l_suppkey, x0, x0 + w as x1, y0, y0 + h as y1, floor(w * h / 2) as area, w, h, y0 + h / 2.0::double as cy from (select l_suppkey, (l_partkey * 37 + l_linenumber * 11) % 1500 as x0, (l_orderkey % 40) * 30 + l_linenumber % 3 as y0, 2 + l_linenumber * 2 as w, 8 + (l_quantity % 6)::bigint as h from lineitem))"
_GLYPHS = "glyphs as (select *, row_number() over (partition by l_suppkey order by x0, y0, x1, y1) as k from boxes where h between 6 and 24 and w between 2 and 20 and area / (h * w)::double between 0.15 and 0.85)"
_FOLLOWS = "links as (select a.l_suppkey, a.k as a, b.k as b from glyphs a join glyphs b on a.l_suppkey = b.l_suppkey and a.k < b.k and b.x0 - a.x1 <= 1.2 * a.h and abs(a.cy - b.cy) <= 0.3 * a.h and abs(a.h - b.h) <= 0.4 * a.h)"

SQL = {
    "mask_components": f"with recursive {_PX}, {_labels('parts', _SET)} select vec_id, row_number() over (partition by vec_id order by root) - 1 as component, area, top, bottom, first, last from ({_TABLE})",
    "mask_components_diagonal": f"with recursive {_PX}, {_labels('parts', 'v > 0.12', _AROUND)} select vec_id, count(*) as parts, max(area) as largest from ({_TABLE}) group by vec_id",
    "mask_geometry": (
        f"with recursive {_PX}, {_labels('parts', _SET)} select p.vec_id, count(*) as area, count(distinct root) as components, count(*) - coalesce(any_value(inner_n), 0) as edge, round(count(*) / 64.0::double, 9) as area_share, round(avg(x) / 8, 9) as cx, round(avg(y) / 8, 9) as cy,"
        f" round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1))::double, 9) as box_fill, round(count(*) filter (x > 3) / count(*)::double, 9) as outside, round(power(count(*) - coalesce(any_value(inner_n), 0), 2) / (4 * pi() * count(*)), 9) as compactness from parts p left join {_EDGE} e on e.vec_id = p.vec_id group by p.vec_id"
    ),
    "mask_region": (
        f"with recursive {_PX}, {_labels('parts', _SET)}, best as (select vec_id, arg_min(root, (-area, root)) as root from ({_TABLE}) group by vec_id), kept as (select p.* from parts p join best b on p.vec_id = b.vec_id and p.root = b.root),"
        f" rest_px as (select x.vec_id, x.y, x.x from px x anti join kept k on x.vec_id = k.vec_id and x.y = k.y and x.x = k.x), open as (select vec_id, y, x from rest_px where y in (0, 7) or x in (0, 7) union select b.vec_id, b.y, b.x from open a join rest_px b on a.vec_id = b.vec_id and {_BESIDE})"
        " select e.vec_id, 64 - coalesce(n, 0) as area from (select distinct vec_id from kept) e left join (select vec_id, count(*) as n from open group by vec_id) o on o.vec_id = e.vec_id"
    ),
    "mask_opened": (
        f"with {_PX}, m as (select * from px where v > -0.1), inner_px as (select a.vec_id, a.y, a.x from m a join m b on a.vec_id = b.vec_id and {_BESIDE} group by all having count(*) = 4),"
        f" grown as (select vec_id, y, x from inner_px union select b.vec_id, b.y, b.x from inner_px a join px b on a.vec_id = b.vec_id and {_BESIDE}) {_TRACE.format('grown')}"
    ),
    "local_means": f"with {_PX} select a.vec_id, a.y::int as y, a.x::int as x, round(sum(b.v) / 9, 9) as mean from px a cross join range(-1, 2) d(dy) cross join range(-1, 2) e(dx) join px b on b.vec_id = a.vec_id and b.y = least(greatest(a.y + dy, 0), 7) and b.x = least(greatest(a.x + dx, 0), 7) group by a.vec_id, a.y, a.x",
    "bright_overlays": f"with {_PX}, means as (select a.vec_id, a.y, a.x, a.v, sum(b.v) / 9 as mean from px a cross join range(-1, 2) d(dy) cross join range(-1, 2) e(dx) join px b on b.vec_id = a.vec_id and b.y = least(greatest(a.y + dy, 0), 7) and b.x = least(greatest(a.x + dx, 0), 7) group by all), held as (select * from means where v > 0.1 and v > mean + 0.1) {_TRACE.format('held')}",
    "text_lines": f"with recursive {_BOXES}, {_GLYPHS}, {_FOLLOWS}, ways as (select * from links union all select l_suppkey, b, a from links), reach as (select distinct l_suppkey, a, a as r from ways union select r.l_suppkey, w.b, r.r from reach r join ways w on w.l_suppkey = r.l_suppkey and w.a = r.a), roots as (select l_suppkey, a, min(r) as root from reach group by l_suppkey, a) select l_suppkey, count(*) as lines from (select l_suppkey, root from roots group by l_suppkey, root having count(*) >= 3) group by l_suppkey",
    "glyph_partners": "with g as (select l_orderkey, l_quantity::int as h, l_linenumber * 3 as w, row_number() over () as k from lineitem) select l_orderkey, count(*) as calipers from g a where exists (select 1 from g b where b.l_orderkey = a.l_orderkey and b.k <> a.k and abs(a.h - b.h) <= 4 and abs(a.w - b.w) <= 4) group by l_orderkey",
    "channel_summary": "with m as (select vec_id, [list_sum(embedding[16 * k + 1:16 * k + 16]::double[]) / 16 for k in range(0, 4)] as means from embeddings) select vec_id, case when means[1] > 0 then list_position(means, list_max(means)) - 1 end as peak_channel, round(case when means[1] > 0 then list_max(means) / means[1] end, 6) as enhancement from m",
    "lesion_rows": (
        "with bad as (select distinct l_orderkey from lineitem group by l_orderkey, l_linenumber having count(*) > 1), r as (select l_orderkey, l_linenumber as z, greatest(l_quantity - 15, 0) as n from lineitem l anti join bad b on l.l_orderkey = b.l_orderkey),"
        " g as (select *, z - row_number() over (partition by l_orderkey order by z) as k from r where n > 0), t as (select l_orderkey, min(z) as first, max(z) as last, arg_min(z, (-n, z)) as peak, round(sum(n)::double, 6) as total from g group by l_orderkey, k)"
        " select l_orderkey, (row_number() over (partition by l_orderkey order by first))::int as lesion, first, last, peak, total, false as bad from t union all select l_orderkey, null, null, null, null, null, true from bad"
    ),
}
QUERIES = {f.__name__: f for f in (mask_components, mask_components_diagonal, mask_geometry, mask_region, mask_opened, local_means, bright_overlays, text_lines, glyph_partners, channel_summary, lesion_rows)}
