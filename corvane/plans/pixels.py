"""Queries of pixel measures: an embedding is an image of 8 x 8 pixels. Their SQL is in texts."""

from pyspark.sql import functions as F

from corvane.operators import masks as M
from corvane.operators import pixels as P
from corvane.plans import texts
from corvane.sources.tables import table


def _px(spark, sf):
    return P.grid(table(spark, sf, "embeddings"), "vec_id", F.col("embedding"), 8)


def _labelled(spark, sf):
    return P.grid(table(spark, sf, "embeddings"), "vec_id", F.col("embedding"), 8, ["label"])


def _out(df, *columns, digits=6, **rounded):
    """image as vec_id, columns, and rounded ones under their new names."""
    return df.select(F.col("image").alias("vec_id"), *columns, *[F.round(c, digits).alias(n) for n, c in rounded.items()])


def px_quality(spark, sf):
    return _out(P.quality(_px(spark, sf)), brightness="brightness", contrast="contrast", low="low", high="high", spread="spread")


def px_entropy(spark, sf):
    return _out(P.entropy(P.levels_of(_px(spark, sf), -1.0, 1.0, 32)), entropy="entropy")


def px_laplacian(spark, sf):
    return _out(P.sharpness(_px(spark, sf)), sharpness="sharpness")


def px_otsu(spark, sf):
    return _out(P.otsu(P.levels_of(_px(spark, sf), -1.0, 1.0, 32)), "level")


def px_bbox(spark, sf):
    return _out(P.set_box(_px(spark, sf), F.col("v") > 0.15), "x0", "y0", "x1", "y1", "area", cx="cx", cy="cy")


def px_perimeter(spark, sf):
    edge = P.beside(_px(spark, sf), F.col("v") > 0).where("set and around < 4")
    return _out(edge.groupBy("image").agg(F.count("*").alias("edge_pixels")), "edge_pixels")


def px_mean_std_image(spark, sf):
    return P.mean_image(_labelled(spark, sf), ["label"]).select("label", (F.col("y") * 8 + F.col("x")).alias("i"), F.round("mean", 6).alias("mean_v"), F.round("std", 6).alias("std_v"))


def px_mip(spark, sf):
    return P.mean_image(_labelled(spark, sf), ["label"]).select("label", "y", "x", F.round("top", 6).alias("top"))


def px_column_profile(spark, sf):
    ends = P.column_profile(_px(spark, sf)).groupBy("image").agg(F.min("mean").alias("a"), F.max("mean").alias("b"))
    return _out(ends, darkest="a", brightest="b")


def px_tiles(spark, sf):
    return _out(P.tiles(_px(spark, sf), 4), "ty", "tx", digits=5, snr="snr")


def px_window(spark, sf):
    return _out(P.window_scaled(_px(spark, sf), 0.05, 0.95), (F.col("y") * 8 + F.col("x")).alias("i"), v="v")


def px_znorm(spark, sf):
    return _out(P.z_normed(_px(spark, sf)), (F.col("y") * 8 + F.col("x")).alias("i"), v="v")


def px_crop_pad(spark, sf):
    return _out(P.cropped(_px(spark, sf), 2, 2, 6, 6), "y", "x", v="v")


def px_noise(spark, sf):
    return _out(P.noise(_px(spark, sf)), sigma="sigma")


def px_blockiness(spark, sf):
    return _out(P.blockiness(_px(spark, sf), 4), blockiness="blockiness")


def px_block_mean(spark, sf):
    return _out(P.block_means(_px(spark, sf), 2), "y", "x", v="v")


def px_equalise(spark, sf):
    from corvane.operators.levels import distribution

    return _out(distribution(P.levels_of(_px(spark, sf), -1.0, 1.0, 32), "image", "level", "n"), "level", cdf="cdf")


def _pixels_of(runs):
    return runs.select(F.col("image").alias("vec_id"), "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def _runs(spark, sf, level):
    sizes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return M.mask_runs(table(spark, sf, "embeddings"), "vec_id", F.transform("embedding", lambda v: v.cast("double") > level), 8), sizes


def px_erosion(spark, sf):
    return _pixels_of(M.eroded(*_runs(spark, sf, -0.05)))


def px_dilation(spark, sf):
    return _pixels_of(M.dilated(*_runs(spark, sf, 0.15)))


def px_ring_contrast(spark, sf):
    return _out(P.ring_contrast(_px(spark, sf), F.col("v") > 0.15), digits=5, cnr="cnr")


def px_kinetic_curve(spark, sf):
    return _out(P.kinetic_curve(_px(spark, sf), F.col("y") % 4, F.col("x").between(2, 5)), "phase", mean_v="mean", peak="peak")


def px_volume_stats(spark, sf):
    out = P.volume_facts(_labelled(spark, sf), "label", F.col("v") > 0.15, 0.008)
    return out.select("label", "voxels", "slices", "x0", "x1", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "ml")])


def px_ssim_global(spark, sf):
    px = _px(spark, sf)
    return _out(P.whole_similarity(px, px.withColumn("image", F.col("image") - 1), 0.0001, 0.0009), ssim="ssim")


def px_slice_choice(spark, sf):
    return _out(P.central_lines(_px(spark, sf), F.col("v") > 0), "y")


def px_dual_panel(spark, sf):
    """Whether a dark column stands between brighter sides."""
    px = _px(spark, sf).withColumn("v", F.abs("v"))
    return _out(P.dual_panel(P.column_profile(px), 8, 0.08, 0.11), "dual_panel")


def px_speckle(spark, sf):
    return _out(P.speckle(P.tiles(_px(spark, sf), 2, 4), 5), snr="snr")


def px_window_positive(spark, sf):
    return _out(P.window_scaled(_px(spark, sf), 0.1, 0.9, True), "y", "x", v="v")


def px_znorm_inside(spark, sf):
    return _out(P.z_normed(_px(spark, sf), -0.1, 0.1), "y", "x", v="v")


def px_quality_range(spark, sf):
    out = P.quality(_px(spark, sf), -0.1, 0.1)
    return _out(out, snr="snr", spread_share="spread_share", clipped_low="clipped_low", clipped_high="clipped_high")


_FOUR = "(select vec_id, i // 8 as y, i % 8 as x, v::double as v from (select vec_id, unnest(range(0, 64)) as i, unnest(embedding) as v from embeddings))"
NEW = {
    "px_dual_panel": f"with m as (select vec_id, x, avg(abs(v)) as m from {_FOUR} group by all) select vec_id, coalesce(min(m) filter (x between 2 and 4) < 0.08, false) and coalesce(max(m) filter (x < 2) > 0.11, false) and coalesce(max(m) filter (x >= 5) > 0.11, false) as dual_panel from m group by vec_id",
    "px_speckle": f"with t as (select vec_id, avg(v) / nullif(stddev_pop(v), 0) as snr from {_FOUR} group by vec_id, y // 2, x // 2), r as (select vec_id, snr, row_number() over (partition by vec_id order by snr) - 1 as r, count(*) over (partition by vec_id) as n from t where snr is not null) select vec_id, round(case when any_value(n) >= 5 then median(snr) filter (r >= n // 2) end, 6) as snr from r group by vec_id",
    "px_window_positive": f"with e as (select vec_id, quantile_cont(v, 0.1) as a, quantile_cont(v, 0.9) as b from {_FOUR} where v > 0 group by vec_id) select p.vec_id, p.y::int as y, p.x::int as x, round(case when b > a then least(greatest((v - a) / (b - a), 0), 1) end, 6) as v from {_FOUR} p left join e on e.vec_id = p.vec_id",
    "px_znorm_inside": f"with e as (select vec_id, avg(v) as m, stddev_pop(v) as s from {_FOUR} where v > -0.1 and v < 0.1 group by vec_id) select p.vec_id, p.y::int as y, p.x::int as x, round((v - m) / nullif(s, 0), 6) as v from {_FOUR} p left join e on e.vec_id = p.vec_id",
    "px_quality_range": f"select vec_id, round(avg(v) / nullif(stddev_samp(v), 0), 6) as snr, round((max(v) - min(v)) / 0.2::double, 6) as spread_share, round(avg((v <= -0.1)::int), 6) as clipped_low, round(avg((v >= 0.1)::int), 6) as clipped_high from {_FOUR} group by vec_id",
}
QUERIES = {
    f.__name__: f
    for f in (
        px_quality, px_entropy, px_laplacian, px_otsu, px_bbox, px_perimeter, px_mean_std_image, px_mip, px_column_profile, px_tiles, px_window, px_znorm, px_crop_pad, px_noise, px_blockiness, px_block_mean, px_equalise,
        px_erosion, px_dilation, px_ring_contrast, px_kinetic_curve, px_volume_stats, px_ssim_global, px_slice_choice, px_dual_panel, px_speckle, px_window_positive, px_znorm_inside, px_quality_range,
    )
}
SQL = {name: NEW.get(name) or texts.SQL[name] for name in QUERIES}
