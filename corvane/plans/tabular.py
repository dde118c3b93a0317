"""Queries of catalogues, joins, windows and scores over tables. Their SQL is in texts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import answers, projections
from corvane.functions.scalar import ratio
from corvane.operators import comparison, evaluation, matching, outliers, quantiles, series, splits, summary
from corvane.plans import texts
from corvane.sources import adapters
from corvane.sources.tables import table


def _labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


def catalogue_summary(spark, sf):
    labels = table(spark, sf, "labels").withColumn("there", F.lit(1))
    rows = table(spark, sf, "documents").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.count("there").alias("labelled"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"),
        F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"),
    )


def claimed_vs_verified(spark, sf):
    """What a registry claims of each source, fifty rows, against what is there."""
    seen = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    met = matching.claimed_and_observed(seen.select("source", F.lit(50).alias("n")), seen, "source", ["n"])
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return met.select("source", F.col("claimed").cast("int").alias("claimed"), whole("observed").alias("observed"), (whole("observed") - F.col("claimed").cast("long")).alias("difference"))


def group_split_conflicts(spark, sf):
    return splits.overlapping_groups(table(spark, sf, "orders"), "o_custkey", "o_orderstatus")


def images_per_group(spark, sf):
    out = summary.group_sizes(table(spark, sf, "orders"), "o_custkey")
    return out.select("least", F.col("middle").cast("double").alias("mid"), "most", F.col("groups").alias("grps"))


def centre_pivot(spark, sf):
    out = summary.label_table(_labelled(spark, sf), "source", "quality", {"bad": 0, "good": 1}, ("bad", "good"), ["n_chars"])
    return out.select("source", "bad", "good", "bad_share", F.col("n_chars_median").alias("median_chars"))


def report_quality(spark, sf):
    e = table(spark, sf, "events")
    out = quantiles.with_quantiles(e.groupBy("event_type").agg(F.count("*").alias("n")), e, ["event_type"], {"q25": ("value", 0.25), "q50": ("value", 0.5), "q75": ("value", 0.75)})
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


def manifest_rollup(spark, sf):
    out = summary.manifest_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_orderkey")
    return out.select("l_returnflag", "l_linestatus", F.col("lesions").alias("items"), "slices", F.col("groups").alias("orders_n"))


def macro_facts(spark, sf):
    out = summary.facts(table(spark, sf, "orders"), {"orders": F.count("*"), "share_large": F.avg((F.col("o_totalprice") > 200000).cast("double")), "max_total": F.max("o_totalprice")})
    return out.withColumn("value", F.when(F.col("name") == "share_large", F.round("value", 9)).otherwise(F.col("value")))


def slice_patient_rollup(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return summary.rollup_scores(rows, "o_custkey", "o_orderkey", "l_discount", "label").select("o_custkey", F.round("l_discount", 6).alias("max_score"), "label")


def class_rate_per_group(spark, sf):
    o = table(spark, sf, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return summary.group_rate(o, "o_custkey", "label").select(F.col("groups").alias("grps"), "positive", F.round("rate", 9).alias("rate"))


def flag_rates(spark, sf):
    e = table(spark, sf, "events").withColumn("over_100", F.col("value") > 100).withColumn("under_10", F.col("value") < 10)
    long = summary.flag_percent(e, "event_type", ["over_100", "under_10"])
    return long.groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("flag") == f, F.col("percent"))), 6).alias(f) for f in ("over_100", "under_10")])


def size_totals(spark, sf):
    return summary.size_totals(table(spark, sf, "documents"), ["source"], "n_chars").select("source", "total", "files")


def hist_by_label(spark, sf):
    return _labelled(spark, sf).groupBy("quality", F.floor(F.col("n_chars") / 500).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def split_code_mode(spark, sf):
    coded = summary.named_splits(table(spark, sf, "orders"), "o_orderpriority", {})
    return coded.groupBy(F.col("o_orderpriority").alias("split_code"), F.coalesce("split", F.lit("other")).alias("split")).agg(F.count("*").alias("n"))


def pooled_mean(spark, sf):
    users = table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return summary.pooled_mean(users, "s", "n").select(F.round("mean", 9).alias("mean_value"))


# ---------------------------------------------------------------- projections and joins


def onehot_label(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("b"), (F.col("c_acctbal") < 0).alias("d"), (F.col("c_acctbal") > 5000).alias("r"))
    return c.select("c_custkey", projections.first_flagged([("b", "building"), ("d", "debt"), ("r", "rich")], "normal").alias("label"))


def composite_key_first(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return matching.one_of_each(li, ["l_orderkey", "l_partkey", "l_suppkey"], ["l_linenumber", "l_quantity"])


def composite_key_last(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_quantity", (-F.col("l_linenumber")).alias("back"), "l_partkey")
    return matching.lookup(table(spark, sf, "orders").select("o_orderkey"), li, ["o_orderkey"], ["back", "l_partkey", "l_suppkey", "l_quantity"], how="inner").select("o_orderkey", "l_suppkey", "l_quantity")


def keep_first_per_key(spark, sf):
    return matching.one_of_each(table(spark, sf, "events").select("event_id", "user_id", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


def latest_state(spark, sf):
    return matching.one_of_each(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], last=True).drop("ts")


def endpoint_union(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("endpoint")).union(li.select("l_suppkey")).distinct()


def exclusion_list(spark, sf):
    return projections.without(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", table(spark, sf, "labels").where("toxic = 1"))


def label_lookup(spark, sf):
    return matching.lookup(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], ["quality"])


def answer_parsing(spark, sf):
    """What a turn of a conversation answers, with ordinary words of two languages for yes and no."""
    return table(spark, sf, "conversations").select("conv_id", "turn", answers.parsed_answer(F.col("text"), ["the"], ["der"]).alias("answer"))


def inventory_status(spark, sf):
    state = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linestatus").alias("status"))
    return table(spark, sf, "part").select("p_partkey").join(state, "p_partkey", "left").select("p_partkey", F.coalesce("status", F.lit("pending")).alias("status"))


def pair_list_membership(spark, sf):
    pairs = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    return matching.share_in_pairs(table(spark, sf, "documents"), "doc_id", "source", pairs, "a", "b").withColumn("share", F.round("share", 9))


def stage_lookup(spark, sf):
    stages = spark.createDataFrame([(0, 3, "head"), (1, 10, "top"), (2, 27, "all")], "stage_no int, epochs int, stage string")
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("epoch")).distinct()
    return matching.stage_of(rows, "epoch", stages, "stage_no", "epochs", "stage").select("epoch", F.coalesce("stage", F.lit("all")).alias("stage"))


def clinical_unpivot(spark, sf):
    """Two columns of a part as rows of its sides; small values are no finding."""
    p = table(spark, sf, "part").select("p_partkey", F.lit("L").alias("sa"), F.col("p_size").alias("va"), F.lit("R").alias("sb"), F.floor("p_retailprice").cast("int").alias("vb"), F.lit(1).alias("ok"))
    p = p.withColumn("oka", (F.col("va") > 5).cast("int")).withColumn("okb", (F.col("vb") > 5).cast("int"))
    return adapters.unpivoted(p, ["p_partkey"], [{"side": "sa", "v": "va", "ok": "oka"}, {"side": "sb", "v": "vb", "ok": "okb"}], "ok", [1]).select("p_partkey", "side", "v")


def manifest_union(spark, sf):
    part = lambda name, key: table(spark, sf, name).select(F.col(key).alias("id"), F.lit(name).alias("source"))
    rows = part("orders", "o_orderkey").unionByName(part("documents", "doc_id")).unionByName(part("embeddings", "vec_id"))
    kinds = spark.createDataFrame([("orders", "table"), ("documents", "text"), ("embeddings", "vector")], "source string, modality string")
    return adapters.with_modality(rows, "source", kinds).select("id", "source", "modality")


def id_overlap(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id")).agg(F.count("*").alias("shared"))


# ---------------------------------------------------------------- windows


def log_durations(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    gap = F.lead("t").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("t")
    return e.select("event_id", "user_id", gap.alias("epoch_gap")).where("epoch_gap is not null")


def early_stop_replay(spark, sf):
    rows = series.with_patience(table(spark, sf, "events"), ["user_id"], "event_id", "value")
    return rows.select("user_id", "event_id", "best", F.col("improved").cast("int").alias("improved"))


def running_patience(spark, sf):
    return series.with_patience(table(spark, sf, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", F.col("stale").cast("long").alias("stale"))


def best_epoch(spark, sf):
    return series.best_epochs(table(spark, sf, "events"), ["user_id"], "event_id", {"value": True}).select("user_id", F.col("best_value").alias("best_event"))


def top_outliers(spark, sf):
    """The 36 farthest events of each type; deviations come from sums, and a task keeps 36 of a type."""
    e = table(spark, sf, "events").select("event_id", "event_type", outliers.known("value").alias("v"))
    facts = e.groupBy(F.col("event_type").alias("t")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = e.join(facts, F.col("event_type").eqNullSafe(F.col("t"))).withColumn("z", ratio(F.col("v") - F.col("m"), F.col("s")))
    order = Window.partitionBy("event_type").orderBy(F.abs("z").desc(), "event_id")
    return z.withColumn("r", F.row_number().over(order)).where("r <= 36").select("event_id", "event_type", F.round("z", 6).alias("z"))


def errors_per_source(spark, sf):
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return _labelled(spark, sf).where("quality = 0").withColumn("r", F.row_number().over(order)).where("r <= 3").select("doc_id", "source")


def most_confident_error(spark, sf):
    rows = _labelled(spark, sf).withColumn("prob", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)))
    return rows.where("quality = 0").groupBy("source").agg(F.max("prob").alias("confidence"))


def curve_washout(spark, sf):
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    v = F.col("l_extendedprice")
    out = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max(v).alias("peak"), F.min_by(v, key).alias("first_v"), F.max_by(v, key).alias("last_v"))
    return out.where("n >= 2").drop("n")


def side_agreement(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    open_line, done = F.col("l_linestatus") == "O", F.col("o_orderstatus") == "F"
    same = (open_line & ~done) | ((F.col("l_linestatus") == "F") & (F.col("o_orderstatus") != "O"))
    return both.agg(F.round(F.avg(same.cast("double")), 9).alias("share"))


# ---------------------------------------------------------------- scores, joins and boxes


def ovr_auc(spark, sf):
    e = table(spark, sf, "embeddings").select("label", *[F.get("embedding", k).alias(f"p{k}") for k in range(10)])
    rows = comparison.class_rows(e, "label", [f"p{k}" for k in range(10)])
    return evaluation.auc(rows, "p", "y", ["cls"]).select("cls", F.round("auc", 9).alias("auc"))


def sensitivity_at_specificity(spark, sf):
    out = comparison.operating_points(_labelled(spark, sf), "quality", "n_chars", ["source"])
    return out.where("sensitivity is not null").select("source", F.round("sensitivity", 9).alias("sensitivity"))


def manifest_verification(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.md5("o_orderstatus").alias("digest"))
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.md5(F.max("l_linestatus")).alias("digest"))
    return matching.verify_manifest(e, a)[0]


def nearest_slice(spark, sf):
    """The order line of each part whose quantity is the nearest to its size."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("p_partkey") == F.col("l_partkey"))
    gap = F.abs(F.col("l_quantity") - F.col("p_size"))
    best = F.min_by(F.struct("l_orderkey", "l_linenumber", gap.alias("gap")), F.struct(gap, "l_orderkey", "l_linenumber", "l_suppkey"))
    return li.groupBy("p_partkey").agg(best.alias("x")).select("p_partkey", "x.*")


def phase_slice_grid(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return series.phase_grid(li, "l_orderkey", "l_returnflag", "at").select("l_orderkey", "l_linenumber", "l_partkey", F.col("phase_no").alias("phase"), "slice_no")


def priority_label(spark, sf):
    li = table(spark, sf, "lineitem")
    named = adapters.label_by_priority(li, "l_orderkey", "l_returnflag", [("R", "malignant"), ("A", "benign")], "normal", "-")
    boxes = li.groupBy("l_orderkey").agg(F.count("*").alias("findings"), F.min(F.col("l_quantity") - F.col("l_linenumber")).alias("x0"), F.max(F.col("l_quantity") + F.col("l_linenumber")).alias("x1"))
    return named.select("l_orderkey", F.col("label_name").alias("label")).join(boxes, "l_orderkey")


def majority_baseline(spark, sf):
    n = _labelled(spark, sf).groupBy("source", "quality").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.round(ratio(F.max("n"), F.sum("n")), 9).alias("chance"))


def evenly_spaced(spark, sf):
    out = series.evenly_spaced(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 4)
    return out.select("user_id", F.col("place").alias("k"), "event_id")


def cross_entropy_by_source(spark, sf):
    p = 1 / (1 + F.exp(-F.col("n_chars") / 4000.0))
    rows = _labelled(spark, sf).withColumn("loss", -F.log(F.when(F.col("quality") == 1, p).otherwise(1 - p)))
    return rows.groupBy("source").agg(F.round(F.avg("loss"), 9).alias("loss"))


def box_pad_mirror(spark, sf):
    """Boxes 50 wide in an image of 600, padded by 10 and mirrored left to right."""
    whole = lambda c: c.cast("int")
    p = table(spark, sf, "part").select("p_partkey", F.struct(whole(F.col("p_size") * 10).alias("x0"), F.lit(0).alias("y0"), whole(F.col("p_size") * 10 + 50).alias("x1"), F.lit(50).alias("y1")).alias("box")).where("box.x1 <= 600")
    moved = adapters.padded_box(F.col("box"), 10, 0, F.lit(600), F.lit(600), F.lit(True))
    return p.select("p_partkey", moved.alias("b")).select("p_partkey", "b.x0", "b.x1")


QUERIES = {
    f.__name__: f
    for f in (
        catalogue_summary, claimed_vs_verified, group_split_conflicts, images_per_group, centre_pivot, report_quality, manifest_rollup, macro_facts, slice_patient_rollup, class_rate_per_group, flag_rates, size_totals,
        hist_by_label, split_code_mode, pooled_mean, onehot_label, composite_key_first, composite_key_last, keep_first_per_key, latest_state, endpoint_union, exclusion_list, label_lookup, answer_parsing, inventory_status,
        pair_list_membership, stage_lookup, clinical_unpivot, manifest_union, id_overlap, log_durations, early_stop_replay, running_patience, best_epoch, top_outliers, errors_per_source, most_confident_error, curve_washout,
        side_agreement, ovr_auc, sensitivity_at_specificity, manifest_verification, nearest_slice, phase_slice_grid, priority_label, majority_baseline, evenly_spaced, cross_entropy_by_source, box_pad_mirror,
    )
}
SQL = {name: texts.SQL[name] for name in QUERIES}
