"""Evaluation statistics of predictions tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.keys import order_key
from corvane.functions.scalar import ratio
from corvane.operators.ranks import ranked, sums_before


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None, name: str = "auc") -> DataFrame:
    """Tie-aware ROC AUC for each value of by; null where a class is absent.

    Rows are first summed by score; sums of smaller scores come from ranges of them, so no task orders all scores.
    """
    by = by or []
    held = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    ties = held.groupBy(*by, F.col(score).alias("_s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_q"))
    wins = sums_before(ties, "_s", ["_q"], by).withColumn("_w", F.col("_p") * (F.col("before__q") + F.col("_q") / F.lit(2.0)))
    return wins.groupBy(*by).agg(F.sum(F.col("_p") + F.col("_q")).alias("n"), ratio(F.sum("_w"), F.sum("_p").cast("double") * F.sum("_q").cast("double")).alias(name))


def confusion(df: DataFrame, pred: str, label: str, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp for each value of by."""
    hit = lambda l, p: F.count_if((F.col(label) == l) & (F.col(pred) == p))
    return df.groupBy(*(by or [])).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def class_metrics(conf: DataFrame) -> DataFrame:
    """Adds accuracy, sensitivity, specificity (null when undefined), precision and F1 (0 when undefined)."""
    c = {k: F.col(k) for k in ("tn", "fp", "fn", "tp")}
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return conf.select(
        "*",
        ratio(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]).alias("accuracy"),
        ratio(c["tp"], c["tp"] + c["fn"]).alias("sensitivity"),
        ratio(c["tn"], c["tn"] + c["fp"]).alias("specificity"),
        zero(ratio(c["tp"], c["tp"] + c["fp"])).alias("precision"),
        zero(ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])).alias("f1"),
    )


def bias_verdict(false_positive_rate: Column, false_negative_rate: Column) -> Column:
    lean = F.when(false_positive_rate > false_negative_rate, "false_positive_leaning").when(false_negative_rate > false_positive_rate, "false_negative_leaning")
    return F.coalesce(lean, F.lit("balanced"))


def fold_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by, metric, mean, std: over folds, with the population deviation; nulls are left out."""
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    return rows.groupBy(*by, F.col("x.metric").alias("metric")).agg(F.avg("x.v").alias("mean"), F.stddev_pop("x.v").alias("std"))


def late_fusion(df: DataFrame, sample: str, present: str, weight: str, logit: str) -> DataFrame:
    """Softmax of the weights over the present branches of a sample, applied to their logits."""
    held = df.where(F.col(present))
    return held.groupBy(sample).agg((F.sum(F.exp(weight) * F.col(logit)) / F.sum(F.exp(weight))).alias("fused"))


def placements(df: DataFrame, score: str, label: str, name: str) -> DataFrame:
    """score, label, name: the share of the other class that a row of that score and class beats, ties as one half."""
    ties = df.groupBy(F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    sums = sums_before(ties, "_s", ["_p", "_q"]).crossJoin(F.broadcast(ties.agg(F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"))))
    both = sums.select("_s", ratio(F.col("before__q") + F.col("_q") / 2, F.col("_nq")).alias("_up"), ratio(F.col("_np") - F.col("before__p") - F.col("_p") / 2, F.col("_np")).alias("_down"))
    return both.select(F.col("_s").alias(score), F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("_up").alias("v")), F.struct(F.lit(0).alias("y"), F.col("_down").alias("v")))).alias("x")).select(score, F.col("x.y").alias(label), F.col("x.v").alias(name))


def delong(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """One row: auc_a, auc_b, variance of their difference, z. No spread gives z null, which reads as p = 1.

    Rows with a null label or score take no part. Placements are joined back by score, so ties cost one row.
    """
    held = df.where(F.col(label).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(label, F.col(a).alias("_a"), F.col(b).alias("_b"))
    rows = held.join(placements(held, "_a", label, "_va"), ["_a", label]).join(placements(held, "_b", label, "_vb"), ["_b", label])
    pos = lambda c: F.when(F.col(label) == 1, c)
    neg = lambda c: F.when(F.col(label) == 0, c)
    gap = F.col("_va") - F.col("_vb")
    out = rows.agg(F.avg(pos(F.col("_va"))).alias("auc_a"), F.avg(pos(F.col("_vb"))).alias("auc_b"), (F.var_samp(pos(gap)) / F.count(pos(gap)) + F.var_samp(neg(gap)) / F.count(neg(gap))).alias("variance"))
    return out.withColumn("z", F.when(F.col("variance") > 0, (F.col("auc_a") - F.col("auc_b")) / F.sqrt("variance")))


def bootstrap_auc_delta(df: DataFrame, group: str, label: str, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """replicate, auc_a, auc_b, delta: AUC of a less AUC of b where whole groups are drawn with replacement; one-class draws go.

    A draw is a hash of seed, replicate and number, modulo the number of groups; a group counts as often as it was
    drawn. Groups are ranked by hash; rows meet their replicates' weights by an equi-join on the group.
    """
    groups = ranked(df.select(F.col(group).alias("_g")).distinct().withColumn("_k", order_key(seed, "_g")), "_k", tie="_g").select("_g", F.col("rank").alias("_r"), F.col("total").alias("_n"))
    drawn = groups.select("_r", "_n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    index = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_r").cast("string"))), 1, 12), 16, 10).cast("long") % F.col("_n")
    weights = drawn.select("replicate", index.alias("_r")).groupBy("replicate", "_r").agg(F.count("*").alias("_w")).join(groups.select("_g", "_r"), "_r")
    facts = df.select(F.col(group).alias("_g"), F.col(label).alias("_y"), F.explode(F.array(F.struct(F.lit("a").alias("m"), F.col(a).cast("double").alias("s")), F.struct(F.lit("b").alias("m"), F.col(b).cast("double").alias("s")))).alias("_x"))
    small = facts.groupBy("_g", F.col("_x.m").alias("_m"), F.col("_x.s").alias("_s")).agg(F.count_if(F.col("_y") == 1).alias("_p"), F.count_if(F.col("_y") == 0).alias("_q"))
    ties = small.join(weights, "_g").groupBy("replicate", "_m", "_s").agg(F.sum(F.col("_p") * F.col("_w")).alias("_p"), F.sum(F.col("_q") * F.col("_w")).alias("_q"))
    below = F.coalesce(F.sum("_q").over(Window.partitionBy("replicate", "_m").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ties.withColumn("_won", F.col("_p") * (below + F.col("_q") / F.lit(2.0)))
    aucs = won.groupBy("replicate", "_m").agg(ratio(F.sum("_won"), F.sum("_p").cast("double") * F.sum("_q").cast("double")).alias("auc"))
    sides = aucs.groupBy("replicate").agg(F.max(F.when(F.col("_m") == "a", F.col("auc"))).alias("auc_a"), F.max(F.when(F.col("_m") == "b", F.col("auc"))).alias("auc_b"))
    return sides.select("replicate", "auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("delta")).where("delta is not null")
