"""Comparing models: intervals, fold means, out-of-fold pools, multi-class scores and stacking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scalar import ratio
from corvane.operators.evaluation import auc, bootstrap_auc_delta, class_metrics, confusion, delong
from corvane.operators.graph import cut
from corvane.operators.quantiles import quantiles
from corvane.operators.ranks import sums_before


def _two_sided(z: Column) -> Column:
    """The two-sided tail of the normal law, for tables of few rows."""

    def tail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return F.pandas_udf(tail, "double")(z)


def delong_p(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """delong() with p, the two-sided normal tail of z; 1 where the difference has no spread."""
    return delong(df, label, a, b).withColumn("p", _two_sided(F.coalesce(F.col("z"), F.lit(0.0))))


def interval(draws: DataFrame, columns: Sequence[str], level: float = 0.95) -> DataFrame:
    """One row: lower and upper percentile of each column of draws, interpolated."""
    tail = (1 - level) / 2
    return quantiles(draws, [], {f"{c}_{n}": (c, p) for c in columns for n, p in (("lower", tail), ("upper", 1 - tail))})


def group_bootstrap(df: DataFrame, group: str, label: str, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """One row: intervals of the AUCs of a and b and of their difference over draws of whole groups, and p_not_better,
    the share of draws in which a is no better than b."""
    draws = bootstrap_auc_delta(df, group, label, a, b, replicates, seed)
    return interval(draws, ["auc_a", "auc_b", "delta"]).crossJoin(F.broadcast(draws.agg(F.avg((F.col("delta") <= 0).cast("double")).alias("p_not_better"), F.count("*").alias("draws"))))


def _weighted_auc(ties: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, auc from _s, _p, _q: weights of both classes for each score."""
    below = F.coalesce(F.sum("_q").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = ties.withColumn("_won", F.col("_p") * (below + F.col("_q") / F.lit(2.0)))
    return won.groupBy(*by).agg(ratio(F.sum("_won"), F.sum("_p").cast("double") * F.sum("_q").cast("double")).alias("auc"))


def fold_mean_draws(df: DataFrame, fold: str, image: str, label: str, a: str, b: str, replicates: int, seed: int, shared: bool) -> DataFrame:
    """replicate, delta: mean over folds of AUC(a) - AUC(b), where images are drawn with replacement within each fold.

    shared takes one draw for all folds, for a test set that is the same in every fold. Draws in which some fold
    has one class alone are left out. An image that a fold has more than once is drawn once for each of its rows.
    """
    place = F.row_number().over(Window.partitionBy(fold).orderBy(image, label, a, b)) - 1
    rows = cut(df.select(fold, image, label, a, b).withColumn("_r", place.cast("long")))
    sizes = rows.groupBy(fold).agg(F.count("*").alias("_n"))
    slots = rows.select(fold, "_r").join(F.broadcast(sizes), fold).select(fold, "_r", "_n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.lit("all") if shared else F.col(fold).cast("string"), F.col("_r").cast("string"))
    index = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") % F.col("_n")
    weights = slots.select(fold, "replicate", index.alias("_r")).groupBy(fold, "replicate", "_r").agg(F.count("*").alias("_w"))
    drawn = rows.join(weights, [fold, "_r"]).select("replicate", fold, label, "_w", F.explode(F.array(F.struct(F.lit("a").alias("m"), F.col(a).cast("double").alias("s")), F.struct(F.lit("b").alias("m"), F.col(b).cast("double").alias("s")))).alias("x"))
    ties = drawn.groupBy("replicate", fold, F.col("x.m").alias("_m"), F.col("x.s").alias("_s")).agg(F.sum(F.when(F.col(label) == 1, F.col("_w")).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 0, F.col("_w")).otherwise(0)).alias("_q"))
    each = _weighted_auc(ties, ["replicate", fold, "_m"])
    signed = F.when(F.col("_m") == "a", F.col("auc")).otherwise(-F.col("auc"))
    n_folds = sizes.count()
    means = each.groupBy("replicate").agg((F.sum(signed) / n_folds).alias("delta"), F.count("auc").alias("_k"))
    return means.where(F.col("_k") == 2 * n_folds).select("replicate", "delta")


def fold_mean_delta(df: DataFrame, fold: str, image: str, label: str, a: str, b: str, replicates: int = 2000, seed: int = 0, shared: bool = False) -> DataFrame:
    """One row: observed fold-mean difference, its interval, and the two-sided bootstrap p."""
    seen = auc(df, a, label, [fold], "_a").select(fold, "_a").join(auc(df, b, label, [fold], "_b").select(fold, "_b"), fold).agg(F.avg(F.col("_a") - F.col("_b")).alias("delta_mean"))
    draws = cut(fold_mean_draws(df, fold, image, label, a, b, replicates, seed, shared))
    share = lambda c: F.avg(c.cast("double"))
    p = F.least(F.lit(1.0), 2 * F.least(share(F.col("delta") <= 0), share(F.col("delta") >= 0)))
    return seen.crossJoin(F.broadcast(interval(draws, ["delta"]))).crossJoin(F.broadcast(draws.agg(p.alias("p"), F.count("*").alias("draws"))))


def same_images(df: DataFrame, fold: str, image: str, position: str) -> bool:
    """Whether there are several folds and all have the same images in the same order."""
    ranked = df.select(fold, image, F.row_number().over(Window.partitionBy(fold).orderBy(position)).alias("_k"))
    folds = df.select(fold).distinct().count()
    places = ranked.groupBy("_k").agg(F.countDistinct(image).alias("images"), F.count("*").alias("n"))
    return folds > 1 and places.where((F.col("images") > 1) | (F.col("n") < folds)).limit(1).count() == 0


def compare_models(df: DataFrame, fold: str, image: str, position: str, label: str, a: str, b: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """One row of the comparison of two models: fold means, their difference with interval and p, and, unless all folds
    test the same images, the difference and its p over the pooled out-of-fold rows."""
    fixed = same_images(df, fold, image, position)
    means = auc(df, a, label, [fold], "_a").select(fold, "_a").join(auc(df, b, label, [fold], "_b").select(fold, "_b"), fold).agg(F.avg("_a").alias("auc_a_mean"), F.avg("_b").alias("auc_b_mean"))
    one = df.agg(F.countDistinct(image) if fixed else F.count("*")).first()[0]
    out = means.select(F.lit(one).alias("n"), F.lit(fixed).alias("fixed_split"), "*").crossJoin(F.broadcast(fold_mean_delta(df, fold, image, label, a, b, replicates, seed, fixed)))
    if fixed:
        return out.withColumn("pooled_delta", F.lit(None).cast("double")).withColumn("pooled_p", F.lit(None).cast("double"))
    pooled = delong_p(df, label, a, b).select((F.col("auc_a") - F.col("auc_b")).alias("pooled_delta"), F.col("p").alias("pooled_p"))
    return out.crossJoin(F.broadcast(pooled))


def threshold_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """by, n, auc, accuracy, sensitivity, specificity, precision, f1 with scores of at least threshold as positive."""
    by = list(by)
    conf = class_metrics(confusion(df.withColumn("_pred", (F.col(score) >= threshold).cast("int")), "_pred", label, by))
    found = auc(df, score, label, by)
    told = [*by, "n", "auc", "accuracy", "sensitivity", "specificity", "precision", "f1"]
    return (conf.join(found, by) if by else conf.crossJoin(F.broadcast(found))).select(*told)


def fold_table(df: DataFrame, fold: str, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """threshold_metrics() of each fold and, with fold pooled, of all out-of-fold rows together."""
    each = threshold_metrics(df, label, score, [fold], threshold).withColumn(fold, F.col(fold).cast("string"))
    return each.unionByName(threshold_metrics(df, label, score, (), threshold).withColumn(fold, F.lit("pooled")))


def class_rows(df: DataFrame, label: str, probs: Sequence[str]) -> DataFrame:
    """cls, y, p: a row for each class of each row, y telling whether it is its label."""
    return df.select(F.col(label).alias("_l"), F.posexplode(F.array(*[F.col(p).cast("double") for p in probs])).alias("cls", "p")).select("cls", (F.col("_l") == F.col("cls")).cast("int").alias("y"), "p")


def multiclass_auc(df: DataFrame, label: str, probs: Sequence[str]) -> DataFrame:
    """name, auc: of each class against the rest, their mean (macro; classes with one side only are left out) and of all decisions pooled (micro)."""
    rows = class_rows(df, label, probs)
    each = auc(rows, "p", "y", ["cls"]).select(F.col("cls").cast("string").alias("name"), "auc")
    return each.union(each.agg(F.lit("macro"), F.avg("auc"))).union(auc(rows, "p", "y").select(F.lit("micro"), "auc"))


def operating_points(df: DataFrame, label: str, score: str, by: Sequence[str] = (), level: float = 0.9) -> DataFrame:
    """by, sensitivity (at specificity level), specificity (at sensitivity level), read linearly off the curve.

    The curve starts at no positive decision and has a point for each score; null where a class is absent.
    """
    by = list(by)
    ties = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, (-F.col(score)).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    total = ties.groupBy(*by).agg(F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"))
    sums = sums_before(ties, "_s", ["_p", "_q"], by)
    held = sums.join(total, by) if by else sums.crossJoin(F.broadcast(total))
    x0, y0 = ratio(F.col("before__q"), F.col("_nq")), ratio(F.col("before__p"), F.col("_np"))
    x1, y1 = ratio(F.col("before__q") + F.col("_q"), F.col("_nq")), ratio(F.col("before__p") + F.col("_p"), F.col("_np"))
    seg = held.select(*by, x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    # the highest sensitivity at a false-positive rate, and the lowest false-positive rate at a sensitivity
    at_x = F.when(F.col("x1") <= 1 - level, F.col("y1")).when(F.col("x0") <= 1 - level, F.col("y0") + (F.lit(1 - level) - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    at_y = F.when(F.col("y0") >= level, F.col("x0")).when(F.col("y1") >= level, F.col("x0") + (F.lit(level) - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    return seg.groupBy(*by).agg(F.max(at_x).alias("sensitivity"), (1 - F.min(at_y)).alias("specificity"))


def mean_operating_points(df: DataFrame, label: str, probs: Sequence[str], level: float = 0.9) -> DataFrame:
    """One row: operating_points() of each class against the rest, averaged over the classes that have both sides."""
    return operating_points(class_rows(df, label, probs), "y", "p", ["cls"], level).agg(F.avg("sensitivity").alias("sensitivity"), F.avg("specificity").alias("specificity"))


def one_of_two_auc(df: DataFrame, label: str, probs: Sequence[str], negative: int = 1, positive: int = 2) -> DataFrame:
    """n, auc of the rows of two classes by the positive one's share of both probabilities."""
    rows = df.where(F.col(label).isin(negative, positive)).select((F.col(label) == positive).cast("int").alias("y"), ratio(F.col(probs[positive]), F.col(probs[negative]) + F.col(probs[positive])).alias("p"))
    return auc(rows, "p", "y")


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, taken from the largest one down."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, v: s + v))


def argmax(values: Column) -> Column:
    """Place (from 0) of the largest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def per_class_table(df: DataFrame, pred: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """by, cls, support, precision, recall, f1 of both classes; 0 where a ratio has no denominator."""
    c = confusion(df, pred, label, list(by))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    told = lambda k, hit, missed, false: F.struct(F.lit(k).alias("cls"), (hit + missed).alias("support"), zero(hit, hit + false).alias("precision"), zero(hit, hit + missed).alias("recall"), zero(2 * hit, 2 * hit + missed + false).alias("f1"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select(*by, F.explode(F.array(told(0, tn, fp, fn), told(1, tp, fn, fp))).alias("x")).select(*by, "x.*")


def pooled_confusion(folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """class_metrics() of tn, fp, fn, tp summed over folds."""
    return class_metrics(folds.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]))


def stacked(df: DataFrame, fold: str, label: str, features: Sequence[str], name: str = "stacked") -> DataFrame:
    """df with name: the probability of a logistic model on features that was fitted on the other folds.

    Folds are few; each is a job over the table. A fold whose other folds have one class alone gets null.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        rest, own = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        if rest.select(label).distinct().count() < 2:
            part = own.select(*df.columns, F.lit(None).cast("double").alias(name))
        else:
            model = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=100).fit(rest.withColumn(label, F.col(label).cast("double")))
            part = model.transform(own).select(*df.columns, F.get(vector_to_array("probability"), 1).alias(name))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.withColumn(name, F.lit(None).cast("double"))
