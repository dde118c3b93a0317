"""Joins by precedence, position, content, range, nearness and overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import cut


def one_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by order; combined before the shuffle, null keys are one key."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(*df.columns)


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False, how: str = "left") -> DataFrame:
    """df with the columns of the first (or last) row of table for each key; unmatched rows have nulls, or go where how is inner."""
    return df.join(one_of_each(table, keys, order, last), list(keys), how)


def assigned_split(df: DataFrame, key: str, splits: DataFrame, split: str = "split", precedence: Sequence[str] = ("val", "train")) -> DataFrame:
    """df with its split by key; a key in several gets the first of precedence, unknown keys get null."""
    rank = F.array_position(F.array(*[F.lit(x) for x in precedence]), F.col(split))
    best = splits.groupBy(key).agg(F.min_by(split, F.struct(F.when(rank > 0, rank).otherwise(len(precedence) + 1), split)).alias(split))
    return df.join(best, key, "left")


def by_pattern(df: DataFrame, column: str, pattern: str, table: DataFrame, table_column: str, table_pattern: str, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df joined to table where the groups of both patterns (joined by -) and the columns within are equal; the first match by order, else nulls."""
    derived = lambda c, p: F.when(F.col(c).rlike(p), F.array_join(F.slice(F.split(F.regexp_replace(c, f"^.*?{p}.*$", "$1\u0001$2"), "\u0001"), 1, 2), "-"))
    keyed = table.withColumn("_key", derived(table_column, table_pattern)).where("_key is not null")
    return lookup(df.withColumn("_key", derived(column, pattern)), keyed, [*within, "_key"], order).drop("_key")


def align_predictions(left: DataFrame, right: DataFrame, keys: Sequence[str], image: str, position: str, label: str, prob: str) -> DataFrame:
    """keys, image, occurrence, label, prob_a, prob_b: the predictions of two models for the same images.

    Within keys, lists that are equal in order are aligned by position, also where an image occurs more than once.
    Otherwise images must be unique on both sides and right must have every image of left; more images of right are
    left out. Anything else, or labels that differ, is an error that names the first keys concerned.
    """
    occurrence = F.row_number().over(Window.partitionBy(*keys, image).orderBy(position))
    a, b = (cut(d.select(*keys, image, label, prob, position).withColumn("occurrence", occurrence)) for d in (left, right))
    met = a.select(*keys, image, "occurrence", F.col(label).alias("label_a"), F.col(prob).alias("prob_a"), F.col(position).alias("pos_a")).join(
        b.select(*keys, image, "occurrence", F.col(label).alias("label_b"), F.col(prob).alias("prob_b"), F.col(position).alias("pos_b")), [*keys, image, "occurrence"], "full")
    # equal lists have the same image at every place, that is, equal ranks of the positions of each met pair
    for s in "ab":
        met = met.withColumn(f"rank_{s}", F.when(F.col(f"pos_{s}").isNotNull(), F.row_number().over(Window.partitionBy(*keys, F.col(f"pos_{s}").isNotNull()).orderBy(f"pos_{s}", image, "occurrence"))))
    met = cut(met)
    facts = met.groupBy(*keys).agg(
        F.bool_and(F.col("rank_a").eqNullSafe(F.col("rank_b"))).alias("equal"), F.max("occurrence").alias("times"),
        F.count_if(F.col("pos_b").isNull()).alias("missing"), F.count_if(F.col("label_a") != F.col("label_b")).alias("labels"), F.count("pos_a").alias("n"),
    ).where("n > 0")
    bad = facts.where("labels > 0 or (not equal and (times > 1 or missing > 0))").first()
    if bad is not None:
        what = "labels differ" if bad["labels"] else "lists differ and images are not unique" if bad["times"] > 1 else f"{bad['missing']} images are missing on the right"
        raise ValueError(f"{', '.join(str(bad[k]) for k in keys)}: {what}")
    return met.where("pos_a is not null").select(*keys, image, "occurrence", F.col("label_a").alias(label), "prob_a", "prob_b")


def verify_manifest(expected: DataFrame, actual: DataFrame) -> tuple[DataFrame, str]:
    """(path, status of each file; verdict) of two tables (path, digest).

    status is ok, changed, missing, or new for files that are not expected. Where every expected path is missing,
    contents decide: a file whose digest is found anywhere is moved. The verdict is OK, OK (by content) or MISMATCH.
    """
    e, a = expected.select("path", F.col("digest").alias("_e")), actual.select("path", F.col("digest").alias("_a"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "new").when(F.col("_e") != F.col("_a"), "changed").otherwise("ok")
    met = cut(e.join(a, "path", "full").select("path", status.alias("status"), F.col("_e").alias("digest")))
    n, ok, missing = met.agg(F.count_if(F.col("status") != "new"), F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "missing")).first()
    if not n or missing < n:
        return met.select("path", "status"), "OK" if ok == n else "MISMATCH"
    held = actual.select("digest").distinct().withColumn("_there", F.lit(True))
    moved = cut(met.join(held, "digest", "left").select("path", F.when((F.col("status") == "missing") & F.col("_there"), "moved").otherwise(F.col("status")).alias("status")))
    return moved, "MISMATCH" if moved.where("status = 'missing'").limit(1).count() else "OK (by content)"


def stage_of(rows: DataFrame, epoch: str, stages: DataFrame, stage: str, length: str, value: str) -> DataFrame:
    """rows with value of the stage whose range holds the epoch; the last stage goes on beyond its end.

    stages are a short list in order of stage, each length epochs long; their ranges follow one another from 0.
    """
    span = Window.orderBy(stage)
    end = F.sum(length).over(span)
    ranges = stages.select(F.col(value).alias(value), (end - F.col(length)).alias("_lo"), F.when(F.lead(stage).over(span).isNotNull(), end).alias("_hi"))
    inside = (F.col(epoch) >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col(epoch) < F.col("_hi")))
    return rows.join(F.broadcast(ranges), inside, "left").drop("_lo", "_hi")


def nearest_value(rows: DataFrame, value: str, table: DataFrame, table_value: str, within: Sequence[str], pick: Sequence[str]) -> DataFrame:
    """rows with the columns pick of the table row of the same within whose value is the nearest, the smaller value on ties.

    Both sides are merged in order, and each row sees the last table row before it and the first after it, so a
    group costs its size, not the product of both.
    """
    fields = [*pick, table_value]
    right = table.where(F.col(table_value).isNotNull()).select(*within, F.col(table_value).cast("double").alias("_v"), F.struct(*fields).alias("_r"), F.lit(None).cast(rows.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_l"))
    left = rows.select(*within, F.col(value).cast("double").alias("_v"), F.lit(None).cast(right.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))
    order = Window.partitionBy(*within).orderBy("_v", *[F.col(f"_r.{f}") for f in fields])
    both = right.unionByName(left)
    before = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("_b", before).withColumn("_a", after).where("_l is not null")
    gap = lambda s: F.abs(F.col(f"{s}.{table_value}").cast("double") - F.col("_v"))
    best = F.when(F.col("_a").isNull() | (gap("_b") <= gap("_a")), F.col("_b")).otherwise(F.col("_a"))
    return seen.withColumn("_best", best).select("_l.*", *[F.col(f"_best.{f}").alias(f if f not in rows.columns else f"{f}_near") for f in fields])


def greedy_match(overlaps: DataFrame, a: str, b: str, size: str, within: Sequence[str] = ()) -> DataFrame:
    """a, b, size of a one-to-one match: the largest overlap first, ties by a and b, ends that are taken go.

    A round takes every pair that is the best of both its ends, which is what taking them one by one gives; rounds
    end when none is left.
    """
    keys = list(within)
    left = cut(overlaps.select(*keys, a, b, size).where(F.col(size) > 0))
    taken = None
    order = [F.desc(size), F.col(a), F.col(b)]
    while left.limit(1).count():
        ranked = left.withColumn("_ra", F.row_number().over(Window.partitionBy(*keys, a).orderBy(*order))).withColumn("_rb", F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)))
        best = cut(ranked.where("_ra = 1 and _rb = 1").select(*keys, a, b, size))
        taken = best if taken is None else taken.union(best)
        left = cut(left.join(best.select(*keys, a), [*keys, a], "left_anti").join(best.select(*keys, b), [*keys, b], "left_anti"))
    return taken if taken is not None else left


def paired_by_name(a: DataFrame, b: DataFrame, path: str = "path") -> DataFrame:
    """name, path_a, path_b of files that two folders have under one name."""
    name = F.element_at(F.split(path, "/"), -1)
    return a.select(name.alias("name"), F.col(path).alias("path_a")).join(b.select(name.alias("name"), F.col(path).alias("path_b")), "name")


def claimed_and_observed(claimed: DataFrame, observed: DataFrame, key: str, facts: Sequence[str]) -> DataFrame:
    """key, fact, claimed, observed, status: ok, differs, not claimed or not observed for each fact of each claimed key."""
    long = lambda d, n: d.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).cast("double").alias(n)) for f in facts])).alias("x")).select(key, "x.*")
    met = long(claimed, "claimed").join(long(observed, "observed"), [key, "fact"], "left")
    status = F.when(F.col("claimed").isNull(), "not claimed").when(F.col("observed").isNull(), "not observed").when(F.col("claimed") == F.col("observed"), "ok").otherwise("differs")
    return met.withColumn("status", status)


def share_in_pairs(df: DataFrame, key: str, source: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """source, n, in_pairs, share: how many rows of each source are an end of some pair."""
    ends = pairs.select(F.col(a).alias(key)).union(pairs.select(F.col(b).alias(key))).distinct().withColumn("_in", F.lit(1))
    met = df.join(ends, key, "left").groupBy(source).agg(F.count("*").alias("n"), F.count("_in").alias("in_pairs"))
    return met.withColumn("share", F.col("in_pairs") / F.col("n"))
