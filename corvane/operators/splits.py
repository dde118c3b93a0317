"""Hold-outs, folds and sampling weights: whole groups on one side, sizes exact, order from md5 keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.keys import order_key
from corvane.operators.ranks import ranked

ROWS = 1 << 18  # in one task, on average


def _held(fraction: float) -> Column:
    """max(1, floor(n f)) of the column total."""
    return F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(fraction))).cast("long")


def group_holdout(df: DataFrame, group: str, seed: int, fraction: float, name: str = "split") -> DataFrame:
    """Adds train / val: the last max(1, floor(n f)) groups in shuffled order are val."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    groups = ranked(df.select(F.col(group).alias("_g")).distinct().withColumn("_k", order_key(seed, "_g")), "_k", tie="_g")
    side = F.when(F.col("rank") >= F.col("total") - _held(fraction), "val").otherwise("train")
    return df.join(groups.select("_g", side.alias(name)), df[group].eqNullSafe(F.col("_g"))).drop("_g")


def stratified_holdout(df: DataFrame, key: str, label: str, seed: int, fraction: float, name: str = "split") -> DataFrame:
    """Adds train / val: in each label the last max(1, floor(n f)) rows in shuffled order are val."""
    rows = ranked(df.withColumn("_k", order_key(seed, key)), "_k", [label], key)
    return rows.withColumn(name, F.when(F.col("rank") >= F.col("total") - _held(fraction), "val").otherwise("train")).drop("_k", "rank", "total")


def group_folds(df: DataFrame, group: str, label: str, order: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Adds a fold 1..k to whole groups, dealt round robin within the label of each group's first row."""
    groups = df.groupBy(F.col(group).alias("_g")).agg(F.min_by(label, order).alias("_l")).withColumn("_k", order_key(seed, "_g"))
    dealt = ranked(groups, "_k", ["_l"], "_g").select("_g", (F.col("rank") % k + 1).cast("int").alias(name))
    return df.join(dealt, df[group].eqNullSafe(F.col("_g"))).drop("_g")


def group_kfold(df: DataFrame, group: str, label: str, order: str, k: int, seed: int, test_fold: int, holdout: float) -> DataFrame:
    """Adds train / val / test: one fold of group_folds is test, the rest is split by group_holdout."""
    folds = group_folds(df, group, label, order, k, seed, "_fold")
    test = folds.where(F.col("_fold") == test_fold).withColumn("split", F.lit("test"))
    rest = group_holdout(folds.where(F.col("_fold") != test_fold), group, seed, holdout)
    return rest.unionByName(test).drop("_fold")


def official_kfold(df: DataFrame, fold: str, group: str, test_fold: int, seed: int, holdout: float) -> DataFrame:
    """Adds train / val / test from a given fold column; a group with a row in the test fold is test throughout.

    val is the first max(1, floor(n f)) of the other groups in shuffled order.
    """
    tests = df.where(F.col(fold) == test_fold).select(F.col(group).alias("_t")).distinct()
    pool = df.join(tests, df[group] == F.col("_t"), "left_anti")
    groups = ranked(pool.select(F.col(group).alias("_g")).distinct().withColumn("_k", order_key(seed, "_g")), "_k", tie="_g")
    side = groups.select("_g", F.when(F.col("rank") < _held(holdout), "val").otherwise("train").alias("split"))
    rest = pool.join(side, pool[group].eqNullSafe(F.col("_g"))).drop("_g")
    return rest.unionByName(df.join(tests, df[group] == F.col("_t"), "left_semi").withColumn("split", F.lit("test")))


def fixed_test_kfold(df: DataFrame, is_test: Column, group: str, label: str, order: str, k: int, seed: int, fold: int) -> DataFrame:
    """Adds train / val / test: given test rows stay test; fold of the rest validates."""
    test = df.where(is_test).withColumn("split", F.lit("test"))
    rest = group_folds(df.where(~is_test), group, label, order, k, seed, "_fold")
    return rest.withColumn("split", F.when(F.col("_fold") == fold, "val").otherwise("train")).drop("_fold").unionByName(test)


def nested_three_way(df: DataFrame, group: str, seed: int, test: float, val: float) -> DataFrame:
    """Adds train / val / test: a group hold-out for test, then one of the rest, with the next seed, for val."""
    first = group_holdout(df, group, seed, test, "_first")
    rest = group_holdout(first.where("_first = 'train'"), group, seed + 1, val)
    return rest.unionByName(first.where("_first = 'val'").withColumn("split", F.lit("test"))).drop("_first")


def three_way_stratified(df: DataFrame, key: str, label: str, seed: int, val: float, test: float) -> DataFrame:
    """Adds val / test / train by rank within the label: val first, test next, sizes max(1, round half even)."""
    rows = ranked(df.withColumn("_k", order_key(seed, key)), "_k", [label], key)
    size = lambda f: F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(f)).cast("int"))
    split = F.when(F.col("rank") < size(val), "val").when(F.col("rank") < size(val) + size(test), "test").otherwise("train")
    return rows.withColumn("split", split).drop("_k", "rank", "total")


def block_groups(df: DataFrame, number: str, size: int, name: str = "block") -> DataFrame:
    """Adds the block of consecutive numbers (from 1) that a row falls in."""
    return df.withColumn(name, F.floor((F.col(number) - 1) / size).cast("long"))


def balanced_weights(df: DataFrame, branch: str, source: str, label: str, name: str = "weight") -> DataFrame:
    """Adds 1 / (branches * sources in the branch * labels in the source * rows of the label there).

    Counts come from one aggregation by branch, source and label; rows get them by a join, so no window holds a
    whole source.
    """
    n = df.groupBy(F.col(branch).alias("_b"), F.col(source).alias("_s"), F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    labels = n.groupBy(F.col("_b").alias("_b1"), F.col("_s").alias("_s1")).agg(F.count("*").alias("_labels"))
    sources = labels.groupBy(F.col("_b1").alias("_b2")).agg(F.count("*").alias("_sources"))
    branches = sources.agg(F.count("*").alias("_branches"))
    plan = n.join(labels, F.col("_b").eqNullSafe(F.col("_b1")) & F.col("_s").eqNullSafe(F.col("_s1"))).join(sources, F.col("_b").eqNullSafe(F.col("_b2"))).crossJoin(F.broadcast(branches))
    plan = plan.select("_b", "_s", "_l", (1.0 / (F.col("_branches") * F.col("_sources") * F.col("_labels") * F.col("_n"))).alias(name))
    return df.join(plan, df[branch].eqNullSafe(F.col("_b")) & df[source].eqNullSafe(F.col("_s")) & df[label].eqNullSafe(F.col("_l"))).drop("_b", "_s", "_l")


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """label, weight = n / (classes * count) for labels 0..classes-1; an absent class counts once."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    joined = all_.join(n, F.col("label") == F.col("l"), "left")
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return joined.crossJoin(F.broadcast(total)).select("label", (F.col("total") / (F.lit(float(classes)) * F.coalesce("n", F.lit(1)))).alias("weight"))


def sample_per(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """At most n rows for each value of by, in shuffled order. Spark applies the limit before the shuffle."""
    order = Window.partitionBy(*by).orderBy(order_key(seed, key), key)
    return df.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= n).drop("_at")


def samples_per(df: DataFrame, by: list[str], key: str, n: int, seeds: list[int], name: str = "epoch", shares: int = 16) -> DataFrame:
    """sample_per for each of seeds, with the place of the seed (from 0) as name.

    Rows travel without their hashes, and once for all seeds: first by shares of each value of by, so that a large one
    is not one task's, and then those that lead their share for a seed. Parts hold ROWS rows on average, however many there are.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))

    def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
        held = rows.repartition(parts, *keys)
        return held.withColumns({f"_at{i}": F.row_number().over(Window.partitionBy(*keys).orderBy(order_key(s, key), key)) for i, s in enumerate(seeds)})

    leads = F.array(*[F.when(F.col(f"_at{i}") <= n, F.lit(i)) for i in range(len(seeds))])
    first = placed(df.withColumn("_share", F.pmod(F.xxhash64(key), F.lit(shares))), [*by, "_share"])
    some = first.where(F.exists(leads, lambda x: x.isNotNull())).select(*df.columns)
    return placed(some, by).select(*df.columns, F.explode(F.array_compact(leads)).alias(name))


def overlapping_groups(df: DataFrame, group: str, split: str, used: str | None = None) -> DataFrame:
    """group, splits: groups with used rows in more than one split; empty for a sound protocol.

    Rows without a group or a split are in none, and with used only rows for which that is true count.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(split).isNotNull() & (F.col(used) if used else F.lit(True)))
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def row_holdout(df: DataFrame, key: str, seed: int, fraction: float, name: str = "split") -> DataFrame:
    """Adds train / val: the last max(1, floor(n * fraction)) rows by hash validate, whatever their labels."""
    rows = ranked(df.withColumn("_k", order_key(seed, key)), "_k", tie=key)
    return rows.withColumn(name, F.when(F.col("rank") >= F.col("total") - _held(fraction), "val").otherwise("train")).drop("_k", "rank", "total")


def patient_folds(df: DataFrame, group: str, label: str, n: int, seed: int, fold: int) -> DataFrame:
    """Adds fold (0 to n - 1, by groups, stratified by a group's largest label) and split for fold: that fold tests, the next one (in a circle) validates."""
    tops = df.groupBy(group).agg(F.max(label).alias("_top"))
    placed = ranked(tops.withColumn("_k", order_key(seed, group)), "_k", ["_top"], group).select(F.col(group).alias("_g"), (F.col("rank") % n).cast("int").alias("fold"))
    split = F.when(F.col("fold") == fold % n, "test").when(F.col("fold") == (fold + 1) % n, "val").otherwise("train")
    return df.join(placed, df[group].eqNullSafe(F.col("_g"))).drop("_g").withColumn("split", split)


def out_of_distribution(df: DataFrame, source: str, held: list, group: str, label: str, order: str, k: int, seed: int) -> DataFrame:
    """Adds part: ood for rows of the held sources, else the fold (1 to k) of their group; null sources are not held."""
    out = F.coalesce(F.col(source).isin(held), F.lit(False))
    rest = group_folds(df.where(~out), group, label, order, k, seed, "_fold").withColumn("part", F.col("_fold").cast("string")).drop("_fold")
    return rest.unionByName(df.where(out).withColumn("part", F.lit("ood")))


def held_fraction(fraction: float, source_is_small: bool, least: float = 0.2) -> float:
    """The hold-out's share: at least least where a source is small."""
    return max(fraction, least) if source_is_small else fraction


def fold_of_source(df: DataFrame, source: str, plans: dict[str, tuple[str, dict]]) -> DataFrame:
    """Each source under the split protocol that plans names for it, with its arguments; sources without a plan go.

    Protocols: group_kfold, official_kfold, fixed_test_kfold, group_holdout, stratified_holdout, row_holdout.
    """
    known = {f.__name__: f for f in (group_kfold, official_kfold, fixed_test_kfold, group_holdout, stratified_holdout, row_holdout)}
    parts = []
    for name, (protocol, arguments) in sorted(plans.items()):
        if protocol not in known:
            raise ValueError(f"unknown split protocol {protocol}")
        parts.append(known[protocol](df.where(F.col(source) == name), **arguments))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
