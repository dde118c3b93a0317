"""Classes of copies: what all pairs of their members amount to, without listing a pair.

A class is a set of rows that are copies of each other; links join classes whose members are near copies. A class of n
rows stands for n (n - 1) / 2 pairs, a link of classes of n and m rows for n m. Whether a pair leaks or its labels
conflict depends on few values of its ends, so pairs are counted as products of counts of those values; pairs within
one group are counted likewise and taken off. The work grows with rows and links, never with pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import components, cut

#: Columns of members besides key and class_id; those a table lacks are null (used: true).
FACTS = ("grp", "used", "label", "split", "fold")


def content_classes(df: DataFrame, key: str, content: Column) -> DataFrame:
    """df with class_id: the smallest key of all rows of equal content. Rows without content are classes of their own."""
    told = df.withColumn("_c", content)
    first = told.where("_c is not null").groupBy("_c").agg(F.min(key).alias("_first"))
    return told.join(first.withColumnRenamed("_c", "_d"), F.col("_c") == F.col("_d"), "left").withColumn("class_id", F.coalesce("_first", F.col(key))).drop("_c", "_d", "_first")


def _members(members: DataFrame) -> DataFrame:
    known = lambda f: F.col(f) if f in members.columns else F.lit(True) if f == "used" else F.lit(None).cast("string")
    return members.select("class_id", *[known(f).alias(f) for f in FACTS])


def _side(cells: DataFrame, end: str) -> DataFrame:
    return cells.select(*[F.col(c).alias(end if c == "class_id" else f"{c}_{end}") for c in cells.columns])


def _met(edges: DataFrame, cells: DataFrame, within: bool) -> DataFrame:
    """Each edge (a, b) with each cell of a beside each cell of b; within: of one group only."""
    both = edges.join(_side(cells, "a"), "a").join(_side(cells, "b"), "b")
    return both.where("grp_a = grp_b") if within else both


def _ordered(condition: Column) -> Column:
    """Pairs that meet the condition; in a class met with itself each is counted from both ends."""
    return F.coalesce(F.sum(F.when(condition, F.col("n_a") * F.col("n_b"))), F.lit(0))


def _leaks(edges: DataFrame, cells: DataFrame, within: bool) -> DataFrame:
    differs = lambda c: F.coalesce(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(False))
    return _met(edges, cells, within).groupBy("a", "b").agg(_ordered(differs("split")).alias("holdout"), _ordered(~differs("split") & differs("fold")).alias("kfold"))


def _conflicts(edges: DataFrame, cells: DataFrame, within: bool) -> DataFrame:
    return _met(edges, cells, within).groupBy("a", "b").agg(_ordered(F.col("label_a") != F.col("label_b")).alias("conflicts"))


def pair_counts(members: DataFrame, links: DataFrame | None = None, other_groups_only: bool = False) -> DataFrame:
    """a, b, pairs, same_group, conflicts, holdout, kfold: counts over all pairs of members of linked classes a < b, and,
    with a = b, of a class of two rows or more.

    members has key and class_id and some of FACTS; links has a and b, class ids. Pairs of one known group are
    same_group. conflicts: both labels known and different. Leaks are pairs of used rows that are not of one group:
    holdout if their splits are known and differ, else kfold if their folds do. other_groups_only leaves out pairs of
    one group, and edges that have no other. Few labels, splits and folds are taken for granted: their combinations
    meet within an edge. Empty tables and rows without links give no rows.
    """
    rows = cut(_members(members).groupBy("class_id", *FACTS).agg(F.count("*").alias("n")))
    sizes = rows.groupBy("class_id").agg(F.sum("n").alias("n"))
    edges = sizes.where("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    if links is not None:
        ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        edges = edges.union(ends.select(*[F.col(c).cast(dict(edges.dtypes)[c]) for c in ("a", "b")]))
    edges = cut(edges)
    own = F.col("a") == F.col("b")

    def summed(where: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
        """Cells by class and columns, and those by class, group and columns."""
        held = rows.where(where)
        return tuple(held.groupBy("class_id", *by, *columns).agg(F.sum("n").alias("n")) for by in ([], ["grp"]))

    def less(all_: DataFrame, same: DataFrame, names: list[str]) -> DataFrame:
        """What is counted over all pairs less what is counted within groups."""
        minus = same.select("a", "b", *[(-F.col(c)).alias(c) for c in names])
        return all_.select("a", "b", *names).unionByName(minus).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names])

    leaking, leaking_in = summed("used", ["split", "fold"])
    leaks = less(_leaks(edges, leaking, False), _leaks(edges, leaking_in, True), ["holdout", "kfold"])
    labelled, labelled_in = summed("label is not null", ["label"])
    conflicts = _conflicts(edges, labelled, False)
    if other_groups_only:
        conflicts = less(conflicts, _conflicts(edges, labelled_in, True), ["conflicts"])
    grouped = rows.where("grp is not null").groupBy("class_id", "grp").agg(F.sum("n").alias("n"))
    same = _met(edges, grouped, True).groupBy("a", "b").agg(F.sum(F.when(own, F.col("n_a") * (F.col("n_a") - 1)).otherwise(F.col("n_a") * F.col("n_b"))).alias("same_group"))
    out = edges.join(_side(sizes, "a"), "a").join(_side(sizes, "b"), "b")
    out = out.withColumn("pairs", F.when(own, F.col("n_a") * (F.col("n_a") - 1)).otherwise(F.col("n_a") * F.col("n_b")))
    for part in (same, conflicts, leaks):
        out = out.join(part, ["a", "b"], "left")
    half = lambda c: F.expr(f"coalesce({c}, 0) div if(a = b, 2, 1)").alias(c)
    out = out.select("a", "b", *[half(c) for c in ("pairs", "same_group", "conflicts", "holdout", "kfold")])
    if other_groups_only:
        out = out.withColumn("pairs", F.col("pairs") - F.col("same_group")).withColumn("same_group", F.lit(0).cast("long")).where("pairs > 0")
    return out


def member_leaks(members: DataFrame, key: str) -> DataFrame:
    """key, class_id, split, copies, leaks of every member: how many others its class has, and how many of them are in another
    split. Unknown splits differ from none.

    Members meet counts by class and split, never each other.
    """
    cells = cut(members.groupBy("class_id", "split").agg(F.count("*").alias("n")))
    sizes = cells.groupBy(F.col("class_id").alias("_c")).agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("split").isNotNull(), F.col("n"))), F.lit(0)).alias("known"))
    told = cells.join(sizes, F.col("class_id") == F.col("_c")).select("_c", F.col("split").alias("_s"), (F.col("all") - 1).alias("copies"), F.when(F.col("split").isNotNull(), F.col("known") - F.col("n")).otherwise(0).alias("leaks"))
    return members.join(told, (F.col("class_id") == F.col("_c")) & F.col("split").eqNullSafe(F.col("_s"))).select(key, "class_id", "split", "copies", "leaks")


def leaking_classes(counts: DataFrame) -> DataFrame:
    """The edges of pair_counts() over which some pair leaks."""
    return counts.where("holdout + kfold > 0")


def class_groups(counts: DataFrame) -> DataFrame:
    """class_id, root: classes of pair_counts() that edges lead to from each other, by the smallest of them."""
    held = cut(counts.select("a", "b"))
    linked = components(held, "a", "b").select(F.col("node").alias("class_id"), "root")
    alone = held.where("a = b").select(F.col("a").alias("class_id")).join(linked, "class_id", "left_anti")
    return linked.unionByName(alone.select("class_id", F.col("class_id").alias("root")))


def duplicate_totals(counts: DataFrame, members: DataFrame) -> DataFrame:
    """One row of what the edges of pair_counts() hold: confirmed_pairs, groups, images_in_groups, label_conflict_pairs,
    conflict_groups and split_leak_pairs."""
    counts = cut(counts)
    roots = cut(class_groups(counts))
    images = members.join(roots, "class_id").agg(F.count("*").alias("images_in_groups"), F.countDistinct("root").alias("groups"))
    conflicts = counts.where("conflicts > 0").join(roots, F.col("a") == F.col("class_id")).agg(F.countDistinct("root").alias("conflict_groups"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = counts.agg(none("pairs").alias("confirmed_pairs"), none("conflicts").alias("label_conflict_pairs"), none(F.col("holdout") + F.col("kfold")).alias("split_leak_pairs"))
    return sums.crossJoin(F.broadcast(images)).crossJoin(F.broadcast(conflicts)).select("confirmed_pairs", "groups", "images_in_groups", "label_conflict_pairs", "conflict_groups", "split_leak_pairs")
