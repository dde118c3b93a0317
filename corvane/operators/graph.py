"""Duplicate groups as connected components, and what follows from them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_own: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names and read back.

    Where that is unset, a session whose driver does all the work gets a temporary folder; on a cluster it is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="corvane-"))
        folder = _own[0]
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node reached. Labels spread by minimum, two hops a round, until none changes."""
    edges = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = cut(edges.union(edges.select("b", "a")).distinct())
    roots = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        spread = edges.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        step = roots.join(spread, F.col("node") == F.col("a")).select("node", F.least("root", "m").alias("root"))
        jump = step.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = cut(step.join(jump, F.col("root") == F.col("n2"), "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root")))
        moved = new.join(roots.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        roots = new
        if not moved:
            return roots


def _rooted(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, node, root of all ends of edges within groups: labels spread by minimum, all groups in step."""
    g, v = np.concatenate([group, group]), np.concatenate([a, b])
    order = np.lexsort((v, g))
    new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (v[order][1:] != v[order][:-1])])
    at = np.empty(len(g), np.int64)
    at[order] = np.cumsum(new) - 1
    ends = np.stack([at[: len(a)], at[len(a) :]])
    root = np.arange(int(new.sum()))
    while True:
        own = root[ends]
        least = own.min(axis=0)
        if (own == least).all():
            break
        np.minimum.at(root, own[0], least)
        np.minimum.at(root, own[1], least)
        while (root[root] != root).any():
            root = root[root]
    node = v[order][new]
    return g[order][new], node, node[root]


def _rooted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def solved(table: pa.Table, codes: np.ndarray, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            group, node, root = _rooted(codes, table.column("a").to_numpy(), table.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(group)), pa.array(node), pa.array(root)], ["group", "node", "root"])

    def encoded(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, pa.Array]:
        table = pa.Table.from_batches(parts).combine_chunks()
        told = table.column("group").combine_chunks().dictionary_encode("encode")
        return table, told.indices.to_numpy(), told.dictionary

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.column("group")[0].as_py() == batch.column("group")[-1].as_py() == held[0].column("group")[0].as_py():
            continue  # a group longer than a batch
        table, codes, keys = encoded(held)
        whole = int(np.flatnonzero(codes != codes[-1])[-1]) + 1
        yield from solved(table.slice(0, whole), codes[:whole], keys)
        held = table.slice(whole).to_batches()
    if held:
        yield from solved(*encoded(held))


def components_within(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, node, root: components() of pairs(group, a, b) whose ends, whole numbers, lie in one group.

    Groups meet in one shuffle and are solved many at once, so there are no rounds over the whole table; a task holds
    a batch of groups, and a group is held whole.
    """
    edges = pairs.select(F.col(group).alias("group"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    kind = dict(edges.dtypes)["group"]
    return edges.repartition("group").sortWithinPartitions("group").mapInArrow(_rooted_batches, f"`group` {kind}, node long, root long")


def copy_pairs(df: DataFrame, key: str, content: str) -> DataFrame:
    """first, key: each later copy of a content with the smallest key that has it; no pairs among copies."""
    digest = df.select(F.col(key).alias("key"), F.sha2(content, 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    return digest.join(first, "digest").where("key <> first").select("first", "key")


def attach_groups(df: DataFrame, key: str, pairs: DataFrame, a: str, b: str, name: str = "dup_group") -> DataFrame:
    """df with the root of each row's group; rows in no pair are their own group."""
    roots = components(pairs, a, b)
    return df.join(roots, df[key] == roots["node"], "left").withColumn(name, F.coalesce("root", df[key])).drop("node", "root")


def resolved_subset(df: DataFrame, key: str, group: str, label: str) -> DataFrame:
    """One row (smallest key) of each group whose labels agree; groups in conflict go whole. Null labels agree."""
    facts = df.groupBy(F.col(group).alias("_g")).agg(F.min(key).alias("_keep"), F.countDistinct(label).alias("_labels"))
    return df.join(facts.where("_labels <= 1"), df[key] == F.col("_keep")).drop("_g", "_keep", "_labels")


def split_leakage(pairs: DataFrame, facts: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Pairs whose ends are used, of different groups, and in different splits or folds.

    facts has key, used, grp, split and fold. Nulls never differ; holdout_split wins over kfold.
    """
    side = lambda s: facts.select(F.col(key).alias(f"{s}_key"), *[F.col(c).alias(f"{s}_{c}") for c in ("used", "grp", "split", "fold")])
    both = pairs.join(side("a"), F.col(a) == F.col("a_key")).join(side("b"), F.col(b) == F.col("b_key"))
    differs = lambda c: F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(False))
    same_group = F.coalesce(F.col("a_grp") == F.col("b_grp"), F.lit(False))
    leaks = both.where(F.col("a_used") & F.col("b_used") & ~same_group & (differs("split") | differs("fold")))
    return leaks.select(a, b, F.when(differs("split"), "holdout_split").otherwise("kfold").alias("leak_type"))
