"""Model-based probes: isolation forests, what features tell of a source or label, and stable clusters."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.keys import order_key
from corvane.operators.evaluation import auc
from corvane.operators.graph import cut
from corvane.operators.matching import greedy_match
from corvane.operators.outliers import known, zscore_outliers
from corvane.operators.quantiles import quantiles
from corvane.operators.ranks import ranked

SAMPLE = 20_000  # rows that trees are drawn from: the documented bound
TREE = 256  # rows of a tree
SHARE = 100_000  # rows that meet a forest at a time


def _path_norm(n: float) -> float:
    """Mean length of an unsuccessful search among n values."""
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """(column, cut, below, above), or the length that a leaf of len(x) rows stands for."""
    spread = np.nonzero(x.max(axis=0) > x.min(axis=0))[0] if len(x) > 1 and depth else []
    if not len(spread):
        return (_path_norm(len(x)),)
    c = int(rng.choice(spread))
    at = rng.uniform(x[:, c].min(), x[:, c].max())
    low = x[:, c] < at
    return (c, at, _tree(x[low], rng, depth - 1), _tree(x[~low], rng, depth - 1))


def _lengths(tree: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += depth + tree[0]
        return
    low = x[rows, tree[0]] < tree[1]
    _lengths(tree[2], x, rows[low], depth + 1, out)
    _lengths(tree[3], x, rows[~low], depth + 1, out)


def _grown(metrics: int, trees: int, seed: int):
    """The forest of a dataset's sample, as rows (dataset, forest, size)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        few = table.sort_by([("part", "ascending"), ("key", "ascending")]).slice(0, SAMPLE)
        held = few.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, metrics)
        rng = np.random.default_rng(seed)
        size = min(TREE, len(held))
        forest = [_tree(held[rng.choice(len(held), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)]
        return pa.table([few.column("d").slice(0, 1), pa.array([pickle.dumps(forest)], pa.binary()), pa.array([size], pa.int64())], names=["d", "forest", "size"])

    return run


def _scored(metrics: int):
    """Scores of a share of a dataset's rows by its forest."""

    def run(key: tuple, rows: pa.Table, grown: pa.Table) -> pa.Table:
        x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, metrics) if rows.num_rows else np.zeros((0, metrics))
        forest, total = pickle.loads(grown.column("forest")[0].as_py()) if grown.num_rows else [], np.zeros(len(x))
        for tree in forest:
            _lengths(tree, x, np.arange(len(x)), 0, total)
        whole = max(_path_norm(grown.column("size")[0].as_py()), 1e-9) if grown.num_rows else 1.0
        return pa.table([rows.column("key"), rows.column("d"), pa.array(2.0 ** (-total / max(len(forest), 1) / whole))], names=["key", "d", "score"])

    return run


def isolation_scores(df: DataFrame, key: str, dataset: str, metrics: Sequence[str], trees: int = 100, seed: int = 42, least: int = 20) -> DataFrame:
    """key, dataset, score (0 to 1, larger is odder) by an isolation forest of each dataset of at least least rows.

    Metrics are standardised within a dataset; nulls and NaN count as its mean. Each tree is grown on TREE of at most
    SAMPLE rows, those of the smallest hash of their key; every row is scored. Rows meet their dataset's forest in
    shares of at most about SHARE rows, so a large dataset is scored by many tasks. A null dataset is one.
    """
    told = df.select(F.col(key).alias("key"), F.col(dataset).alias("d"), *[known(m).alias(f"v{k}") for k, m in enumerate(metrics)])
    held = range(len(metrics))
    stats = told.groupBy("d").agg(F.count("*").alias("n"), *[f(f"v{k}").alias(f"{n}{k}") for k in held for n, f in (("m", F.avg), ("s", F.stddev_pop))]).where(F.col("n") >= least)
    stats = stats.withColumnRenamed("d", "_d").withColumn("shares", F.ceil(F.col("n") / SHARE).cast("int"))
    scaled = [F.coalesce((F.col(f"v{k}") - F.col(f"m{k}")) / F.when(F.col(f"s{k}") > 0, F.col(f"s{k}")).otherwise(1.0), F.lit(0.0)) for k in held]
    part = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30))
    rows = cut(told.join(stats, F.col("d").eqNullSafe(F.col("_d"))).select("key", "d", F.array(*scaled).alias("x"), part.alias("part"), "n", "shares"))
    few = rows.where(F.col("part") < F.least(F.lit(1.0), F.lit(1.2 * SAMPLE) / F.col("n")) * (1 << 30)).select("key", "d", "x", "part")
    kind, own = dict(told.dtypes)["d"], dict(told.dtypes)["key"]
    forests = few.groupBy("d").applyInArrow(_grown(len(metrics), trees, seed), f"d {kind}, forest binary, size long")
    share = rows.withColumn("share", F.pmod(F.col("part"), F.col("shares")).cast("int")).select("key", "d", "x", "share")
    dealt = forests.join(stats.select("_d", "shares"), F.col("d").eqNullSafe(F.col("_d"))).select("d", "forest", "size", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    found = share.groupBy("d", "share").cogroup(dealt.groupBy("d", "share")).applyInArrow(_scored(len(metrics)), f"key {own}, d {kind}, score double")
    return found.select(F.col("key").alias(key), F.col("d").alias(dataset), "score")


def flag_outliers(df: DataFrame, key: str, dataset: str, metrics: Sequence[str], limit: float = 3.0, share: float = 0.01, least: int = 20) -> DataFrame:
    """key, dataset, max_abs_z, reasons, score, forest_flag of rows that a metric or the forest finds odd in their dataset.

    The forest of a dataset of at least least rows flags those whose score exceeds the exact 1 - share quantile of
    its scores; reasons of a row that only it finds are isolation_forest. Nulls and NaN are missing values.
    """
    odd = zscore_outliers(df, key, dataset, list(metrics), limit).select(F.col(key).alias("_k"), F.col(dataset).alias("_o"), "max_abs_z", "reasons")
    found = cut(isolation_scores(df, key, dataset, metrics, least=least))
    edge = quantiles(found, [dataset], {"_edge": ("score", 1 - share)}).select(F.col(dataset).alias("_e"), "_edge")
    flagged = found.join(edge, F.col(dataset).eqNullSafe(F.col("_e"))).withColumn("_odd", F.col("score") > F.col("_edge")).select(F.col(key).alias("_s"), F.col(dataset).alias("_t"), "score", "_odd")
    scored = df.select(key, dataset).join(flagged, F.col(key).eqNullSafe(F.col("_s")) & F.col(dataset).eqNullSafe(F.col("_t")), "left").withColumn("forest_flag", F.coalesce("_odd", F.lit(False)))
    both = scored.join(odd, F.col(key).eqNullSafe(F.col("_k")) & F.col(dataset).eqNullSafe(F.col("_o")), "left").where(F.col("forest_flag") | F.col("reasons").isNotNull())
    return both.select(key, dataset, "max_abs_z", F.coalesce("reasons", F.lit("isolation_forest")).alias("reasons"), "score", "forest_flag")


def _folds(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """df with _fold: rows of a label dealt in turn, by hash."""
    rows = ranked(df.withColumn("_h", order_key(seed, key)), "_h", [label], key)
    return rows.withColumn("_fold", (F.col("rank") % k).cast("int")).drop("_h", "rank", "total")


def _out_of_fold(df: DataFrame, stages: list, k: int, index: str) -> DataFrame:
    """Predictions of every row by a model of the other folds."""
    out = None
    for fold in range(k):
        own = df.where(F.col("_fold") == fold)
        model = Pipeline(stages=[*stages, LogisticRegression(featuresCol="_x", labelCol=index, maxIter=100)]).fit(df.where(F.col("_fold") != fold))
        part = model.transform(own)
        out = part if out is None else out.unionByName(part)
    return out


def source_probe(df: DataFrame, key: str, source: str, features: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """One row: n, accuracy with which the features tell a row's source (out of fold) and chance, the largest source's share.

    Features are imputed by their median and standardised; folds are stratified by source.
    """
    held = df.where(F.col(source).isNotNull()).select(key, source, *[F.col(c).cast("double").alias(c) for c in features])
    named = StringIndexer(inputCol=source, outputCol="_y").fit(held).transform(held)
    rows = cut(_folds(named, key, source, k, seed))
    filled = [f"_{c}" for c in features]
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True)]
    found = _out_of_fold(rows, stages, k, "_y").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("accuracy"))
    top = rows.groupBy(source).agg(F.count("*").alias("_n")).agg((F.max("_n") / F.sum("_n")).alias("chance"))
    return found.crossJoin(F.broadcast(top))


def source_probes(df: DataFrame, key: str, source: str, subsets: dict[str, Sequence[str]], k: int = 5, seed: int = 42) -> DataFrame:
    """name, n, accuracy, chance: source_probe() of each named subset of features."""
    parts = [source_probe(df, key, source, features, k, seed).select(F.lit(name).alias("name"), "*") for name, features in subsets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_probe(df: DataFrame, key: str, label: str, attribute: str | None = None, features: Sequence[str] = (), k: int = 5, seed: int = 42) -> DataFrame:
    """One row: n, auc with which an attribute (one-hot, unseen values aside) or features tell a 0/1 label, out of fold."""
    held = df.where(F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("_y"), *([attribute] if attribute else []), *[F.col(c).cast("double").alias(c) for c in features])
    rows = cut(_folds(held, key, "_y", k, seed))
    if attribute:
        stages = [StringIndexer(inputCol=attribute, outputCol="_a", handleInvalid="keep"), OneHotEncoder(inputCols=["_a"], outputCols=["_x"], handleInvalid="keep")]
    else:
        filled = [f"_{c}" for c in features]
        stages = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True)]
    scored = _out_of_fold(rows, stages, k, "_y").select(F.get(vector_to_array("probability"), 1).alias("p"), F.col("_y").cast("int").alias("y"))
    return auc(scored, "p", "y")


def stable_clusters(df: DataFrame, key: str, features: Sequence[str], k: int, before: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """key, cluster: k-means whose numbers follow those of before(key, cluster), by the largest overlaps one to one."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    new = cut(KMeans(k=k, seed=seed).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster")))
    if before is None:
        return new
    shared = new.join(before.select(key, F.col("cluster").alias("old")), key).groupBy("cluster", "old").agg(F.count("*").alias("n"))
    kept = greedy_match(shared, "cluster", "old", "n").select("cluster", "old").collect()  # k rows at most
    number = {r["cluster"]: r["old"] for r in kept}
    free = iter(sorted(set(range(k)) - set(number.values())))
    number |= {c: next(free) for c in range(k) if c not in number}
    return new.withColumn("cluster", F.element_at(F.create_map(*[F.lit(int(x)) for pair in number.items() for x in pair]), F.col("cluster")))
