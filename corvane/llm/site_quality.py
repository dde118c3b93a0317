"""Quality classification: document evidence and shrunken posteriors of hosts and paths.

A logistic model on style features gives each document's evidence. Sites add theirs: the mean evidence of a host
is shrunk towards the global prior, that of a path towards its host, each with a strength found from the spread
between groups (method of moments of a beta law). The document's log-odds are then moved by how far its path's
posterior lies from the global prior. All sums are grouped aggregations that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import cut
from corvane.llm.text import SPACE_RUN, space_words

FEATURES = ["log_words", "symbol_share", "upper_share", "bang_share", "bar_share", "distinct_share", "stop_share", "mean_word"]


def _less(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def style_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with the columns FEATURES in place of text; all 0 for null and blank texts."""
    words = space_words(F.col("text"))
    rest = [c for c in docs.columns if c != "text"]
    df = docs.select(*rest, F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words)
    text, n = F.col("text"), F.size("words")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    letters = F.greatest(_less(text, r"[A-Za-z]+"), F.lit(1)).cast("double")
    many = F.greatest(n, F.lit(1)).cast("double")
    return df.select(
        *rest,
        F.log1p(n.cast("double")).alias("log_words"),
        ((F.length(text) - F.length(F.translate(text, "#*$%&<>{}=\\^~", ""))) / chars).alias("symbol_share"),
        (_less(text, "[A-Z]+") / letters).alias("upper_share"),
        ((F.length(text) - F.length(F.translate(text, "!?", ""))) / many).alias("bang_share"),
        ((F.length(text) - F.length(F.translate(text, "|", ""))) / many).alias("bar_share"),
        (F.size(F.array_distinct("words")) / many).alias("distinct_share"),
        ((F.length(text) - F.length(F.translate(text, ".", ""))) / many).alias("stop_share"),
        F.least(F.length(F.regexp_replace(text, SPACE_RUN, "")) / many, F.lit(40.0)).alias("mean_word"),
    )


def fit_evidence(labelled: DataFrame, label_col: str = "label", bound: int = 20000):
    """Weights (intercept first) of a logistic model on labelled rows of FEATURES.

    At most bound rows are used, those of the smallest hash of their id (the documented bound of the sample).
    Without labels, or with one class alone, all weights are 0 but the intercept, which is the log-odds of the
    class within [-3, 3].
    """
    rows = labelled.where(F.col(label_col).isNotNull())
    # only rows under a hash threshold are ordered: about a fifth more than are wanted, so never all of them in one task
    under = int(min(1.0, 1.2 * bound / max(rows.count(), 1)) * (1 << 30))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < under).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id", *FEATURES).limit(bound)
    rows = cut(rows.select(F.col(label_col).cast("double").alias("label"), *FEATURES), "labelled")
    n, k = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or k == 0 or k == n:
        return [0.0 if n == 0 else (3.0 if k else -3.0)] + [0.0] * len(FEATURES)
    model = LogisticRegression(regParam=0.001, maxIter=60).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return [float(model.intercept)] + [float(w) for w in model.coefficients]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: str, prior: Column) -> DataFrame:
    """One row (strength): pseudo-counts of the beta law whose spread the group means show."""
    spread = F.sum(F.col("n") * F.pow(F.col(mean) - prior, F.lit(2.0)))
    inner = F.sum(prior * (1 - prior))
    return groups.agg(spread.alias("spread"), inner.alias("inner"), F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("n") * prior * (1 - prior)).alias("whole"))


def _pseudo(row) -> float:
    """Large if groups differ no more than chance would have it, small if they differ much; within [1, 1000]."""
    if not row["n"] or not row["whole"]:
        return 1000.0
    between = (row["spread"] - row["inner"]) / row["whole"]
    return min(1000.0, max(1.0, 1.0 / between - 1.0)) if between > 0 else 1000.0


def site_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    threshold: float = 0.5,
    site_weight: float = 0.5,
) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score, kept for every row of docs.

    labels(id_col, label_col) names 0/1 labels of some documents; only its labels and the texts teach the
    document model. A labelled document counts in its site with its label, any other with its evidence. Null
    hosts and paths are values of their own. A null or blank text has the evidence of empty features. Repeated
    label rows vote once, by their mean; repeated documents count as often as they occur. Empty tables give no
    rows or, for labels, the neutral evidence 0.5. Site tables are joined, never collected.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col)).alias("label"))
    labelled = cut(style_features(rows).join(marks, "doc_id", "left"), "evidence")
    weights = fit_evidence(labelled.withColumn("label", F.round("label")))
    linear = F.lit(weights[0])
    for name, w in zip(FEATURES, weights[1:], strict=True):
        linear = linear + F.col(name) * F.lit(w)
    judged = labelled.select("doc_id", "host", "path", "label", (1 / (1 + F.exp(-linear))).alias("evidence"))
    judged = judged.withColumn("vote", F.coalesce("label", "evidence"))

    paths = cut(judged.groupBy("host", "path").agg(F.sum("vote").alias("k"), F.count("*").alias("n")), "paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("mean", F.col("k") / F.col("n")), "hosts")
    whole = hosts.agg(F.sum("k"), F.sum("n")).first()
    prior = (whole[0] or 0.0) / whole[1] if whole[1] else 0.5
    host_strength = _pseudo(_strength(hosts, "mean", F.lit(prior)).first())
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("k") + prior * host_strength) / (F.col("n") + host_strength)).alias("host_posterior"))
    placed = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).withColumn("mean", F.col("k") / F.col("n"))
    path_strength = _pseudo(_strength(placed, "mean", F.col("host_posterior")).first())
    placed = placed.select(F.col("h"), F.col("path").alias("p"), "host_posterior", ((F.col("k") + F.col("host_posterior") * path_strength) / (F.col("n") + path_strength)).alias("path_posterior"))
    both = judged.join(placed, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    moved = _logit(F.col("evidence")) + site_weight * (_logit(F.col("path_posterior")) - _logit(F.lit(prior)))
    score = 1 / (1 + F.exp(-moved))
    return both.select("doc_id", "evidence", "host_posterior", "path_posterior", score.alias("score"), (score >= threshold).alias("kept"))
