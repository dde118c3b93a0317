"""Temperature mixing of sources: tempered token shares, realised as budgeted permutations of blocks.

Share p_s of a source becomes w_s = p_s^x / sum p^x. The exponent is bisected to the largest x in [0, 1] whose
entropy reaches the target, and raised if a source would then repeat more often than allowed. Each source reads
whole epochs of its documents while its budget lasts, then blocks in a seeded order, and the last block in the
order of its documents' hashes. All order comes from hashes, so a lost task gives the same rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.storage import cut
from corvane.llm.text import SPACE_RUN, SPACES

SECTIONS = 16  # points of a bisection round: four halvings in one pass over the sources
BUCKET_BITS = 10  # buckets of a source's blocks, as a power of two
ROUNDS = 11  # 44 halvings, below the resolution of the weights


def count_tokens(text: Column) -> Column:
    """Runs without white space; 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.coalesce(F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPACE_RUN))), F.lit(0)).cast("long")


def _bisect(sources: DataFrame, total: int, low: float, high: float, holds) -> float:
    """The largest x in [low, high] for which holds(stats) is true, if it is true for low and turns false once."""
    for _ in range(ROUNDS):
        step = (high - low) / SECTIONS
        points = [low + step * k for k in range(1, SECTIONS + 1)]
        share = F.col("tokens") / F.lit(float(total))
        sums = [F.sum(F.pow(share, F.lit(x))).alias(f"z{k}") for k, x in enumerate(points)]
        logs = [F.sum(F.pow(share, F.lit(x)) * F.log(share)).alias(f"l{k}") for k, x in enumerate(points)]
        peaks = [F.max(F.pow(share, F.lit(x - 1.0))).alias(f"r{k}") for k, x in enumerate(points)]
        row = sources.agg(*sums, *logs, *peaks).first()
        good = 0
        while good < SECTIONS and holds(points[good], row[f"z{good}"], row[f"l{good}"], row[f"r{good}"]):
            good += 1
        low, high = (low + step * good, low + step * min(good + 1, SECTIONS))
        if low >= high:
            break
    return low


def fit_exponent(sources: DataFrame, budget: int | None = None, evenness: float = 0.5, max_repeats: float = 4.0) -> float:
    """The exponent for sources(source, tokens).

    The target entropy lies evenness of the way from that of the natural shares (0) to that of equal ones (1).
    Then no source may be read more than max_repeats times for the budget (default: all tokens once). One or no
    source, or no tokens: 1. A budget that no weights can read within max_repeats is an error.
    """
    held = sources.where("tokens > 0")
    total, n = held.agg(F.sum("tokens"), F.count("*")).first()
    if total and (budget or 0) > max_repeats * total:
        raise ValueError(f"a budget of {budget} tokens reads {total} tokens more than {max_repeats} times")
    if not total or n < 2:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))
    natural = held.agg(-F.sum(share * F.log(share))).first()[0]
    target = natural + evenness * (math.log(n) - natural)
    entropy = lambda x, z, l, r: math.log(z) - x * l / z >= target
    x = _bisect(held, total, 0.0, 1.0, entropy)
    times = (budget or total) / total
    too_often = lambda y, z, l, r: r / z * times > max_repeats
    z, peak = held.agg(F.sum(F.pow(share, F.lit(x))), F.max(F.pow(share, F.lit(x - 1.0)))).first()
    return x if peak / z * times <= max_repeats else _bisect(held, total, x, 1.0, too_often)


def _classes(docs: DataFrame, key: list[str], id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, n_tokens, h, k, m: equal rows (by two hashes of the columns key) are one class of m rows."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_tokens(F.col(text_col)).alias("n_tokens"),
        F.xxhash64(*key, F.lit(seed)).alias("h"), F.xxhash64(F.lit(seed), *key).alias("k"),
    )
    return rows.groupBy("doc_id", "source", "n_tokens", "h", "k").agg(F.count("*").alias("m"))


def _readings(classes: DataFrame, budget: int | None, evenness: float, max_repeats: float, block_tokens: int, seed: int) -> DataFrame:
    """classes with weight, block, full (whole epochs) and extra (how many of the class's rows the last epoch reads)."""
    sources = cut(classes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("m")).alias("tokens")), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = total if budget is None else budget
    x = fit_exponent(sources, budget, evenness, max_repeats)
    raw = sources.withColumn("raw", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(x))).otherwise(0.0))
    z = raw.agg(F.sum("raw")).first()[0] or 1.0
    plan = raw.withColumn("weight", F.col("raw") / F.lit(z)).withColumn("take", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
    plan = plan.select(
        F.col("source").alias("s"),
        "weight",
        F.when(F.col("tokens") > 0, F.expr("take div tokens")).otherwise(0).cast("long").alias("full"),
        F.when(F.col("tokens") > 0, F.expr("take % tokens")).otherwise(0).cast("long").alias("rest"),
        F.greatest(F.ceil(F.col("tokens") / F.lit(block_tokens)), F.lit(1)).cast("long").alias("blocks"),
    )
    plan = cut(plan, "mix-plan")
    size = F.col("n_tokens") * F.col("m")
    dealt = classes.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("blocks")))

    # tokens before each block: first over the buckets of a source, whose number is bounded, then within a bucket
    sizes = dealt.groupBy("source", "block", "full", "rest").agg(F.sum(size).alias("size")).withColumn("order", F.xxhash64("full", "block", F.lit(seed)))
    sizes = cut(sizes.withColumn("bucket", F.shiftright("order", 64 - BUCKET_BITS)), "mix-sizes")
    upto = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("size")).withColumn("earlier", upto(Window.partitionBy("source").orderBy("bucket"))).select(F.col("source").alias("es"), F.col("bucket").alias("eb"), "earlier")
    within = sizes.withColumn("inner", upto(Window.partitionBy("source", "bucket").orderBy("order", "block")))
    placed = within.join(buckets, F.col("source").eqNullSafe(F.col("es")) & (F.col("bucket") == F.col("eb")))
    before = cut(placed.select(F.col("source").alias("bs"), F.col("block").alias("b"), (F.col("earlier") + F.col("inner")).alias("before"), "size"), "mix-blocks")
    held = dealt.join(before, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("b")))
    at_edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))
    inside = Window.partitionBy("source", "block").orderBy("h", "k", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(size).over(inside), F.lit(0))
    fits = F.when(left < 0, 0).otherwise(F.least(F.col("m"), F.floor(left / F.greatest("n_tokens", F.lit(1)))))
    edge = held.where(at_edge).withColumn("extra", fits.cast("long"))
    others = held.where(~at_edge).withColumn("extra", F.when(F.col("before") + F.col("size") <= F.col("rest"), F.col("m")).otherwise(0).cast("long"))
    both = edge.unionByName(others)
    empty = F.col("n_tokens") == 0
    return both.select("doc_id", "source", "n_tokens", "h", "k", "m", "weight", "block", F.when(empty, 1).otherwise(F.col("full")).alias("full"), F.when(empty, 0).otherwise(F.col("extra")).alias("extra"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    evenness: float = 0.5,
    max_repeats: float = 4.0,
    block_tokens: int = 1 << 17,
    seed: int = 17,
) -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block, place: a row for every reading of a document.

    place orders the readings of an epoch within a source (block order first, then documents). A source's
    readings take at most its budget of tokens, floor(weight * budget), and miss it by less than one document.
    A null source is a source of its own; documents without tokens belong to the first epoch and cost nothing.
    Rows of equal id, text and source count each, and their readings are told apart by nothing; null ids are ids
    like others. An empty table, or a budget of 0, gives the documents without tokens alone. A budget beyond
    max_repeats times all tokens is an error. Only per-source sums reach the driver, a round at a time.
    """
    classes = cut(_classes(docs, [id_col, text_col, source_col], id_col, text_col, source_col, seed), "mix-docs")
    held = _readings(classes, budget, evenness, max_repeats, block_tokens, seed)
    # as many readings an epoch as the class has rows, and extra ones of the epoch after
    times = (F.col("full") * F.col("m") + F.col("extra")).cast("int")
    read = held.withColumn("times", times).where("times > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("epoch", F.expr("at div m").cast("int"))
    place = F.struct(F.xxhash64("epoch", "block", F.lit(seed)).alias("block_key"), F.xxhash64("h", "epoch").alias("doc_key"))
    return read.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", place.alias("place"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, evenness: float = 0.5, max_repeats: float = 4.0, block_tokens: int = 1 << 17, seed: int = 17) -> DataFrame:
    """The rows of docs as often as mix_sources reads them, with all their columns.

    Rows are told apart by all their columns, never by their id alone: equal rows share their class's readings, so
    repeated or missing ids neither multiply nor lose rows. Columns must be of types that can be hashed.
    """
    columns = docs.columns
    classes = cut(_classes(docs, columns, id_col, text_col, source_col, seed), "mix-docs")
    held = cut(_readings(classes, budget, evenness, max_repeats, block_tokens, seed), "mix-read")
    # every row of a class is read alike, but for the one class of a source at which its budget ends
    times = held.select(F.col("h").alias("_h"), F.col("k").alias("_k"), (F.col("full") + (F.col("extra") == F.col("m")).cast("long")).cast("int").alias("_times"), F.when(F.col("extra") < F.col("m"), F.col("extra")).otherwise(0).cast("int").alias("_some"))
    keyed = docs.select(*columns, F.xxhash64(*columns, F.lit(seed)).alias("_h"), F.xxhash64(F.lit(seed), *columns).alias("_k"))
    copies = lambda df, n: df.where(F.col(n) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(n)))).select(*columns)
    whole = copies(keyed.join(times.where("_times > 0").select("_h", "_k", "_times"), ["_h", "_k"]), "_times")
    some = keyed.join(F.broadcast(times.where("_some > 0").select("_h", "_k", "_some")), ["_h", "_k"]).dropDuplicates(["_h", "_k"])  # a row for each source at most
    return whole.unionByName(copies(some, "_some"))
