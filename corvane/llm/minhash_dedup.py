"""Near-duplicate documents: universal hash minima, banding, verification on full sets, connected components.

1. One pass makes each document's set of shingle hashes, its minima under many universal hash functions, the
   band keys and a 128-bit digest of the set. Sets are not kept; only this small table is.
2. Equal sets are one class, found by grouping digests with partial aggregation, so copies are never paired.
3. Within each bucket (band, key) every class is paired with the smallest one. Pairs are made distinct across
   bands, thinned by their minima and verified on the full sets; links give components.
4. Buckets that still hold more than one component are compared in blocks of bounded size: each pair of blocks
   of one bucket is a group of its own, intersections come from matrix products, pairs within a component are
   skipped and only new links that join components leave the group. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.storage import cut
from corvane.llm.text import ascii_lower, space_words

SEED = 20240229
STEP = 1 << 16  # values hashed at once, so that one pass stays in the processor's cache
BLOCK = 512  # classes in a block of a large bucket


def shingle_set(text: Column, width: int) -> Column:
    """Distinct 64-bit hashes of runs of width words; a shorter text is one run; no words, no shingles."""
    words = space_words(ascii_lower(text))
    return _shingles_of(words, width)


def _shingles_of(words: Column, width: int) -> Column:
    n = F.size(words)
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    return (
        F.when(n >= width, F.array_distinct(F.transform(F.sequence(F.lit(0), n - width), run)))
        .when(n > 0, F.array(F.xxhash64(F.array_join(words, "\n"), n)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles; the words are a column of their own so that no expression is worked out twice."""
    words = docs.select("doc_id", space_words(ascii_lower(F.col("text"))).alias("words"))
    return words.select("doc_id", _shingles_of(F.col("words"), width).alias("shingles"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signer(bands: int, rows: int):
    rng = np.random.default_rng(SEED)
    n = bands * rows
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    shift = np.uint64(32)

    def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Row per set: the least of ((a x + b) mod 2^64) / 2^32 for each function."""
        out = np.empty((n, len(starts)), np.uint32)
        x = np.empty_like(values)
        for k in range(n):
            np.multiply(values, a[k], out=x)
            np.add(x, b[k], out=x)
            np.right_shift(x, shift, out=x)
            out[k] = np.minimum.reduceat(x, starts)
        return out

    def pieces(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """minima() in steps of bounded size; a set longer than a step is folded over its parts."""
        out = np.full((n, len(starts)), 0xFFFFFFFF, np.uint32)
        cuts = np.union1d(starts, np.arange(0, len(values), STEP))
        owner = np.searchsorted(starts, cuts, side="right") - 1
        ends = np.append(cuts[1:], len(values))
        i = 0
        while i < len(cuts):
            j = max(i + 1, int(np.searchsorted(ends, cuts[i] + STEP, side="right")))
            part = minima(values[cuts[i] : ends[j - 1]], cuts[i:j] - cuts[i])
            for k, o in enumerate(owner[i:j]) if owner[i] == owner[j - 1] else [(0, owner[i])]:
                out[:, o] = np.minimum(out[:, o], part[:, k])
            if owner[i] != owner[j - 1]:
                out[:, owner[i + 1 : j]] = np.minimum(out[:, owner[i + 1 : j]], part[:, 1:])
            i = j
        return out

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = batch.column("shingles")
                lengths = np.diff(sets.offsets.to_numpy()).astype(np.int64)
                values = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                full = lengths > 0
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[full] if len(lengths) else np.zeros(0, np.int64)
                digests = np.zeros((2, len(lengths)), np.int64)
                keys = [None] * len(lengths)
                marks = [None] * len(lengths)
                if full.any():
                    digests[0, full] = np.add.reduceat(_mix(values ^ np.uint64(0x9E3779B97F4A7C15)), starts).view(np.int64)
                    digests[1, full] = np.add.reduceat(_mix(values + np.uint64(0xD1B54A32D192ED03)), starts).view(np.int64)
                    least = pieces(values, starts).astype(np.uint64)
                    band = np.zeros((bands, least.shape[1]), np.uint64)
                    for r in range(rows):
                        band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + least[r::rows][:bands] + np.uint64(r + 1))
                    band, small = band.T.view(np.int64), (least.T & np.uint64(0xFFFF)).astype(np.uint16)
                    for k, at in enumerate(np.nonzero(full)[0]):
                        keys[at], marks[at] = band[k], small[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(lengths), pa.array(digests[0]), pa.array(digests[1]), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "keys", "marks"],
                )

    return sign


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2), band keys, low 16 bits of all minima."""
    return _sets(docs, width).mapInArrow(_signer(bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, keys array<bigint>, marks binary")


def _alike(percent: int):
    """Keeps the pairs whose minima agree in at least the share that a true link would, less five standard deviations."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("marks_a", "marks_b"))
            p = percent / 100
            least = p - 5 * np.sqrt(p * (1 - p) / x.shape[1])
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return keep


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 |A and B| >= percent |A or B|."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def _block_links(percent: int):
    """Links within one pair of blocks of one bucket, as a forest over the components seen so far."""

    def find(parent: dict, x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def links(table: pa.Table) -> pa.Table:
        ids, side, comp = (table.column(c).to_numpy() for c in ("doc_id", "side", "component"))
        sets = [np.asarray(x, dtype=np.int64) for x in table.column("shingles").to_pylist()]
        same = bool(table.column("first")[0].as_py() == table.column("second")[0].as_py())
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(ids)), sizes)
        shingle = np.concatenate(sets)
        _, column, times = np.unique(shingle, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        left, right = (np.arange(len(ids)),) * 2 if same else (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0])
        row_l, row_r = np.full(len(ids), -1), np.full(len(ids), -1)
        row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
        common = np.zeros((len(left), len(right)), np.float64)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        wide = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            i, j = np.searchsorted(column, [at, at + wide])
            o, c = owner[i:j], column[i:j] - at
            grid_l, grid_r = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
            in_l, in_r = row_l[o] >= 0, row_r[o] >= 0
            grid_l[row_l[o[in_l]], c[in_l]] = 1
            grid_r[row_r[o[in_r]], c[in_r]] = 1
            common += grid_l @ grid_r.T
        union = sizes[left][:, None] + sizes[right][None, :] - common
        hit = (common * 100 >= union * percent) & (comp[left][:, None] != comp[right][None, :])
        parent: dict = {}
        a, b = [], []
        for x, y in zip(*np.nonzero(hit), strict=True):
            p, q = find(parent, comp[left[x]]), find(parent, comp[right[y]])
            if p != q:
                parent[p] = q
                a.append(ids[left[x]])
                b.append(ids[right[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked if 100 |A and B| >= percent |A or B| over their sets of width-word shingles (words are
    runs without ASCII white space, A-Z in lower case). component_id is the smallest id that links reach, kept is
    true for it alone. Null and blank texts have no shingles and link with nothing; texts below width words are
    one shingle. Rows that repeat an id share its component. A row without an id is its own component (null) and
    kept. Other columns of docs are ignored; id_col must cast to long. A pair at the threshold meets in some band with probability
    1 - (1 - s^rows)^bands: with 25 bands of 5, 0.9999996 at 0.85 and 0.99995 at 0.8.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(signatures(docs, width, bands, rows), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")

    classes = filled.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    member = cut(filled.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"]).select("doc_id", "rep").distinct(), "classes")
    heads = filled.join(classes.select("n_shingles", "d1", "d2", F.col("rep").alias("doc_id")), ["doc_id", "n_shingles", "d1", "d2"], "left_semi")
    keyed = heads.select("doc_id", F.posexplode("keys").alias("band", "key"))
    pivots = keyed.groupBy("band", "key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last")
    bucketed = cut(keyed.join(pivots.select("band", "key", "pivot"), ["band", "key"]), "buckets")

    marks = heads.select("doc_id", "marks", "n_shingles")
    stars = bucketed.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    m = [marks.select(F.col("doc_id").alias(s), F.col("marks").alias(f"marks_{s}"), F.col("n_shingles").alias(f"n_{s}")) for s in "ab"]
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    likely = stars.join(m[1], "b").join(m[0], "a").where(fits).select("a", "b", "marks_a", "marks_b").mapInArrow(_alike(percent), "a long, b long")
    likely = cut(likely, "pairs")

    met = bucketed.select("doc_id").distinct()
    sets = cut(_sets(docs.where("doc_id is not null").join(met, "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]), "sets")
    links = cut(_verified(likely, sets, percent), "links")
    parts = cut(connected_components(links.toDF("u", "v")), "parts")

    labelled = bucketed.select("band", "key", "doc_id").join(parts.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = labelled.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    open_ = cut(labelled.join(counts.select("band", "key", "n"), ["band", "key"]), "open")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    placed = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int"))
    spread = placed.select(
        "band", "key", "doc_id", "component",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("first"), F.greatest("block", o).alias("second"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))).alias("at"),
    ).select("band", "key", "doc_id", "component", "at.*")
    grouped = spread.join(sets, "doc_id").groupBy("band", "key", "first", "second")
    more = cut(grouped.applyInArrow(_block_links(percent), "a long, b long").distinct(), "more")

    every = links.union(more).union(member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    final = connected_components(every.toDF("u", "v"))
    out = signed.select("doc_id", "n_shingles").join(final.toDF("doc_id", "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates, with all its columns; rows without shingles all stay.

    Rows are numbered first (in a written table, so that numbers hold), and groups are of rows: ids are not read,
    so equal rows are one group whatever their ids, and rows that share an id with other texts are judged alone.
    """
    names = {f"_c{k}": c for k, c in enumerate(docs.columns)}
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`").alias(n) for n, c in names.items()]), "numbered")
    text = next(n for n, c in names.items() if c == text_col)
    gone = near_duplicates(numbered, "_row", text, **options).where("not kept").select(F.col("doc_id").alias("_row"))
    return numbered.join(gone, "_row", "left_anti").select(*[F.col(n).alias(c) for n, c in names.items()])
