"""Approximate nearest neighbours by inner product over shifted space-filling curves.

1. Equal vectors are one point, held by their smallest ids. Points fall into bands of length, as the largest inner
   products are mostly those of long vectors; within a band only directions are ordered.
2. Directions are projected on many random planes, shifted, and ordered along a Hilbert curve on each. A point lies
   on the curves where its projection is longest, and a query asks on those where its own is (there its neighbours
   stand out most).
3. How far neighbours lie apart along the curves is measured: a bounded number of the queries is compared with all
   points, and the number of curves and the windows of each band are the cheapest that would have found the wished
   share of their neighbours. So windows are narrow where vectors have structure and wide where they have none.
4. Points and queries are range-partitioned by curve, band and range of keys. A range holds 16-bit codes; ranges with
   many points or queries are cut into parts of bounded size.
5. The best of all ranges merge, and are ranked again on the original vectors, which are fetched for them alone.
   What a query still has to beat comes from a bounded sample and, on large tables, from looks at a part of the points,
   each four times as large as the one before; so the rows that a query finds don't grow with the table.
6. An exact check follows, as a point lies on some of the curves only and windows end: every query meets all points
   whose length lets them beat what it has found, in blocks of bounded size and in double precision.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.storage import cut

AXES = 2
GRID_BITS = 14
PART = 8192  # points, and queries, in one group
LEAST = 256  # points that a range holds at least, on average
MOST_RANGES = 1024  # of a band on a curve
SIDES = 2  # ranges that a query sees on either side of its own
PROBES = (4, 8, 16, 24)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of grid cells, by undoing the curve's turns bit by bit."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            on = (x[:, d] >> b) & 1 == 1
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(on, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


class Curves:
    """Planes, shifts, grid, bands and ranges, learnt from a sample of points and of queries with their neighbours."""

    def __init__(self, sample: np.ndarray, reps: np.ndarray, curves: int, copies: int, seed: int):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        axes: list[np.ndarray] = []
        while len(axes) < curves * AXES:
            axes += list(np.linalg.qr(rng.normal(size=(dim, dim)))[0].T)
        self.planes = np.array(axes[: curves * AXES])
        self.curves, self.copies = curves, min(copies, curves)
        self.sample, self.reps = sample.astype(np.float32), reps  # what queries are compared with at first
        length = np.linalg.norm(sample, axis=1)
        y = sample / length[:, None] @ self.planes.T
        self.low = y.min(axis=0)
        span = y.max(axis=0) - self.low
        self.unit = np.where(span > 0, span, 1.0) * 1.25
        self.low = self.low - self.unit * rng.uniform(0.0, 0.2, len(self.unit))
        self.order = np.sort(self._keys(y), axis=0)
        # a band's vectors are a tenth longer than those before it at least
        self.edges: list[float] = []
        for share in 0.5 ** np.arange(1, 7):
            e = float(np.quantile(length, 1 - share))
            if e > 1.1 * (self.edges[-1] if self.edges else float(length.min())):
                self.edges.append(e)
        self.share = np.bincount(np.searchsorted(self.edges, length, side="right"), minlength=len(self.edges) + 1) / len(length)
        self.probes, self.ranges = 0, np.zeros(len(self.share), np.int64)

    def whole(self) -> Curves:
        """One curve with one range a band, which all points lie on and all queries look through."""
        one = copy.copy(self)
        one.planes, one.low, one.unit, one.order = self.planes[:AXES], self.low[:AXES], self.unit[:AXES], self.order[:, :1]
        one.curves = one.copies = one.probes = 1
        one.ranges = np.ones(len(self.share), np.int64)
        return one

    def _keys(self, y: np.ndarray) -> np.ndarray:
        cells = np.clip((y - self.low) / self.unit * (1 << GRID_BITS), 0, (1 << GRID_BITS) - 1).astype(np.int64)
        return np.stack([hilbert_keys(cells[:, c * AXES : (c + 1) * AXES], GRID_BITS) for c in range(self.curves)], axis=1)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Band; share of the sample before it on each curve; curves from the longest projection on."""
        x = x.astype(np.float64)
        length = np.linalg.norm(x, axis=1)
        y = x / length[:, None] @ self.planes.T
        keys = self._keys(y)
        at = np.stack([np.searchsorted(self.order[:, c], keys[:, c], side="right") for c in range(self.curves)], axis=1) / len(self.order)
        best = np.argsort(-(y.reshape(len(x), self.curves, AXES) ** 2).sum(axis=2), axis=1, kind="stable")
        return np.searchsorted(self.edges, length, side="right"), at, best

    def range_of(self, band: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.minimum((at * self.ranges[band][:, None]).astype(np.int64), np.maximum(self.ranges[band] - 1, 0)[:, None])

    def tune(self, asked: np.ndarray, owner: np.ndarray, near: np.ndarray, n: int, recall: float) -> None:
        """Sets the cheapest probes and ranges that find the share recall of near[k], neighbours of asked[owner[k]]."""
        _, q_at, q_best = self.place(asked)
        band, at, best = self.place(near)
        own = np.zeros(at.shape, bool)
        np.put_along_axis(own, best[:, : self.copies], True, axis=1)
        grid = np.unique(np.concatenate([np.geomspace(1 / MOST_RANGES, 1.0, 60), [1.0]]))
        chosen = None
        for probes in (p for p in PROBES if p <= self.curves):
            c = q_best[owner][:, :probes]
            far = np.where(np.take_along_axis(own, c, 1), np.abs(np.take_along_axis(at, c, 1) - np.take_along_axis(q_at[owner], c, 1)), 2.0).min(axis=1)
            hits = np.array([[np.sum(far[band == b] <= g) for g in [-1.0, *grid]] for b in range(len(self.share))])
            wide = np.concatenate([[0.0], grid])
            step = np.zeros(len(self.share), np.int64)
            while hits[np.arange(len(step)), step].sum() < recall * len(far):
                gain = (hits - hits[np.arange(len(step)), step][:, None]) / np.maximum(self.share[:, None] * (wide[None, :] - wide[step][:, None]), 1e-9)
                gain[wide[None, :] <= wide[step][:, None]] = 0
                b, g = np.unravel_index(gain.argmax(), gain.shape)
                if gain[b, g] <= 0:
                    break
                step[b] = g
            found = hits[np.arange(len(step)), step].sum() >= recall * len(far)
            cost = probes * float((self.share * wide[step]).sum())
            if chosen is None or (not found, cost) < chosen[:2]:
                chosen = (not found, cost, probes, wide[step])
        _, _, self.probes, wide = chosen
        most = np.maximum(1, (self.share * n / LEAST).astype(np.int64))
        self.ranges = np.where(wide > 0, np.minimum(np.ceil(SIDES / np.maximum(wide, 1e-9)).astype(np.int64), np.minimum(most, MOST_RANGES)), 0)

    def least_scores(self, x: np.ndarray, reps: np.ndarray, k: int) -> np.ndarray:
        """What the k-th best of the sample scores: a bound that no true neighbour lies under."""
        if len(self.sample) <= k:
            return np.full(len(x), -np.inf)
        scores = x.astype(np.float32) @ self.sample.T
        scores[reps[:, None] == self.reps[None, :]] = -np.inf
        return np.partition(scores, len(self.sample) - k, axis=1)[:, len(self.sample) - k].astype(np.float64)


def _vectors(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            yield whole.slice(i, rows)


def _truth(asked: np.ndarray, most: int):
    """The best points of this task for each of the asked vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = np.zeros((0, asked.shape[1])), np.full((len(asked), 0), -np.inf)
        for batch in _slices(batches, 4096):
            x = np.concatenate([held, _vectors(batch).astype(np.float64)])
            scores = np.concatenate([best, asked @ x[len(held) :].T], axis=1)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :most]
            used, at = np.unique(top, return_inverse=True)
            held, best = x[used], scores[:, used]
        top = np.argsort(-best, axis=1, kind="stable")[:, :most]
        q, x = np.repeat(np.arange(len(asked)), top.shape[1]), held[top.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(np.take_along_axis(best, top, 1).ravel()), pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))], ["q", "score", "vector"])

    return run


def _slot(curves: Curves, c: np.ndarray, band: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of a range among those of all curves and bands."""
    before = np.cumsum(curves.ranges) - curves.ranges
    return c * int(curves.ranges.sum()) + before[band] + at


def _on_curves(curves: Curves, band: np.ndarray, at: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every point on the curves that hold it."""
    r = np.repeat(np.arange(len(band)), curves.copies)
    c = best[:, : curves.copies].ravel()
    r, c = r[curves.ranges[band[r]] > 0], c[curves.ranges[band[r]] > 0]
    return r, _slot(curves, c, band[r], curves.range_of(band, at)[r, c])


def _asking(curves: Curves, q: np.ndarray, at: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every range that a query looks through, in all bands."""
    rows, slots = [], []
    r = np.repeat(q, curves.probes)
    c = best[q, : curves.probes].ravel()
    for band in np.nonzero(curves.ranges)[0]:
        here = curves.range_of(np.full(len(at), band), at)[r, c]
        for step in range(-SIDES, SIDES + 1):
            ok = (here + step >= 0) & (here + step < curves.ranges[band])
            rows.append(r[ok])
            slots.append(_slot(curves, c[ok], np.full(ok.sum(), band), here[ok] + step))
    return (np.concatenate(rows), np.concatenate(slots)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _loads(curves: Curves):
    """Points and queries of each range, summed over a task, and the length of its longest point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = curves.curves * int(curves.ranges.sum())
        held, top = np.zeros((2, n), np.int64), np.zeros(n)
        for batch in _slices(batches):
            x = _vectors(batch)
            band, at, best = curves.place(x)
            r, slot = _on_curves(curves, band, at, best)
            held[0] += np.bincount(slot, minlength=n)
            np.maximum.at(top, slot, np.linalg.norm(x.astype(np.float64), axis=1)[r])
            held[1] += np.bincount(_asking(curves, np.nonzero(batch.column("asks").to_numpy(zero_copy_only=False))[0], at, best)[1], minlength=n)
        used = np.nonzero(held.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[0, used]), pa.array(held[1, used]), pa.array(top[used])], ["slot", "points", "queries", "top"])

    return run


def _parted(rows: np.ndarray, slots: np.ndarray, own: np.ndarray, other: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, slot, own part, other part: each row in one of the own parts of its slot, and once for each of the other's."""
    mine = (ids[rows] * 2654435761 >> 7) % own[slots]
    times = other[slots]
    place = np.repeat(np.arange(len(rows)), times)
    return rows[place], slots[place], mine[place], np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)


def _spread(curves: Curves, p_parts: np.ndarray, q_parts: np.ndarray, tops: np.ndarray, k: int, exact: bool):
    """A coded row (exact: a whole one) for each curve of each point, and for queries one for each range they look through.

    No query is sent to a range whose longest point can't reach what the query has found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _vectors(batch).astype(np.float64 if exact else np.float32)
            rep, asks = batch.column("rep").to_numpy(), np.nonzero(batch.column("asks").to_numpy(zero_copy_only=False))[0]
            band, at, best = curves.place(x)
            scale = (np.abs(x).max(axis=1) / 32767).astype(np.float32)
            codes = np.rint(x / scale[:, None]).astype(np.int16)
            length = np.linalg.norm(x.astype(np.float64), axis=1)
            least = batch.column("least").to_numpy(zero_copy_only=False)
            if len(asks) and not exact:
                least = least.copy()
                least[asks] = np.maximum(least[asks], curves.least_scores(x[asks], rep[asks], k))
            for asking in (False, True):
                r, slot = _asking(curves, asks, at, best) if asking else _on_curves(curves, band, at, best)
                if asking:
                    ok = length[r] * tops[slot] * (1 + 1e-6) >= least[r]
                    r, slot = r[ok], slot[ok]
                r, slot, mine, other = _parted(r, slot, *((q_parts, p_parts) if asking else (p_parts, q_parts)), rep)
                held = [v.tobytes() for v in (x if asking or exact else codes)]
                part, q_part = (other, mine) if asking else (mine, other)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(part.astype(np.int32)), pa.array(q_part.astype(np.int32)), pa.array(np.full(len(r), asking)), pa.array(rep[r]), pa.array(scale[r]), pa.array(least[r]), pa.array([held[i] for i in r], pa.binary())],
                    ["slot", "part", "q_part", "asking", "rep", "scale", "least", "code"],
                )

    return run


def _best(most: int, exact: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ask, reps, scale, least = (table.column(c).to_numpy() for c in ("asking", "rep", "scale", "least"))
        q, c = np.nonzero(ask)[0], np.nonzero(~ask)[0]
        out: list[tuple] = []
        if len(q) and len(c):
            codes = table.column("code")
            read = lambda rows, kind: np.frombuffer(b"".join(codes.take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), -1)
            c = c[np.argsort(reps[c], kind="stable")]
            x = read(c, np.float64) if exact else read(c, np.int16).astype(np.float32) * scale[c][:, None]
            longest = np.linalg.norm(x, axis=1).max()
            for i in range(0, len(q), 512):
                asked = read(q[i : i + 512], np.float64 if exact else np.float32)
                scores = asked @ x.T
                # four standard deviations of the rounding of codes, on both sides; or a bound of that of sums
                slack = np.linalg.norm(asked, axis=1) * (1e-12 * longest if exact else 8 * float(scale[c].max()) / np.sqrt(12))
                floor = least[q[i : i + 512]] - slack
                if scores.shape[1] > most:
                    floor = np.maximum(np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most] - (slack if exact else 0), floor)
                a, b = np.nonzero(scores >= floor[:, None])
                out.append((reps[q[i : i + 512]][a], reps[c][b], scores[a, b]))
        a, b, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": pa.array(a.astype(np.int64)), "rep": pa.array(b.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    return run


def _looks(n: int, sample: int) -> list[float]:
    """Shares of the points that queries look at in turn: of each look, and of the sample before, the next is four times the size at most."""
    shares = [1.0]
    while shares[-1] * n > 4 * sample:
        shares.append(shares[-1] / 4)
    return shares[::-1]


def _met(points: DataFrame, curves: Curves, most: int, k: int, exact: bool, shares: list[float], salt: int) -> DataFrame:
    """query, rep, score: what those of points(rep, vector, asks, least) that ask find among all of them, in the last of the looks."""
    p_parts, q_parts = np.ones((2, curves.curves * int(curves.ranges.sum())), np.int64)
    tops = np.zeros(len(p_parts))
    loads = points.mapInArrow(_loads(curves), "slot long, points long, queries long, top double").groupBy("slot").agg(F.sum("points").alias("points"), F.sum("queries").alias("queries"), F.max("top").alias("top"))
    for r in loads.collect():  # a row for each range, whose number has a bound
        s = r["slot"]
        p_parts[s], q_parts[s], tops[s] = max(1, -(-r["points"] // PART)), max(1, -(-r["queries"] // PART)), r["top"]
    keys = ["slot", "part", "q_part"]
    for share in shares:
        looked = points.where(F.col("asks") | (F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(1 << 31)) < int(share * (1 << 31))))
        spread = looked.mapInArrow(_spread(curves, p_parts, q_parts, tops, k, exact), "slot long, part int, q_part int, asking boolean, rep long, scale float, least double, code binary")
        found = spread.repartitionByRange(*keys).groupBy(*keys).applyInArrow(_best(most, exact), "query long, rep long, score double")
        if share < 1:
            points = _told(points, found.groupBy("query", "rep").agg(F.max("score").alias("score")), k)
    return found


def _told(points: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """points with least: the score of the k + 1st of what each query has found, and without bound where there are fewer."""
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    last = found.withColumn("at", F.row_number().over(by_score)).where(F.col("at") == k + 1).select(F.col("query").alias("rep"), F.col("score").alias("found"))
    return cut(points.join(last, "rep", "left").withColumn("least", F.coalesce("found", "least")).drop("found"), "told")


def _few(points: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """About most of n points, those of small hashes of their rep; only they travel."""
    part = F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(1 << 31))
    return points.where(part < int(min(1.0, 1.2 * most / max(n, 1)) * (1 << 31))).orderBy(F.xxhash64("rep", F.lit(salt)), "rep").limit(most)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    curves: int = 96,
    copies: int = 32,
    recall: float = 0.96,
    sample: int = 8000,
    measured: int = 128,
    seed: int = 5,
    compared: int = 20_000,
    rest: bool = True,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product found for each query.

    queries holds the ids (id_col, cast to long) of the rows of vectors that ask; candidates are all rows but the
    query's own. Windows are set for the given recall, as measured on some of the queries. Nulls, zero vectors,
    vectors with null or non-finite components, of another than the usual dimension, or without an id take no part,
    as queries and as candidates. Ties go to the smaller id; repeated rows count once, and an id with several
    vectors with the best of them; an empty table gives no rows. Planes, shifts and range bounds come from at most
    sample vectors, windows from at most measured queries against all vectors, and first bounds of scores from at most
    compared vectors (documented bounds). With rest the answer is exact: after the curves every query meets all that
    they left out and that could still beat what was found, which is quadratic where lengths are alike. Without rest
    the answer has the recall of the curves.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull()).where(usable).select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).distinct()
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == sizes["dim"])
    asked = queries.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("asks", F.lit(True))
    held = rows.join(asked, "id", "left")
    # the k + 1 smallest ids of each point are all that an answer can need; the limit is applied before the shuffle
    first = cut(rows.withColumn("at", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("at") <= k + 1), "points")
    reps = first.where("at = 1").select(F.col("id").alias("rep"), "vector")
    members = first.join(reps, "vector").select("rep", "id")
    askers = cut(held.where("asks").select("id", "vector").join(reps, "vector").select(F.col("id").alias("query_id"), F.col("rep").alias("query")), "askers")
    points = reps.join(askers.select(F.col("query").alias("rep")).distinct().withColumn("asks", F.lit(True)), "rep", "left").withColumn("asks", F.coalesce("asks", F.lit(False))).withColumn("least", F.lit(float("-inf")))
    points = cut(points, "asking")

    n, n_asks = points.agg(F.count("*"), F.count_if("asks")).first()
    if not n_asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    taken = _few(points.select("rep", "vector"), n, max(sample, compared), seed).collect()
    tried = np.array([r["vector"] for r in _few(points.where("asks").select("rep", "vector"), n_asks, measured, seed + 1).collect() or taken[:measured]], np.float64)
    drawn, own = np.array([r["vector"] for r in taken], np.float64), np.array([r["rep"] for r in taken], np.int64)
    learnt = Curves(drawn[:sample], own[:sample], curves, copies, seed)
    learnt.sample, learnt.reps = drawn[:compared].astype(np.float32), own[:compared]
    by_score = Window.partitionBy("q").orderBy(F.desc("score"))
    truth = points.select("vector").mapInArrow(_truth(tried, k + 1), "q int, score double, vector array<double>")
    known = truth.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= k + 1).collect()
    learnt.tune(tried, np.array([r["q"] for r in known]), np.array([r["vector"] for r in known]), n, recall)

    found = _met(points, learnt, 3 * (k + 1), k, False, _looks(n, len(learnt.sample)), seed + 2)
    merged = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    by_code = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    likely = merged.withColumn("at", F.row_number().over(by_code)).where(F.col("at") <= 3 * (k + 1)).select("query", "rep")
    product = F.aggregate(F.zip_with("asked", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    asked_of = points.where("asks").select(F.col("rep").alias("query"), F.col("vector").alias("asked"))
    scored = lambda pairs: pairs.join(points.select("rep", "vector"), "rep").join(asked_of, "query").select("query", "rep", product.alias("score"))
    first_of = lambda pairs: cut(pairs.withColumn("at", F.row_number().over(by_code)).where(F.col("at") <= k + 1).select("query", "rep", "score"), "near")
    near = first_of(scored(likely))
    if rest:
        more = _met(_told(points, near, k), learnt.whole(), k + 1, k, True, [1.0], seed)
        near = first_of(near.unionByName(scored(more.join(near, ["query", "rep"], "left_anti").select("query", "rep"))))
    each = near.join(members, "rep").withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("at") <= k + 1)
    answers = askers.join(each, "query").where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
