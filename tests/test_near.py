"""Near duplicates, label resolution and matching against plain versions and worked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, hashing, labels, matching, near

SIDE = 32


def signed(bits):
    return int(np.uint64(int("".join("1" if b else "0" for b in bits), 2)).astype(np.int64))


def plain_hashes(image):
    small = image.reshape(8, SIDE // 8, 8, SIDE // 8).mean(axis=(1, 3))
    k, n = np.meshgrid(np.arange(8), np.arange(SIDE), indexing="ij")
    c = np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE)) * np.where(k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))
    low = c @ image @ c.T
    return signed((small > small.mean()).ravel()), signed((small < np.roll(small, -1, axis=1)).ravel()), signed((low > np.median(low.ravel()[1:])).ravel())


def smooth(rng):
    y, x = np.mgrid[0:SIDE, 0:SIDE] / SIDE
    return 120 + 100 * np.cos(rng.uniform(1, 6) * x + rng.uniform(0, 6)) * np.cos(rng.uniform(1, 6) * y + rng.uniform(0, 6))


@pytest.fixture(scope="module")
def frame(spark):
    """Twelve images; 5 is a noisy copy of 0 in another split with another label, 6 of 1 in the same group, 7 equals 2."""
    rng = np.random.default_rng(2)
    images = [smooth(rng) for _ in range(12)]
    images[5], images[6], images[7] = images[0] + rng.normal(0, 1, (SIDE, SIDE)), images[1] + rng.normal(0, 1, (SIDE, SIDE)), images[2].copy()
    rows = []
    for k, x in enumerate(images):
        x = np.clip(np.rint(x), 0, 255)
        a, d, p = plain_hashes(x)
        grp = {5: "g5", 6: "g1", 11: None}.get(k, f"g{k}")
        rows.append((k, "toy", f"s{k}", "x", k % 2 if k != 11 else None, True, grp, "val" if k == 5 else "train", k % 3, a, d, p, [int(v) for v in x.ravel()]))
    return spark.createDataFrame(rows, "i long, dataset string, sample_id string, label_name string, label int, used boolean, grp string, split string, fold int, ahash long, dhash long, phash long, thumb array<int>"), rows


def test_hashes_of_pixels(frame):
    df, rows = frame
    got = {r.i: r for r in df.select("i", near.cosine_hash(F.col("thumb"), SIDE).alias("p")).collect()}
    assert {k: r.p for k, r in got.items()} == {r[0]: r[11] for r in rows}


def test_find_duplicates(frame):
    df, rows = frame
    found = near.find_duplicates(df, "i", "thumb", size=SIDE)
    got = {(r.a, r.b): r for r in found.pairs.collect()}
    assert {(0, 5), (1, 6), (2, 2)} <= set(got)
    px = {r[0]: np.array(r[12], float).reshape(1, SIDE, SIDE) for r in rows}
    pop = lambda x: bin(x & (1 << 64) - 1).count("1")
    h = {r[0]: r[9:12] for r in rows}
    for (a, b), r in got.items():
        assert r.ssim == pytest.approx(near.structural_similarity(px[a], px[b])[0]) and r.ssim >= 0.95
        assert (r.ahash_dist, r.dhash_dist, r.phash_dist) == tuple(pop(x ^ y) for x, y in zip(h[a], h[b]))
    want = {(a, b) for a in h for b in h if a < b and any(pop(x ^ y) <= 4 for x, y in zip(h[a], h[b])) and near.structural_similarity(px[a], px[b])[0] >= 0.95}
    classes = {r.i: r.class_id for r in found.members.collect()}
    assert classes == {k: 2 if k == 7 else k for k in h}
    assert set(got) == {(classes[a], classes[b]) for a, b in want} and sum(r.pairs for r in got.values()) == len(want)
    assert got[0, 5].conflicts == 1 and got[0, 5].same_group == 0 and got[1, 6].same_group == 1
    assert found.candidates.count() >= len(want) - 1
    order = sorted(got)
    first = []
    for p in order:
        if got[p].group_id not in first:
            first.append(got[p].group_id)
    assert first == list(range(len(first)))
    only = near.find_duplicates(df, "i", "thumb", other_groups_only=True, size=SIDE)
    assert {(r.a, r.b) for r in only.pairs.collect()} == set(got) - {(1, 6)}


def test_a_leak_behind_the_first_copy(frame):
    """0 and 5 are copies of one group, 1 is a near copy of both: only the second copy leaks."""
    df, rows = frame
    rng = np.random.default_rng(9)
    image = np.clip(np.rint(smooth(rng)), 0, 255)
    other = np.clip(image + rng.integers(-1, 2, image.shape), 0, 255)
    make = lambda k, x, grp, split: (k, "toy", f"s{k}", "x", 0, True, grp, split, 1, *plain_hashes(x), [int(v) for v in x.ravel()])
    three = df.sparkSession.createDataFrame([make(0, image, "g1", "train"), make(5, image, "g1", "val"), make(9, other, "g2", "train")], df.schema)
    for apart in (False, True):
        got = {(r.a, r.b): (r.pairs, r.holdout, r.kfold) for r in near.find_duplicates(three, "i", "thumb", other_groups_only=apart, size=SIDE).pairs.collect()}
        assert got == {(0, 9): (2, 1, 0)} | ({} if apart else {(0, 0): (1, 0, 0)})


def test_leaks_of_both_kinds(frame):
    df, _ = frame
    pairs = df.sparkSession.createDataFrame([(0, 5), (1, 6), (3, 4), (3, 9), (10, 11)], "a long, b long")
    got = graph.split_leakage(pairs, df.select("i", "used", "grp", "split", "fold"), "a", "b", "i").collect()
    assert sorted((r.a, r.b, r.leak_type) for r in got) == [(0, 5, "holdout_split"), (3, 4, "kfold"), (10, 11, "kfold")]


def test_long_chains_and_cycles(spark):
    n = 60
    edges = [(k, k + 1) for k in range(n)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(n + 1)} | {k: 200 for k in (200, 201, 202)}


def test_hamming_at_four(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    rows = [(k, int(x)) for k, x in enumerate(base)]
    for k, x in enumerate(base):
        flips = rng.choice(64, int(rng.integers(0, 8)), replace=False)
        rows.append((100 + k, int(x ^ np.bitwise_xor.reduce(np.array([np.uint64(1) << np.uint64(f) for f in flips] or [np.uint64(0)], np.uint64)).view(np.int64))))
    got = hashing.hamming_pairs(spark.createDataFrame([*rows, (999, None)], "k long, h long"), "k", "h", 4).collect()
    pop = lambda x: bin(x & (1 << 64) - 1).count("1")
    want = {(a, b, pop(x ^ y)) for a, x in rows for b, y in rows if a < b and pop(x ^ y) <= 4}
    assert {(r.a, r.b, r.distance) for r in got} == want and len(got) == len(want)


def test_resolve_labels(spark):
    items = [("P1", 1, 1, "L"), ("P1", 2, 0, "R"), ("P2", 1, 1, "L"), ("P2", 2, 1, "L"), ("P3", 1, 1, "L"), ("P3", 2, 0, "L"), ("P4", 1, 1, "L"), ("P4", 2, 0, "R"), ("P5", 1, 1, "L"), ("P5", 2, 0, "R")]
    cases = [("P1", 1, "L", 1), ("P1", 2, "R", 1), ("P2", 1, "R", None), ("P3", 1, "L", 1), ("P3", 2, "L", 0), ("P4", 1, "L", 1), ("P5", 1, None, 1), ("P5", 2, "R", 0), ("P6", 1, "L", 1)]
    clinical = spark.createDataFrame(items, "patient string, ordinal int, label int, side string")
    asked = spark.createDataFrame(cases, "patient string, segment int, side_from_mask string, label_tumours_first int")
    got = {(r.patient, r.segment): (r.label, r.label_method, r.guess_agrees) for r in labels.resolve_labels(clinical, asked, "patient", "label", "side", "side_from_mask", "label_tumours_first").collect()}
    assert got == {
        ("P1", 1): (1, "by_side", True), ("P1", 2): (0, "by_side", False), ("P2", 1): (1, "uniform", None), ("P3", 1): (None, "ambiguous", None), ("P3", 2): (None, "ambiguous", None),
        ("P4", 1): (None, "count_mismatch", None), ("P5", 1): (None, "side_conflict", None), ("P5", 2): (0, "by_side", True), ("P6", 1): (None, "count_mismatch", None),
    }
    both = {f: {(r.patient, r.segment): (r.label, r.side) for r in labels.segment_labels(clinical, asked, "patient", "ordinal", "label", "segment", ["label", "side"], f).collect()} for f in (True, False)}
    assert both[True]["P1", 2] == (0, "R") and both[True]["P4", 1] == (None, None)
    flipped = spark.createDataFrame([("Q", 1, 0, "L"), ("Q", 2, 1, "R")], "patient string, ordinal int, label int, side string")
    two = spark.createDataFrame([("Q", 1), ("Q", 2)], "patient string, segment int")
    assert [labels.segment_labels(flipped, two, "patient", "ordinal", "label", "segment", ["label"], f).orderBy("segment").collect()[0].label for f in (True, False)] == [1, 0]
    agree = labels.side_agreement(spark.createDataFrame([("L", "L", "R"), ("R", "R", None), (None, "L", "L")], "s string, h1 string, h2 string"), "s", ["h1", "h2"])
    assert sorted(tuple(r) for r in agree.collect()) == [("h1", 2, 1.0), ("h2", 1, 0.0)]
    sides = spark.createDataFrame([(70.0, 100), (20.0, 100)], "c double, w int").select(labels.side_of(F.col("c"), F.col("w"), F.lit(0.5), F.lit(1.0)).alias("s"))
    assert [r.s for r in sides.collect()] == ["L", "R"]


def test_lookups(spark):
    t = spark.createDataFrame([("p", "v", 1, "a"), ("p", "v", 2, "b"), ("q", "v", 3, "c")], "k string, v string, n int, x string")
    rows = spark.createDataFrame([("p", "v"), ("z", "v")], "k string, v string")
    pick = lambda **o: sorted((r.k, r.x) for r in matching.lookup(rows, t, ["k", "v"], ["n"], **o).collect())
    assert pick() == [("p", "a"), ("z", None)] and pick(last=True, how="inner") == [("p", "b")]
    splits = spark.createDataFrame([("p", "train"), ("p", "val"), ("q", "train")], "k string, split string")
    assert sorted((r.k, r.split) for r in matching.assigned_split(rows, "k", splits).collect()) == [("p", "val"), ("z", None)]
    a = spark.createDataFrame([("P1", "7.000000-abc"), ("P1", "bad")], "p string, d string")
    b = spark.createDataFrame([("P1", "x/7-abc.dcm", 1), ("P1", "y/7-abc.dcm", 2), ("P2", "7-abc.dcm", 1)], "p string, f string, at int")
    got = matching.by_pattern(a, "d", r"(\d+)\.0+-(\w+)", b, "f", r"(\d+)-(\w+)\.dcm", ["p"], ["at"])
    assert sorted((r.d, r.f) for r in got.collect()) == [("7.000000-abc", "x/7-abc.dcm"), ("bad", None)]


def test_alignment(spark):
    schema = "fold int, image string, pos int, label int, prob double"
    left = spark.createDataFrame([(1, "a", 0, 0, 0.1), (1, "a", 1, 1, 0.2), (1, "b", 2, 0, 0.3), (2, "b", 0, 0, 0.4), (2, "c", 1, 1, 0.5)], schema)
    right = spark.createDataFrame([(1, "a", 0, 0, 0.6), (1, "a", 1, 1, 0.7), (1, "b", 2, 0, 0.8), (2, "c", 0, 1, 0.9), (2, "x", 1, 1, 0.9), (2, "b", 2, 0, 1.0), (3, "q", 0, 1, 1.0)], schema)
    args = (["fold"], "image", "pos", "label", "prob")
    got = matching.align_predictions(left, right, *args).collect()
    assert sorted((r.fold, r.image, r.occurrence, r.prob_a, r.prob_b) for r in got) == [(1, "a", 1, 0.1, 0.6), (1, "a", 2, 0.2, 0.7), (1, "b", 1, 0.3, 0.8), (2, "b", 1, 0.4, 1.0), (2, "c", 1, 0.5, 0.9)]
    for bad, what in ((right.where("image <> 'c'"), "missing"), (right.withColumn("label", F.lit(1)), "labels"), (right.where("not (fold = 1 and image = 'b')"), "not unique")):
        with pytest.raises(ValueError, match=what):
            matching.align_predictions(left, bad, *args)


def test_manifests(spark):
    of = lambda *r: spark.createDataFrame(r, "path string, digest string")
    e = of(("a/one.bin", "1"), ("two.bin", "2"))
    verdict = lambda a: (sorted(tuple(r) for r in matching.verify_manifest(e, a)[0].collect()), matching.verify_manifest(e, a)[1])
    assert verdict(e) == ([("a/one.bin", "ok"), ("two.bin", "ok")], "OK")
    assert verdict(of(("a/one.bin", "1"), ("two.bin", "x"), ("new", "3"))) == ([("a/one.bin", "ok"), ("new", "new"), ("two.bin", "changed")], "MISMATCH")
    assert verdict(of(("z", "1"), ("y", "2")))[1] == "OK (by content)" and verdict(of(("z", "1")))[1] == "MISMATCH"


def test_ranges_and_nearest(spark):
    stages = spark.createDataFrame([(1, 3, "head"), (2, 10, "top"), (3, 187, "all")], "stage int, epochs int, scope string")
    epochs = spark.createDataFrame([(k,) for k in (0, 2, 3, 12, 13, 199, 500)], "epoch int")
    assert [r.scope for r in matching.stage_of(epochs, "epoch", stages, "stage", "epochs", "scope").orderBy("epoch").collect()] == ["head", "head", "top", "top", "all", "all", "all"]
    rng = np.random.default_rng(1)
    table = [(int(g), float(v), k) for k, (g, v) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 40, 60)))]
    rows = [(int(g), float(v), k) for k, (g, v) in enumerate(zip(rng.integers(0, 4, 40), rng.integers(-5, 45, 40)))]
    got = matching.nearest_value(spark.createDataFrame(rows, "g int, z double, id int"), "z", spark.createDataFrame(table, "g int, at double, n int"), "at", ["g"], ["n"])
    for r in got.collect():
        near_ones = [t for t in table if t[0] == r.g]
        gap = min((abs(t[1] - r.z) for t in near_ones), default=None)
        assert (r["at"] is None) == (gap is None) and (gap is None or abs(r["at"] - r.z) == gap)
    assert got.count() == len(rows)


def test_greedy_match(spark):
    rng = np.random.default_rng(3)
    rows = [(int(w), int(a), int(b), int(rng.integers(0, 5))) for w in range(2) for a in range(6) for b in range(6)]
    got = matching.greedy_match(spark.createDataFrame(rows, "w int, a int, b int, n int"), "a", "b", "n", ["w"])
    want = set()
    for w in range(2):
        used = set()
        for n, a, b in sorted((-n, a, b) for v, a, b, n in rows if v == w and n):
            if ("a", a) not in used and ("b", b) not in used:
                used |= {("a", a), ("b", b)}
                want.add((w, a, b, -n))
    assert {tuple(r) for r in got.collect()} == want


def test_small_joins(spark):
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert [tuple(r) for r in matching.paired_by_name(files("a/x.png", "a/y.png"), files("b/x.png")).collect()] == [("x.png", "a/x.png", "b/x.png")]
    claimed = spark.createDataFrame([("d", 5, None), ("e", 1, 1)], "k string, n int, m int")
    observed = spark.createDataFrame([("d", 5, 2)], "k string, n int, m int")
    assert sorted((r.k, r.fact, r.status) for r in matching.claimed_and_observed(claimed, observed, "k", ["n", "m"]).collect()) == [("d", "m", "not claimed"), ("d", "n", "ok"), ("e", "m", "not observed"), ("e", "n", "not observed")]
    docs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "id long, src string")
    pairs = spark.createDataFrame([(1, 9)], "a long, b long")
    assert sorted(tuple(r) for r in matching.share_in_pairs(docs, "id", "src", pairs, "a", "b").collect()) == [("s", 2, 1, 0.5), ("t", 1, 0, 0.0)]
