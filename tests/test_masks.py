"""Masks as runs against plain labelling, morphology and local means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import masks as M

H, W = 11, 13


def plain_labels(mask, diagonal=False):
    out, count = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        count += 1
        todo = [(y, x)]
        out[y, x] = count
        while todo:
            a, b = todo.pop()
            for da in (-1, 0, 1):
                for db in (-1, 0, 1):
                    p, q = a + da, b + db
                    if (diagonal or not da * db) and 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                        out[p, q] = count
                        todo.append((p, q))
    return out, count


def plain_dilated(mask, times):
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return mask


def plain_eroded(mask, times):
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return mask


def plain_filled(mask):
    rest, n = plain_labels(~mask)
    edge = set(rest[0]) | set(rest[-1]) | set(rest[:, 0]) | set(rest[:, -1])
    return mask | (np.isin(rest, [k for k in range(1, n + 1) if k not in edge]))


def largest(mask):
    labels, n = plain_labels(mask)
    return labels == 1 + np.argmax([(labels == k).sum() for k in range(1, n + 1)]) if n else mask


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(4)
    out = {f"i{k}": rng.random((H, W)) < p for k, p in enumerate((0.2, 0.4, 0.55, 0.7, 0.9))}
    out["none"], out["all"] = np.zeros((H, W), bool), np.ones((H, W), bool)
    ring = np.zeros((H, W), bool)
    ring[2:9, 2:9] = True
    ring[3:8, 3:8] = False
    out["ring"] = ring
    return out


@pytest.fixture(scope="module")
def runs(spark, images):
    df = spark.createDataFrame([(k, [bool(v) for v in m.ravel()]) for k, m in images.items()] + [("empty", []), ("null", None)], "id string, m array<boolean>").repartition(3)
    return M.mask_runs(df, "id", F.col("m"), W).cache()


@pytest.fixture(scope="module")
def sizes(spark, images):
    return spark.createDataFrame([(k, W, H) for k in images], "image string, width int, height int")


def drawn(df, images):
    out = {k: np.zeros((H, W), bool) for k in images}
    for r in df.collect():
        assert not out[r.image][r.y, r.x0 : r.x1 + 1].any()  # runs don't overlap
        out[r.image][r.y, r.x0 : r.x1 + 1] = True
    return out


def same(got, images, plain):
    for k, m in images.items():
        assert (got[k] == plain(m)).all(), k


def test_runs(runs, images):
    same(drawn(runs, images), images, lambda m: m)


@pytest.mark.parametrize("diagonal", [False, True])
def test_components(runs, images, diagonal):
    table = M.component_table(M.labelled(runs, diagonal)).collect()
    for k, m in images.items():
        labels, n = plain_labels(m, diagonal)
        want = []
        for c in range(1, n + 1):
            ys, xs = np.nonzero(labels == c)
            want.append((c - 1, len(ys), ys.min(), ys.max(), xs.min(), xs.max()))
        assert sorted((r.component, r.area, r.top, r.bottom, r["first"], r["last"]) for r in table if r.image == k) == want


def test_morphology(runs, images, sizes):
    same(drawn(M.largest_component(runs), images), images, largest)
    same(drawn(M.inverted(runs, sizes), images), images, lambda m: ~m)
    same(drawn(M.filled(runs, sizes), images), images, plain_filled)
    same(drawn(M.opened(runs, sizes, 1), images), images, lambda m: plain_dilated(plain_eroded(m, 1), 1))
    for times in (1, 2):
        same(drawn(M.dilated(runs, sizes, times), images), images, lambda m: plain_dilated(m, times))  # noqa: B023
        same(drawn(M.eroded(runs, sizes, times), images), images, lambda m: plain_eroded(m, times))  # noqa: B023
    labels = lambda m: plain_labels(m)[0]
    keep = lambda m: np.isin(labels(m), [c for c in range(1, labels(m).max() + 1) if 2 <= (labels(m) == c).sum() <= 9])
    same(drawn(M.within_areas(runs, 2, 9), images), images, keep)

    def region(m):
        out = plain_filled(largest(plain_dilated(plain_eroded(m, 2), 2)))
        return out if out.sum() >= 0.02 * out.size else np.ones_like(m)

    same(drawn(M.content_region(runs, sizes), images), images, region)


def test_geometry(spark, runs, images, sizes):
    half = spark.createDataFrame([(k, y, 0, 6) for k in images for y in range(H)], "image string, y int, x0 int, x1 int")
    got = {r.image: r for r in M.geometry(runs, sizes, half).collect()}
    assert set(got) == {k for k, m in images.items() if m.any()}
    for k, r in got.items():
        m = images[k]
        ys, xs = np.nonzero(m)
        edge = (m & ~plain_eroded(m, 1)).sum()
        assert (r.area, r.components, r.box_width, r.box_height, r.edge) == (m.sum(), plain_labels(m)[1], np.ptp(xs) + 1, np.ptp(ys) + 1, edge)
        assert (r.area_share, r.cx, r.cy, r.box_fill) == tuple(map(pytest.approx, (m.mean(), xs.mean() / W, ys.mean() / H, m.sum() / (r.box_width * r.box_height))))
        assert (r.outside, r.compactness) == (pytest.approx(m[:, 7:].sum() / m.sum()), pytest.approx(edge**2 / (4 * np.pi * m.sum())))


def test_local_means_and_overlays(spark):
    rng = np.random.default_rng(5)
    px = rng.integers(0, 256, (2, H, W)).astype(float)
    df = spark.createDataFrame([(k, [float(v) for v in x.ravel()]) for k, x in enumerate(px)], "id int, p array<double>")
    for size in (3, 5, 15):
        got = np.zeros((2, H, W))
        for r in M.local_means(df, "id", F.col("p"), W, size).collect():
            got[r.image, r.y, r.x] = r["mean"]
        half = size // 2
        for k in range(2):
            pad = np.pad(px[k], half, mode="symmetric")
            want = np.array([[pad[y : y + size, x : x + size].mean() for x in range(W)] for y in range(H)])
            assert np.allclose(got[k], want)
    found = {(r.image, r.y, x) for r in M.bright_overlays(df, "id", F.col("p"), W, 3).collect() for x in range(r.x0, r.x1 + 1)}
    pad = np.pad(px, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    mean = sum(pad[:, a : a + H, b : b + W] for a in range(3) for b in range(3)) / 9
    assert found == {tuple(int(v) for v in at) for at in np.argwhere((px > 200) & (px > mean + 30))}


def plain_lines(boxes):
    glyphs = [b for b in boxes if 6 <= b[3] - b[2] <= 24 and 2 <= b[1] - b[0] <= 20 and 0.15 <= b[4] / ((b[3] - b[2]) * (b[1] - b[0])) <= 0.85]
    glyphs.sort(key=lambda b: (b[0], b[2], b[1], b[3]))
    parent = list(range(len(glyphs)))
    find = lambda k: k if parent[k] == k else find(parent[k])
    for a, p in enumerate(glyphs):
        for b in range(a + 1, len(glyphs)):
            q, h = glyphs[b], p[3] - p[2]
            if q[0] - p[1] <= 1.2 * h and abs((p[2] + p[3]) - (q[2] + q[3])) / 2 <= 0.3 * h and abs(h - (q[3] - q[2])) <= 0.4 * h:
                parent[find(b)] = find(a)
    n = [find(k) for k in range(len(glyphs))]
    return sum(n.count(k) >= 3 for k in set(n))


def test_text_lines(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for image in range(8):
        boxes = set()
        for _ in range(60):
            x, y, w, h = rng.integers(0, 400), rng.integers(0, 120), rng.integers(1, 24), rng.integers(4, 28)
            boxes.add((int(x), int(x + w), int(y), int(y + h), int(w * h * rng.choice([0.1, 0.5, 0.6, 0.95]))))
        y, h = int(rng.integers(200, 260)), 12  # a line of text, and two glyphs that are none
        boxes |= {(20 * k, 20 * k + 9, y + k % 2, y + h, 50) for k in range(6)} | {(300, 309, 300, 312, 50), (315, 324, 300, 312, 50)}
        rows += [(image, *b) for b in boxes]
        want[image] = plain_lines(list(boxes))
    table = spark.createDataFrame(rows, "image int, x0 int, x1 int, y0 int, y1 int, area int")
    assert {r.image: r.lines for r in M.text_lines(table, "image").collect()} == {k: n for k, n in want.items() if n} and any(want.values())


def test_crosses_with_partners(spark):
    """Two crosses of about a size, one of another, a block and a bar."""
    px = np.zeros((80, 120), bool)

    def cross(y, x, side):
        px[y + side // 2, x : x + side] = True
        px[y : y + side, x + side // 2] = True

    cross(5, 5, 9), cross(5, 40, 11), cross(30, 60, 21)
    px[60:70, 10:20] = True
    px[60:62, 60:90] = True
    df = spark.createDataFrame([("a", [bool(v) for v in px.ravel()])], "id string, m array<boolean>")
    glyphs = M.cross_glyphs(M.labelled(M.mask_runs(df, "id", F.col("m"), 120)))
    assert sorted((r.h, r.w) for r in glyphs.collect()) == [(9, 9), (11, 11), (21, 21)]
    assert [tuple(r) for r in M.paired_glyphs(glyphs).collect()] == [("a", 2)]


def test_colours_labels_and_channels(spark):
    red = np.zeros((20, 30), int)
    red[2:12, 3:13], red[15, 25] = 200, 220
    flat = lambda a: [int(v) for v in a.ravel()]
    df = spark.createDataFrame([("a", flat(red), flat(red // 4), flat(red // 4)), ("b", flat(red), flat(red), flat(red))], "id string, r array<int>, g array<int>, b array<int>")
    sizes = spark.createDataFrame([("a", 30, 20), ("b", 30, 20)], "image string, width int, height int")
    runs = M.colour_parts(df, "id", F.col("r"), F.col("g"), F.col("b"), 30, 0.4, 0.3)
    region = spark.createDataFrame([(k, y, 0, 7) for k in "ab" for y in range(20)], "image string, y int, x0 int, x1 int")
    got = {r.image: tuple(r)[1:] for r in M.colour_shares(runs, sizes, region, 0.01).collect()}
    assert got == {"a": (101 / 600, 50 / 160, 1), "b": (0.0, 0.0, 0)}
    bright = M.mask_runs(df, "id", F.transform("r", lambda v: v > 150), 30)
    body = spark.createDataFrame([("a", 0, 20, 29), ("b", 0, 20, 29)], "image string, y int, x0 int, x1 int")
    labels = {r.image: (r.labels, r.label_share) for r in M.outside_labels(bright, body, sizes, 10, 20, 90).collect()}
    grown = plain_dilated(np.pad(np.ones((1, 10), bool), ((0, 19), (20, 0))), 10)
    n = ((red > 150) & ~grown)[2:12, 3:13].sum()
    assert labels == {k: (1, n / 600) if 20 <= n <= 90 else (0, 0.0) for k in "ab"}
    told = {r.id: (r.peak_channel, r.enhancement) for r in M.channel_summary(df.where("id = 'a'"), "id", ["g", "r", "b"]).collect()}
    assert told["a"] == (1, pytest.approx(red.mean() / (red // 4).mean()))
