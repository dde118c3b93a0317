"""Image profiles and level tables against small plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import images as I
from corvane.operators import levels as V


def flood(mask, diagonal=False):
    """Sets of pixels of the connected parts, by search."""
    left, parts = set(zip(*np.nonzero(mask))), []
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    while left:
        stack, part = [left.pop()], set()
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            for a, b in steps:
                if (y + a, x + b) in left:
                    left.remove((y + a, x + b))
                    stack.append((y + a, x + b))
        parts.append(frozenset(part))
    return set(parts)


@pytest.mark.parametrize("diagonal", [False, True])
def test_parts(diagonal):
    rng = np.random.default_rng(1)
    for share in (0.2, 0.45, 0.6, 0.9):
        for _ in range(15):
            mask = rng.random((13, 17)) < share
            parts, n = I.label_parts(mask, diagonal)
            assert {frozenset(zip(*np.nonzero(parts == k))) for k in range(1, n + 1)} == flood(mask, diagonal) and ((parts > 0) == mask).all()


def test_shapes():
    mask = np.zeros((12, 12), bool)
    mask[2:9, 2:9] = True
    mask[5, 5] = False
    mask[10, 10] = True
    assert I.filled(mask)[5, 5] and I.filled(mask).sum() == mask.sum() + 1
    assert I.largest_part(mask).sum() == 48 and I.opened(mask, 1)[10, 10] == False  # noqa: E712
    assert I.shrunk(mask).sum() == 25 - 1 - 4 and I.grown(mask & (np.indices(mask.shape)[0] == 10)).sum() == 5
    x = np.random.default_rng(0).random((9, 11))
    p = np.pad(x, 2, mode="symmetric")
    assert np.allclose(I.local_mean(x, 5), [[p[y : y + 5, z : z + 5].mean() for z in range(11)] for y in range(9)])
    assert 60 < I.otsu(np.concatenate([np.full(50, 20.0), np.full(70, 200.0), [60.0]])) < 200 or I.otsu(np.array([20.0] * 50 + [200.0] * 70)) >= 20


def picture(seed, h=64, w=80):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(np.rint(90 + 60 * np.sin(x / 9) * np.cos(y / 7) + rng.normal(0, 8, (h, w))), 0, 255)


def test_profile(spark):
    good = picture(1)
    mask = np.zeros(good.shape, int)
    mask[20:40, 30:50] = 1
    rows = [(1, 64, 80, 8, "mri", good.ravel().tolist(), mask.ravel().tolist(), None, None), (2, 64, 80, 8, "mri", good.ravel().tolist(), mask[::2, ::2].ravel().tolist(), 32, 40), (3, 64, 80, 8, "ultrasound", (good + 0).ravel().tolist(), None, None, None), (4, 64, 80, 8, "mri", [1.0], None, None, None), (5, 4, 4, 12, None, [4095.0] * 16, [0] * 16, None, None), (6, 64, 80, 8, "mri", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, height int, width int, bits int, modality string, pixels array<double>, mask array<int>, mask_height int, mask_width int")
    got = {r.id: r for r in I.profile(df, "id", masked=True).collect()}
    r = got[1]
    p = np.pad(good, 1, mode="symmetric")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * good
    n = np.bincount(good.astype(int).ravel(), minlength=256) / good.size
    k = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]])
    noise = np.sqrt(np.pi / 2) * np.mean([abs((good[y : y + 3, x : x + 3] * k).sum()) for y in range(62) for x in range(78)]) / 6
    want = {"brightness": good.mean(), "contrast": good.std(ddof=1), "sharpness": lap.var(), "entropy": -(n[n > 0] * np.log2(n[n > 0])).sum(), "noise_sigma": noise, "snr": good.mean() / noise, "roi_fraction": 1.0, "mask_area_share": 400 / 5120, "mask_components": 1, "mask_width": 20, "mask_height": 20, "mask_cx": 39.5 / 80, "mask_cy": 29.5 / 64, "mask_fill": 1.0, "mask_perimeter": 76, "mask_compactness": 76**2 / (4 * np.pi * 400), "mask_outside_share": 0.0}
    assert {c: r[c] for c in want} == pytest.approx(want)
    assert got[2].mask_shape_mismatch and got[2].mask_area_share == pytest.approx(400 / 5120) and not r.mask_shape_mismatch
    assert got[3].speckle_snr is not None and got[3].mask_present is None and 0 < got[3].high_frequency_share < 1
    assert got[4].load_error and got[6].load_error and got[4].brightness is None
    assert got[5].brightness == 255 and got[5].spectral_slope is None and got[5].mask_present is False and got[5].native_max == 4095
    near = [bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in zip(I.hashes(good), I.hashes(np.clip(good + np.random.default_rng(5).normal(0, 2, good.shape), 0, 255)))]
    assert max(near) <= 8 and r.ahash == I.hashes(good)[0]


def levels_of(spark, images):
    rows = [(k, int(v), int(n)) for k, x in images.items() for v, n in zip(*np.unique(x, return_counts=True))]
    return spark.createDataFrame(rows, "image string, level int, n long")


def test_matching(spark):
    a, b = picture(1).astype(int), (picture(2) // 2).astype(int)
    df, ref = levels_of(spark, {"a": a, "b": b}), levels_of(spark, {"b": b}).select("level", "n")
    got = {(r.image, r.level): r.mapped for r in V.matched(df, ref, "image", "level", "n").collect()}
    assert all(v == k[1] for k, v in got.items() if k[0] == "b")
    s, sn = np.unique(a, return_counts=True)
    t, tn = np.unique(b, return_counts=True)
    want = np.interp(np.cumsum(sn) / sn.sum(), np.cumsum(tn) / tn.sum(), t)
    assert all(abs(got["a", int(v)] - w) <= 0.5 + 1e-9 for v, w in zip(s, want))
    lut = {(r.image, r.level): r.mapped for r in V.windowed(df, "image", "level", "n", 0.05, 0.9).collect()}
    lo, hi = np.percentile(a, [5, 90])
    assert all(lut["a", int(v)] == int(np.clip(np.round((v - lo) / (hi - lo) * 255), 0, 255)) for v in s)
    flat = levels_of(spark, {"f": np.full(9, 7)})
    assert [r.mapped for r in V.windowed(flat, "image", "level", "n").collect()] == [7]
    even = {r.level: r.mapped for r in V.equalised(df.where("image = 'a'"), "image", "level", "n").collect()}
    assert even[int(s[0])] == 0 and even[int(s[-1])] == 255
    pixels = spark.createDataFrame([("a", 0, 0, int(s[0]))], "image string, y int, x int, level int")
    assert V.applied(pixels, V.equalised(df.where("image = 'a'"), "image", "level", "n"), "image", "level").first().level == 0


def test_fuzzy_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 3, 500) for c in (20, 120, 230)]).round().astype(int)
    rows = V.fuzzy_clusters(levels_of(spark, {"a": x, "b": 255 - x}), "image", "level", "n").collect()
    for image, centres in (("a", (20, 120, 230)), ("b", (25, 135, 235))):
        got = sorted({(r.cluster, round(r.centre, 6)) for r in rows if r.image == image})
        assert [c for c, _ in got] == [0, 1, 2] and all(abs(c - w) <= 2 for (_, c), w in zip(got, centres))
    total = {}
    for r in rows:
        total[r.image, r.level] = total.get((r.image, r.level), 0) + r.membership
    assert all(abs(v - 1) < 1e-9 for v in total.values())
