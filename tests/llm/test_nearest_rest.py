"""Nearest vectors that the curves leave out are found by the exact check."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.llm import curve_ann

N, DIM, K = 3000, 24, 10


@pytest.mark.parametrize("kind", ["unit", "lengths"])
def test_exact(spark, kind, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, DIM))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(N, 1)))
    x = x.astype(np.float32)
    held = pa.ListArray.from_arrays(pa.array((np.arange(N + 1) * DIM).astype(np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(N), "embedding": held}), tmp_path / "x.parquet")
    df = spark.read.parquet(str(tmp_path / "x.parquet")).repartition(4)
    # few curves, fewer copies, a low recall and two looks
    rows = curve_ann.nearest(df, df.where("vec_id % 20 = 0"), k=K, curves=12, copies=3, recall=0.5, sample=300, compared=300).collect()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in rows}
    x = x.astype(np.float64)
    want = {}
    for q in range(0, N, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want |= {(q, i + 1): int(v) for i, v in enumerate(np.argsort(-s, kind="stable")[:K])}
    assert got == want


def test_looks_grow_fourfold():
    for n in (10, 80_000, 80_001, 10**6, 10**8):
        looks = curve_ann._looks(n, 20_000)
        assert looks[-1] == 1 and looks[0] * n <= 80_000 and all(b == 4 * a for a, b in zip(looks, looks[1:], strict=False))
