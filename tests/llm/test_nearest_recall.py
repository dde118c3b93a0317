"""Recall of the curves against brute force, where windows are far narrower than the table."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.llm import curve_ann

N, DIM, K = 16_000, 64, 20


def table(spark, x, folder):
    held = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": held}), folder / "x.parquet")
    return spark.read.parquet(str(folder / "x.parquet")).repartition(6)


def vectors(kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(N, DIM))
    if kind == "clusters":
        x = rng.normal(size=(400, DIM))[rng.integers(0, 400, N)] + 0.25 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "log-normal lengths":
        x *= np.exp(rng.normal(size=(N, 1)))
    if kind == "hot":
        x[: N // 3] = x[0] + 1e-3 * rng.normal(size=(N // 3, DIM))
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["unit", "log-normal lengths", "hot"])
def test_recall(spark, kind, tmp_path):
    x = vectors(kind)
    df = table(spark, x, tmp_path)
    rows = curve_ann.nearest(df, df.where("vec_id % 20 = 0").select("vec_id"), k=K).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    x = x.astype(np.float64)
    assert set(found) == set(range(0, N, 20))
    hits = []
    for q, got in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        least = np.sort(s)[-K]
        assert len(got) == K and q not in got and all(abs(s[v] - z) < 1e-9 for v, z in got.items())
        hits.append(np.mean([s[v] >= least for v in got]))
    assert np.mean(hits) >= 0.9
