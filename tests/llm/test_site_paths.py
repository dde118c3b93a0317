"""Host and path posteriors on documents with real hosts and paths."""

import pytest

from corvane.llm import site_quality


def test_sparse_paths_shrink_to_their_host(spark):
    groups = [("a.org", "/good", 60, 1), ("a.org", "/dense", 30, 0), ("a.org", "/sparse", 1, 0), ("b.org", "/x", 40, 0), ("b.org", "/one", 1, 1)]
    rows = [(host, path, label) for host, path, n, label in groups for _ in range(n)]
    docs = spark.createDataFrame([(i, f"Text {i} has {'a few ' * (i % 7)}words.", h, p) for i, (h, p, _) in enumerate(rows)], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, y) for i, (_, _, y) in enumerate(rows)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in site_quality.site_quality(docs, labels, host_col="host", path_col="path").collect()}
    of = {(h, p): got[i] for i, (h, p, _) in enumerate(rows)}
    host = of["a.org", "/good"]["host_posterior"]
    sparse, dense = of["a.org", "/sparse"]["path_posterior"], of["a.org", "/dense"]["path_posterior"]
    assert 0 < dense < sparse < host < of["a.org", "/good"]["path_posterior"] < 1
    strength = sparse / (host - sparse)  # of the law (k + host * strength) / (n + strength), from k = 0, n = 1
    assert dense == pytest.approx(host * strength / (30 + strength))
    other = of["b.org", "/one"]
    assert other["path_posterior"] == pytest.approx((1 + other["host_posterior"] * strength) / (1 + strength))
