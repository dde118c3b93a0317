"""Leaks of exact copies are told for every document, not for leaking classes alone."""

from collections import Counter

from corvane.operators import copies
from corvane.plans import duplicates


def test_member_leaks(spark):
    rows = [(1, 1, "train"), (2, 1, "train"), (3, 1, "val"), (4, 1, None), (5, 5, "val"), (6, 6, None), (7, 6, None)]
    got = copies.member_leaks(spark.createDataFrame(rows, "k long, class_id long, split string"), "k")
    assert sorted((r["k"], r["copies"], r["leaks"]) for r in got.collect()) == [(1, 3, 1), (2, 3, 1), (3, 3, 2), (4, 3, 0), (5, 0, 0), (6, 1, 0), (7, 1, 0)]


def test_every_document_has_a_row(spark, tmp_path):
    texts = ["a", "a", "b", None, None, "a"]
    docs = [(k, t, f"s{k % 3}" if k else None, "en") for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in duplicates.leak_exact_copies(spark, str(tmp_path)).collect()}
    assert [got[k]["class_id"] for k in range(6)] == [0, 0, 2, 3, 4, 0]
    sides = {k: r["split"] for k, r in got.items()}
    for k, r in got.items():
        others = Counter(sides[j] for j, t in enumerate(texts) if j != k and t is not None and t == texts[k])
        assert (r["copies"], r["leaks"]) == (sum(others.values()), sum(n for s, n in others.items() if s != sides[k]))
