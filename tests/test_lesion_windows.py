"""Lesions come from windows in the JVM, with the first error of a case."""

from corvane.operators import cases


def test_lesion_windows(spark):
    nan = float("nan")
    rows = [(1, 3, 2.0), (1, 4, 5.0), (1, 5, 5.0), (1, 7, 1.0), (1, 8, 0.0), (1, 9, nan), (1, 10, 4.0), (2, 1, 1.0), (2, 1, 2.0), (2, 9, -1.0), (3, 2, -1.0), (3, 4, 1.0), (3, 4, 1.0), (4, None, 1.0), (5, 1, 0.0), (6, 1, None), (None, 2, 1.5)]
    out = cases.lesion_rows(spark.createDataFrame(rows, "c int, z int, n double"), "c", "z", "n")
    assert "PythonUDTF" not in out._jdf.queryExecution().executedPlan().toString()
    missing = "slice or area missing or negative"
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] or 0, r[1] or 0)) == [
        (None, 1, 2, 2, 2, 1.5, None), (1, 1, 3, 5, 4, 12.0, None), (1, 2, 7, 7, 7, 1.0, None), (1, 3, 10, 10, 10, 4.0, None),
        (2, None, None, None, None, None, "slice 1 twice"), (3, None, None, None, None, None, missing), (4, None, None, None, None, None, missing), (6, None, None, None, None, None, missing),
    ]
