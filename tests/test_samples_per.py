"""Samples of several seeds in one pass are those of each seed alone."""

from corvane.operators import splits as S
from corvane.plans import splits as P


def test_same_as_one_by_one(spark):
    rows = [(k, None if k % 11 == 0 else 0 if k % 2 else k % 7) for k in range(3000)] + [(None, 3)]
    df = spark.createDataFrame(rows, "id int, g int").repartition(5)
    got = sorted(map(tuple, S.samples_per(df, ["g"], "id", 4, [9, 5, 7], "e", 3).collect()), key=str)
    want = [(r["id"], r["g"], e) for e, s in enumerate([9, 5, 7]) for r in S.sample_per(df, ["g"], "id", 4, s).collect()]
    assert got == sorted(want, key=str) and len(got) == 3 * 4 * 8


def test_no_hash_travels(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = P.k_per_group_epoch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.toString().splitlines()
    shuffles = [k for k, line in enumerate(lines) if "Exchange " in line]
    assert len(shuffles) == 2 and not any("md5" in line for line in lines[shuffles[-1] :])
    below = [line for k in shuffles for line in lines[k + 1 : k + 3]]
    assert below and not any("md5" in line for line in below)
