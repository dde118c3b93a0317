"""Partners of glyphs: nulls, many of one size, and parts whose number follows the glyphs."""

from corvane.operators import masks as M


def test_partners(spark, monkeypatch):
    rows = [(i, h, w) for i in (1, 2, None) for h, w in ((10, 10), (14, 14), (30, 30))] + [(3, 5, 5)] * 3 + [(4, 5, 5), (4, 10, 5), (5, None, 5), (5, None, 5)]
    glyphs = spark.createDataFrame(rows, "image int, h int, w int")
    want = {(1, 2), (2, 2), (None, 2), (3, 3)}
    assert {tuple(r) for r in M.paired_glyphs(glyphs).collect()} == want
    monkeypatch.setattr(M, "GLYPHS", 1)
    out = M.paired_glyphs(glyphs)
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f", {len(rows)}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
