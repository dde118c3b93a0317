"""Catalogue pieces on small records."""

from pyspark.sql import functions as F

from corvane.sources import adapters as A


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_boxes(spark):
    df = spark.createDataFrame([("a", "[1, 2, 10, 20]"), ("b", "[1, 2]"), ("c", None), ("d", "x")], "i string, t string").withColumn("box", A.box_of_list(F.col("t")))
    assert {r.i: tuple(r.box) if r.box else None for r in df.collect()} == {"a": (1, 2, 11, 22), "b": None, "c": None, "d": None}
    c = spark.createDataFrame([("m", 535, 425, 10), ("m", 100, 100, 5), ("n", None, 1, 1)], "i string, x int, y int, r int").withColumn("box", A.box_of_circle(F.col("x"), F.col("y"), F.col("r"), 1024))
    assert [(r.i, tuple(r.box)) for r in A.box_around(c, ["i"], "box").collect()] == [("m", (95, 589, 545, 929))]
    px = spark.createDataFrame([("a", 2, 3, 9), ("a", 4, 7, 9), ("a", 0, 0, 1)], "i string, y int, x int, v int")
    assert [(tuple(r.box), r.n) for r in A.box_of_pixels(px, ["i"], F.col("v") > 5).collect()] == [((3, 2, 8, 5), 2)]
    b = spark.createDataFrame([(1, True), (2, False)], "i int, right boolean").withColumn("box", F.expr(f"cast(named_struct('x0', 500, 'y0', 100, 'x1', 550, 'y1', 150) as {A.BOX})"))
    out = {r.i: tuple(r.b) for r in b.select("i", A.padded_box(F.col("box"), 10, 64, F.lit(600), F.lit(400), F.col("right")).alias("b")).collect()}
    assert out == {1: (40, 90, 110, 160), 2: (490, 90, 560, 160)} and out[1][2] - out[1][0] == 70
    small = b.select(A.padded_box(F.expr(f"cast(named_struct('x0', 0, 'y0', 0, 'x1', 4, 'y1', 4) as {A.BOX})"), 1, 20, F.lit(600), F.lit(400)).alias("b")).first().b
    assert small.x1 - small.x0 <= 20 and small.x0 == 0


def test_labels(spark):
    lines = spark.createDataFrame([("m1", 1, None, "CALC"), ("m1", 2, "B", "CIRC"), ("m1", 3, "M", "CIRC"), ("m2", 1, None, "NORM")], "i string, line int, sev string, kind string")
    assert found(A.label_by_lines(lines, "i", "line", "sev", {"B": 0, "M": 1}, None, "kind").fillna(-1), "i", "label", "findings") == [("m1", 0, "CALC|CIRC"), ("m2", -1, "NORM")]
    kinds = spark.createDataFrame([("a", "B"), ("a", "M"), ("b", "N"), ("b", "N"), ("c", "X")], "i string, k string")
    assert found(A.label_by_priority(kinds, "i", "k", [("M", "malignant"), ("B", "benign")], "undefined", "N"), "i", "label_name", "n_findings", "kinds") == [("a", "malignant", 2, "B|M"), ("b", "normal", 0, "N"), ("c", "undefined", 1, "X")]
    wide = spark.createDataFrame([("p", 1, "left", 7, "right"), ("q", None, None, 0, "R ")], "p string, l1 int, s1 string, l2 int, s2 string")
    rows = A.unpivoted(wide, ["p"], [{"label": "l1", "side": "s1"}, {"label": "l2", "side": "s2"}], "label", [0, 1])
    assert found(rows.withColumn("side", A.side_letter(F.col("side"))), "p", "ordinal", "label", "side") == [("p", 1, 1, "L"), ("q", 2, 0, "R")]
    flags = spark.createDataFrame([("a", True), ("a", None), ("b", None)], "i string, f boolean")
    assert found(A.any_positive(flags, ["i"], F.col("f")), "i", "malignant", "n") == [("a", True, 2), ("b", False, 1)]
    codes = spark.createDataFrame([(1,), (2,), (3,)], "c int").select(A.recoded(F.col("c"), {1: 0, 2: 1}).alias("r"))
    assert [r.r for r in codes.collect()] == [0, 1, None]


def test_files_and_keys(spark):
    files = spark.createDataFrame([("d", "d/2.png", 5), ("d", "d/1.png", 5), ("d", "d/3.png", 9), ("e", "e/1.png", 1)], "f string, p string, n int")
    assert found(A.smallest_and_largest(files, "f", F.col("n"), "p").fillna("-"), "f", "smallest", "largest") == [("d", "d/1.png", "d/3.png"), ("e", "e/1.png", "-")]
    paths = spark.createDataFrame([(1, "x/y/A/1.dcm", "x/y/B/1.dcm"), (2, "x/y/C/1.dcm", "x/y/C/2.dcm"), (3, "x", None)], "i int, a string, b string")
    assert found(A.indexed_paths(paths, ["a", "b"], 3), "i", "folder") == [(1, "A"), (1, "B"), (2, "C")]
    r = spark.range(1).select(A.frame_name(F.lit("f"), F.lit(7), 3).alias("a"), A.parsed_key(F.lit("s1_abc_d@9@x")).alias("b"), A.parsed_key(F.lit("plain")).alias("c"), A.years_of_days(F.lit(730.5)).alias("d")).first()
    assert tuple(r) == ("f007", "abc_d", "plain", 2.0)
    t = spark.createDataFrame([(" IMG001 ", " calcificaton "), ("note", "x"), ("img2", "norm")], "i string, c string")
    assert found(A.tidy_codes(t, "i", "c", {"CALCIFICATON": "CALC"}), "i", "c") == [("IMG001", "CALC"), ("img2", "NORM")]
    peaks = spark.createDataFrame([("a", 3, 5), ("a", 1, 5), ("a", 2, 4)], "l string, z int, area int")
    assert found(A.peak_rows(peaks, ["l"], "area", "z"), "l", "z", "area") == [("a", 1, 5)]
    tagged = A.with_modality(spark.createDataFrame([("s",), ("t",)], "source string"), "source", spark.createDataFrame([("s", "mri")], "source string, modality string"))
    assert found(tagged.fillna("-"), "source", "modality") == [("s", "mri"), ("t", "-")]
