"""Sources, sinks and projections on files and small tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.functions import projections as P
from corvane.functions import scalar
from corvane.sources import sinks, tables


def put(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_listing(spark, tmp_path):
    put(tmp_path / "a" / "x.PNG")
    put(tmp_path / "b.nii.gz")
    (tmp_path / "c.nii.gz").mkdir()
    got = tables.files_under(spark, str(tmp_path), (".png", ".nii.gz"))
    assert [r[0].rsplit("/", 1)[1] for r in found(got, "path", "length")] == ["x.PNG", "b.nii.gz"]
    assert tables.files_under(spark, str(tmp_path / "nothing")).count() == 0


def test_class_folders_and_masks(spark, tmp_path):
    for name in ("benign/a.png", "benign/a_mask.png", "benign/a_mask_1.png", "benign/b.png", "malignant/a.png"):
        put(tmp_path / name)
    files = tables.files_under(spark, str(tmp_path))
    assert found(tables.class_folders(files), "label", "stem") == [("benign", "a"), ("benign", "b"), ("malignant", "a")]
    assert found(tables.paired_images(files), "label", "stem", "masks") == [("benign", "a", 2)]
    manifest = sinks.slot_manifest(tables.class_folders(files), {"benign": 0}, slot=1)
    assert manifest.columns == ["img1", "img2", "img3", "label"] and found(manifest, "img1", "label") == [("MISSING", 0)] * 2
    with pytest.raises(ValueError):
        sinks.slot_manifest(tables.class_folders(files), {"other": 1})


def test_paths(spark, tmp_path):
    for name in ("train/0/p1/s1.npy", "train/1/p2/s7.npy", "test/0/p3/s2.txt"):
        put(tmp_path / name)
    got = tables.path_parts(tables.files_under(spark, str(tmp_path)), ("split", "class", "patient"), ".npy")
    assert found(got, "split", "class", "patient", "stem") == [("train", "0", "p1", "s1"), ("train", "1", "p2", "s7")]
    for k in (10, 2, 1):
        put(tmp_path / "case" / f"dce_aqc_{k}.nii")
    numbered = tables.numbered_files(tables.files_under(spark, str(tmp_path / "case")), r"aqc_(\d+)")
    assert found(numbered, "place", "number", "of") == [(1, 1, 3), (2, 2, 3), (3, 10, 3)]


def test_text_sources(spark, tmp_path):
    put(tmp_path / "semi.csv", "﻿Image; Label\nCHCO_000.png;Benign\nCHVI_005.png;Benign \n")
    assert found(tables.semicolon_csv(spark, str(tmp_path / "semi.csv")), "Image", "Label") == [("CHCO_000.png", "Benign"), ("CHVI_005.png", "Benign")]
    put(tmp_path / "info.txt", "mdb001 G CIRC B 535 425 197\nmdb003 D NORM\n\n")
    got = tables.records(spark, str(tmp_path / "info.txt"), ("ref", "tissue", "kind", "severity", "x"), 3)
    assert found(got.fillna("-"), "ref", "severity", "x") == [("mdb001", "B", "535"), ("mdb003", "-", "-")]
    put(tmp_path / "ids.txt", "1.2 1.3\n\n 1.2\n")
    assert found(tables.id_list(spark, str(tmp_path / "ids.txt")), "id") == [("1.2",), ("1.3",)]
    put(tmp_path / "t.csv", "id,n\na,1\nb,x\n")
    assert tables.csv_table(spark, str(tmp_path / "t.csv"), "id string, n int").count() == 2
    put(tmp_path / "s.csv", "title,\nName, Age\nann,3\n,\n")
    assert found(tables.sheet(spark, str(tmp_path / "s.csv"), 1), "Name", "Age") == [("ann", "3")]
    put(tmp_path / "log.txt", "2024-01-01 00:00:00 START a\n2024-01-01 00:01:54 EXIT a\n2024-01-01 01:00:00 START b\nnoise\n")
    assert sorted((r.command, r.seconds) for r in tables.job_durations(tables.job_log(spark, str(tmp_path / "log.txt"))).collect()) == [("a", 114), ("b", None)]


def test_json_sources(spark, tmp_path):
    put(tmp_path / "r.json", json.dumps({"b": {"license": "x", "backup": ["p"]}, "a": {"license": None, "backup": []}}))
    got = tables.registry(spark, str(tmp_path / "r.json"), "struct<license:string,backup:array<string>>")
    assert [r.name for r in got.collect()] == ["a", "b"] and got.columns == ["name", "license", "backup"]
    put(tmp_path / "run.json", json.dumps({"per_fold": [{"auc": 0.9}, {"auc": 0.8}], "summary": {}}))
    assert found(tables.run_results(spark, str(tmp_path / "run.json"), "struct<auc:double>"), "fold", "auc") == [(1, 0.9), (2, 0.8)]
    root = str(tmp_path / "pred")
    spark.createDataFrame([(1, 0.5)], "image long, prob double").write.parquet(f"{root}/run=a/fold=1")
    rows, missing = tables.predictions(spark, root, ["a"], [1, 2], "image long, prob double")
    assert found(rows, "run", "fold", "image") == [("a", 1, 1)] and missing == [("a", 2)]


def test_validity_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, [1], None, [2]), (2, None, None, None)], "id int, pre array<int>, p1 array<int>, p2 array<int>")
    assert found(tables.validity(df, ["id"], ["pre"], ["p1", "p2"]), "id", "has_pre", "n_valid") == [(1, True, 1), (2, False, 0)]
    built = []
    make = lambda: built.append(1) or df
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), make).count() == 2
    assert built == [1]


def test_checksums_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("two.bin", "ff"), ("a/one  x.bin", "0a")], "path string, digest string")
    sinks.write_checksums(rows, str(tmp_path / "sums"))
    assert lines(tmp_path / "sums") == ["0a  a/one  x.bin", "ff  two.bin"]
    assert found(tables.checksum_manifest(spark, str(tmp_path / "sums")), "path", "digest") == [("a/one  x.bin", "0a"), ("two.bin", "ff")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", {"k": 1}, 12345.6789, "train"), (1234567, None, None, None, "val")], "n long, s string, m map<string,int>, x double, split string")
    sinks.write_table(df, str(tmp_path / "t"))
    assert dict(spark.read.parquet(str(tmp_path / "t")).dtypes)["m"] == "string"
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_json(df.where("n = 1234567"), str(tmp_path / "j"))
    assert json.loads(lines(tmp_path / "j")[0]) == {"n": 1234567, "s": None, "m": None, "x": None, "split": "val"}
    sinks.write_lines(sinks.report_lines(df.select("n", "s", "x")), str(tmp_path / "l"))
    assert sorted(lines(tmp_path / "l")) == [r"1 & a & 12,345.679 \\", r"1,234,567 & -- & -- \\"]
    sinks.write_split_tree(df.select("n", "split", F.lit(0).alias("label")), str(tmp_path / "tree"))
    assert os.path.isdir(tmp_path / "tree" / "split=train" / "label=0")
    inventory = spark.createDataFrame([("x", "open", 1, "X", "by hand"), ("y", "open", 2, "Y", None)], "id string, cat string, pos int, title string, notes string")
    state = spark.createDataFrame([("y", "done", "3 files")], "id string, status string, detail string")
    report = sinks.status_report(inventory, state, "id", "cat", "pos", "title", "notes")
    sinks.write_lines(report, str(tmp_path / "status"), ["category", "position"])
    assert lines(tmp_path / "status") == ["## open", "| X | pending | by hand |", "| Y | done | 3 files |"]


def test_projections(spark):
    df = spark.createDataFrame([("a", 0, 1, 1, 3, "5"), ("b", 0, 0, 4, 3, "x"), (None, 1, 1, 2, 2, None)], "id string, c int, b int, lo int, hi int, t string")
    assert found(df.select(P.first_flagged([("c", "cancer"), ("b", "benign")], "normal").alias("l")), "l") == [("benign",), ("cancer",), ("normal",)]
    with pytest.raises(ValueError, match="zz"):
        P.require_columns(df, ["id", "zz"])
    with pytest.raises(ValueError):
        P.require_rows(df.limit(0), "x")
    assert P.require_rows(P.require_columns(df, ["id"]), "x") is df
    assert P.existing(df, "id", df.select(F.lit("a").alias("path"))).count() == 1
    assert P.without(df, "id", ["a"]).count() == 2 and P.without(df, "id", df.where("id = 'a'")).count() == 2
    assert P.without_class(df, "t", "x").count() == 2 and P.without_class(df, "t", "x", keep=True).count() == 3
    assert found(df.where("id is not null").select(P.merged_ids(F.col("id"), {"a": "b"}).alias("x")), "x") == [("b",), ("b",)]
    assert P.prefixed(df.select("id", "c"), "meta_", ["id"]).columns == ["id", "meta_c"]
    cast = {r.lo: (r.t, r.load_error) for r in P.checked_cast(df, "t", "int").collect()}
    assert cast == {1: (5, None), 4: (None, "t: no int: x"), 2: (None, None)}
    slots, held = P.one_slot(F.col("c"), F.col("hi"), 2)
    assert [(r.s, r.p) for r in df.where("id = 'a'").select(slots.alias("s"), held.alias("p")).collect()] == [([3, None], [True, False])]
    a, b = P.head_sample(df, ["lo"], 2)
    assert found(a, "lo") == [(1,), (2,)] and found(b, "lo") == [(1,)]
    assert found(P.unknown_names(["a", "q", "q"], df, "id"), "id") == [("q",)]
    assert P.selected(df, "id", "t", ["a"], ["x"]).count() == 2 and P.selected(df, "id", "t").count() == 3
    with pytest.raises(ValueError, match="q"):
        P.selected(df, "id", "t", ["q"])
    both, changed = P.merged_settings(F.expr("map('lr', '1', 'k', '2')"), F.expr("map('lr', '3', 'k', '2', 'new', '1')"))
    r = spark.range(1).select(both.alias("a"), changed.alias("b")).first()
    assert r.a == {"lr": "3", "k": "2", "new": "1"} and r.b == {"lr": "3", "new": "1"}
    assert found(P.slices_of(df, "id", "lo", "hi"), "lo", "slice") == [(1, 1), (1, 2), (1, 3), (2, 2)]
    phases = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "case string, phase int")
    assert found(P.complete_cases(phases, "case", "phase", [1, 2]), "case") == [("a",)]
    names = spark.createDataFrame([("x-Be-1",), ("x-Ma-2",), ("y",)], "n string")
    assert sorted(str(r[0]) for r in names.select(P.label_in_name(F.col("n"), {"-Be-": 0, "-Ma-": 1})).collect()) == ["0", "1", "None"]


def test_scalars(spark):
    r = spark.range(1).select(
        scalar.clean(F.lit(float("nan"))).alias("nan"), scalar.to_bool(F.lit(" Yes ")).alias("yes"), scalar.to_bool(F.lit("?")).alias("odd"),
        scalar.presence(F.array(F.lit("a.png"), F.lit(" missing"), F.lit(None).cast("string"), F.lit(""))).alias("there"), scalar.human_size(F.lit(1536)).alias("size"), scalar.human_size(F.lit(3)).alias("small"),
    ).first()
    assert (r.nan, r.yes, r.odd, r.there, r.size, r.small) == (None, True, None, [True, False, False, False], "1.5 KB", "3 B")
