"""Every license rule fires on its own words, without others around."""

import random
import re
import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from corvane.llm import license_scan


def spellings(parsed):
    """All texts of a parsed regex; a repeat without bound stands for 0 or 2 times."""
    parts = []
    for op, arg in parsed:
        op = str(op)
        if op == "ANY":
            parts.append(["q"])
        elif op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "IN":
            parts.append([chr(c) for kind, v in arg for c in ([v] if str(kind) == "LITERAL" else range(v[0], v[1] + 1))])
        elif op == "SUBPATTERN":
            parts.append(spellings(arg[-1]))
        elif op == "BRANCH":
            parts.append([x for branch in arg[1] for x in spellings(branch)])
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            once = spellings(inner)
            parts.append(([""] if low == 0 else []) + (once if high == 1 else [once[0] * 2]))
        else:
            raise AssertionError(op)
    return ["".join(x) for x in product(*parts)]


@pytest.fixture(scope="module")
def texts():
    return {r["priority"]: spellings(re._parser.parse(r["regex"])) for r in license_scan.rules()}


def test_gates_and_keywords_are_in_every_match(texts):
    for r in license_scan.rules():
        for text in texts[r["priority"]]:
            assert r["keyword"] in f" {text} ", (r, text)
            assert any(g in f" {text} " for g in license_scan.GATES), (r, text)
    assert all(any(g in f" {p} " for g in license_scan.GATES) for p, _ in license_scan.BASE)


def test_every_rule_fires_on_its_own_words(spark, texts):
    """The whole text is one detection, with the label of the best rule that matches it."""
    rules = [(r["label"], re.compile(r["regex"])) for r in license_scan.rules()]
    alone = sorted({t for ts in texts.values() for t in (ts[0], ts[-1])})
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string").repartition(8)).collect()
    assert len(rows) == len(alone)
    for r in rows:
        text = alone[r["doc_id"]]
        best = next(label for label, regex in rules if regex.fullmatch(text))
        assert [(d["start"], d["end"], d["label"]) for d in r["detections"]] == [(0, r["n_words"], best)], text


@pytest.mark.parametrize(
    "text, label",
    [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("Released under Apache 2.0", "apache-2.0"),
        ("the 3-clause BSD", "bsd-3-clause"),
        ("MIT No Attribution", "mit-0"),
        ("CC0 1.0 Universal", "cc0-1.0"),
        ("All rights\nreserved.", "proprietary"),
        ("released into the public\n  domain", "public-domain"),
        ("Creative  Commons\nAttribution 4.0", "cc-by-4.0"),
        ("may be used to endorse or\r\npromote products derived from this software", "bsd-3-clause"),
    ],
)
def test_texts_without_the_word_license(spark, text, label):
    assert license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == label


def test_hand_written_rules():
    hand = [*license_scan.NAMES, *license_scan.SENTENCES, *license_scan.NOTICES]
    assert len(hand) >= 200 and len({r for _, _, r in hand}) == len(hand)


def test_the_better_rule_of_two_that_overlap(spark):
    """The tag (weight 1) and the name after it share words, and the name reaches further."""
    text = "spdx license identifier mit license"
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(d["start"], d["end"], d["label"]) for d in r["detections"]] == [(0, 4, "mit")] and r["score"] == 1.0


@pytest.mark.parametrize("text", ["my driver license mit degree", "license isc y", "the license ruby gave me", "a license vim"])
def test_names_that_are_words(spark, text):
    assert license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"] == ""


def plain_suppression(found):
    kept, top, bench = [], None, []
    for x in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if top is None or x[0] >= top[1]:
            kept += [top] if top else []
            top, bench = x, []
        elif x[1] > top[1] and x[2] < top[2]:
            kept += sorted((y for y in bench if y[1] <= x[0]), key=lambda y: (y[2], y[0], y[1], y[2]))[:1]
            top, bench = x, []
        else:
            bench.append(x)
    return kept + ([top] if top else [])


def test_suppression(spark):
    """Chains of overlaps over more than one block; a detection beaten by one that is beaten in turn comes back."""
    r = random.Random(6)
    cases = [[(0, 5, 4, "long", 0.5), (1, 3, 3, "inner", 0.5), (4, 8, 1, "best", 0.5)]]
    for n in (1, 2, 5, 40, 300):
        starts = [r.randint(0, 3 * n) for _ in range(n)]
        cases.append([(s, s + r.randint(1, 9), r.randint(0, 20), "x", 0.5) for s in starts])
    assert [x[3] for x in plain_suppression(cases[0])] == ["inner", "best"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, found array<{license_scan.DETECTION}>")
    for row in df.select("k", license_scan._suppressed(F.col("found")).alias("kept")).collect():
        assert [tuple(x) for x in row["kept"]] == plain_suppression(cases[row["k"]])


def test_many_matches_in_one_text(spark):
    text = "Licensed under the MIT License. " * 50_000
    began = time.time()
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], len(r["detections"])) == (250_000, 50_000, 2, 249_997, 50_000)
    assert time.time() - began < 120
