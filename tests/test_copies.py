"""Pair counts of copy classes against all pairs, and exact quantiles against numpy."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from corvane.operators import copies as C
from corvane.operators import quantiles as Q
from corvane.operators import splits as S

SCHEMA = "key long, class_id long, grp string, used boolean, label int, split string, fold int"


def plain_counts(rows, links, apart):
    out = {}
    for x, y in combinations(sorted(rows), 2):
        edge = tuple(sorted((x[1], y[1])))
        if x[1] != y[1] and edge not in links:
            continue
        same = x[2] is not None and x[2] == y[2]
        if apart and same:
            continue
        differs = lambda k: x[k] is not None and y[k] is not None and x[k] != y[k]  # noqa: B023, E731
        n = out.setdefault(edge, Counter())
        n["pairs"] += 1
        n["same"] += same
        n["conflicts"] += differs(4)
        if x[3] and y[3] and not same:
            n["holdout"] += differs(5)
            n["kfold"] += not differs(5) and differs(6)
    return out


@pytest.mark.parametrize("apart", [False, True])
def test_counts_equal_all_pairs(spark, apart):
    r = random.Random(5)
    rows = []
    for k in range(160):  # classes of one to many, with nulls everywhere
        rows.append((k, r.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10 + k]), r.choice([None, "p", "q", "r"]), r.random() < 0.8, r.choice([None, 0, 1]), r.choice([None, "train", "val"]), r.choice([None, 1, 2, 3])))
    links = {(0, 1), (1, 2), (3, 4), (5, 6)}
    members = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame([(b, a) for a, b in links] + [(0, 1), (7, 7)], "a long, b long")
    counts = C.pair_counts(members, table, apart)
    got = {(x.a, x.b): (x.pairs, x.same_group, x.conflicts, x.holdout, x.kfold) for x in counts.collect()}
    want = {e: tuple(n[c] for c in ("pairs", "same", "conflicts", "holdout", "kfold")) for e, n in plain_counts(rows, links, apart).items()}
    assert got == want
    parent = {k: k for k, *_ in rows}
    find = lambda x: x if parent[x] == x else find(parent[x])
    linked, conflicts = set(), set()
    held = [(x, y) for x, y in combinations(rows, 2) if (x[1] == y[1] or tuple(sorted((x[1], y[1]))) in links) and not (apart and x[2] is not None and x[2] == y[2])]
    for x, y in held:
        linked |= {x[0], y[0]}
        parent[max(find(x[0]), find(y[0]))] = min(find(x[0]), find(y[0]))
    conflicts = {find(x[0]) for x, y in held if x[4] is not None and y[4] is not None and x[4] != y[4]}
    total = C.duplicate_totals(counts, members).first()
    assert tuple(total) == (len(held), len({find(k) for k in linked}), len(linked), sum(n[2] for n in want.values()), len(conflicts), sum(n[3] + n[4] for n in want.values()))


def test_classes_of_five(spark):
    """The first copy is unused and the next two are of one group: the leak is between the others."""
    rows = [(1, None, "g", False, 0, "train", 1), (2, None, "g", True, 0, "train", 1), (3, None, "g", True, 0, "val", 1), (4, None, "h", True, 1, "val", 1), (5, None, "h", True, None, None, 2), (6, None, "h", True, 0, "train", 9)]
    df = spark.createDataFrame(rows, SCHEMA).drop("class_id").selectExpr("*", "if(key = 6, null, 'same text') as text")
    members = C.content_classes(df, "key", df["text"])
    assert {r.key: r.class_id for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}
    got = C.leaking_classes(C.pair_counts(members)).collect()
    assert [(r.a, r.b, r.pairs, r.same_group, r.conflicts, r.holdout, r.kfold) for r in got] == [(1, 1, 10, 4, 3, 1, 2)]
    assert C.pair_counts(members.limit(0)).count() == 0
    assert tuple(C.duplicate_totals(C.pair_counts(members.limit(0)), members.limit(0)).first()) == (0, 0, 0, 0, 0, 0)


def test_group_conflicts(spark):
    rows = [("a", "train", True), ("a", "val", False), ("b", "train", True), ("b", "val", True), (None, "train", True), (None, "val", True), ("c", None, True), ("c", "val", True)]
    df = spark.createDataFrame(rows, "g string, s string, used boolean")
    assert sorted(r.g for r in S.overlapping_groups(df, "g", "s").collect()) == ["a", "b"]
    assert [r.g for r in S.overlapping_groups(df, "g", "s", "used").collect()] == ["b"]


def test_quantiles_equal_numpy(spark, monkeypatch):
    """Also with a sketch so coarse that brackets miss, ties, nulls, NaN and a hot group."""
    rng = np.random.default_rng(8)
    rows = [("hot", float(v), float(np.exp(5 * v))) for v in rng.normal(size=3000)] + [(f"g{k % 7}", float(k % 5), None) for k in range(100)]
    rows += [(None, 1.0, 2.0), (None, 4.0, float("nan")), ("one", 7.0, 3.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    wanted = {"v25": ("v", 0.25), "v50": ("v", 0.5), "v99": ("v", 0.99), "w0": ("w", 0.0), "w50": ("w", 0.5), "w100": ("w", 1.0)}
    for accuracy in (1000, 10):
        monkeypatch.setattr(Q, "ACCURACY", accuracy)
        got = {r.g: r for r in Q.quantiles(df, ["g"], wanted).collect()}
        assert set(got) == {g for g, *_ in rows}
        for g, r in got.items():
            for name, (c, p) in wanted.items():
                x = [row[1 + (c == "w")] for row in rows if row[0] == g]
                x = [t for t in x if t is not None and t == t]
                assert r[name] == (pytest.approx(np.quantile(x, p), rel=1e-12) if x else None), (g, name)
    whole = [v for _, v, _ in rows if v is not None]
    assert Q.quantiles(df, [], {"m": ("v", 0.5)}).first().m == pytest.approx(np.median(whole))
    assert Q.quantiles(df.limit(0), [], {"m": ("v", 0.5)}).first().m is None
    assert Q.quantiles(df.limit(0), ["g"], {"m": ("v", 0.5)}).count() == 0
