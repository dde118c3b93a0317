"""What the methods themselves decide, against plain versions: line rules, rank-order distances, site posteriors."""

import os
import re
from collections import Counter

import numpy as np
import pytest

import plain
from corvane.llm import language_id, quality_rules, queries, site_quality

SF = os.environ.get("CORVANE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def line_rule(line):
    words = plain.words_of(line)
    chars = sum(map(len, words))
    low = line.lower()
    spoken = [r"[\x20\x09-\x0D]+".join(map(re.escape, p.split(" "))) for p in quality_rules.BOILERPLATE]
    rest = re.sub(r"(?<![^\W])(?:" + "|".join(spoken) + r")(?![^\W])", "", low)
    share = 1 - sum(map(len, plain.words_of(rest))) / max(sum(map(len, plain.words_of(low))), 1) if rest != low else 0.0
    upper, lower = len(re.findall("[A-Z]", line)), len(re.findall("[a-z]", line))
    signs = sum(w in ("|", "»", "›", "•", "·", "::", ">", ">>") for w in words)
    bangs = sum(map(len, re.findall(r"[!?]{2,}", line))) / 2
    if share > 0 and (len(words) <= 10 or share > 0.3):
        return "boilerplate"
    if signs >= 3 and signs > 0.2 * len(words):
        return "navigation"
    if len(re.findall(r"[#*$%&|<>{}=\\^~]", line)) > 0.1 * chars:
        return "symbols"
    if len(words) >= 3 and upper > 0.7 * (upper + lower) and upper >= 8:
        return "shouting"
    if len(words) >= 3 and 2 * bangs > len(words):
        return "punctuation"
    if len(words) >= 10 and len(set(words)) < 0.25 * len(words):
        return "repetition"
    if len(words) < 3 and not re.search(r"[.!?:;…\"')\]][ \t\n\x0b\f\r]*$", line):
        return "fragment"
    return None


def test_kept_by_line_rules(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    own = [(-1, "Read more\nHome | News | Sport | Contact | About\nTHIS IS ALL SHOUTING HERE\n" + "A line of plain words that stays as it is.\n" * 9), (-2, "Weiterlesen\nhier klicken und mehr erfahren\nlire la suite\nLeer más\n" + "words " * 60), (-3, "wow!! so!! much!!\n" + " ".join(f"word{k}" for k in range(60)))]
    rows = quality_rules.quality_rules(table.select("doc_id", "text").union(spark.createDataFrame(own, "doc_id long, text string"))).collect()
    texts = {d: r["text"] for d, r in docs.items()} | dict(own)
    seen = Counter()
    for r in rows:
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if plain.words_of(x)]
        rules = [line_rule(x) for x in lines]
        left = [x for x, rule in zip(lines, rules, strict=True) if rule is None]
        n = plain.quality(texts[r["doc_id"]])
        share = sum(len(w) for x in left for w in plain.words_of(x)) / n[1] if n[1] else 0.0
        assert r["clean_text"] == "\n".join(left) and r["dropped_rules"] == [x for x in rules if x], r["doc_id"]
        assert r["kept_share"] == pytest.approx(share) and r["kept"] == (not n[5] and share >= 0.5)
        seen.update(x for x in rules if x)
    assert {"boilerplate", "navigation", "shouting", "punctuation", "repetition", "fragment"} <= set(seen)


def plain_grams(text, most):
    norm = re.sub(r"[^\w]|[\d_]", " ", text.lower())
    norm = "".join(c if c.isalpha() else " " for c in norm)
    norm = re.sub(" +", " ", norm).lstrip(" ") if norm.strip() else ""
    norm = norm if norm.endswith(" ") or not norm else norm + " "
    grams = Counter()
    for k in (1, 2, 3):
        for i in range(len(norm) - k + 1):
            g = norm[i : i + k]
            if not (k == 1 and g == " ") and not (k == 3 and g[1] == " "):
                grams[g] += 1
    key = lambda g: (len(g), [ord(c) if c != " " else 0 for c in g])
    return sorted(grams, key=lambda g: (-grams[g], key(g)))[:most]


def packed(g):
    out = len(g)
    for k in range(3):
        at = k - (3 - len(g))
        out = out << 17 | (0 if at < 0 or g[at] == " " else ord(g[at]))
    return out


def test_rank_order_distance(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = language_id.learn_profiles(table)
    learnt = {}
    for r in profiles.collect():
        learnt.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    own = {lang: Counter() for lang in learnt}
    rows = language_id.identify(table, profiles).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ranked = plain_grams(docs[r["doc_id"]]["text"] or "", 300)
        if not ranked:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        far = {lang: sum(min(abs(p[packed(g)] - k), 400) if packed(g) in p else 400 for k, g in enumerate(ranked)) for lang, p in learnt.items()}
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - far[best] / (400 * len(ranked)))
    for r in docs.values():  # under the sample's bound every document teaches
        if r["text"] is not None and r["lang"] is not None:
            norm = plain_grams(r["text"], 10**9)
            assert all(isinstance(g, str) for g in norm)
            own[r["lang"]][r["doc_id"]] += 1
    assert set(own) == set(learnt) and all(len(p) == 400 and sorted(p.values()) == list(range(400)) for p in learnt.values())


def test_site_posteriors(spark, docs):
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["quality"] is not None:
            labels.setdefault(r["doc_id"], []).append(r["quality"])
    rows = queries.op6_quality_classifier(spark, SF).collect()
    vote = {r["doc_id"]: np.mean(labels[r["doc_id"]]) if r["doc_id"] in labels else r["evidence"] for r in rows}
    path_of = {d: (r["source"], r["lang"]) for d, r in docs.items()}
    paths, hosts = {}, {}
    for d, (h, p) in path_of.items():
        for table, key in ((paths, (h, p)), (hosts, h)):
            k, n = table.get(key, (0.0, 0))
            table[key] = (k + vote[d], n + 1)
    prior = sum(k for k, _ in hosts.values()) / len(docs)

    def strength(groups):
        """groups: (k, n, prior of the group)"""
        spread, inner, whole = sum(n * (k / n - q) ** 2 for k, n, q in groups), sum(q * (1 - q) for _, _, q in groups), sum(n * q * (1 - q) for _, n, q in groups)
        between = (spread - inner) / whole
        return min(1000.0, max(1.0, 1 / between - 1)) if between > 0 else 1000.0

    a = strength([(k, n, prior) for k, n in hosts.values()])
    host = {h: (k + prior * a) / (n + a) for h, (k, n) in hosts.items()}
    b = strength([(k, n, host[h]) for (h, _), (k, n) in paths.items()])
    path = {(h, p): (k + host[h] * b) / (n + b) for (h, p), (k, n) in paths.items()}
    logit = lambda x: np.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for r in rows:
        h, p = path_of[r["doc_id"]]
        score = 1 / (1 + np.exp(-(logit(r["evidence"]) + 0.5 * (logit(path[h, p]) - logit(prior)))))
        assert (r["host_posterior"], r["path_posterior"], r["score"]) == (pytest.approx(host[h], rel=1e-9), pytest.approx(path[h, p], rel=1e-9), pytest.approx(score, rel=1e-9))
        assert r["kept"] == (r["score"] >= 0.5)
    assert site_quality.FEATURES
