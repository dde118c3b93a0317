"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from corvane.llm import curve_ann, language_id, license_scan, minhash_dedup, piece_encoding, quality_rules, secret_scan, site_quality, source_mixing, token_binary
from corvane.llm.queries import tokenizer_file

LONG = "one two three four five six seven eight nine ten. " * 4000
ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, LONG, "en", None), (5, LONG, "en", "b"), (6, "short", "de", "b"),
    (7, "short", "de", "b"), (7, "short", "de", "b"), (None, "no id at all here", "en", "c"), (9, "x" * 300, "en", "c"), (10, "the MIT license, Apache License, Version 2.0 cc-by-nc", "en", "c"),
    (11, 'token = "0123456789abcdef0123456789abcdef" é Ünï', "fr", "c"), (12, "a b c d e a b c", "en", "c"), (13, "12345 ###", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
NAMES = ("words", "h", "block", "rep", "spans", "blob_id", "unit", "label", "component", "n", "id", "part")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in NAMES:
        df = df.selectExpr("*", f"'clash' as `{c}`")
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_rows_in_rows_out(docs, empty):
    got = {"license": license_scan.license_scan, "quality": quality_rules.quality_rules, "secret": secret_scan.secret_scan, "dedup": minhash_dedup.near_duplicates}
    for f in got.values():
        assert f(docs).count() == len(ROWS) and f(empty).count() == 0


def test_license_and_quality_values(docs):
    found, judged = by_id(license_scan.license_scan(docs)), by_id(quality_rules.quality_rules(docs))
    for d, text, _, _ in ROWS:
        r, q = found[d], judged[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain.licenses(text)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == plain.quality(text)


def test_rule_count_and_suppression(spark):
    assert len(license_scan.rules()) >= 200
    text = "Licensed under the GNU Lesser General Public License version 2.1"
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert "lgpl-2.1" in r["labels"].split(",") and "gpl" not in r["labels"].split(",")


def test_dedup_values(docs):
    rows = minhash_dedup.near_duplicates(docs, width=3, percent=85).collect()
    known = [(d, t) for d, t, _, _ in ROWS if d is not None]
    part, size = plain.components(known, 3, 85)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (size[r["doc_id"]], part[r["doc_id"]], part[r["doc_id"]] == r["doc_id"])


def test_secret_ledger(docs):
    first = secret_scan.scan_new(docs).cache()
    again = secret_scan.secret_scan(docs, ledger=first)
    assert secret_scan.scan_new(docs, first).count() == 0
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in again.collect()}
    assert spans[11] == [("assign", 0, 41), ("hex", 9, 41)] and spans[1] == []
    assert by_id(secret_scan.redacted(docs))[11]["text"] == '<assign>" é Ünï'


def test_language_values(docs, empty):
    profiles = language_id.learn_profiles(docs)
    found = by_id(language_id.identify(docs, profiles))
    assert {d for d in found if found[d]["lang_pred"] == "und"} == {1, 2, 3, 13}
    assert language_id.identify(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.learn_profiles(empty)).collect()} == {"und"}


def test_mixing_values(docs, empty):
    rows = source_mixing.mix_sources(docs).collect()
    assert {1, 2, 3} <= {r["doc_id"] for r in rows if r["n_tokens"] == 0}
    assert source_mixing.mix_sources(empty).count() == 0


def test_site_values(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (99, 1), (10, None)], "doc_id long, quality int")
    assert site_quality.site_quality(docs, labels).count() == len(ROWS)
    assert site_quality.site_quality(docs, labels.limit(0)).count() == len(ROWS)
    assert site_quality.site_quality(empty, labels).count() == 0


def test_pieces_values(docs, empty):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = piece_encoding.encode(docs, model)
    for r in got.collect():
        text = next(t for d, t, _, _ in ROWS if d == r["doc_id"]) or ""
        assert r["ids"] == sp.encode(text)
    back = by_id(piece_encoding.decode(got.select("doc_id", "ids"), model))
    assert all(back[d]["text"] == (t or "") for d, t, _, _ in ROWS)
    assert piece_encoding.encode(empty, model).count() == 0


def test_viterbi_is_the_best_path(spark):
    pieces = [(1, "a", -2.0), (2, "b", -2.5), (3, "ab", -3.0), (4, "ba", -3.5), (5, "aba", -6.0), (6, "bab", -5.5)]
    table = piece_encoding.piece_table(spark, pieces)
    score = {p: (s, i) for i, p, s in pieces}

    def best(u):
        sums = [(0.0, [])]
        for e in range(1, len(u) + 1):
            sums.append(max(((sums[s][0] + score[u[s:e]][0], sums[s][1] + [score[u[s:e]][1]]) for s in range(e) if u[s:e] in score), key=lambda x: x[0]))
        return sums[-1][0]

    units = ["a", "ab", "aba", "abab", "babab", "abbaabab"]
    spelt = {i: s for i, _, s in pieces}
    rows = piece_encoding.viterbi_paths(piece_encoding.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), table, 3, piece_encoding.scored_edge()), 100).collect()
    for r in rows:
        assert sum(spelt[i] for i in r["ids"]) == pytest.approx(best(r["unit"]))


def test_merges_with_pieces_better_than_their_parts(spark):
    """abc comes before ab and bc by rank, so merging a part makes an earlier edge ready."""
    pieces = [(1, "abc", -1.0), (2, "ab", -2.0), (3, "bc", -3.0), (4, "ca", -1.5), (5, "cab", -1.2), (6, "a", -9.0), (7, "b", -9.0), (8, "c", -9.0)]
    score, spelt = {p: s for _, p, s in pieces}, {i: p for i, p, _ in pieces}

    def merge(u):
        now = list(u)
        while True:
            pairs = [(-score[x + y], k) for k, (x, y) in enumerate(zip(now, now[1:])) if x + y in score]
            if not pairs:
                return now
            k = min(pairs)[1]
            now[k : k + 2] = ["".join(now[k : k + 2])]

    rng = np.random.default_rng(5)
    units = sorted({"".join("abc"[i] for i in rng.integers(0, 3, n)) for n in [*range(1, 13)] * 8} | {"abc" * 20})
    table = piece_encoding.piece_table(spark, pieces)
    found = piece_encoding.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), table, 3, piece_encoding.packed_edge())
    rows = piece_encoding.merge_paths(found, 100).collect()
    assert {r["unit"]: [spelt[i] for i in r["ids"]] for r in rows} == {u: merge(u) for u in units}


@pytest.mark.parametrize("top", [2, 1 << 9, 1 << 16, 1 << 31, 1 << 32])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = rng.integers(0, top, n).astype(np.uint64)
        ids[rng.random(n) < 0.5] %= np.uint64(3)
        lengths = np.array([n])
        docs, got, back = token_binary.from_segment(token_binary.to_segment(np.array([7]), lengths, ids))
        assert docs.tolist() == [7] and got.tolist() == [n] and (back == ids).all()


def test_token_rows(spark, docs):
    path = str(spark.conf.get("spark.checkpoint.dir")) + "/edge-tokens"
    token_binary.write_tokens(docs.where("doc_id is not null"), path, tokenizer_file("word_bpe_49k.json"))
    rows = token_binary.read_index(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(d for d, *_ in ROWS if d is not None)
    assert next(r["n_tokens"] for r in rows if r["doc_id"] == 1) == 1


def test_nearest_edges(spark):
    v = lambda *x: [float(a) for a in x]
    rows = [(0, v(1, 0)), (1, v(1, 0)), (2, v(0, 1)), (3, None), (4, v(0, 0)), (5, [1.0, None]), (6, v(float("nan"), 1)), (7, v(-1, 0)), (None, v(1, 1)), (7, v(-1, 0)), (8, v(1, 2, 3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as id")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in curve_ann.nearest(df, df.where("vec_id in (0, 3)"), k=5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.0), (0, 3, 7, -1.0)]
    assert curve_ann.nearest(df.limit(0), df, k=5).count() == 0


def test_secrets_of_long_texts(spark):
    """Millions of letters before a scheme, tens of thousands of matches, runs of what begins a token: all in linear time."""
    keys = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(50_000)]
    texts = ["a" * 5_000_000 + "://user:password@host", "\n".join(keys), "eyJ" * 1_000_000, "bearer " * 300_000, "token" + " " * 2_000_000 + "= 0123456789", "-----BEGIN " + "A" * 2_000_000, "see .https://me:pw@host/x and 9ftp://a:b@c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    found, clean = by_id(secret_scan.secret_scan(docs)), by_id(secret_scan.redacted(docs))
    assert time.time() - began < 240
    for k, text in enumerate(texts):
        own = [(s["kind"], s["start"], s["end"]) for s in found[k]["spans"]]
        base = [s for s in own if s[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest() == plain.secrets(text)[3]
    assert [s["kind"] for s in found[6]["spans"]] == ["url", "url"] and clean[6]["text"] == "see .<url>/x and 9<url>"
    assert found[1]["spans"][7]["digest"] == hashlib.sha256(keys[7].encode()).hexdigest()
    assert clean[1]["text"] == "\n".join(["<hex>"] * len(keys))
    assert clean[2]["text"] == texts[2]


def test_redaction_across_blocks(spark):
    """Parts that overlap, touch, begin and end the text, in more than one block."""
    spans, kinds = [], ["assign", "hex", "url"]
    rng = np.random.default_rng(4)
    at = 0
    for k in range(700):
        at += int(rng.integers(0, 4))
        spans.append((kinds[k % 3], at, at + int(rng.integers(1, 9)), ""))
    text = "".join("aé日😀"[i % 4] for i in range(spans[-1][1] + 20))
    want, reach = "", 0
    for kind, a, b, _ in spans:
        if a >= reach:
            want += text[reach:a] + f"<{kind}>"
        reach = max(reach, b)
    want += text[reach:]
    df = spark.createDataFrame([(text, spans), (text, []), ("", [])], f"text string, spans array<{secret_scan.SPAN}>")
    got = df.select(F.when(F.size("spans") > 0, secret_scan._replaced(F.col("text"), secret_scan._cover(F.col("spans")))).otherwise(F.col("text"))).collect()
    assert [r[0] for r in got] == [want, text, ""]
