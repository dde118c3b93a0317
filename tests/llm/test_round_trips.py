"""Byte-level BPE against its library, whitening against numpy, spelling variants against all pairs."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import re

from corvane.llm import byte_pairs, queries, spelling, whitening

SF = os.environ.get("CORVANE_TEST_SF", "/root/testdata/sf0.001")
PARTS = ["a", "b", "th", "ing", " ", "  ", "\n", "'s", "'S", "<|endoftext|>", "<|", "é", "ß", "日本", "͸", "Ᲊ", "\U000323b0", "　", "\x85", "\x1c", "1", "½", "२", "😀", "!", "?", "\t", "​", "�", "\U00010d40"]
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 3000), (5, "one two  three "), (5, "one two  three "), (None, "no id"), (7, "<|endoftext|><|endoftext|> a<|endoftext|>"), (8, "word " * 30000), (9, "é" * 500)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codec():
    return byte_pairs.Codec(queries.tokenizer_file("byte_bpe_50k.json"), 100_000)  # so small a cache turns over


def test_bpe_equals_library_on_mixed_texts(library, codec, monkeypatch):
    monkeypatch.setattr(byte_pairs, "SLICE", 2000)
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0, 0xD7FF), r.randint(0x10000, 0x3FFFF)])) for _ in range(30)) for _ in range(1000)]
    texts += ["a" * n for n in (1, 2, 63, 64, 65, 129, 5000)] + ["th" * 70 + "ing" * 90, "ab " * 3000, " " * 300, "\n\n x  " * 900]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in codec.encode(texts)] == want
    ids = [[r.randint(-3, 50300) for _ in range(r.randint(0, 30))] for _ in range(500)]
    flat, ends = np.array([i for x in ids for i in x]), np.cumsum([len(x) for x in ids])
    assert codec.decode(flat, ends) == [library.decode([i for i in x if 0 <= i <= 50256], skip_special_tokens=False) for x in ids]


def test_bpe_tables(spark, library):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'clash' as ids", "1 as n")
    back = byte_pairs.decode(byte_pairs.encode(docs, path), path).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["text"]) for r in back) == sorted((str(d), library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in EDGES)
    assert byte_pairs.decode(byte_pairs.encode(docs.limit(0), path), path).count() == 0
    held = spark.createDataFrame([(1, None), (2, [None, 64]), (3, []), (4, [99999999, 65])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in byte_pairs.decode(held, path).collect()} == {1: None, 2: "a", 3: "", 4: "b"}
    with pytest.raises(ValueError):
        byte_pairs.Codec(queries.tokenizer_file("word_bpe_49k.json"), 1)


def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_byte_pairs(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


# ---------------------------------------------------------------- whitening


def plain_whitening(rows, k):
    x = {v: [int(np.floor(256 * float(c))) for c in e] for v, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    f = np.array(fit, float)
    cov = np.cov(f.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    return x, n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(cov)


def test_whitening_query(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x, n, sums, values, vectors, trace = plain_whitening(table, 4)
    rows = queries.op12_embedding_whitening(spark, SF).collect()
    assert len(rows) == 4 * len(x)
    sign = {}
    for r in rows:
        own, c = x[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True)))
        w = (np.array(own) - np.array(sums) / n) @ vectors[:, c] / np.sqrt(values[c])
        s = sign.setdefault(c, np.sign(w * r["whitened"]))
        assert r["whitened"] == pytest.approx(s * w, abs=1e-8) and r["explained"] == pytest.approx(values[c] / trace, rel=1e-10) and r["identity_error"] < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, x string, component int"
    make = lambda rows: spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], schema)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0
    nan = float("nan")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, -1.0, 0.0]), (4, [0.0, -1.0, 0.0]), (None, [0.0, 0.0, 0.0]), (6, [nan, 0.0, 0.0]), (7, [None, 0.0, 0.0]), (8, None), (9, []), (10, [1.0, 2.0]), (11, [float("inf"), 0.0, 0.0])]
    got = whitening.whiten(make(rows)).collect()  # a double eigenvalue, and a direction without spread
    assert Counter(r["vec_id"] for r in got) == {1: 2, 2: 2, 3: 2, 4: 4, None: 2}
    assert all(r["n"] == 5 and r["identity_error"] < 1e-12 and r["explained"] == pytest.approx(0.5) for r in got)
    assert {r["deviation"] for r in got} == {0, (5 * 256) ** 2}


def test_whitening_of_large_integers(spark):
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(3e9, 1), (-2e9, 2), (1e9, -7e8), (5, 5)])]
    fit = whitening.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 256, "vec_id", "embedding")
    x = [[int(256 * c) for c in v] for _, v in rows]
    n, sums, matrix = whitening.scatter(fit)
    assert (n, sums) == (4, [sum(c) for c in zip(*x, strict=True)])
    assert matrix == [[4 * sum(v[i] * v[j] for v in x) - sums[i] * sums[j] for j in range(2)] for i in range(2)]


def test_polynomial_and_roots(spark):
    r = np.random.default_rng(3)
    for d in (1, 2, 3, 7):
        a = r.integers(-50, 50, (d, d))
        m = (a @ a.T).astype(object)
        if d == 7:  # blocks, so that Hessenberg reduction meets zeros; and a triple root
            m[:, :] = 0
            for i in range(7):
                m[i, i] = 9 if i < 3 else 4
            m[4, 5] = m[5, 4] = 2
        p = whitening.characteristic_polynomial(spark, m.tolist())
        values = np.linalg.eigvalsh(m.astype(float))[::-1]
        assert np.allclose(p[::-1], np.poly(values), rtol=1e-9, atol=1e-6)
        roots = whitening.largest_roots(p, 4)
        assert np.allclose([n / 2**b for n, b in roots], values[:4])
        v = np.array(whitening.components_of(m.tolist(), roots))
        assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-12) and np.allclose(v @ m.astype(float), values[: len(v), None] * v, atol=1e-9 * values[0])


# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(n, ratio=10):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def variants(spark, n, **kw):
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    return [tuple(r) for r in spelling.spelling_variants(table, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_near_pairs_equal_all_pairs():
    r = random.Random(3)
    for _ in range(150):
        groups = [sorted({"".join(r.choice("abç") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 40))}) for _ in range(r.randint(1, 4))]
        texts, of = [x for g in groups for x in g], np.array([k for k, g in enumerate(groups) for _ in g])
        i, j = spelling.near_pairs(texts, of)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((x, y) for x in range(len(texts)) for y in range(len(texts)) if of[x] == of[y] and one_edit(texts[x], texts[y]))


@pytest.mark.parametrize("largest", [3, 5000])
def test_variants_equal_all_pairs(spark, largest, monkeypatch):
    """Groups of over three words are halved until no more can be; few words at a time, so that groups cross batches."""
    r = random.Random(largest)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(400)}
    n = {w: r.choice([2, 3, 30, 400, 5000, 70000]) for w in words}
    rows = variants(spark, n, largest=largest)
    assert len(rows) == len(n) and set(rows) == plain_variants(n)


def test_variants_edges(spark):
    assert variants(spark, {}) == []
    long = "x" * 200_000
    n = {long: 2, long + "y": 30, "alone": 5, "z": 4, "\U0001f600abc": 3, "\U0001f600abd": 40}
    assert set(variants(spark, n)) == plain_variants(n)


def test_vocabulary(spark):
    docs = [(1, "Straße straße STRASSE information informations"), (2, None), (3, ""), (None, "information straße"), (4, "x" * 100_000 + " short"), (4, "x" * 100_000 + " short"), (5, "Épreuve épreuve épreuve 日本日本日本日本 informa7tion")] + [(k, "information straßen") for k in range(6, 90)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' as word", "1 as n", "2 as run")
    count, deleted = Counter(), 0
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w, deleted = w[: h % len(w)] + w[h % len(w) + 1 :], deleted + 1
            count[w] += len(w) >= 7
    assert deleted
    assert {(r["word"], r["n"]) for r in spelling.vocabulary(table).collect()} == {(w, n) for w, n in count.items() if n >= 2}
