"""The queries over a whole small table against plain versions."""

import os
import zlib
from pathlib import Path

import numpy as np
import pytest

import plain
from corvane.llm import queries

SF = os.environ.get("CORVANE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, f):
    return [r.asDict() for r in f(spark, SF).collect()]


def test_license_scan(spark, docs):
    for r in result(spark, queries.op1_license_scans):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain.licenses(docs[r["doc_id"]]["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_quality_rules(spark, docs):
    rows = result(spark, queries.op2_quality_rules)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain.quality(docs[r["doc_id"]]["text"])
        assert not (r["kept"] and r["base_failed"])
    assert len(rows) == len(docs)


def test_source_mixing(spark, docs):
    rows = result(spark, queries.op3_source_mixing)
    tokens = {d: len(plain.words_of(r["text"])) for d, r in docs.items()}
    total = sum(tokens.values())
    natural, read, weight = {}, {}, {}
    for d, r in docs.items():
        natural[r["source"]] = natural.get(r["source"], 0) + tokens[d]
    for r in rows:
        assert r["n_tokens"] == tokens[r["doc_id"]]
        read[r["source"]] = read.get(r["source"], 0) + r["n_tokens"]
        weight[r["source"]] = r["weight"]
    assert abs(sum(weight.values()) - 1) < 1e-9
    p = np.array([natural[s] / total for s in weight])
    h = lambda q: -(q * np.log(q)).sum()
    target = h(p) + 0.5 * (np.log(len(p)) - h(p))
    assert h(np.array([weight[s] for s in weight])) == pytest.approx(target, abs=1e-6)
    longest = max(tokens.values())
    for s, w in weight.items():
        assert w * total - longest <= read[s] <= w * total
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows)


def test_language_id(spark, docs):
    rows = result(spark, queries.op4_language_id)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["n_chars"] > 40]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97


def test_token_binary(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    rows = sorted(result(spark, queries.op5_token_binary), key=lambda r: r["doc_id"])
    start = 0
    for r, (d, doc) in zip(rows, sorted(docs.items()), strict=True):
        ids = t.encode(doc["text"] or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_quality_classifier(spark, docs):
    rows = {r["doc_id"]: r for r in result(spark, queries.op6_quality_classifier)}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == len(docs)
    assert np.mean([rows[d]["kept"] == bool(q) for d, q in labels.items() if d in rows]) > 0.9


def test_sentencepiece(spark, docs):
    import sentencepiece

    from corvane.llm import piece_encoding

    model = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r["doc_id"]: r["ids"] for r in piece_encoding.encode(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    assert got == {d: sp.encode(r["text"] or "") for d, r in docs.items()}
    rows = result(spark, queries.op7_sentencepiece)
    assert len(rows) == len(docs) and all(r["round_trip"] and r["n_pieces"] == len(got[r["doc_id"]]) for r in rows)


def test_secret_scan(spark, docs):
    for r in result(spark, queries.op8_secret_scans):
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == plain.secrets(docs[r["doc_id"]]["text"])


def test_nearest_recall(spark):
    rows = result(spark, queries.op9_nearest_vectors)
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table], np.float64)
    near = {}
    for r in rows:
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for q in np.nonzero(ids % 20 == 0)[0]:
        s = x @ x[q]
        best = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        got = sorted(near[ids[q]])
        assert [k for k, _, _ in got] == list(range(1, 21))
        assert np.allclose([z for _, _, z in got], [s[np.nonzero(ids == v)[0][0]] for _, v, _ in got])
        hits.append(len({v for _, v, _ in got} & set(ids[best])) / 20)
    assert np.mean(hits) >= 0.9


def test_minhash_dedup(spark, docs):
    part, size = plain.components([(d, r["text"]) for d, r in docs.items()], 3, 85)
    rows = result(spark, queries.op10_minhash_dedup)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {d: (size[d], part[d], part[d] == d) for d in docs}


def test_pipeline(spark, docs, tmp_path):
    """Stage by stage against plain versions: every stage works on what its predecessor kept."""
    import sys

    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import sentencepiece

    import corpus_pipeline

    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = now.columns, dict(docs)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        stage(spark, now, SF).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        after = now.collect()
        ids = {r["doc_id"] for r in after}
        if name == "language_id":
            assert ids == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
        elif name == "minhash_dedup":
            part, _ = plain.components([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert ids == {d for d in part if part[d] == d}
        elif name == "secret_scans":
            assert len(after) == len(before) and all(plain.secrets(r["text"])[:3] == (0, 0, 0) for r in after)
            same = {r["doc_id"]: r["text"] for r in before}
            assert all(r["text"] == same[r["doc_id"]] for r in after if plain.secrets(same[r["doc_id"]])[:3] == (0, 0, 0) and "://" not in r["text"])
        elif name == "source_mixing":
            assert ids <= {r["doc_id"] for r in before} and len(after) > 0
        else:
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before) and all(r["ids"] == sp.encode(texts[r["doc_id"]] or "") for r in after)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
    assert held
