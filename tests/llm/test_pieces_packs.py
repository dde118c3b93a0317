"""Packs, bundles and rounds of piece encoding against the library."""

import random

from corvane.llm import piece_encoding
from corvane.llm.queries import tokenizer_file

SIGNS = ["the", "Straße", "a", " ", " ", "  ", "\n", "\n\n", "\n \n", "▁", "\x01", "12", "!?", "漢", "😀", "ß,", "\t", "x" * 70]


def texts_of(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_chunks_hold_the_units_of_the_whole_text():
    for text in texts_of(20_000, 3):
        if text:
            whole = piece_encoding.UNIT.findall("▁" + text.replace(" ", "▁"))
            assert [u for c in piece_encoding._chunks(text) for u in piece_encoding._units(c)] == whole, text


def test_many_packs_shares_and_rounds(spark):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [*texts_of(150, 4), None, "", "one two " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = {k: spark.conf.get(k) for k in (*piece_encoding.BATCHES, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold")}
    tables = spark.catalog.listTables()
    got = piece_encoding.encode(docs, model, pack=100, share=16, packs_at_once=4)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {k: sp.encode(t or "") for k, t in enumerate(texts)}
    assert {k: spark.conf.get(k) for k in before} == before and spark.catalog.listTables() == tables
