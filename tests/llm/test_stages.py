"""The pipeline's stages on nulls, repeated rows, long texts, empty tables and clashing column names."""

from collections import Counter
from pathlib import Path

import pytest

import plain
from corvane.llm import source_mixing
from corvane.llm.queries import tokenizer_file

import sys

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline

LONG = "The house stands by the river and the old road goes over the hill to the next town. " * 2500
TEXTS = ["The river runs past the old mill and the town behind it", "Der Fluss fließt an der alten Mühle vorbei und hinter ihr liegt die Stadt"]
ROWS = [
    (1, None, "en", "a", 5), (2, "", "en", "a", 0), (3, " \n", None, None, 2), (4, "12 34 !!", "en", "a", 8), (5, LONG, "en", "a", len(LONG)), (6, LONG + "end", "en", "b", len(LONG) + 3),
    (7, TEXTS[0], "en", "b", 1), (7, TEXTS[0], "en", "b", 1), (7, TEXTS[1], "de", "b", 1), (None, TEXTS[0], "en", None, 1), (None, "Quite another text without any id at all", "en", "c", 1),
    (None, "Quite another text without any id at all", "en", "c", 1), (9, 'my password = "hunter2hunter2" is here and the rest of it stays', "en", "c", 1), (10, "\U00030000\U00030001", "xx", "c", 2),
]
NAMES = ("score", "lang_pred", "spans", "blob_id", "component_id", "block", "ids", "unit", "share", "text_crc32", "h", "_row", "_c0", "m")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in NAMES:
        df = df.selectExpr("*", f"'clash' as `{c}`")
    return df.repartition(3)


def run(spark, k, df):
    out = corpus_pipeline.STAGES[k][1](spark, df, "")
    if k < 4:
        assert out.columns == df.columns
    return Counter((r["doc_id"], r["text"] if k < 4 else tuple(r["ids"])) for r in out.collect())


def test_empty_tables(spark, docs):
    for k in range(5):
        assert not run(spark, k, docs.limit(0))


def test_language(spark, docs):
    assert run(spark, 0, docs) == Counter((d, t) for d, t, *_ in ROWS if any(c.isalpha() for c in t or ""))


def test_dedup(spark, docs):
    got = run(spark, 1, docs)
    texts = Counter(t for _, t in got.elements())
    assert texts[LONG] + texts[LONG + "end"] == 1 and all(texts[t] == 1 for t in {t for _, t, *_ in ROWS if t and t.strip() and t[:9] != LONG[:9]})
    assert texts[None] == texts[""] == texts[" \n"] == 1


def test_secrets(spark, docs):
    got = run(spark, 2, docs)
    assert got == Counter((d, "my <assign>\" is here and the rest of it stays" if d == 9 else t) for d, t, *_ in ROWS)


def test_mix(spark, docs):
    got = run(spark, 3, docs)
    given = Counter((d, t) for d, t, *_ in ROWS)
    assert set(got) <= set(given)
    total = sum(len(plain.words_of(t)) * n for (_, t), n in given.items())
    assert sum(len(plain.words_of(t)) * n for (_, t), n in got.items()) <= total
    assert all(n <= 4 * given[x] for x, n in got.items())
    for d, t, *_ in ROWS:
        if not plain.words_of(t):
            assert got[d, t] == given[d, t]


def test_equal_rows_are_not_multiplied(spark):
    for rows in ([(1, "a b c", "s")] * 3, [(None, f"text number {k}", "s") for k in range(4)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        assert source_mixing.mixed(df).count() == len(rows) and source_mixing.mix_sources(df).count() == len(rows)


def test_budget_and_repeats(spark):
    df = spark.createDataFrame([(k, "w " * 10, "big" if k < 90 else "small") for k in range(100)], "doc_id long, text string, source string")
    rows = source_mixing.mix_sources(df, evenness=1.0, max_repeats=2.0, block_tokens=40).collect()
    read = Counter(r["source"] for r in rows)
    assert read["small"] <= 20 and sum(read.values()) <= 100 and max(Counter(r["doc_id"] for r in rows).values()) <= 2
    assert Counter(r["source"] for r in source_mixing.mix_sources(df, budget=5000, evenness=0.0, max_repeats=5.0).collect()) == {"big": 450, "small": 50}
    with pytest.raises(ValueError):
        source_mixing.mix_sources(df, budget=5000, max_repeats=4.0)


def test_encode(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert run(spark, 4, docs) == Counter((d, tuple(sp.encode(t or ""))) for d, t, *_ in ROWS)
