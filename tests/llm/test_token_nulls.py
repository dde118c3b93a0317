"""Rows without an id stand first in the token files, with a null id."""

import numpy as np
from test_edges import ROWS, SCHEMA
from tokenizers import Tokenizer

from corvane.llm import token_binary
from corvane.llm.queries import tokenizer_file


def test_null_ids_in_a_segment():
    docs, lengths, ids = token_binary.from_segment(token_binary.to_segment([None, None, 0, 7], np.array([1, 0, 2, 1]), np.arange(4, dtype=np.uint64)))
    assert docs.tolist() == [None, None, 0, 7] and lengths.tolist() == [1, 0, 2, 1] and ids.tolist() == [0, 1, 2, 3]
    assert token_binary.from_segment(token_binary.to_segment([], np.zeros(0, np.int64), np.zeros(0, np.uint64)))[0].tolist() == []


def test_all_rows_are_written(spark, tmp_path):
    rows = [*ROWS, (None, None, "en", "c"), (None, "another without id", "en", "c"), (0, "the id zero", "en", "c"), (-3, "below", "en", "c")]
    model = tokenizer_file("word_bpe_49k.json")
    t, path = Tokenizer.from_file(model), str(tmp_path / "tokens")
    token_binary.write_tokens(spark.createDataFrame(rows, SCHEMA), path, model)
    order = sorted(((d, x) for d, x, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in order]
    index = token_binary.read_index(spark, path).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in index] == [(d, len(ids)) for d, ids in want]
    assert [r["start"] for r in index] == np.cumsum([0] + [len(ids) for _, ids in want])[:-1].tolist()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], list(r["ids"])) for r in token_binary.read_ids(spark, path).collect()), key=key) == sorted(want, key=key)
