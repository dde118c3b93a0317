"""Ids of cut texts against the library on whole texts."""

import json
import random

import numpy as np
import pytest

from corvane.llm import token_binary
from corvane.llm.queries import tokenizer_file

SIGNS = [*"abcDEFxyz'.,;:!?#$%&*()0129 \n\tßüÉİıŞσΣς漢한가😀<|ªﬁǅŸÿ", "́", "̇", "̣", " ", "\U00030000", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "İ.", "the ", "ANKARA'DAKİ EVİ. "]


def texts_of(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["ANKARA'DAKİ EVİ.", "x" * 3000, "EVİ. " * 500]


def expected(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("cache_bytes", [1 << 12, 1 << 26])
def test_cut_texts_give_the_ids_of_whole_texts(cache_bytes):
    path, texts = tokenizer_file("word_bpe_49k.json"), texts_of(30_000)
    encode = token_binary._new_encoder(path, 2, cache_bytes)
    got = [x for k in range(0, len(texts), 100) for x in encode(texts[k : k + 100])]
    assert got == expected(path, texts)


@pytest.mark.parametrize("change", ["other file", "other normaliser"])
def test_other_files_are_not_cut(tmp_path, change):
    path = tokenizer_file("byte_bpe_50k.json")
    if change == "other normaliser":
        told = json.load(open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8"))
        told["normalizer"]["normalizers"].pop()
        path = str(tmp_path / "t.json")
        json.dump(told, open(path, "w", encoding="utf-8"))
    texts = texts_of(2000, 5)
    assert token_binary._new_encoder(path, 2, 1 << 20)(texts) == expected(path, texts)
