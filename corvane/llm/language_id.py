"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams of a language, by rank. A document is ranked in the
same way over its whole text and goes to the language of the least out-of-place distance. n-grams run over
lower-case letters; every run of other characters is one blank. Counting is a sort of packed 64-bit keys per
Arrow batch; profiles are learnt by grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BITS = 17  # a character's code; three of them and the length mark fit 52 bits
STEP = 1 << 19  # characters counted at once


def _letter_codes() -> np.ndarray:
    """Code of each code point: that of the letter itself, 0 for all that is no letter; letters past BITS bits share codes."""
    low = (1 << BITS) - 1
    return np.array([(c if c <= low else (c & low) | 1) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


_codes: list[np.ndarray] = []
MOST_LANGUAGES = 1000  # more values than that are no languages


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document index, gram, count of every distinct 1- to 3-gram, ordered by document and gram."""
    if not _codes:
        _codes.append(_letter_codes())
    joined = "\n\n".join(t.lower().replace("\n", " ") for t in texts) + "\n\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    code = _codes[0][points].astype(np.uint64)
    ends = np.nonzero(points == 10)[0][1::2] + 1
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(np.concatenate([[0], ends])))
    blank = code == 0
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run stays, but none before a text's first letter
    code, doc = code[keep], doc[keep]
    one, two, three = np.uint64(1 << 51), np.uint64(2 << 51), np.uint64(3 << 51)
    shift, shift2, top = np.uint64(BITS), np.uint64(2 * BITS), np.uint64(53)
    same = doc[1:] == doc[:-1]
    singles = ((doc << top) | one | code)[code != 0]
    pairs = ((doc[1:] << top) | two | (code[:-1] << shift) | code[1:])[same]
    triples = ((doc[2:] << top) | three | (code[:-2] << shift2) | (code[1:-1] << shift) | code[2:])[same[1:] & same[:-1] & (code[1:-1] != 0)]
    keys = np.concatenate([singles, pairs, triples])
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.nonzero(first)[0]
    count = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> top).astype(np.int64), (keys & np.uint64((1 << 53) - 1)).astype(np.int64), count


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges of about STEP characters; at most 1024 documents, as the key's top bits hold their number."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and j - i < 1024 and (j == i or n + len(texts[j] or "") <= STEP):
            n += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _ranks(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent grams of each document with their rank from 0; ties by gram."""
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    starts = np.searchsorted(doc, np.arange(doc[-1] + 1 if len(doc) else 0))
    rank = np.arange(len(doc)) - starts[doc] if len(doc) else np.zeros(0, np.int64)
    top = rank < most
    return doc[top], gram[top], rank[top]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for i, j in _chunks(texts):
            doc, gram, count = _grams([t or "" for t in texts[i:j]])
            names = np.array(langs[i:j], object)
            yield pa.RecordBatch.from_arrays([pa.array(names[doc], pa.string()), pa.array(gram), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400, sample: int = 3000) -> DataFrame:
    """lang, gram, rank: the size most frequent grams of each language.

    Learnt from the documents of at most sample ids a language, those of the smallest hash (the documented bound);
    rows with a null text, language or id take no part, and all rows of a chosen id count. More than MOST_LANGUAGES
    values of lang_col are an error. Only rows whose hash lies under their language's bound are ranked, so no
    task meets all rows of a language; texts don't travel.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null")
    # about a third more ids than are wanted lie under the bound, were all ids single; if they repeat, all ids do
    ids = {r["lang"]: r["ids"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.03).alias("ids")).limit(MOST_LANGUAGES + 1).collect()}
    if len(ids) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of {lang_col}")
    bounds = docs.sparkSession.createDataFrame([(lang, float(min(1.0, 1.35 * sample / max(n, 1)))) for lang, n in ids.items()], "lang string, bound double")
    h = F.xxhash64("doc_id")
    few = rows.select("lang", "doc_id", h.alias("h")).join(F.broadcast(bounds), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("bound") * (1 << 30)).select("lang", "doc_id", "h").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "doc_id")
    chosen = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("lang", "doc_id")
    # at most sample ids for each of MOST_LANGUAGES; a broadcast while that is some MB
    chosen = F.broadcast(chosen) if len(ids) * sample <= 1_000_000 else chosen
    counted = rows.join(chosen, ["lang", "doc_id"], "left_semi").select("text", "lang").mapInArrow(_count_batches, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return total.withColumn("rank", F.row_number().over(by_rank) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def _predictor(profiles: dict[str, dict[int, int]], size: int, most: int):
    langs = sorted(profiles)
    grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    table = np.full((len(langs), len(grams) + 1), -1, np.int64)
    for k, lang in enumerate(langs):
        for g, r in profiles[lang].items():
            table[k, np.searchsorted(grams, g)] = r

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, j in _chunks(texts):
                doc, gram, rank = _ranks(*_grams([t or "" for t in texts[i:j]]), most)
                if not len(doc) or not langs:
                    continue
                at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                at = np.where(grams[at] == gram, at, len(grams))
                n = np.bincount(doc, minlength=j - i)
                far = np.empty((len(langs), j - i))
                for k in range(len(langs)):
                    ranks = table[k, at]
                    far[k] = np.bincount(doc, np.where(ranks < 0, size, np.minimum(np.abs(ranks - rank), size)), j - i)
                best = far.argmin(axis=0)
                has = np.bincount(doc, (gram >> 51) == 1, j - i) > 0
                near = 1 - far[best, np.arange(j - i)] / np.maximum(n * size, 1)
                for d in np.nonzero(has)[0]:
                    pred[i + d] = langs[best[d]]
                score[i:j] = np.where(has, np.clip(near, 0, 1), 0)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(pred, pa.string()), pa.array(score)], [*rest, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, most: int = 300) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs; only the text is read.

    lang_pred is the language of the least out-of-place distance over the document's most frequent grams, ties
    to the smaller name; score is 1 less the mean distance a gram over the largest possible. A null text, one
    without a letter, or an empty table of profiles gives 'und' and 0. Rows are independent: repeated rows
    repeat their result, null ids pass through. profiles holds size rows for each of a
    bounded number of languages and is collected. id_col must cast to long.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predictor(_collected(profiles), size, most), "doc_id long, lang_pred string, score double")


def _collected(profiles: DataFrame) -> dict[str, dict[int, int]]:
    learnt: dict[str, dict[int, int]] = {}
    for row in profiles.collect():
        learnt.setdefault(row["lang"], {})[row["gram"]] = row["rank"]
    return learnt


def known_languages(docs: DataFrame, profiles: DataFrame, text_col: str = "text", least_score: float = 0.0, size: int = 400, most: int = 300) -> DataFrame:
    """The rows of docs, with all their columns, whose own text is in one of the languages with at least least_score.

    Every row is judged by itself: ids are not read, so repeated and null ids are no matter.
    """
    names = {f"_c{k}": c for k, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.col(f"`{text_col}`").alias("text"))
    schema = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in names)
    judged = held.mapInArrow(_predictor(_collected(profiles), size, most), f"{schema}, lang_pred string, score double")
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(*[F.col(n).alias(c) for n, c in names.items()])
