"""Spelling variants: words of a corpus that lie one edit apart, by dynamic programming over sorted lists.

Two words one edit apart share the first half of the shorter one or the rest of it: halves deal all words out to groups
in which every pair is found. A group that is too large is halved again, and so on; a group whose words share all
but one character of the shorter word is small by the alphabet, so no group grows with the corpus.

Within a task, the free middles of all groups form one sorted list. Queries go down it together: a state is a query, a
range of the list whose words share a prefix, and the banded row of edit distances between the query and that
prefix. The row is computed once for the range, the range falls apart where the common prefixes of adjacent words
end, and a range whose row exceeds one edit throughout is skipped whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import cut
from corvane.llm.text import ascii_lower

RUN = "A-Za-z\\u00C0-\\u00FF"
#: Words of a group beyond which it is halved again.
LARGEST = 5000
#: Words that a task looks at together.
TOGETHER = 1 << 16
#: Queries that advance together.
QUERIES = 1 << 16
FAR = 2  # edit distances are capped here


# ---------------------------------------------------------------- vocabulary


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """word, n of docs: words by how often they occur, with the letter that its hash chooses deleted from every
    every-th run of a document.

    Runs of letters are counted whole and in place; a null text has none, a null id counts as an empty one.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([{RUN}]{{{least_length},}})"), F.lit(1))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    each = each.select("doc", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % every == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- groups


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, a, b, most) as two each: those that share more of the front, and those that share more of the end.

    A group is the words that share a characters in front and b at the end, in pairs whose shorter word has m
    characters. A pair whose common front has at least a + half characters is found in the first new group; any other
    shares at least m - a - half at the end. most keeps the second from finding the first's pairs again.
    """
    half = F.expr("int((m - a - b) div 2)")
    front = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("most").alias("most"))
    end = F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - half).alias("b"), F.least("most", F.col("a") + half).alias("most"))
    return rows.withColumn("part", F.explode(F.array(front, end))).select("word", "n", "m", "part.a", "part.b", "part.most")


def _named(rows: DataFrame) -> DataFrame:
    """Rows with the key of their group: what its words share, and where."""
    shared = F.concat_ws(" ", F.expr("substring(word, 1, a)"), F.expr("right(word, b)"), "m", "a", "most")
    return rows.withColumn("key", shared)


def groups(words: DataFrame, largest: int = LARGEST) -> DataFrame:
    """key, word, n, m, a, b, most: every word in each group where a word one edit apart may be.

    Groups of over largest words are halved until none is left that can be: at one free character of the shorter word.
    """
    length = F.length("word")
    both = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m >= 1")
    rows = _named(_halved(both.select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b"), (F.col("m") + 1).alias("most"))))
    done = None
    while True:
        large = rows.where("m - a - b > 1").groupBy("key").count().where(F.col("count") > largest).select("key")
        large = cut(large, "spelling-large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fits = rows.join(large, "key", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        rows = cut(_named(_halved(rows.join(large, "key", "left_semi").drop("key"))), "spelling-halved")


# ---------------------------------------------------------------- the sorted list


def _common(flat: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many characters each text has in common with the one before it; -1 where a group starts."""
    common = np.where(np.concatenate([[False], group[1:] == group[:-1]]), 0, -1)
    live = np.nonzero(common == 0)[0]
    depth = 0
    while len(live):
        live = live[np.minimum(size[live], size[live - 1]) > depth]
        live = live[flat[start[live] + depth] == flat[start[live - 1] + depth]]
        depth += 1
        common[live] = depth
    return common


def near_pairs(middles: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), in both orders, of texts of one group that lie exactly one edit apart.

    middles: ascending and distinct within a group, the groups one after another; group: a number for each, ascending.
    """
    n = len(middles)
    size = np.array([len(x) for x in middles], np.int64)
    start = np.cumsum(size) - size
    flat = np.append(np.frombuffer("".join(middles).encode("utf-32-le"), "<u4").astype(np.int64), -1)
    common = _common(flat, start, size, group)
    first = np.nonzero(common < 0)[0]
    last = np.append(first[1:], n)
    of = np.searchsorted(first, np.arange(n), side="right") - 1
    found = [np.zeros((2, 0), np.int64)]
    for begin in range(0, n, QUERIES):
        query = np.arange(begin, min(n, begin + QUERIES))
        low, high = first[of[query]], last[of[query]]
        row = np.tile(np.array([FAR, 0, 1], np.int8), (len(query), 1))  # of the prefix and as many characters of the query less one, as many, one more
        row[size[query] < 1, 2] = FAR
        depth = 0
        while len(query):
            # the text that ends here, if any, is the range's first
            ends = size[low] == depth
            gap = size[query] - depth
            hit = np.nonzero(ends & (np.abs(gap) <= 1))[0]
            hit = hit[row[hit, gap[hit] + 1] == 1]
            found.append(np.stack([query[hit], low[hit]]))
            low = low + ends
            more = (low < high) & ~((low + 1 == high) & (low == query))  # nothing is left, or the query alone
            query, low, high, row = query[more], low[more], high[more], row[more]
            # ranges fall apart where a text has no more in common with the one before it
            border = np.append(np.nonzero(common <= depth)[0], n)
            a, b = np.searchsorted(border, low, side="right"), np.searchsorted(border, high, side="left")
            parts = b - a + 1
            owner = np.repeat(np.arange(len(query)), parts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            lows = np.where(nth == 0, low[owner], border[a[owner] + nth - 1])
            highs = np.where(nth == parts[owner] - 1, high[owner], border[a[owner] + nth])
            query, row = query[owner], row[owner]
            place = depth + np.array([-1, 0, 1])
            inside = (place >= 0) & (place < size[query, None])
            own = flat[np.where(inside, start[query, None] + place, len(flat) - 1)]
            miss = (own != flat[start[lows] + depth][:, None]).astype(np.int8)
            before, same, after = row[:, 0], row[:, 1], row[:, 2]
            new = np.empty_like(row)
            new[:, 0] = np.minimum(before + miss[:, 0], same + 1)
            new[:, 1] = np.minimum(np.minimum(same + miss[:, 1], after + 1), new[:, 0] + 1)
            new[:, 2] = np.minimum(after + miss[:, 2], new[:, 1] + 1)
            new[size[query, None] < depth + np.array([0, 1, 2])] = FAR  # the query has no such prefix
            alive = new.min(axis=1) < FAR
            query, low, high, row = query[alive], lows[alive], highs[alive], np.minimum(new[alive], FAR)
            depth += 1
    i, j = np.concatenate(found, axis=1)
    return i, j


def _best(table: pa.Table) -> pa.RecordBatch | None:
    """For each word of whole groups, what near words these show: how many, and the most frequent."""
    keys = table.column("key").to_pylist()
    words, n, m = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("m").to_numpy()
    a, b, most = (table.column(c).to_numpy() for c in ("a", "b", "most"))
    group = np.concatenate([[0], np.cumsum([x != y for x, y in zip(keys, keys[1:], strict=False)])]) if keys else np.zeros(0, int)
    i, j = near_pairs([w[x : len(w) - y] for w, x, y in zip(words, a.tolist(), b.tolist(), strict=True)], group)
    size = np.array([len(w) for w in words])
    ours = np.minimum(size[i], size[j]) == m[i]
    i, j = i[ours], j[ours]
    if len(i):  # pairs with a longer common front belong to another group
        capped = np.nonzero(most[i] <= m[i])[0]
        taken = np.ones(len(i), bool)
        for k in capped.tolist():
            x, y, c = words[i[k]], words[j[k]], int(most[i[k]])
            taken[k] = x[:c] != y[:c]
        i, j = i[taken], j[taken]
    if not len(i):
        return None
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[j], -n[j], rank[i]))
    i, j = i[order], j[order]
    first = np.concatenate([[True], i[1:] != i[:-1]])
    at = np.nonzero(first)[0]
    count = np.diff(np.append(at, len(i)))
    pick = lambda k: pa.array([words[x] for x in k.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([pick(i[at]), pa.array(n[i[at]]), pa.array(count), pick(j[at]), pa.array(n[j[at]])], ["word", "n", "n_near", "near", "near_n"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups, as many as fit together; what follows the last border waits for more."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(final: bool) -> pa.RecordBatch | None:
        nonlocal held, rows
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column("key").to_pylist()
        end = len(keys)
        if not final:
            while end and keys[end - 1] == keys[-1]:
                end -= 1
        held = table.slice(end).to_batches() if end < len(keys) else []
        rows = len(keys) - end
        return _best(table.slice(0, end)) if end else None

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            if (found := flush(False)) is not None:
                yield found
    if held and (found := flush(True)) is not None:
        yield found


def near_words(words: DataFrame, largest: int = LARGEST) -> DataFrame:
    """word, n, n_near, near, near_n of words(word, n): how many words lie one edit away, and the most frequent of them
    (ties: the first in code-point order). Words without a near word have no row; words are taken to be distinct."""
    dealt = groups(words, largest).repartition("key").sortWithinPartitions("key", F.expr("substring(word, a + 1, length(word) - a - b)"))
    found = dealt.select("key", "word", "n", "m", "a", "b", "most").mapInArrow(_scan, "word string, n long, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("x"), F.col("near").alias("near")))
    summed = found.groupBy("word").agg(F.any_value("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return summed.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.x")).alias("near_n"))


# ---------------------------------------------------------------- forms and roots


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): forms are followed to the last, twice as far in every round."""
    now = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut(now.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 10, largest: int = LARGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n), a row for each.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least ratio
    times its own, else null; its root is the last word that forms lead to, itself without a form. Words are
    distinct and not null; an empty table stays empty.
    """
    words = cut(words.select("word", "n"), "spelling-words")
    near = cut(near_words(words, largest), "spelling-near")
    formed = near.where(F.col("near_n") >= ratio * F.col("n")).select("word", F.col("near").alias("form"), F.col("near_n").alias("form_n"))
    tied = formed.join(_roots(formed), "word")
    out = words.join(near.select("word", "n_near"), "word", "left").join(tied, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
