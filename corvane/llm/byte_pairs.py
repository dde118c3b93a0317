"""Byte-level BPE over whole texts: encoding by a segment tree of pair ranks, and decoding.

A word's segment tree has a leaf for each adjacent pair of symbols, rank * width + place, and every node holds the
least leaf below it. The root therefore names the leftmost pair of the lowest rank; merging it changes three leaves,
each in a logarithmic number of steps, and merging ends when no leaf holds a rank. Words of one width advance
together in numpy; longer ones have a tree each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

NONE = np.iinfo(np.int64).max
#: Words of up to this many bytes advance together.
WIDEST = 64
#: Characters that are encoded at a time; longer texts are cut where a word starts.
SLICE = 1 << 20
#: Bytes that an entry of the word cache takes besides its key and value.
ENTRY = 200

# How such files split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"
#: A single blank between other characters always starts a word.
WORD_START = regex.compile(r"(?<=\S) (?=\S)")
LOOSE_BLANK = re.compile(r"(?<!\S) | (?!\S)")


def visible_bytes() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, rest = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(rest))
        rest += b not in own
    return out


class Words:
    """Splits texts into words, with the letters and numbers of the Unicode version that the tokenizers library has.

    Versions differ in code points that were assigned late; the library's own splitter is asked about those alone,
    and only texts that hold one which it takes for neither are split by the stricter pattern.
    """

    def __init__(self):
        import unicodedata

        from tokenizers import pre_tokenizers

        split = pre_tokenizers.ByteLevel(add_prefix_space=False)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        late = []
        for kind, beside in (("L", "a"), ("N", "1")):
            found = [c for c in "".join(regex.findall(rf"\p{{{kind}}}+", every)) if unicodedata.category(c) == "Cn"]
            for lo in range(0, len(found), 500):
                part = found[lo : lo + 500]
                whole = {at for _, at in split.pre_tokenize_str("\n".join(beside + c + beside for c in part))}
                late += [ord(c) for k, c in enumerate(part) if (4 * k, 4 * k + 3) not in whole]
        self.plain = regex.compile(WORDS.format(L=r"\p{L}", N=r"\p{N}", O=r"[^\s\p{L}\p{N}]"))
        self.late = None
        if late:
            ranges = _ranges(sorted(late))
            self.late = re.compile(f"[{ranges}]")
            self.strict = regex.compile("(?V1)" + WORDS.format(L=rf"[\p{{L}}--[{ranges}]]", N=rf"[\p{{N}}--[{ranges}]]", O=rf"[[^\s\p{{L}}\p{{N}}]||[{ranges}]]"))

    def split(self, text: str) -> list[str]:
        late = self.late and not text.isascii() and self.late.search(text)
        return (self.strict if late else self.plain).findall(text)


def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out, first = [], points[0]
    for now, then in zip(points, [*points[1:], -1], strict=True):
        if then != now + 1:
            out.append(f"\\U{first:08x}-\\U{now:08x}")
            first = then
    return "".join(out)


class Merges:
    """The merge table of a tokenizer file, and segment trees over it."""

    def __init__(self, vocab: dict[str, int], merges: list):
        table = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            table[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.byte_ids = np.array([vocab[c] for c in visible_bytes()], np.int64)
        keys = np.array([(a << 32) | b for a, b in table], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.ranks = np.append(np.array([r for r, _ in table.values()], np.int64)[order], NONE)
        self.merged = np.zeros(len(merges) + 1, np.int64)
        for rank, new in table.values():
            self.merged[rank] = new
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.byte_ranks = self.rank(self.byte_ids[a], self.byte_ids[b])
        self.pairs = table

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b), NONE where they do not merge; negative symbols are no symbols."""
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w)
            if n == 1:
                out[k] = self.byte_ids[w[0]].astype("<i4").tobytes()
            elif n > WIDEST:
                out[k] = np.array(self._one(w), "<i4").tobytes()
            elif n:
                classes.setdefault(max(4, 1 << (n - 1).bit_length()), []).append(k)
        for width, own in classes.items():
            for lo in range(0, len(own), 1 << 14):
                part = own[lo : lo + (1 << 14)]
                for k, ids in zip(part, self._many([words[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _many(self, words: list[bytes], width: int) -> list[bytes]:
        """Words of at most width bytes, width a power of two: a merge in each unfinished word at every step."""
        m = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width).astype(np.int64)
        size = np.array([len(w) for w in words])
        place = np.arange(width)
        stride = width + 1  # the last column stands for "no neighbour"
        symbols = np.full((m, stride), -1, np.int64)
        symbols[:, :width] = np.where(place < size[:, None], self.byte_ids[raw], -1)
        after = np.tile(np.append(np.arange(1, width + 1), width), (m, 1))
        before = np.tile(np.append(np.concatenate([[width], np.arange(width - 1)]), width), (m, 1))
        tree = np.full((m, 2 * width), NONE, np.int64)
        first = self.byte_ranks[raw[:, :-1] * 256 + raw[:, 1:]]
        tree[:, width:-1] = np.where((place[1:] < size[:, None]) & (first < NONE), first * width + place[:-1], NONE)
        low = width
        while low > 1:
            low //= 2
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        symbols, after, before, tree = symbols.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.arange(m)

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            base, node = row * (2 * width), at + width
            tree[base + node] = value
            while node[0] > 1:
                node = node >> 1
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])

        while True:
            root = tree[live * (2 * width) + 1]
            more = root < NONE
            if not more.all():
                live, root = live[more], root[more]
            if not len(live):
                break
            rank, i = np.divmod(root, width)
            row = live * stride
            j = after[row + i]
            k = after[row + j]
            p = before[row + i]
            new = self.merged[rank]
            symbols[row + i], symbols[row + j] = new, -1
            after[row + i] = k
            before[row + k] = i
            put(live, j, NONE)
            right = self.rank(new, symbols[row + k])
            put(live, i, np.where(right < NONE, np.where(right < NONE, right, 0) * width + i, NONE))
            has = p < width
            if has.any():
                own, q = live[has], p[has]
                left = self.rank(symbols[row[has] + q], new[has])
                put(own, q, np.where(left < NONE, np.where(left < NONE, left, 0) * width + q, NONE))
        grid = symbols.reshape(m, stride)
        kept = grid >= 0
        ends = 4 * np.cumsum(kept.sum(axis=1))
        ids = grid[kept].astype("<i4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _one(self, word: bytes) -> list[int]:
        """A long word by a tree of its own."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        none = (len(self.merged) + 1) * width
        pairs, symbols = self.pairs, self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if found := pairs.get((symbols[i], symbols[i + 1])):
                tree[width + i] = found[0] * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            new = int(self.merged[rank])
            symbols[i], symbols[j], after[i] = new, -1, k
            put(j, none)
            put(i, none)
            if k >= 0:
                before[k] = i
                if found := pairs.get((new, symbols[k])):
                    put(i, found[0] * width + i)
            p = before[i]
            if p >= 0:
                found = pairs.get((symbols[p], new))
                put(p, found[0] * width + p if found else none)
        return [s for s in symbols if s >= 0]


class Known:
    """What has been encoded before: two generations, the older of which goes when the newer is full."""

    def __init__(self, most_bytes: int):
        self.most, self.held, self.young, self.old = most_bytes, 0, {}, {}

    def learn(self, keys: set[str], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A table that has all keys."""
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        fresh = [k for k in keys if k not in young]
        missing = [k for k in fresh if k not in old]
        young.update((k, old[k]) for k in fresh if k in old)
        young.update(zip(missing, make(missing), strict=True))
        self.held += sum(len(k) + len(young[k]) + ENTRY for k in fresh)
        return young


class Codec:
    """A byte-level BPE tokenizer file: texts to ids and back.

    Files with a normaliser, another splitter, dropout, or added tokens that strip blanks or match words are refused.
    """

    def __init__(self, path: str, cache_bytes: int):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"]
        added = told.get("added_tokens") or []
        odd = told.get("normalizer") or not split or split["type"] != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
        odd = odd or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        if odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.merges = Merges(model["vocab"], model["merges"])
        self.words = Words()
        self.special = {t["content"]: t["id"] for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.by_word, self.by_chunk = Known(cache_bytes), Known(cache_bytes)
        byte_of = {c: b for b, c in enumerate(visible_bytes())}
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        raw = [None] * (max(tokens) + 1)
        for i, t in tokens.items():
            raw[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.known = np.array([x is not None for x in raw])
        self.raw = pa.array([x or b"" for x in raw], pa.large_binary())

    def _parts(self, text: str) -> Iterator[str | int]:
        """Pieces of a text that are split on their own, and ids of added tokens."""
        pieces = self.special_pattern.split(text) if self.special_pattern else [text]
        for n, piece in enumerate(pieces):
            if n % 2:
                yield self.special[piece]
                continue
            at = 0
            while len(piece) - at > SLICE and (cut := WORD_START.search(piece, at + SLICE)):
                yield piece[at : cut.start()]
                at = cut.start()
            yield piece[at:]

    def _merged(self, words: list[str]) -> list[bytes]:
        return self.merges.encode([w.encode("utf-8", "replace") for w in words])

    def _joined(self, chunks: list[str]) -> list[bytes]:
        split = [self.words.split(c[1:] if c[0] == " " else " " + c) for c in chunks]
        known = self.by_word.learn(set().union(*split), self._merged)
        return [b"".join(map(known.__getitem__, w)) for w in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        Where every blank stands between other characters, each starts a word, and what lies between two is looked
        up whole; a key that starts with a blank is the start of a text, which has none before it.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bool, list[str]]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            chunks = self.by_chunk.learn(set().union(*(w for _, whole, w in waiting if whole)), self._joined)
            words = self.by_word.learn(set().union(*(w for _, whole, w in waiting if not whole)), self._merged)
            for k, whole, w in waiting:
                out[k].append(b"".join(map((chunks if whole else words).__getitem__, w)))
            waiting.clear()
            held = 0

        for k, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, int):
                    flush()
                    out[k].append(part.to_bytes(4, "little"))
                elif part:
                    if whole := not LOOSE_BLANK.search(part):
                        found = part.split(" ")
                        found[0] = " " + found[0]
                    else:
                        found = self.words.split(part)
                    waiting.append((k, whole, found))
                    held += len(part)
                    if held >= SLICE:
                        flush()
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive lists of ids; ends: where each list ends. Ids that the file lacks are left out."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.known))
        known[known] = self.known[ids[known]]
        taken = self.raw.take(pa.array(ids[known]))
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
        data = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] else b""
        last = at[np.concatenate([[0], np.cumsum(known)])[ends]].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([int(at[0]), *last[:-1]], last, strict=True)]


_codecs: dict = {}


def codec(path: str, cache_bytes: int = 24 << 20) -> Codec:
    """The codec of this Python worker: tasks that follow each other share it and its words."""
    if (path, cache_bytes) not in _codecs:
        _codecs[path, cache_bytes] = Codec(path, cache_bytes)
    return _codecs[path, cache_bytes]


def _runs(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most units each."""
    start = held = 0
    for k, n in enumerate(lengths):
        held += n
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every row: the whole text's ids under the tokenizer file, as its library gives without special tokens added.

    A null or empty text has no ids; an added token that stands in a text is its id. Null ids of rows pass through,
    repeated rows repeat, other columns are ignored, an empty table stays empty. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _runs([len(t) for t in texts], SLICE):
                found = own.encode(texts[a:b])
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids], ["doc_id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(table: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """table with the text of its ids: an added token is its own name, bytes that are no UTF-8 become U+FFFD.

    Null ids give a null text, null entries and ids that the file lacks are left out. All columns of table stay; one
    named as text_col is replaced.
    """
    kept = [c for c in table.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            lists = batch.column(ids_col)
            sizes = [n or 0 for n in lists.value_lengths().to_pylist()]
            for a, b in _runs(sizes, SLICE):
                part = lists.slice(a, b - a)
                ids = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = own.decode(ids, np.cumsum(sizes[a:b]))
                column = pa.array(texts, pa.string(), mask=part.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in kept), column], [*kept, text_col])

    schema = StructType([*(StructField(f.name, f.dataType) for f in table.select(*kept).schema), StructField(text_col, StringType())])
    return table.mapInArrow(run, schema)
