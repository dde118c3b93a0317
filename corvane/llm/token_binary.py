"""Token-id output in Simple-8b words, written by Spark in id order and read back.

File format. An output folder is a Parquet table with a row per segment: part and segment (their order is the
order of the ids), start (ids of the part before it) and payload. A payload is little-endian:

    8 bytes   magic "S8BSEG2\\0"
    4 x u32   documents D, ids N, words W, escapes E
    D x i64   document ids          D x u32   ids of each document
    B x u32   first word of each block of 128 ids, B = ceil(N / 128)
    W x u64   words                 E x u64   escaped ids
    D x u8    1 where a document has no id (its place among the ids holds 0)

The top four bits of a word are its selector: how many ids of how many bits the other 60 hold, lowest bits
first. Selector 13 is an escape: the word holds the place of one id among the escapes. A block ends with its
last word, so blocks are decoded on their own; unused places of a last word are zero.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"S8BSEG2\0"
BLOCK = 128
SEGMENT = 1 << 20  # ids after which a segment ends
ESCAPE = 13
# Ids a word and bits an id, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """block offsets, words, escapes of unsigned ids. All blocks advance together, a word at a time."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros((blocks, BLOCK), np.uint64)
    v.reshape(-1)[:n] = ids
    length = np.full(blocks, BLOCK)
    if blocks:
        length[-1] = n - BLOCK * (blocks - 1)
    # for each selector: the first place from here on whose id is too wide
    stop = np.full((len(WIDTHS), blocks, BLOCK + 1), BLOCK, np.uint8)
    place = np.arange(BLOCK, dtype=np.uint8)
    bits = np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    most = int(bits.max(initial=0))
    for k, width in enumerate(WIDTHS):
        if width >= most:
            continue
        wide = np.where(bits > width, place, np.uint8(BLOCK))
        stop[k, :, :BLOCK] = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1]
    counts = np.array(COUNTS)
    at = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    rows, words, escapes = [], [], []
    n_escapes = 0
    while len(live):
        p, left = at[live], length[live] - at[live]
        fits = stop[:, live, p] - p[None, :] >= np.minimum(counts[:, None], left[None, :])
        sel = np.where(fits.any(axis=0), fits.argmax(axis=0), ESCAPE)
        word = np.zeros(len(live), np.uint64)
        for k in np.unique(sel):
            own = np.nonzero(sel == k)[0]
            if k == ESCAPE:
                escapes.append(v[live[own], p[own]])
                word[own] = np.arange(n_escapes, n_escapes + len(own), dtype=np.uint64)
                n_escapes += len(own)
            else:
                for c in range(COUNTS[k]):
                    here = p[own] + c
                    inside = here < length[live[own]]
                    word[own] |= np.where(inside, v[live[own], np.minimum(here, BLOCK - 1)], 0).astype(np.uint64) << np.uint64(c * WIDTHS[k])
            word[own] |= np.uint64(int(k) << 60)
        rows.append(live)
        words.append(word)
        at[live] += np.append(counts, 1)[sel]
        live = live[at[live] < length[live]]
    if not blocks:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    row, word = np.concatenate(rows), np.concatenate(words)
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(blocks)).astype(np.uint32)
    return offsets, word[order], np.concatenate(escapes) if escapes else np.zeros(0, np.uint64)


def unpack(n: int, offsets: np.ndarray, words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The n ids, all words of a selector at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.append(COUNTS, 1)[sel]
    run = np.cumsum(counts) - counts
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    first = run - run[offsets[block]] + block * BLOCK
    out = np.zeros(n + 64, np.uint64)
    for k in np.unique(sel):
        own = np.nonzero(sel == k)[0]
        if k == ESCAPE:
            out[first[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << WIDTHS[k]) - 1)
        ends = np.minimum((block[own] + 1) * BLOCK, n)
        for c in range(COUNTS[k]):
            here = first[own] + c
            inside = here < ends
            out[here[inside]] = (words[own[inside]] >> np.uint64(c * WIDTHS[k])) & mask
    return out[:n]


def to_segment(doc_ids: np.ndarray | list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    offsets, words, escapes = pack(ids)
    docs = pa.array(doc_ids, pa.int64())
    known, missing = docs.fill_null(0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False)
    head = np.array([len(docs), len(ids), len(words), len(escapes)], "<u4")
    parts = [MAGIC, head, known.astype("<i8"), lengths.astype("<u4"), offsets.astype("<u4"), words.astype("<u8"), escapes.astype("<u8"), missing.astype("u1")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def from_segment(payload: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """document ids (null where there is none), ids of each, all ids."""
    if payload[:8] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    d, n, w, e = (int(x) for x in np.frombuffer(payload, "<u4", 4, 8))
    at = 24
    out = []
    for kind, count in (("<i8", d), ("<u4", d), ("<u4", -(-n // BLOCK)), ("<u8", w), ("<u8", e), ("u1", d)):
        out.append(np.frombuffer(payload, kind, count, at))
        at += out[-1].nbytes
    return pa.array(out[0].astype(np.int64), mask=out[5] == 1), out[1], unpack(n, out[2], out[3], out[4])


_encoders: dict = {}

# The normaliser and pre-tokenizer under which a text can be cut at blanks. They drop white space,
# compose, lower-case, and never join letters with other characters.
BLANK_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BLANK_SPLITS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Letters that the normaliser leaves alone, then a run of symbols: two words of such a pre-tokenizer.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?#$%&*()]*)")
#: Bytes that an entry of the chunk cache takes besides its key and value.
ENTRY = 200


def _encoder(tokenizer: str, end_id: int, cache_bytes: int):
    """The encoder of this Python worker: tasks that follow each other share the tokenizer and its chunks."""
    key = (tokenizer, end_id, cache_bytes)
    if key not in _encoders:
        _encoders[key] = _new_encoder(*key)
    return _encoders[key]


def _visible_bytes() -> dict[int, str]:
    """Byte to the character that stands for it in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _new_encoder(tokenizer: str, end_id: int, cache_bytes: int):
    """Texts to ids, each ended by end_id.

    If the file's normaliser and pre-tokenizer are those above, texts are cut at blanks and a chunk is encoded once
    while the cache holds it: letters of PLAIN by the file's model alone, the rest by the whole tokenizer. Chunks
    come from two generations of at most about cache_bytes, the older of which goes when the newer is full. With
    any other file, whole texts go to the tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if sys.byteorder != "little":
        raise ValueError("ids are packed on little-endian machines")
    with open(tokenizer, encoding="utf-8") as f:
        told = json.load(f)
    whole = Tokenizer.from_file(tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    pack = lambda found: [array("I", x.ids).tobytes() for x in found]

    steps = lambda part, key: part[key] if part and part.get("type") == "Sequence" else [part]
    added = told.get("added_tokens") or []
    if steps(told["normalizer"], "normalizers") != BLANK_NORMALISER or steps(told["pre_tokenizer"], "pretokenizers") != BLANK_SPLITS or any(t["normalized"] or not t["content"].startswith("<|") for t in added):
        return lambda texts: [x + end for x in pack(whole.encode_batch_fast(texts, add_special_tokens=False))]

    words = Tokenizer(whole.model)
    visible = _visible_bytes()
    young: dict[bytes, bytes] = {}
    old: dict[bytes, bytes] = {}
    held = 0

    def by_model(letters: list[bytes]) -> list[bytes]:
        return pack(words.encode_batch_fast([x.decode() if x.isascii() else x.decode("latin-1").translate(visible) for x in letters], add_special_tokens=False))

    def by_tokenizer(chunks: list[bytes]) -> list[bytes]:
        return pack(whole.encode_batch_fast([x.decode() for x in chunks], add_special_tokens=False))

    def find(chunks: set[bytes]) -> None:
        """Puts all chunks in the young generation."""
        nonlocal held
        letters, others, joined = {}, {}, []
        for c in chunks:
            if c in old:
                young[c] = old[c]
                continue
            m = PLAIN.fullmatch(c.decode())
            if not m:
                others[c] = None
            elif m[2]:
                stem = m[1].encode()
                joined.append((c, stem, c[len(stem) :]))
            else:
                letters[c] = None
        for _, stem, marks in joined:
            for piece, kind in ((stem, letters), (marks, others)):
                if piece not in young:
                    if piece in old:
                        young[piece] = old[piece]
                    else:
                        kind[piece] = None
        for kind, encode in ((letters, by_model), (others, by_tokenizer)):
            young.update(zip(kind, encode(list(kind)), strict=True))
        for c, stem, marks in joined:
            young[c] = young[stem] + young[marks]
        held += sum(len(c) + len(young[c]) + ENTRY for c in chunks)

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal young, old, held
        raw = [t.encode("utf-8", "replace").replace(b"\n", b" ") for t in texts]
        split = [(x if b"<|" in x else x.lower()).split(b" ") for x in raw]  # special tokens are told by their case
        if held > cache_bytes:
            old, young, held = young, {}, 0
        find(set().union(*split).difference(young))
        return [b"".join(map(young.__getitem__, chunks)) + end for chunks in split]

    return encode


def _segments(tokenizer: str, end_id: int, cache_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, end_id, cache_bytes)
        part = TaskContext.get().partitionId()
        start = segment = held = 0
        docs: list[int | None] = []
        data: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal start, segment, held
            lengths = np.array([len(x) // 4 for x in data], np.int64)
            ids = np.frombuffer(b"".join(data), "<u4").astype(np.uint64)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start]), pa.array([len(ids)]), pa.array([to_segment(docs, lengths, ids)], pa.binary())], ["part", "segment", "start", "n_ids", "payload"])
            start, segment, held = start + len(ids), segment + 1, 0
            docs.clear()
            data.clear()
            return row

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for i in range(0, len(texts), 256):
                for doc, x in zip(ids[i : i + 256], encode(texts[i : i + 256]), strict=True):
                    docs.append(doc)
                    data.append(x)
                    held += len(x) // 4
                    if held >= SEGMENT:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, cache_bytes: int = 100 << 20) -> None:
    """Encodes every text and writes its ids, each document ended by end_id, in ascending id order under path.

    A null text is empty and gives the end id alone. Rows without an id come before all others and keep a null
    id; rows that repeat an id, or have none, stand side by side, in the order of their texts (null texts first).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = ranged.mapInArrow(_segments(tokenizer, end_id, cache_bytes), "part int, segment int, start long, n_ids long, payload binary")
    out.write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
            docs, lengths, ids = from_segment(payload.as_py())
            ends = np.cumsum(lengths.astype(np.int64))
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([docs, pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column("payload"):
            docs, lengths, ids = from_segment(payload.as_py())
            at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int64)))], ["doc_id", "ids"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; start counts from the first file's first id."""
    table = spark.read.parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row for each output file
    offset, before = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in parts):
        offset.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(offset, "part int, offset long"))
    placed = table.join(offsets, "part").select((F.col("start") + F.col("offset")).alias("start"), "payload")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of every document in the files."""
    return spark.read.parquet(path).select("payload").mapInArrow(_with_ids, "doc_id long, ids array<bigint>")
