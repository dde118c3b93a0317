"""SentencePiece encoding and decoding over a relational lattice.

1. Documents are packed: each task turns its texts into numbers of units (runs that no piece of the vocabulary
   reaches across). A pack is a row with its documents' numbers, and its distinct units stand beside it in bundles,
   one for each share of the units' hashes. Texts don't travel.
2. The distinct units of all packs become a lattice: every substring up to the longest piece is exploded,
   equi-joined to the piece table, and the edges are grouped by unit.
3. A higher-order fold finds the path: for unigram models Viterbi over positions, for BPE models (the public
   piece file is one) the merges in rank order over the same edges, as a best path of scores is not what a BPE
   model encodes. Boundaries are bits of a long, so a step is a few bit operations.
4. The bundles of a share meet its units, which gives one answer for each bundle; answers go to their packs, and
   every pack is assembled from arrays.

Units of more than WIDE characters don't fit a long; the library encodes those few, with the same model, where
their bundles are answered.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.storage import bucketed, cut, settings

SPACE = "▁"
LETTERS = "A-Za-zÀ-ɏ"
WIDE = 60
PACK = 3 << 22  # characters after which a pack ends
SHARE = 1 << 21  # characters of text for each share of the units, up to MOST_SHARES
MOST_SHARES = 20_000
PACKS_AT_ONCE = 1 << 12  # packs whose bundles of a share meet its units in one group
FRESH = 1 << 19  # units of a share's bundles that are made distinct at once before they travel
LEVEL = 6  # of compression for what travels
BLOCK = 1 << 17  # numbers of a pack that are looked up at once; a lookup takes several times the memory of its numbers
KEYS = 1 << 15  # units that a task of the lattice groups in memory; beyond them it sorts
#: What a write has shuffled goes when it has ended: nothing reads the bundles of the lattice again, and they would lie beside those of the answers.
SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UNIT = re.compile(rf"{SPACE}*(?:[{LETTERS}]+|[^{LETTERS}{SPACE}\n]+)|{SPACE}+|\n+")
Bytes = dict[int, bytes]
#: Ten thousand long texts are too many for one batch of a task that packs them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 256, "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def load_model(path: str):
    """pieces as (id, piece, score), kind ('bpe' or 'unigram'), id of byte 0, and the bytes that each id stands for."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with byte fallback and without normalisation are read")
    pieces, spelt, byte0 = [], {}, None
    letter = re.compile(f"[{LETTERS}]")
    for i, p in enumerate(model.pieces):
        if p.type == p.BYTE:
            spelt[i] = bytes([int(p.piece[3:5], 16)])
            byte0 = i if spelt[i] == b"\0" else byte0
        elif p.type == p.NORMAL:
            body = p.piece.lstrip(SPACE)
            kinds = {bool(letter.match(c)) for c in body}
            if SPACE in body or "\n" in p.piece or len(kinds) > 1:
                raise ValueError(f"piece {p.piece!r} reaches across units")
            pieces.append((i, p.piece, float(p.score)))
            spelt[i] = p.piece.replace(SPACE, " ").encode()
        elif p.type == p.USER_DEFINED:
            raise ValueError("user-defined pieces are not read")
        else:
            spelt[i] = b""
    kind = "bpe" if model.trainer_spec.model_type == model.trainer_spec.BPE else "unigram"
    return pieces, kind, byte0, spelt


def piece_table(spark: SparkSession, pieces) -> DataFrame:
    """id, piece, score, rank (0 for the best score, shared by equal scores), risky; as many rows as the vocabulary.

    A piece is risky if a longer piece that begins or ends with it has a better rank: once it is merged, an edge
    that comes earlier by rank may become ready.
    """
    order = {s: k for k, s in enumerate(sorted({s for _, _, s in pieces}, reverse=True))}
    rank = {p: order[s] for _, p, s in pieces}
    risky = set()
    for p, k in rank.items():
        for part in (x for c in range(1, len(p)) for x in (p[:c], p[c:])):
            if len(part) > 1 and rank.get(part, -1) >= k:
                risky.add(part)
    return spark.createDataFrame([(i, p, s, order[s], p in risky) for i, p, s in pieces], "id int, piece string, score double, rank int, risky boolean")


PACKED = "pack long, share int, docs array<bigint>, crcs array<bigint>, lengths array<int>, codes binary, places binary, sizes binary, spelt binary"


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _chunks(text: str) -> list[str]:
    """Keys of the pieces between blanks; a line's first piece begins with the line ends before it.

    Texts whose units may reach across blanks give their units instead, each marked by a first character \\x01.
    """
    if "  " in text or " \n" in text or text[:1] == " " or SPACE in text or "\x01" in text:
        return ["\x01" + u for u in UNIT.findall(SPACE + text.replace(" ", SPACE))]
    return text.replace("\n", " \n").replace("\n \n", "\n\n").replace("\n \n", "\n\n").split(" ")


def _units(chunk: str) -> list[str]:
    return [chunk[1:]] if chunk[:1] == "\x01" else UNIT.findall(chunk if chunk[:1] == "\n" else SPACE + chunk)


def _squeezed(x: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(x)


def _plain(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _planes(x: np.ndarray, level: int = 1) -> bytes:
    """Unsigned 32-bit numbers, their bytes apart: upper ones are mostly zero."""
    return _squeezed(np.ascontiguousarray(x.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T), level)


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(_plain(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _strings(sizes: bytes, spelt: bytes) -> pa.Array:
    """The units of a bundle from their lengths in bytes and their bytes."""
    ends = np.cumsum(_from_planes(sizes), dtype=np.int64)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype("<i4").tobytes()), pa.py_buffer(_plain(spelt, np.uint8)))


def _spelt(units: pa.Array, first: np.ndarray, last: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Lengths and bytes of the units in each of the ranges [first, last)."""
    bounds, letters = np.frombuffer(units.buffers()[1], "<i4", len(units) + 1, 4 * units.offset), np.frombuffer(units.buffers()[2] or b"", np.uint8)
    return [_planes(np.diff(bounds[i : j + 1]), LEVEL) for i, j in zip(first, last, strict=True)], [_squeezed(letters[bounds[i] : bounds[j]], LEVEL) for i, j in zip(first, last, strict=True)]


def _codes(seen: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of the chunks seen, where flat has those of chunk after chunk and sizes how many each has; how many units lie before each chunk, and before the end."""
    ends = np.zeros(len(seen) + 1, np.int64)
    np.cumsum(sizes[seen], out=ends[1:])
    starts, code = np.cumsum(sizes) - sizes, np.empty(ends[-1], np.uint32)
    for i in range(0, len(seen), BLOCK):
        own = seen[i : i + BLOCK]
        code[ends[i] : ends[i + len(own)]] = flat[_gather(starts[own], sizes[own])]
    return code, ends


def _packs(shares: int, most: int):
    names = [c.split(" ")[0] for c in PACKED.split(", ")]
    kinds = {"pack": pa.int64(), "share": pa.int32(), "docs": pa.list_(pa.int64()), "crcs": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "codes": pa.binary(), "places": pa.binary(), "sizes": pa.binary(), "spelt": pa.binary()}

    def rows(**columns) -> pa.RecordBatch:
        n = len(columns["pack"])
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kinds[c]) for c in names], names)

    def packed(number: int, docs: list, crcs: list, chunks: _Numbers, body: list) -> Iterator[pa.RecordBatch]:
        units, flat, sizes = _Numbers(), array("i"), array("i")
        for c in chunks:
            own = _units(c)
            sizes.append(len(own))
            flat.extend(map(units.__getitem__, own))
        sizes, flat = np.array(sizes, np.int64), np.array(flat, np.int32)
        seen, held = (np.concatenate(body) if body else np.zeros(0, np.int32)), np.cumsum([len(x) for x in body])
        # their memory is wanted for what follows
        chunks.clear()
        body.clear()
        spelt = list(units)
        units.clear()
        code, ends = _codes(seen, flat, sizes)
        lengths = np.diff(np.concatenate([[0], ends[held]]))
        del flat, seen, ends
        # frequent units get small codes, and others follow as they come, so that upper bytes say little
        often = np.zeros(len(spelt), np.int64)
        for i in range(0, len(code), BLOCK):
            often += np.bincount(code[i : i + BLOCK], minlength=len(spelt))
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        for i in range(0, len(code), BLOCK):
            code[i : i + BLOCK] = rank[code[i : i + BLOCK]]
        # a unit's place is by share and spelling: alike neighbours are squeezed well
        spelt = [spelt[k] for k in order]
        home = np.fromiter((zlib.crc32(u.encode()) % shares for u in spelt), np.int32, len(spelt))
        spelt = pa.array(spelt, pa.string())
        order = pc.sort_indices(pa.table({"home": home, "spelt": spelt}), [("home", "ascending"), ("spelt", "ascending")])
        place = np.empty(len(order), np.uint32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.uint32)
        code = _planes(code)
        yield rows(pack=[number], docs=[docs], crcs=[crcs], lengths=[lengths], codes=[code], places=[_planes(place)])
        del code, place
        spelt, home = spelt.take(order), home[order.to_numpy()]
        own, first = np.unique(home, return_index=True)
        sizes, letters = _spelt(spelt, first, np.append(first[1:], len(home)))
        yield rows(pack=[number] * len(own), share=own.tolist(), sizes=sizes, spelt=letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seq = held = 0
        docs, crcs, body, chunks = [], [], [], _Numbers()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                found = _chunks(text) if text else []
                body.append(np.fromiter(map(chunks.__getitem__, found), np.int32, len(found)))
                docs.append(doc)
                crcs.append(zlib.crc32(text.encode("utf-8", "replace")))
                held += len(text)
                if held >= most:
                    yield from packed((task << 32) | seq, docs, crcs, chunks, body)
                    seq, held = seq + 1, 0
                    docs, crcs, body, chunks = [], [], [], _Numbers()
        if docs:
            yield from packed((task << 32) | seq, docs, crcs, chunks, body)

    return run


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _shifted(x: int, by: Column) -> Column:
    """x << by, as a long."""
    return F.call_function("shiftleft", _long(x), by.cast("int"))


def lattice(units: DataFrame, pieces: DataFrame, longest: int, edge: Column) -> DataFrame:
    """edges: sorted array of edge for each piece that occurs in each of units(unit, ...), whose columns stay.

    edge is made of rank, s, e, id, score and risky. units must be distinct and not empty; a unit without any edge
    has a row with an empty array. Starts and ends are exploded as numbers, so substrings are cut in compiled code.
    """
    own = units.columns
    starts = units.select(*own, F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    spans = starts.select(*own, "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, F.length("unit")))).alias("e"))
    rows = spans.select(*own, "s", "e", F.substring(F.col("unit"), F.col("s") + 1, F.col("e") - F.col("s")).alias("part"))
    # hashes are looked up as longs, equal pieces are what counts; the first character keeps a row of every unit
    met = rows.join(F.broadcast(pieces.withColumn("hash", F.xxhash64("piece"))), F.xxhash64("part") == F.col("hash"), "left")
    same = F.col("part") == F.col("piece")
    edges = met.where(same | ((F.col("s") == 0) & (F.col("e") == 1)))
    return edges.groupBy(*own).agg(F.sort_array(F.collect_list(F.when(same, edge))).alias("edges"))


#: The bit of a packed edge of more than one character.
LONG_EDGE = 53


def packed_edge() -> Column:
    """whether e is more than s + 1, rank, s, e, risky and id in one long, which sorts by rank and start after edges of one character: 1, 20, 6, 6, 1 and 20 bits."""
    left = lambda c, k: F.shiftleft(F.col(c).cast("long"), k)
    return F.shiftleft((F.col("e") - F.col("s") > 1).cast("long"), LONG_EDGE).bitwiseOR(left("rank", 33)).bitwiseOR(left("s", 27)).bitwiseOR(left("e", 21)).bitwiseOR(left("risky", 20)).bitwiseOR(F.col("id").cast("long"))


def scored_edge() -> Column:
    return F.struct("rank", "s", "e", "id", "score", "risky")


def _fallback(unit: Column, at: Column, byte0: int) -> Column:
    """ids of the bytes of the character at a place."""
    code = F.hex(F.encode(F.substring(unit, at + 1, F.lit(1)), "UTF-8"))
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.length(code), 1) - 1), lambda k: F.conv(F.substring(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + byte0)


def _field(edge: Column, at: int, bits: int) -> Column:
    return F.shiftright(edge, at).bitwiseAND(_long((1 << bits) - 1))


def merge_paths(found: DataFrame, byte0: int) -> DataFrame:
    """ids (and all but edges of found) by BPE over packed edges: of two neighbours whose union is a piece, those of the best rank merge, the leftmost first.

    Bit s of the mask is set where a symbol starts, and bit n past the last. An edge has the bits of its two ends,
    and of its span from one to the other; it is ready if both ends and just one bit between them are set. One pass
    over the edges by rank is the whole answer unless the merge of a risky piece makes an earlier edge ready, which
    is looked up at that merge; then the unit is folded again, taking the best ready edge anew at every step.
    """
    n = F.length("unit")
    own = [c for c in found.columns if c != "edges"]
    again = _long(1 << 62)
    start_of, end_of, id_of = (lambda e: _field(e, 27, 6)), (lambda e: _field(e, 21, 6)), (lambda e: _field(e, 0, 20))
    ends = lambda e: _shifted(1, start_of(e)).bitwiseOR(_shifted(1, end_of(e)))
    span = lambda e: _shifted(2, end_of(e)) - _shifted(1, start_of(e))
    spread = lambda e: F.struct(e.alias("key"), ends(e).alias("ends"), span(e).alias("span"))
    wide = F.transform(F.filter("edges", lambda e: e >= _long(1 << LONG_EDGE)), spread)
    df = found.select(*own, "edges", wide.alias("wide"))
    ready = lambda m, e: (m.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(m.bitwiseAND(e["span"])) == 3)
    merged = lambda m, e: m.bitwiseAND(F.bitwise_not(e["span"])).bitwiseOR(e["ends"])
    earlier = lambda m, e: F.exists("wide", lambda o: (o["key"] < e["key"]) & ready(m, o))
    checked = lambda m, e: F.aggregate(F.array(merged(m, e)), m.bitwiseAND(again), lambda f, x: F.when(earlier(x, e), x.bitwiseOR(again)).otherwise(x.bitwiseOR(f)))
    once = F.aggregate("wide", _shifted(2, n) - 1, lambda m, e: F.when(~ready(m, e), m).when(_field(e["key"], 20, 1) == 1, checked(m, e)).otherwise(merged(m, e)))
    df = df.select(*own, "edges", "wide", once.alias("once"))
    best = lambda m: F.slice(F.filter("wide", lambda e: ready(m, e)), 1, 1)
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), _shifted(2, n) - 1, lambda m, _: F.aggregate(best(m), m, merged))
    df = df.select(*own, "edges", "wide", F.when(F.col("once").bitwiseAND(again) == 0, F.col("once")).otherwise(exact).alias("mask"))
    # a character is left as it was if the mask has its bit and the next
    alone = F.filter("edges", lambda e: (e < _long(1 << LONG_EDGE)) & (F.call_function("shiftright", F.col("mask"), start_of(e).cast("int")).bitwiseAND(_long(3)) == 3))
    joined = F.transform(F.filter("wide", lambda e: F.col("mask").bitwiseAND(e["span"]) == e["ends"]), lambda e: e["key"])
    df = df.select(*own, "mask", F.concat(alone, joined).alias("kept"))
    # start and id in one long sort by start; a symbol without an edge is a character to be spelt in bytes
    ordered = F.sort_array(F.transform("kept", lambda e: F.shiftleft(start_of(e), 20).bitwiseOR(id_of(e))))
    plain = F.transform(ordered, lambda k: id_of(k).cast("int"))
    whole = F.size("kept") == F.bit_count("mask") - 1
    return df.select(*own, F.when(whole, plain).otherwise(_with_bytes(F.transform("kept", lambda e: F.struct(start_of(e).cast("int").alias("s"), end_of(e).cast("int").alias("e"), F.array(id_of(e).cast("int")).alias("ids"))), byte0)).alias("ids"))


def viterbi_paths(found: DataFrame, byte0: int, unknown: float = -1e4) -> DataFrame:
    """ids (and all but edges of found) over scored edges by the largest sum of scores; of equal sums the path whose last piece is the longest, and so on back.

    A character without a piece of its own costs unknown. The fold runs over positions; its state holds the best
    sum and last edge up to each.
    """
    n = F.length("unit")
    own = [c for c in found.columns if c != "edges"]
    kind = "array<struct<total:double,s:int,ids:array<int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("s"), F.array().cast("array<int>").alias("ids"))).cast(kind)

    def step(best: Column, p: Column) -> Column:
        into = F.filter("edges", lambda e: e["e"] == p)
        options = F.transform(into, lambda e: F.struct((F.get(best, e["s"])["total"] + e["score"]).alias("total"), (-e["s"]).alias("minus_s"), F.array(e["id"]).alias("ids")))
        spelt = F.struct((F.get(best, p - 1)["total"] + F.lit(unknown)).alias("total"), (1 - p).alias("minus_s"), _fallback(F.col("unit"), p - 1, byte0).alias("ids"))
        top = F.array_max(F.when(F.exists(into, lambda e: e["s"] == p - 1), options).otherwise(F.array_append(options, spelt)))
        return F.array_append(best, F.struct(top["total"].alias("total"), (-top["minus_s"]).alias("s"), top["ids"].alias("ids")))

    df = found.select(*own, F.aggregate(F.sequence(F.lit(1), n), first, step).alias("best"))
    empty = F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids"))
    back = F.aggregate(F.sequence(F.lit(1), n), empty, lambda s, _: F.when(s["at"] <= 0, s).otherwise(F.struct(F.get("best", s["at"])["s"].alias("at"), F.concat(F.get("best", s["at"])["ids"], s["ids"]).alias("ids"))), lambda s: s["ids"])
    return df.select(*own, back.alias("ids"))


def _with_bytes(kept: Column, byte0: int) -> Column:
    """ids of the kept symbols in order, with the bytes of every character that none of them covers."""
    spelt = lambda p: F.struct(p.alias("s"), (p + 1).alias("e"), _fallback(F.col("unit"), p, byte0).alias("ids"))
    inside = lambda p: F.exists(kept, lambda k: (k["s"] <= p) & (p < k["e"]))
    unknown = F.transform(F.filter(F.sequence(F.lit(0), F.length("unit") - 1), lambda p: ~inside(p)), spelt)
    return F.flatten(F.transform(F.array_sort(F.concat(kept, unknown)), lambda k: k["ids"]))


def _library(model_path: str):
    """The library's encoder of units, without the blank that it puts before a text."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def encode_units(units: DataFrame, model_path: str) -> DataFrame:
    """ids beside the columns of units(unit, ...), which are distinct and of at most WIDE characters."""
    pieces, kind, byte0, _ = load_model(model_path)
    longest = max(len(p) for _, p, _ in pieces)
    found = lattice(units, piece_table(units.sparkSession, pieces), longest, packed_edge() if kind == "bpe" else scored_edge())
    return merge_paths(found, byte0) if kind == "bpe" else viterbi_paths(found, byte0)


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(share, unit) of bundles that come in order of their shares: units once for each FRESH of them, wide ones not at all."""

    def told(share: int, held: list[pa.Array]) -> pa.RecordBatch:
        found = pc.unique(pa.concat_arrays(held))
        found = found.filter(pc.less_equal(pc.utf8_length(found), WIDE))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), share, np.int32)), found], ["share", "unit"])

    share, held, n = None, [], 0
    for batch in batches:
        for own, sizes, spelt in zip(batch.column("share").to_pylist(), batch.column("sizes"), batch.column("spelt"), strict=True):
            if held and (own != share or n >= FRESH):
                yield told(share, held)
                held, n = [], 0
            share = own
            held.append(_strings(sizes.as_py(), spelt.as_py()))
            n += len(held[-1])
    if held:
        yield told(share, held)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(share, unit, ids) as bundles of the units of a share: their spelling, numbers of ids, and ids."""
    for batch in batches:
        batch = batch.sort_by([("share", "ascending"), ("unit", "ascending")])
        own, first = np.unique(batch.column("share").to_numpy(), return_index=True)
        last = np.append(first[1:], batch.num_rows)
        sizes, spelt = _spelt(batch.column("unit"), first, last)
        ids = batch.column("ids")
        at, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
        counts = [_planes(np.diff(at[i : j + 1]), LEVEL) for i, j in zip(first, last, strict=True)]
        told = [_planes(flat[at[i] : at[j]], LEVEL) for i, j in zip(first, last, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *[pa.array(x, pa.binary()) for x in (sizes, spelt, counts, told)]], ["share", "sizes", "spelt", "counts", "ids"])


def _answers(model_path: str):
    def run(bundles: pa.Table, known: pa.Table) -> pa.Table:
        """For each bundle of a share the numbers of ids of its units, and the ids."""
        names = pa.concat_arrays([pa.array([], pa.string()), *[_strings(a.as_py(), b.as_py()) for a, b in zip(known.column("sizes"), known.column("spelt"), strict=True)]])
        sizes, flat = (np.concatenate([np.zeros(0, "<u4"), *map(_from_planes, known.column(c).to_pylist())]) for c in ("counts", "ids"))
        sizes, flat = sizes.astype(np.int64), flat.astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        answers = []
        for spelt_sizes, spelt in zip(bundles.column("sizes"), bundles.column("spelt"), strict=True):
            units = _strings(spelt_sizes.as_py(), spelt.as_py())
            at = pc.index_in(units, value_set=names)
            wide = at.is_null().to_numpy(zero_copy_only=False)
            at = at.fill_null(0).to_numpy().astype(np.int64)
            if wide.any():
                more = [np.array(x, np.int32) for x in _library(model_path).encode(units.filter(pa.array(wide)).to_pylist())]
                own_sizes, parts = np.zeros(len(at), np.int64), [None] * len(at)
                for k, x in zip(np.nonzero(wide)[0], more, strict=True):
                    parts[k] = x
                for k in np.nonzero(~wide)[0]:
                    parts[k] = flat[starts[at[k]] : starts[at[k]] + sizes[at[k]]]
                own_sizes[:] = [len(x) for x in parts]
                own = np.concatenate(parts)
            else:
                own_sizes, own = sizes[at], flat[_gather(starts[at], sizes[at])]
            answers.append((_planes(own_sizes, LEVEL), _planes(own, LEVEL)))
        return pa.table({"pack": bundles.column("owner"), "home": bundles.column("share"), "sizes": pa.array([a for a, _ in answers], pa.binary()), "ids": pa.array([b for _, b in answers], pa.binary())})

    return run


def _assemble(packs: pa.Table, answers: pa.Table) -> pa.Table:
    found = []
    told = answers.sort_by("home")
    row = packs.to_pylist()[0] if packs.num_rows else None
    if row is not None:
        sizes = np.concatenate([np.zeros(0, "<u4"), *map(_from_planes, told.column("sizes").to_pylist())]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, "<u4"), *map(_from_planes, told.column("ids").to_pylist())]).astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        place, code = _from_planes(row["places"]), _from_planes(row["codes"])
        lengths = np.array(row["lengths"], np.int64)
        ends = np.cumsum(lengths)
        i = 0
        while i < len(lengths):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, side="right")))
            u = place[code[(ends[i - 1] if i else 0) : ends[j - 1]]]
            out = flat[_gather(starts[u], sizes[u])]
            upto = np.concatenate([[0], np.cumsum(sizes[u])])[ends[i:j] - (ends[i - 1] if i else 0)]
            at = np.concatenate([[0], upto]).astype(np.int32)
            found.append(pa.table({"doc_id": pa.array(row["docs"][i:j], pa.int64()), "text_crc32": pa.array(row["crcs"][i:j], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(out))}))
            i = j
    return pa.concat_tables(found) if found else pa.table({"doc_id": pa.array([], pa.int64()), "text_crc32": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", pack: int = PACK, share: int = SHARE, packs_at_once: int = PACKS_AT_ONCE) -> DataFrame:
    """doc_id, ids, text_crc32 (of the UTF-8 text) for every row of docs: the ids that the model's library gives.

    Null and empty texts have no ids. Rows are independent: repeated rows repeat their result and null ids pass
    through; other columns of docs are ignored. Empty tables give no rows. id_col must cast to long.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shares = min(max(-(-chars // share), spark.sparkContext.defaultParallelism), MOST_SHARES)
    with settings(spark, BATCHES):
        held = bucketed(rows.mapInArrow(_packs(shares, pack), PACKED), "pack", "packs")
    packs, bundles = held.where("share is null"), held.where("share is not null").select("pack", "share", "sizes", "spelt")
    n_packs = packs.count()

    near = bundles.select("share", "sizes", "spelt").repartition(shares, "share").sortWithinPartitions("share")
    units = near.mapInArrow(_distinct, "share int, unit string").repartition(shares, "share").distinct()
    with settings(spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": KEYS, SPENT: "true"}):
        known = cut(encode_units(units, model_path).select("share", "unit", "ids").mapInArrow(_bundled, "share int, sizes binary, spelt binary, counts binary, ids binary"), "units")
    left, right, keys = bundles.withColumnRenamed("pack", "owner"), known, ["share"]
    rounds = -(-n_packs // packs_at_once)
    if rounds > 1:  # more bundles of a share than one group should hold
        left, right, keys = left.withColumn("round", F.pmod(F.xxhash64("owner"), F.lit(rounds))), right.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")))), ["share", "round"]
    answers = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_answers(model_path), "pack long, home int, sizes binary, ids binary")
    own = packs.select("pack", "docs", "crcs", "lengths", "codes", "places").groupBy("pack")
    return own.cogroup(answers.groupBy("pack")).applyInArrow(_assemble, "doc_id long, text_crc32 long, ids array<int>")


def _speller(spelt: Bytes):
    lengths = np.array([len(spelt.get(i, b"")) for i in range(max(spelt) + 1)], np.int64)
    starts = np.cumsum(lengths) - lengths
    letters = np.frombuffer(b"".join(spelt.get(i, b"") for i in range(max(spelt) + 1)), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                held = batch.column("ids")
                ids = held.flatten().to_numpy(zero_copy_only=False)
                counts = np.diff(held.offsets.to_numpy()).astype(np.int64)
                raw = letters[_gather(starts[ids], lengths[ids])].tobytes()
                total = np.concatenate([[0], np.cumsum(lengths[ids])])
                ends = total[np.cumsum(counts)]
                begins = total[np.cumsum(counts) - counts]
                # the blank before the first word is the model's own
                texts = [raw[b + (raw[b : b + 1] == b" ") : e].decode("utf-8", "replace") for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "ids"], pa.array(texts, pa.string())], [*[c for c in batch.schema.names if c != "ids"], "text"])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded with its column ids replaced by text; other columns stay. Null ids count as none."""
    rest = [c for c in encoded.columns if c != "ids"]
    _, _, _, spelt = load_model(model_path)
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest)
    rows = encoded.select(*rest, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_speller(spelt), f"{schema}{', ' if rest else ''}text string")
