"""What a task of op7_sentencepiece and of the pipeline's last stage holds for a pack, beyond the pack's own numbers."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from corvane.llm import piece_encoding

WORDS = 1_500_000


def test_packs_are_packed_and_assembled_in_blocks(monkeypatch):
    monkeypatch.setattr(piece_encoding, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = [f"w{k}" for k in range(50)]
    text = " ".join(words * (WORDS // 500))
    batches = [pa.record_batch({"doc_id": [k], "text": [text]}) for k in range(10)]
    tracemalloc.start()
    try:
        pack, bundles = piece_encoding._packs(1, 1 << 40)(iter(batches))
        packing = tracemalloc.get_traced_memory()[1]
        units = piece_encoding._strings(bundles.column("sizes")[0].as_py(), bundles.column("spelt")[0].as_py())
        sizes, ids = np.ones(len(units), np.uint32), np.arange(len(units), dtype=np.uint32)
        answers = pa.table({"pack": pack.column("pack"), "home": pa.array([0], pa.int32()), "sizes": [piece_encoding._planes(sizes)], "ids": [piece_encoding._planes(ids)]})
        tracemalloc.reset_peak()
        told = piece_encoding._assemble(pa.Table.from_batches([pack]).drop_columns(["share", "sizes", "spelt"]), answers)
        assembling = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    names = units.to_pylist()
    spelt = "".join(names[k] for k in told.column("ids")[3].as_py())
    assert spelt == piece_encoding.SPACE + text.replace(" ", piece_encoding.SPACE)
    n = sum(len(x) for x in told.column("ids").to_pylist())
    assert n == 2 * WORDS
    assert packing < 20 * n, packing / n
    assert assembling < 20 * n, assembling / n
