"""What encode leaves on the executors' disks once the units are written."""

import time
from pathlib import Path

from corvane.llm import piece_encoding
from corvane.llm.queries import tokenizer_file


#: Bytes that the sums and counts of encode may leave; bundles of the units below are many times that.
SMALL = 10_000


def _shuffled(spark) -> dict[str, int]:
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    found = {}
    for p in (p for d in folders for p in Path(d).rglob("shuffle_*.data")):
        try:
            found[p.name] = p.stat().st_size
        except FileNotFoundError:  # it went meanwhile
            pass
    return found


def test_bundles_of_the_lattice_do_not_lie_beside_those_of_the_answers(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{hash((k, i)) % 10**9:x}" for i in range(100))) for k in range(200)], "doc_id long, text string")
    before, name = _shuffled(spark), piece_encoding.SPENT
    told = spark.conf.get(name, None)
    got = piece_encoding.encode(docs, tokenizer_file("piece_bpe_32k.model"), pack=1000, share=500)
    ends = time.time() + 20
    left = lambda: sum(n for name, n in _shuffled(spark).items() if name not in before)
    while left() > SMALL and time.time() < ends:
        time.sleep(0.2)
    assert left() <= SMALL
    assert spark.conf.get(name, None) == told
    # nothing that the rows still need has gone, also when they are asked for twice
    first = sorted(tuple(r) for r in got.collect())
    assert len(first) == 200 and first == sorted(tuple(r) for r in got.collect())
