"""What Python workers keep from one stage to the next."""

import subprocess
import sys
from pathlib import Path

import pytest

WORKER = """
import re, sys
import numpy as np, pyarrow as pa
from quern.llm import language, substring

def held():
    return sum(map(int, re.findall("Pss_(?:Anon|Shmem): +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

words = np.array([bytes(w).decode() for w in np.random.default_rng(7).integers(97, 123, (5000, 6), dtype=np.uint8)])

def batch(n, seed):
    picked = words[np.random.default_rng(seed).integers(0, 5000, (n, 400))]
    texts = [" ".join(p) for p in picked]
    doc = pa.array(np.arange(n))
    names = {"doc": doc, "raw": doc, "text": pa.array(texts), "lang": pa.array(["a", "b"] * (n // 2))}
    return pa.RecordBatch.from_arrays(list(names.values()), list(names))

stage = {"language": lambda b: language._count(b), "substring": lambda b: substring._hash_units(b)}[sys.argv[1]]
for b in stage(iter([batch(100, 1)])):
    pass
before = held()
for b in stage(batch(n, n) for n in (10_000,)):
    pass
del b
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
@pytest.mark.parametrize("stage", ["language", "substring"])
def test_workers_give_back_the_memory_of_large_batches(stage):
    root = Path(__file__).resolve().parents[2]
    run = subprocess.run([sys.executable, "-c", WORKER, stage], cwd=root, capture_output=True, text=True, check=True)
    # The batch has 28 MB of text.
    assert float(run.stdout) < 30


def test_slices_hold_all_texts_once():
    import pyarrow as pa

    from quern.llm.text import slices

    texts = ["a" * n for n in (5, 0, 30, 7, 7)] + [None]
    for limits in ((1000, 200_000), (2, 10), (1, 1)):
        found = list(slices(pa.array(texts), *limits))
        assert [t for _, _, some in found for t in some] == texts and [e for _, e, _ in found[:-1]] == [s for s, _, _ in found[1:]]
    assert list(slices(pa.array([], pa.string()))) == []
