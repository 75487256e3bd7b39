"""Workers, which Spark keeps for further tasks, hand back what a task has freed."""

import ctypes
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from loregraph.llm import chunks, common, jaccard_join, super_minhash

KEPT = """
import pyarrow as pa
from loregraph.llm import common

def size():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

def work(batches):
    for batch in batches:
        freed, kept = [], []
        for _ in range(1500):
            freed.append(bytearray(100_000))
            kept.append(bytearray(600))  # pins what lies around it
        del freed
        yield len(kept)

for f in (common.returning_memory(work), work):
    before, held = size(), []
    for x in f([1]):
        held.append(x)
    print(size() - before)
"""


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs glibc")
def test_freed_memory_goes_back():
    out = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, check=True, timeout=60)
    returned, plain = map(int, out.stdout.split())
    assert returned <= 20 < 100 <= plain, (returned, plain)


class Rows:
    """Stands for a table: gives the function that ``mapInArrow`` is given."""

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):  # noqa: N802
        return function


@pytest.fixture
def returned(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "return_memory", lambda: calls.append(1))
    return calls


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([str(i).encode() for i in range(len(texts))], pa.binary())], ["doc_id", "text", "set_key"])


def test_packets_return_memory_at_the_end(monkeypatch, returned):
    monkeypatch.setattr(jaccard_join.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    out = jaccard_join.packs_of(Rows(), 5, 3)(iter([batch(["a b c d e f", None])]))
    assert next(out) is not None and not returned
    assert list(out) == [] and returned == [1]


def test_full_sets_come_in_bounded_batches_and_return_memory(returned):
    """Of a large batch no more than ``TEXTS`` sets are held at once."""
    count = 2 * super_minhash.TEXTS + 5
    out = super_minhash.token_sets(Rows(), 3)(iter([batch([f"a b c {i}" for i in range(count)])]))
    made = list(out)
    assert [b.num_rows for b in made] == [super_minhash.TEXTS, super_minhash.TEXTS, 5] and returned == [1]
    assert np.concatenate([b.column("set_key").to_pylist() for b in made]).tolist() == [str(i).encode() for i in range(count)]
    assert all(len(set(t)) == n == 2 for b in made for n, t in zip(b.column("n").to_pylist(), b.column("tokens").to_pylist()))


def test_new_chunks_are_encoded_some_at_a_time_and_pieces_return_memory(monkeypatch):
    """Ids of a large column come from encoder calls of bounded size; each piece returns memory."""
    given, calls = [], []
    monkeypatch.setattr(chunks, "STRINGS", 7)
    monkeypatch.setattr(chunks, "PIECE", 200)
    monkeypatch.setattr(chunks, "return_memory", lambda: calls.append(1))
    texts = [f"w{i} and w{i * 7 % 50}" for i in range(100)]

    def encode(strings):
        given.append(len(strings))
        return [list(s.encode()) for s in strings]

    found = [ids[low:high].tolist() for _, ids, bounds in chunks.Chunks(chunks.by_strings(encode), []).ids(pa.array(texts)) for low, high in zip(bounds[:-1], bounds[1:])]
    assert found == [list(t.encode()) for t in texts]
    assert max(given) <= 7 and len(calls) > 5
