"""What a Python worker keeps after a task: executors live on through all stages of the pipeline."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from millrace.llm import arrowio, classifier, jaccard


def _anonymous_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


class _Caught:
    """A frame that hands the function of mapInArrow to the test."""

    def __init__(self, docs):
        self.sparkSession, self.columns, self.schema = docs.sparkSession, docs.columns, docs.schema

    def mapInArrow(self, run, schema):
        return run


def test_a_task_leaves_no_memory_behind(docs):
    run = classifier.accepted(_Caught(docs), np.zeros((1 << classifier.BITS) + 1))
    at = docs.columns.index("text")

    def batches(n):
        for k in range(n):
            text = pa.array([" ".join(f"w{(i * 7 + j * k) % 5000}" for j in range(300)) for i in range(8000)])
            yield pa.RecordBatch.from_arrays([text if i == at else pa.nulls(8000) for i in range(len(docs.columns))], docs.columns)

    for _ in run(batches(1)):
        pass
    pa.default_memory_pool().release_unused()
    before = _anonymous_mb()
    for _ in run(batches(3)):
        pass
    assert _anonymous_mb() - before < 40


def test_prefixes_hold_no_whole_sets():
    s = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    token, count, _ = jaccard._Order((np.zeros(0, np.uint32), np.zeros(0, np.uint32)), 80).prefix(s)
    assert np.array_equal(token, s[:1001])
    assert token.base is None and count.base is None


def test_slices_hold_every_row_once():
    text = pa.array(["x" * n for n in (5, 0, 12, 3, 3, 30, 1)] + [None])
    got = list(arrowio.slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", 10))
    assert [x for b in got for x in b.column(0).to_pylist()] == text.to_pylist()
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(0).to_pylist()) <= 10 for b in got)
