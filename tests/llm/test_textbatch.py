import gc
import subprocess
import sys
import weakref
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from rivulet.llm import language_id, packing, queries, textbatch


class Rows:
    """Stands for a DataFrame: gives the function that a worker would run."""

    schema = None

    def mapInArrow(self, run, schema):
        return run


def long_rows(n, size=4096):
    return pa.record_batch({"doc_id": pa.array(range(n)), "text": pa.array([f"{k} " + "word " * (size // 5) for k in range(n)])})


def test_parts_are_all_rows_in_order_and_bounded():
    texts = ["x" * n for n in (0, 5, 300, 1, 0, 2, 90, 90, 90, 0)] + [None]
    batch = pa.record_batch({"t": texts})
    parts = list(textbatch.parts(batch, 100))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 100 for p in parts)
    assert [p.num_rows for p in textbatch.parts(batch.slice(0, 0))] == [0]


def test_language_stage_sees_a_few_mb_of_a_batch_at_once(monkeypatch):
    batch, seen = long_rows(3000), []

    def predict(column, model):
        seen.append(column.nbytes)
        return ["en"] * len(column), np.ones(len(column))

    monkeypatch.setattr(language_id, "_predict", predict)
    out = list(language_id.accepted(Rows(), None)([batch, batch]))
    assert pa.Table.from_batches(out) == pa.Table.from_batches([batch, batch])
    assert sum(seen) > 2 * 3000 * 4000 and max(seen) <= textbatch.PART_BYTES


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads memory from /proc")
def test_a_worker_returns_what_a_stage_has_freed():
    code = """
import re
from pathlib import Path
from rivulet.llm import language_id
from tests.llm.test_textbatch import Rows, long_rows
last = []
def predict(column, model):
    made = [bytes(2000) for _ in range(50_000)]
    last.extend(made[::100] + made[-1:])  # among the freed ones and on top of them
    return ["en"] * len(column), [1.0] * len(column)
def anonymous():
    return int(re.search(r"Anonymous: +([0-9]+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
language_id._predict = predict
batch = long_rows(10)
run = language_id.accepted(Rows(), None)
before = anonymous()
list(run([batch]))
print(anonymous() - before)
"""
    root = Path(__file__).parents[2]
    grown = float(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout)
    assert grown < 50  # of 100 MB


def test_a_worker_keeps_one_operators_tables():
    memo = weakref.ref(packing.worker_memo(queries.tokenizer_path("word_bpe_49k.json")))
    assert packing.worker_memo(queries.tokenizer_path("word_bpe_49k.json")) is memo()
    net = language_id.ByteCNN(["de", "en"])
    model = (("de", "en"), tuple((k, v.shape, v.tobytes()) for k, v in net.params.items()))
    scorer = language_id._scorer(model)
    assert language_id._scorer(model) is scorer
    gc.collect()
    assert memo() is None
