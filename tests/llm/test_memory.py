"""What a task's Python holds beside its input, for one Arrow batch of long and short texts."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from relsight.llm import packing, quality

MB = 1 << 20


def batch(size=6 * MB):
    random.seed(3)
    vocabulary = [f"word{i}" if i % 3 else f"Wörter{i}," for i in range(3000)]
    texts, total = [], 0
    while total < size:
        texts.append(" ".join(random.choices(vocabulary, k=random.choice([30, 300, 3000]))))
        total += len(texts[-1].encode())
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def task(spark, monkeypatch, operator):
    """The function that an operator gives to mapInArrow."""
    docs, caught = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f))
    operator(docs)
    return caught[0]


def peak(run, rows):
    for _ in run(iter([rows.slice(0, 1)])):  # tables that a worker keeps
        pass
    tracemalloc.start()
    try:
        n = sum(x.num_rows for x in run(iter([rows])))
        return n, tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


OPERATORS = {
    "packing": lambda docs: packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 1024),
    "quality": lambda docs: quality.score(docs, quality.train([], np.zeros(0, np.int64), 8, 1, 1.0, 1)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_task_holds_little_at_once(spark, monkeypatch, name):
    rows = batch()
    n, most = peak(task(spark, monkeypatch, OPERATORS[name]), rows)
    assert n >= rows.num_rows
    assert most < 32, f"{most:.0f} MB"
