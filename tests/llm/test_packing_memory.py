"""Packing holds a shard's pieces as objects, not a whole batch of many shards."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidewater.llm import packing


def test_a_batch_of_many_shards_is_not_held_as_objects():
    shards, each, length = 40, 50, 2048
    n = shards * each
    ids = [np.full(length, i, "<i4").tobytes() for i in range(n)]
    columns = [pa.array(np.repeat(np.arange(shards), each), pa.int64()), pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array([length] * n, pa.int32()), pa.array(ids, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "piece", "n", "ids"])
    del ids
    tracemalloc.start()
    got = 0
    for out in packing._packs(length)(iter([batch])):
        got += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == n and batch.nbytes > 16_000_000
    assert peak < 8_000_000
