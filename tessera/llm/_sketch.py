"""A Bloom filter of fixed size over row numbers: it says which rows can't be wanted, before their texts are shuffled.

With more rows than it was made for it lets more rows through; the join that follows drops them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._packed import edges, pack, unpack
from ._words import mix

#: 2 ** BITS bits (8 MB) in 2 ** 7 segments.
BITS, SEGMENTS, PROBES = 26, 128, 2


def _places(rids: np.ndarray) -> np.ndarray:
    x = rids.view(np.uint64)
    return np.stack([mix(x + np.uint64(0x632BE59BD9B4E019 + i)) >> np.uint64(64 - BITS) for i in range(PROBES)])


def sketch(rids: DataFrame) -> np.ndarray:
    def send(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.unique(_places(x)) << np.uint64(64 - BITS)
            cut = edges(at, SEGMENTS)
            rows = [(p, pack(at[cut[p] : cut[p + 1]] >> np.uint64(64 - BITS))) for p in range(SEGMENTS) if cut[p + 1] > cut[p]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "at"])

    def merge(table: pa.Table) -> pa.Table:
        size = (1 << BITS) // SEGMENTS
        part = table.column("part")[0].as_py()
        bits = np.zeros(size, bool)
        for blob in table.column("at").to_pylist():
            bits[(unpack(blob) - np.uint64(part * size)).astype(np.int64)] = True
        return pa.table({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((SEGMENTS, (1 << BITS) // SEGMENTS // 8), np.uint8)
    for row in rids.mapInArrow(send, "part int, at binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def maybe(bits: np.ndarray, rids: np.ndarray) -> np.ndarray:
    out = np.ones(len(rids), bool)
    for at in _places(rids):
        at = at.astype(np.int64)
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
