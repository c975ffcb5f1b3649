"""Bounded summaries of keyed counts: cells of many tasks merged by shuffle, kept by every task afterwards.

A summary is `depth` rows of `width` one-byte counters that stop at 255; a key is counted in one cell of each row, so the least
of its cells is never under its count. Tasks send their cells in packed blocks, blocks of all tasks are added up in two
rounds (salted, then whole), and only the merged summary, whose size is a parameter, reaches the driver and goes out again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layoutlens.llm.common import released

BLOCKS = 64
SALTS = 16
SCHEMA = "block int, salt int, cells binary"
FULL = 255


def cells_for(entries: int, least: int = 1 << 14, most: int = 1 << 24) -> int:
    """A power of two of at least `entries`, between `least` and `most`."""
    return min(most, max(least, 1 << max(0, int(entries) - 1).bit_length()))


class Cells:
    """Counters that never underestimate."""

    def __init__(self, width: int, depth: int, table: np.ndarray | None = None) -> None:
        self.width, self.depth = width, depth
        self.table = np.zeros((depth, width), dtype=np.uint8) if table is None else table

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """(depth, n) cells of 64-bit hashes."""
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        rows = np.arange(self.depth, dtype=np.uint64)[:, None]
        return ((hashes + rows * step) & np.uint64(self.width - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        for row, places in zip(self.table, self.places(hashes), strict=True):
            order = np.argsort(places, kind="stable")
            spots, first = np.unique(places[order], return_index=True)
            row[spots] = np.minimum(row[spots] + np.add.reduceat(counts[order], first), FULL) if len(spots) else 0

    def least(self, hashes: np.ndarray) -> np.ndarray:
        """At least the count of each key (up to FULL)."""
        return np.min(np.take_along_axis(self.table, self.places(hashes), axis=1), axis=0) if len(hashes) else np.zeros(0, np.uint8)

    def blocks(self, salt: int) -> Iterator[pa.RecordBatch]:
        size = self.table.size // BLOCKS
        packed = [(b, zlib.compress(part.tobytes(), 1)) for b, part in enumerate(self.table.reshape(BLOCKS, size)) if part.any()]
        if packed:
            salts = pa.array([salt % SALTS] * len(packed), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int32()), salts, pa.array([c for _, c in packed], pa.binary())], names=["block", "salt", "cells"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one partition added up as they stream past, one held for each block and salt."""
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for block, salt, cells in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = np.frombuffer(zlib.decompress(cells), dtype=np.uint8)
            before = held.get((block, salt))
            held[block, salt] = own if before is None else np.minimum(before.astype(np.uint16) + own, FULL).astype(np.uint8)
    for (block, salt), own in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["block", "salt", "cells"])


def merged(parts: DataFrame, width: int, depth: int) -> Cells:
    """The sum of the blocks (SCHEMA) of all tasks, on the driver: `width` * `depth` bytes at most."""
    salted = parts.repartition("block", "salt").mapInArrow(released(_added), SCHEMA).withColumn("salt", F.lit(0))
    found = salted.repartition("block").mapInArrow(released(_added), SCHEMA).toArrow()
    table = np.zeros((BLOCKS, width * depth // BLOCKS), dtype=np.uint8)
    for block, cells in zip(found["block"].to_pylist(), found["cells"].to_pylist(), strict=True):
        table[block] = np.frombuffer(zlib.decompress(cells), dtype=np.uint8)
    return Cells(width, depth, table.reshape(depth, width))


def cut(data: bytes, size: int, boundary) -> Iterator[bytes]:
    """Parts of some `size` bytes, each ending with a match of the compiled pattern `boundary`; a part without one goes on to the next match."""
    a = 0
    while len(data) - a > size and (found := boundary.search(data, a + size)):
        yield data[a : found.end()]
        a = found.end()
    yield data[a:] if a else data
