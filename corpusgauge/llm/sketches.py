"""Sketches of tasks, added up slice by slice in a tree of groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2**16
#: Sketches that meet in one group of the tree.
WIDTH = 32

SLICES = "slice int, part long, data binary"
_SLICES = pa.schema([("slice", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])

Adding = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _row(no: int, part: int, data: np.ndarray) -> dict:
    return {"slice": no, "part": part, "data": zstandard.ZstdCompressor(level=1).compress(data.tobytes())}


def _opened(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def summed(parts: DataFrame, tasks: int, add: Adding) -> DataFrame:
    """One row per slice: the sum of the slices of all tasks, numbered from 0 to ``tasks`` - 1.

    ``WIDTH`` slices meet in a group, their sums again, so the depth of the tree follows the number of
    tasks and no group grows with it.
    """

    def added(part: pa.Table) -> pa.Table:
        total = None
        for x in part["data"]:
            own = _opened(x.as_py())
            total = own if total is None else add(total, own)
        return pa.Table.from_pylist([_row(part["slice"][0].as_py(), part["part"][0].as_py(), total)], _SLICES)

    while tasks > 1:
        tasks = -(-tasks // WIDTH)
        parts = parts.withColumn("part", F.floor(F.col("part") / WIDTH)).groupBy("slice", "part").applyInArrow(added, SLICES)
    return parts


class SeenTwice:
    """Two Bloom filters of one size: keys seen, and keys seen again; the second has no false negatives."""

    def __init__(self, bits: int):
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, places: np.ndarray) -> None:
        """Bits of keys, one entry for each time that a key is seen."""
        at, n = np.unique(places, return_counts=True)
        byte, mask = (at >> 3).astype(np.int64), np.left_shift(1, at & 7).astype(np.uint8)
        again = (n > 1) | ((self.once[byte] & mask) > 0)
        np.bitwise_or.at(self.twice, byte[again], mask[again])
        np.bitwise_or.at(self.once, byte, mask)

    def slices(self, part: int):
        """Rows of the slices that hold anything."""
        for no in range(-(-len(self.once) // SLICE_BYTES)):
            own = slice(no * SLICE_BYTES, (no + 1) * SLICE_BYTES)
            if self.once[own].any():
                yield pa.RecordBatch.from_pylist([_row(no, part, np.concatenate((self.once[own], self.twice[own])))], _SLICES)


def _seen_by_both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    half = len(x) // 2
    again = x[half:] | y[half:] | (x[:half] & y[:half])  # what two tasks have seen once each is seen twice
    return np.concatenate((x[:half] | y[:half], again))


def twice_seen(parts: DataFrame, tasks: int, bits: int) -> np.ndarray:
    """The filter of keys seen again; it comes to the driver, and its size is ``bits``."""
    out = np.zeros(bits // 8, np.uint8)
    for row in summed(parts, tasks, _seen_by_both).select("slice", "data").collect():
        both = _opened(bytes(row["data"]))
        at = row["slice"] * SLICE_BYTES
        out[at : at + len(both) // 2] = both[len(both) // 2 :]
    return out


def has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bit at each place is set."""
    return (bits[(places >> 3).astype(np.int64)] >> (places & 7).astype(np.uint8)) & 1 > 0
