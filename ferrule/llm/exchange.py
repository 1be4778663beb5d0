"""Rows shuffled in packed form: a few binary rows per task and target instead of one row per item.

Used where every word or window of the corpus has to meet its equals: the JVM then moves blobs,
and numpy works on whole arrays.  A target (bucket or group) is a key of an ordinary Spark shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ferrule.llm.words import slices

_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def pack_batch(batch: pa.RecordBatch | pa.Table) -> bytes:
    """A record batch as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as writer:
        writer.write(batch)
    return sink.getvalue().to_pybytes()


def unpack_batch(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def packed_by_bucket(source: DataFrame, key_of: Callable[[pa.RecordBatch], np.ndarray], text: str = "text") -> DataFrame:
    """``source`` as rows ``(bucket int, payload binary)``: Arrow streams of the rows of a bucket, which ``key_of``
    gives for every row of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, 8 << 20):
            bucket = key_of(part)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            bounds = np.append(first, len(order))
            for at in range(0, len(found), 64):  # bounded output batches
                blobs = [pack_batch(part.take(pa.array(order[bounds[k]:bounds[k + 1]])))
                         for k in range(at, min(at + 64, len(found)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[at:at + 64], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "payload"])

    return source.mapInArrow(run, "bucket int, payload binary")


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array whose neighbours are close."""
    values = values.astype(np.int64)
    return zlib.compress(np.diff(values, prepend=np.int64(0)).tobytes(), 1)


def expand(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.int64))


def gaps(slots: np.ndarray) -> tuple[bytes, int]:
    """An ascending array of small integers as its differences, in the narrowest width."""
    steps = np.diff(slots, prepend=0)
    width = 1 if not len(steps) or steps.max() < 256 else 2 if steps.max() < 65536 else 4
    return steps.astype(f"<u{width}").tobytes(), width


def from_gaps(blob: bytes, width: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, f"<u{width}").astype(np.int64))


def runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of the runs of a sorted array."""
    if len(keys):
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        end = np.append(begin[1:], len(keys))
        yield from zip(keys[begin].tolist(), begin.tolist(), end.tolist(), strict=True)


def totals(source: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], cells: int) -> np.ndarray:
    """Sum over the table of an array of ``cells`` counts per slice (at most ``cells`` rows reach the
    driver)."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for part in slices(batches):
            total += count(part)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["cell", "n"])

    out = np.zeros(cells, dtype=np.int64)
    for row in source.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out
