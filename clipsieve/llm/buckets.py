"""Counts of hashed n-grams as a distributed table, and how chunks of texts look them up.

An n-gram's bucket is the top bits of its hash; the number of buckets follows the
corpus. The table is cut into pieces (ranges of buckets), one row each. Texts are
dealt into chunks; a chunk sends its sorted distinct buckets to their pieces and
gets one value a bucket back, so nothing of the table's size is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A piece has so many buckets (two to the power) at most, and there are 64 pieces at least.
PIECE_BITS = 20
#: n-grams of one chunk of texts, and its texts, at most (one longer text is a chunk of its own).
CHUNK, TEXTS = 1_000_000, 50_000

ASKS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("blob", T.BinaryType())])
#: Buckets of each text of an array of texts.
Buckets = Callable[[pa.Array], Iterator[np.ndarray]]


def low_bits(bits: int) -> int:
    """Bits of a bucket's place within its piece."""
    return min(PIECE_BITS, bits - 6)


def pack(x: np.ndarray) -> bytes:
    """The array's bytes, compressed plane by plane."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T), 1)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def cut(buckets: np.ndarray, low: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Piece, begin, end, and the packed places of each piece of sorted distinct buckets."""
    of = buckets >> low
    starts = np.flatnonzero(np.diff(of, prepend=-1)).tolist() or [0]
    for lo, hi in zip(starts, [*starts[1:], len(buckets)], strict=True):
        if lo == hi:
            return
        places = buckets[lo:hi] - (of[lo] << low)
        yield int(of[lo]), lo, hi, pack(np.diff(places, prepend=0).astype(np.uint32))


def places_of(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint32), dtype=np.int64)


def asks(docs: DataFrame, bits: int, buckets: Buckets, text_at: int) -> DataFrame:
    """``chunk, piece, blob``: each chunk's rows (piece -1), and its distinct buckets by piece. ``text_at``: the column with the texts."""
    low = low_bits(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, texts, n = TaskContext.get().partitionId() << 32, [], [], 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(texts).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            asked = [(-1, sink.getvalue().to_pybytes()), *((k, places) for k, _, _, places in cut(np.unique(np.concatenate(held)), low))]
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(asked), pa.int64()), pa.array([k for k, _ in asked], pa.int32()), pa.array([x for _, x in asked], pa.binary())], ASKS.names)

        for batch in batches:
            begin = 0
            for k, found in enumerate(buckets(batch.column(text_at))):
                held.append(found)
                n += len(found)
                if n >= CHUNK or len(held) >= TEXTS:
                    texts.append(batch.slice(begin, k + 1 - begin))
                    yield packed()
                    chunk, held, texts, n, begin = chunk + 1, [], [], 0, k + 1
            if begin < batch.num_rows:
                texts.append(batch.slice(begin))
        if held:
            yield packed()

    return docs.mapInArrow(rows, ASKS)


def answers(asked: DataFrame, table: DataFrame, columns: tuple[str, ...], value: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """``chunk, piece, blob``: the values of the buckets that are asked for, from ``table`` (``piece`` and binary ``columns``).

    ``value`` makes the array of a piece's values from its columns; a task holds one piece at a time.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values = [], np.zeros(0)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for chunk, piece, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if chunk < 0:
                    held = [blob] if chunk == -len(columns) else [*held, blob]
                    if chunk == -1:
                        values = value(held)
                else:
                    for column, x in zip(out, (chunk, piece, pack(values[places_of(blob)])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ASKS.names)

    both = asked.filter("piece >= 0")
    for k, c in enumerate(columns):
        both = both.unionByName(table.select(F.lit(k - len(columns)).cast("long").alias("chunk"), "piece", F.col(c).alias("blob")))
    return both.repartition("piece").sortWithinPartitions("piece", "chunk").mapInArrow(rows, ASKS)


def met(asked: DataFrame, answered: DataFrame, kind: type, use: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """What ``use`` makes of each chunk's rows and the values of its sorted distinct buckets."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, parts = None, []

        def used() -> Iterator[pa.RecordBatch]:
            for batch in pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches():
                yield from use(batch, np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for x in parts)]))

        for batch in batches:
            for piece, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if piece >= 0:
                    parts.append(x)
                    continue
                if blob is not None:
                    yield from used()
                blob, parts = x, []
        if blob is not None:
            yield from used()

    both = asked.filter("piece < 0").unionByName(answered)
    return both.repartition("chunk").sortWithinPartitions("chunk", "piece").mapInArrow(rows, schema)
