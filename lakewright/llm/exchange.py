"""Documents packed in chunks, and key exchange between chunks and key ranges.

``stage`` packs documents in compressed chunks, once, in the shared folder. A pass over chunks hashes
what it looks at, makes the keys of a chunk distinct and sends one packed row to each range of keys; a
range's task sees all chunks' keys of its range and answers each chunk in the order of the chunk's own
keys. ``meet`` brings chunks and answers together again. A key that very many documents hold costs a
chunk one entry, and all rows of an exchange are of similar size whatever the keys.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.session import cut, partitions
from lakewright.llm.text import slices, texts_of

#: Text bytes of a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20

CHUNKS = "chunk long, part int, payload binary"


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return _squeeze(sink.getvalue().to_pybytes())


def unpack_batch(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(_spread(data)) as stream:
        return stream.read_next_batch()


def stage(docs: DataFrame, text_at: int, size: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, part = -1, payload): all columns of ``docs`` packed by chunk and checkpointed.

    ``text_at``: the position of the text column, whose bytes make up a chunk's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, at, _ = texts_of(batch.column(text_at))
            for i, j in slices(at, size):
                yield packed_rows([((task << 32) + seq, -1, pack_batch(batch.slice(i, j - i)))])
                seq += 1

    return cut(docs.mapInArrow(run, CHUNKS))


def packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    chunk, part, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(payload, pa.binary())], names=["chunk", "part", "payload"])


#: Packed bytes of documents per key range: what a range's task holds follows from it, whatever the input's size.
RANGE_BYTES = 4 << 20
#: The most tasks of an exchange; beyond as many ranges a task answers several, one after another.
MOST_TASKS = 1 << 14


def range_count(staged: DataFrame) -> int:
    """Key ranges for staged documents: one per ``RANGE_BYTES`` packed bytes, at least one per shuffle partition."""
    packed = staged.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    return min(1 << 20, max(partitions(staged.sparkSession), -(-packed // RANGE_BYTES)))


def ranges(parts: int, bits: int) -> np.ndarray:
    """Least key of each of ``parts`` equal ranges of ``bits``-bit keys."""
    return np.array([-(-(p << bits) // parts) for p in range(parts)], np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as compressed byte planes of their differences."""
    if not len(keys):
        return struct.pack("<IQ", 0, 0)
    steps = np.diff(keys)
    top = int(steps.max()) if len(steps) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<IQB", len(keys), int(keys[0]), width) + _squeeze(np.ascontiguousarray(planes).tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    n, first = struct.unpack_from("<IQ", data)
    if not n:
        return np.zeros(0, np.uint64)
    width = data[12]
    planes = np.zeros((n - 1, 8), np.uint8)
    planes[:, :width] = np.frombuffer(_spread(data[13:]), np.uint8).reshape(width, n - 1).T
    out = np.empty(n, np.uint64)
    out[0] = first
    if n > 1:
        out[1:] = np.cumsum(planes.view("<u8").reshape(-1)) + np.uint64(first)
    return out


def pack_array(x: np.ndarray) -> bytes:
    return struct.pack("<I", len(x)) + x.dtype.str.encode().ljust(4) + _squeeze(np.ascontiguousarray(x).tobytes())


def unpack_array(data: bytes) -> np.ndarray:
    kind = np.dtype(data[4:8].decode().strip())
    return np.frombuffer(_spread(data[8:]), kind, count=struct.unpack_from("<I", data)[0])


def join_blobs(*blobs: bytes) -> bytes:
    return struct.pack("<I", len(blobs)) + b"".join(struct.pack("<Q", len(b)) + b for b in blobs)


def split_blobs(data: bytes) -> list[bytes]:
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        (size,) = struct.unpack_from("<Q", data, at)
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def send(keys: np.ndarray, extra: Callable[[slice], bytes], bounds: np.ndarray) -> list[tuple[int, bytes]]:
    """(range, packed keys and extra) of a chunk's sorted distinct keys, for ranges that have any."""
    at = np.append(np.searchsorted(keys, bounds), len(keys))
    out = []
    for p in np.flatnonzero(np.diff(at)):
        s = slice(int(at[p]), int(at[p + 1]))
        out.append((int(p), join_blobs(pack_keys(keys[s]), extra(s))))
    return out


def answer(sent: DataFrame, parts: int, decide: Callable[[list[np.ndarray], list[bytes]], list[np.ndarray]]) -> DataFrame:
    """Let each key range answer: ``decide`` gets the keys and extras of all chunks, gives an array for each.

    Rows are dealt by range. A task holds one range's keys at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_key(batches, 1):
            split = [split_blobs(r[2]) for r in rows]
            given = decide([unpack_keys(k) for k, _ in split], [e for _, e in split])
            yield packed_rows([(r[0], part, pack_array(g)) for r, g in zip(rows, given, strict=True)])

    tasks = min(parts, MOST_TASKS)
    return sent.repartitionById(tasks, F.pmod(F.col("part"), F.lit(tasks))).sortWithinPartitions("part", "chunk").mapInArrow(run, CHUNKS)


def by_key(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Rows (chunk, part, payload) in runs of equal values of a column."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if rows and row[column] != now:
                yield now, rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield now, rows


def meet(staged: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks with their answers: per chunk the packed documents first, then answers in order of round and range.

    The answers of round r have parts r * 2**20 + range.
    """
    out = staged
    for r, a in enumerate(answers):
        out = out.unionByName(a.withColumn("part", F.col("part") + F.lit(r << 20)))
    return out.repartition("chunk").sortWithinPartitions("chunk", "part")


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[np.ndarray]]]:
    """(chunk, documents, the answers of each round joined in key order)."""
    for chunk, rows in by_key(batches, 0):
        if rows[0][1] != -1:
            raise ValueError("answers without their chunk")
        rounds: dict[int, list[np.ndarray]] = {}
        for _, part, payload in rows[1:]:
            rounds.setdefault(part >> 20, []).append(unpack_array(payload))
        last = max(rounds, default=-1)
        yield chunk, unpack_batch(rows[0][2]), [np.concatenate(rounds[r]) if r in rounds else np.zeros(0, np.uint8) for r in range(last + 1)]
