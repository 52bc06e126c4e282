"""Chunks of rows, and questions that chunks ask of all others by 64-bit keys.

``cut`` writes a table of chunks: some MB of consecutive rows, all columns, as one compressed Arrow stream.  A step then works
on whole chunks.  What a chunk must know of the corpus it asks in packed form: ``asked`` deals its distinct keys, sorted, delta-coded and
compressed, with some values each, to buckets; a bucket's task sees the keys of all chunks that fall into it and answers each key in
turn; ``answers`` brings these back to their chunks.  A key is sent once a chunk however often it is there, so a key that a third of
all rows hold is no hot spot, and buckets grow in number with the input, so that each holds about as many keys at any size.

Rows are known by their place in their chunk, not by a key, so rows that agree in all columns stay apart, and columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._work import materialize, partitions, release
from .hashing import mixed

CHUNK_BYTES = 6_000_000
#: Keys that a bucket holds, about.
BUCKET_KEYS = 600_000
#: Text bytes that one pass of array operations handles (a longer text alone).
PASS_BYTES = 1_500_000
CHUNKS = "chunk long, bytes long, n long, rows binary"
_zstd = pa.ipc.IpcWriteOptions(compression="zstd")


def frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_zstd) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thawed(data: bytes) -> pa.Table:
    pa.default_memory_pool().release_unused()  # of the chunk before
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def cut(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` as a materialized table of chunks."""
    at = docs.columns.index(text_col)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < batch.num_rows:
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
                piece = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([int(ends[high - 1]) - before]), pa.array([piece.num_rows]), pa.array([frozen(piece)])], ["chunk", "bytes", "n", "rows"])
                low, seq = high, seq + 1

    return materialize(docs.mapInArrow(made, CHUNKS), name)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column, one after another, and where each begins (and the last one ends); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = whole(column)
    column = pc.fill_null(column.cast(pa.string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[begin[0] : begin[-1]], begin - begin[0]


def passes(begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PASS_BYTES."""
    at, n = 0, len(begin) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + PASS_BYTES, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def squeezed(x: np.ndarray) -> bytes:
    """An array by planes of its bytes, compressed."""
    return pa.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    keys = np.sort(keys)
    return keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]


def order_by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: an order that puts them together by bucket and leaves them sorted in each, and the buckets in that order."""
    bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def asked(table: DataFrame, questions: Callable, kinds: list[str], buckets: int, bits: int = 64) -> DataFrame:
    """(bucket, chunk, size, parts): the packed keys of each chunk of ``table``.

    ``questions`` takes a row of ``table`` (a dict of its columns) and gives sorted keys and a list of arrays, one value a key, of the dtypes ``kinds``.
    The keys of a row must be distinct unless the values tell them apart.  Only the first ``bits`` of a key are sent; its bucket depends on all of them.
    """
    names = ["bucket", "chunk", "size", "parts"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                key, values = questions(row)
                order, bucket = order_by_bucket(key, buckets)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                at = np.concatenate([[0], cuts, [len(key)]]) if len(key) else np.zeros(1, np.int64)
                key, values = key[order] >> np.uint64(64 - bits), [v.astype(d)[order] for v, d in zip(values, kinds, strict=True)]
                rows = [(int(bucket[a]), row["chunk"], int(b - a), [squeezed(np.diff(key[a:b], prepend=np.uint64(0))), *(squeezed(v[a:b]) for v in values)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())))], names)

    return table.mapInArrow(packed, "bucket long, chunk long, size long, parts array<binary>")


def answers(questions: DataFrame, kinds: list[str], reply: Callable, name: str) -> DataFrame:
    """(chunk, <name>): for each chunk, its buckets' numbers and packed answers.

    ``reply`` takes the keys of one bucket from all chunks, one after another, and the lists of their values, and gives one array: an answer to each.
    """

    def replied(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        parts = table.column("parts").to_pylist()
        key = np.concatenate([np.cumsum(unsqueezed(p[0], n, "<u8")) for p, n in zip(parts, sizes, strict=True)])
        values = [np.concatenate([unsqueezed(p[1 + k], n, d) for p, n in zip(parts, sizes, strict=True)]) for k, d in enumerate(kinds)]
        answer = reply(key, values)
        ends = np.cumsum(sizes).tolist()
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "size": table.column("size"), "answer": pa.array([squeezed(answer[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    back = questions.groupBy("bucket").applyInArrow(replied, "chunk long, bucket long, size long, answer binary")
    return materialize(back.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "size", "answer")).alias(name)), name)


def with_answers(table: DataFrame, found: DataFrame) -> DataFrame:
    """``table`` with the answers to each chunk: both sides grow with the input, so both are shuffled at any size."""
    return table.join(found.hint("merge"), "chunk", "left")


def settled(table: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``with_answers``, written, in place of both sides' files: the next questions' shuffle does not stand beside the join's."""
    out = materialize(with_answers(table, found), name)
    release(table, found)
    return out


def placed(key: np.ndarray, buckets: int, found: list[dict] | None, dtype: str) -> np.ndarray:
    """The answers to the sorted ``key`` that a chunk asked, in their order."""
    out = np.zeros(len(key), dtype)
    if len(key):
        order, bucket = order_by_bucket(key, buckets)
        held = {x["bucket"]: x["answer"] for x in found or ()}
        names, sizes = np.unique(bucket, return_counts=True)
        out[order] = np.concatenate([unsqueezed(held[b], n, dtype) for b, n in zip(names.tolist(), sizes.tolist(), strict=True)])
    return out


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, group): ``key[order]`` is sorted, its runs begin at ``start``, and ``group`` is the run of each key as given."""
    order = np.argsort(key, kind="stable")
    first = np.concatenate([np.ones(min(1, len(key)), bool), np.diff(key[order]) != 0])
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), group


def often(key: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Reply: 1 for keys whose numbers of occurrences add up to two or more."""
    order, start, group = grouped(key)
    times = np.add.reduceat(values[0][order].astype(np.int64), start)
    return (times[group] > 1).astype(np.uint8)


def bucket_count(table: DataFrame, keys_a_byte: float) -> int:
    """Buckets for about ``keys_a_byte`` keys in each byte of the chunks' texts."""
    total = table.agg(F.sum("bytes")).first()[0] or 0
    return max(partitions(table.sparkSession), 1 + int(total * keys_a_byte) // BUCKET_KEYS)


def whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def with_result(docs: DataFrame, out_col: str, kind: StructType) -> StructType:
    """The schema of ``docs`` with ``out_col`` last."""
    return StructType([f for f in docs.schema.fields if f.name != out_col] + [StructField(out_col, kind)])


def passed(rows: pa.Table, columns: list[str], out_col: str, found: pa.Array) -> pa.RecordBatch:
    """The rows of a chunk, all their columns by place, with ``found`` as ``out_col``."""
    at = [k for k, c in enumerate(columns) if c != out_col]
    arrays = [whole(rows.column(k)) for k in at]
    return pa.RecordBatch.from_arrays([*arrays, found], [*[columns[k] for k in at], out_col])
