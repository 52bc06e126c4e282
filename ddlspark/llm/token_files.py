"""Token-ID files (operator 2): documents' token ids, entropy-coded in independently reset, checksummed units.

``write`` sorts documents by id over the cluster and writes segments in that order; ``read`` gives the ids back.
A segment is a byte string: a magic word, a zlib-packed index (document ids, nulls marked; token counts; the number
of units and their lengths in tokens and bytes; a CRC-32 of each unit's ids), and the units of ``range_coder``.
It holds whole documents, about ``SEGMENT_TOKENS`` tokens, and can be decoded by itself; so can each unit.  Segments
are rows of Parquet files, because Spark's writers reach any shared store; ``part`` and ``seq`` order them.

Edge cases: a null or empty text is the end id alone; a null id comes first; repeated rows are written one by one,
in any order among themselves; a text of any length stays in one segment; an empty table gives no
segments, and no rows when read; other columns are not written, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import texts, work_dir
from .range_coder import UNIT, decode_unit, encode_unit
from .tokens import ByteLevelIds, ids_of

MAGIC = b"CMR3"
SEGMENT_TOKENS = UNIT
SCHEMA = "part int, seq int, first_id long, n_docs long, n_tokens long, segment binary"


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment of documents with ``counts`` ids each, all ids one after another."""
    parts = [ids[k : k + UNIT] for k in range(0, len(ids), UNIT)]
    coded = [encode_unit(p) for p in parts]
    null = np.array([d is None for d in doc_ids], np.uint8)
    index = zlib.compress(
        struct.pack("<QQ", len(doc_ids), len(parts))
        + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + null.tobytes()
        + counts.astype("<i8").tobytes()
        + np.array([len(p) for p in parts], "<u4").tobytes()
        + np.array([len(c) for c in coded], "<u4").tobytes()
        + np.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], "<u4").tobytes()
    )
    return MAGIC + struct.pack("<I", len(index)) + index + b"".join(coded)


def unpack(segment: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What ``pack`` was given.  Raises ValueError if the magic word or a checksum is wrong."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    size = struct.unpack_from("<I", segment, 4)[0]
    index = zlib.decompress(segment[8 : 8 + size])
    n_docs, n = struct.unpack_from("<QQ", index)
    at, fields = 16, []
    for kind, count in (("<i8", n_docs), ("u1", n_docs), ("<i8", n_docs), ("<u4", n), ("<u4", n), ("<u4", n)):
        fields.append(np.frombuffer(index, kind, count, at))
        at += fields[-1].nbytes
    doc_ids, null, counts, lengths, sizes, sums = fields
    end, ids = 8 + size, [np.zeros(0, np.int64)]
    for k, (length, bytes_, want) in enumerate(zip(lengths.tolist(), sizes.tolist(), sums.tolist(), strict=True)):
        ids.append(decode_unit(segment[end : end + bytes_]))
        end += bytes_
        if len(ids[-1]) != length or zlib.crc32(ids[-1].astype("<u4").tobytes()) != want:
            raise ValueError(f"unit {k} does not match its checksum")
    return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], counts, np.concatenate(ids)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of ``docs`` by ascending id, ``end_id`` after each document, as segments under ``path``."""

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoded, end, part, seq = ids_of(ByteLevelIds, tokenizer).encoded, end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        doc_ids, held, size = [], [], 0

        def done() -> pd.DataFrame:
            counts = np.array([len(x) // 4 for x in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
            row = (part, seq, doc_ids[0], len(doc_ids), len(ids), pack(doc_ids, counts, ids))
            frame = pd.DataFrame([row], columns=["part", "seq", "first_id", "n_docs", "n_tokens", "segment"])
            return frame.astype({"first_id": "Int64"})

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], encoded(batch["text"].tolist()), strict=True):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                held.append(ids + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT_TOKENS:
                    yield done()
                    seq, doc_ids, held, size = seq + 1, [], [], 0
        if doc_ids:
            yield done()

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInPandas(segments, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32; ``with_ids`` adds ``ids`` as little-endian uint32 bytes."""
    files = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one small row a segment of millions of tokens, without its bytes: 10^7 of them, some 10^13 tokens, are sorted in one task
    begin = files.select("part", "seq", "n_tokens").withColumn("begin", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("n_tokens")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, segment in zip(batch["begin"], batch["segment"], strict=True):
                doc_ids, counts, ids = unpack(segment)
                data, to = ids.astype("<u4").tobytes(), np.cumsum(counts)
                parts = [data[4 * (b - n) : 4 * b] for b, n in zip(to.tolist(), counts.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(doc_ids, dtype="Int64"), "start": first + to - counts, "n_tokens": counts, "ids_crc32": [zlib.crc32(p) for p in parts]})
                yield out.assign(ids=parts) if with_ids else out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.join(begin, ["part", "seq"]).select("begin", "segment").mapInPandas(decode, schema)


def new_path(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/token-ids-{uuid.uuid4().hex}"
