"""Best-fit packing (operator 4): best-two-fit of token pieces into sequences of a fixed capacity.

``pieces`` tokenizes whole texts and cuts only documents that are longer than a sequence.  ``best_two_fit``
packs pieces: a sequence is filled greedily with the largest piece that still fits; when nothing fits, its
smallest piece is taken out if two unpacked pieces fill the enlarged gap more tightly.  Packing works in salted
groups of about ``GROUP_PIECES`` pieces, each a task's work of bounded size, whatever the corpus; a group wastes
at most the rest of its last sequences.

Edge cases: a null or empty text is one piece holding only the end id; a text of any length is tokenized whole;
a null id stays a null id; repeated rows are packed as separate documents; an empty table gives no rows; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import materialize, texts
from .tokens import WordIds, ids_of

#: Pieces that one packing group holds on average.
GROUP_PIECES = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "sequence_id long, `offset` long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; ``with_ids`` adds the ids themselves as little-endian uint32 ``ids``."""
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoded = ids_of(WordIds, tokenizer).encoded
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], encoded(batch["text"].tolist()), strict=True):
                ids += end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    row = (doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, part) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return texts(docs, id_col, text_col).mapInPandas(cut, PIECES + (", ids binary" if with_ids else ""))


def two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` by sequence.  Each length is 1 to ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    left = lengths[order].tolist()  # ascending; ids alongside
    ids = order.tolist()

    def take(at: int) -> tuple[int, int]:
        return left.pop(at), ids.pop(at)

    bins = []
    while left:
        bin_, gap = [take(len(left) - 1)], 0
        gap = capacity - bin_[0][0]
        while gap and left and (at := bisect_right(left, gap) - 1) >= 0:
            bin_.append(take(at))
            gap -= bin_[-1][0]
        if gap and len(left) > 1:
            size, index = bin_[-1]  # the greedy filling takes ever smaller pieces
            pair = tightest_pair(left, gap + size, size)
            if pair:
                low, high = pair
                bin_[-1:] = [take(high), take(low)]
                at = bisect_right(left, size)
                left.insert(at, size)
                ids.insert(at, index)
        bins.append([i for _, i in bin_])
    return bins


def tightest_pair(left: list[int], room: int, more_than: int) -> tuple[int, int] | None:
    """Positions low < high in ascending ``left`` whose sum is the largest that is over ``more_than`` and at most ``room``."""
    low, high = 0, bisect_right(left, room - left[0]) - 1
    best, found = more_than, None
    while low < high:
        total = left[low] + left[high]
        if total > room:
            high -= 1
            continue
        if total > best:
            best, found = total, (low, high)
            if best == room:
                break
        low += 1
    return found


def best_two_fit(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """``items`` (PIECES columns, each length 1 to ``capacity``) with sequence_id and offset.

    Full pieces are sequences of their own and never enter a group.
    """
    spread = items.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**40)))  # of a row, so repeated ids fall apart
    items = materialize(spread, "pieces")
    n = items.filter(F.col("length") < capacity).count()
    groups = max(1, -(-n // GROUP_PIECES))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        sequence = np.empty(len(group), dtype=np.int64)
        offset = np.empty(len(group), dtype=np.int64)
        lengths = group["length"].to_numpy()
        first = int(group["salt"].iloc[0]) << 32
        for k, members in enumerate(two_fit(lengths, capacity)):
            sequence[members] = first + k
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return group.drop(columns="salt").assign(sequence_id=sequence, offset=offset)

    names = [f"`{c}` {t}" for c, t in items.drop("salt").dtypes]
    part = items.filter(F.col("length") < capacity).withColumn("salt", F.col("salt") % groups)
    packed = part.groupBy("salt").applyInPandas(pack, ", ".join(names) + ", " + PACKED)
    full = items.drop("salt").filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize whole ``docs`` and pack them; see the module's docstring for the edge cases."""
    return best_two_fit(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), capacity)
