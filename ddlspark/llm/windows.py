"""Substring dedup by words (operator 6): level-wise doubling of repeated windows.

Windows of ``window`` words that also start earlier are removed.  The levels are a fourth, a half and the whole of that length (see
``level_lengths``).  Every window of the whole length holds a picked one of the first level, the one with the smallest hash in it, and copies hold copies of
it, so only picked ones are counted.  Those that occur once are dropped; the others alone are extended to twice their length, forward and
backward, and counted again, until the whole length is reached or none survives.  Then all whole windows around the survivors ask for the
smallest document that has them: a text's windows that an earlier one has, or that it repeats itself, are covered words to remove.

Counts and smallest documents are found by packed questions of chunks (see ``chunks``), so no window's occurrences are ever gathered.
``levels`` goes on doubling beyond the whole length.  Windows are compared by 64-bit hashes: among n different candidate windows about n^2 / 2^65 pairs are taken for equal.

Edge cases: null and empty texts have no words; a text shorter than the window has no window; rows that agree in id are one
document each but never count as earlier than each other; a null id comes before all others; an empty table gives no
rows; other columns pass through ``without_repeats``, whatever their names, but one named like its own result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._work import materialize, release
from .chunks import answers, asked, bucket_count, bytes_of, cut, distinct, grouped, often, passed, passes, placed, thawed, with_answers, with_result
from .words import Words

RESULT = StructType().add("n_words", "long").add("n_removed", "long").add("kept", "string")
#: Picked windows for each byte of text, about; they set the number of buckets.
PICKED = 0.02


def level_lengths(window: int, least: int = 5) -> list[int]:
    """Window lengths by level, the wanted one last: each half of the next, as long as it is whole and not under ``least``."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= least and (len(out) < 2 or window >= 4 * (out[0] // 2)):
        out.insert(0, out[0] // 2)
    return out


class Plan(NamedTuple):
    window: int
    steps: list[int]
    buckets: int
    text_at: int  # the column of the text


class Level:
    """A chunk's windows that ask at a level: of each, its first word, hash and text, in word order over passes."""

    def __init__(self) -> None:
        self.starts: list[np.ndarray] = []  # by pass
        self.hashes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, words: Words, starts: np.ndarray, length: int, first_text: int) -> None:
        self.starts.append(starts)
        self.hashes.append(words.hashes(length, starts))
        self.owners.append(first_text + np.searchsorted(words.first, starts, "right") - 1)

    def hash(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *self.hashes])

    def owner(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *self.owners])


def inside(words: Words, starts: np.ndarray, length: int) -> np.ndarray:
    """Those of the sorted distinct ``starts`` from which ``length`` words of one text go on."""
    starts = starts[(starts >= 0) & (starts + length <= len(words.hash))]
    own = np.searchsorted(words.first, starts, "right") - 1
    return starts[starts + length <= words.first[own] + words.size[own]]


def extended(words: Words, survivors: np.ndarray, length: int, to: int, last: bool) -> np.ndarray:
    """Windows of ``to`` words to ask for around survivors of ``length``: next to them on either side, or, at the last level, all that hold one."""
    shifts = np.arange(to - length + 1) if last else np.array([0, to - length])
    starts = np.unique((survivors[:, None] - shifts).ravel()) if len(survivors) else survivors
    return inside(words, starts, to)


def walked(row: dict, at: int, plan: Plan) -> tuple[Level, list[Words] | None, pa.Table]:
    """The windows that a chunk asks for at step ``at``, from the answers of all steps before it in ``row``."""
    table = thawed(row["rows"])
    data, begin = bytes_of(table.column(plan.text_at))
    steps = plan.steps
    level, ranges = Level(), list(passes(begin))
    all_words = [Words(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a]) for a, b in ranges]
    for words, (a, _) in zip(all_words, ranges, strict=True):
        level.add(words, words.picked(steps[0], plan.window), steps[0], a)
    for k in range(1, at + 1):
        key = distinct(level.hash())
        repeated = placed(key, plan.buckets, row[f"level{k - 1}"], "u1")
        hit = repeated[np.searchsorted(key, level.hash())] > 0 if len(key) else np.zeros(0, bool)
        old, level, seen = level, Level(), 0
        for words, (a, _), starts in zip(all_words, ranges, old.starts, strict=True):
            survivors = starts[hit[seen : seen + len(starts)]]
            seen += len(starts)
            level.add(words, extended(words, survivors, steps[k - 1], steps[k], k == len(steps) - 1), steps[k], a)
    return level, all_words, table


def counted(row: dict, at: int, plan: Plan) -> tuple[np.ndarray, list[np.ndarray]]:
    h = np.sort(walked(row, at, plan)[0].hash())
    first = np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]])
    times = np.diff(np.append(np.flatnonzero(first), len(h)))
    return h[first], [np.minimum(times, 2)]


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as integers, null before all others."""
    return pc.fill_null(column.cast(pa.int64()), -(2**63)).to_numpy()


def least_ids(level: Level, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, and the smallest id of a text of the chunk with each."""
    h, own = level.hash(), ids[level.owner()]
    order, start, _ = grouped(h)
    return h[order][start], np.minimum.reduceat(own[order], start) if len(h) else own


def least(key: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Reply: 1 where a chunk's smallest id is the smallest of all."""
    order, start, group = grouped(key)
    best = np.minimum.reduceat(values[0][order], start)
    return (values[0] == best[group]).astype(np.uint8)


def survived(docs: DataFrame, window: int, text_col: str) -> tuple[DataFrame, DataFrame, Plan]:
    """The chunks, the chunks with the answers of all levels but the last, and the plan."""
    chunked = table = cut(docs, text_col, "chunks")
    plan = Plan(window, level_lengths(window), bucket_count(chunked, PICKED), docs.columns.index(text_col))
    for k in range(len(plan.steps) - 1):
        questions = asked(table, lambda row, k=k: counted(row, k, plan), ["u1"], plan.buckets)
        table = with_answers(table, answers(questions, ["u1"], often, f"level{k}"))
    return chunked, table, plan


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", out_col: str = "dedup") -> DataFrame:
    """``docs`` with ``out_col``, a struct: n_words, n_removed, kept (words joined by one space)."""
    _, table, plan = survived(docs, window, text_col)
    names = docs.columns
    last, wide, id_at = len(plan.steps) - 1, 2 * plan.buckets, docs.columns.index(id_col)

    def firsts(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        level, _, rows = walked(row, last, plan)
        key, own = least_ids(level, ids_of(rows.column(id_at)))
        return key, [own]

    table = with_answers(table, answers(asked(table, firsts, ["<i8"], wide), ["<i8"], least, "firsts"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                level, all_words, rows = walked(row, last, plan)
                ids = ids_of(rows.column(id_at))
                key, own = least_ids(level, ids)
                ours = placed(key, wide, row["firsts"], "u1") > 0
                yield from results(rows, removals(level, ids, key, own, ours, all_words), all_words)

    def removals(level: Level, ids: np.ndarray, key: np.ndarray, own: np.ndarray, ours: np.ndarray, all_words: list[Words]) -> list[np.ndarray]:
        """By pass, whether each word goes: it is in a window that an earlier text has, or that its own text has earlier."""
        h, owner = level.hash(), level.owner()
        at = np.searchsorted(key, h)
        keep = ours[at] & (ids[owner] == own[at]) if len(h) else np.zeros(0, bool)
        order = np.lexsort((np.arange(len(h)), owner, at))  # the first of each window in a text
        again = np.zeros(len(h), bool)
        again[order[1:]] = (at[order[1:]] == at[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        gone, seen, out = ~keep | again, 0, []
        for words, starts in zip(all_words, level.starts, strict=True):
            edge = np.zeros(len(words.hash) + 1, np.int32)
            bad = starts[gone[seen : seen + len(starts)]]
            seen += len(starts)
            np.add.at(edge, bad, 1)
            np.add.at(edge, bad + window, -1)
            out.append(np.cumsum(edge)[:-1] > 0)
        return out

    def results(rows: pa.Table, gone: list[np.ndarray], all_words: list[Words]) -> Iterator[pa.RecordBatch]:
        n_words = np.concatenate([np.zeros(0, np.int64), *[w.size for w in all_words]])
        removed = [np.bincount(w.owner()[g], minlength=len(w.size)) for w, g in zip(all_words, gone, strict=True)]
        texts = rows.column(plan.text_at).to_pylist()
        kept, k = [], 0
        for words, bad, lost in zip(all_words, gone, removed, strict=True):
            for first, size, some in zip(words.first.tolist(), words.size.tolist(), lost.tolist(), strict=True):
                own = (texts[k] or "").encode().split()
                if some:
                    own = [own[i] for i in np.flatnonzero(~bad[first : first + size])]
                kept.append(b" ".join(own).decode())
                k += 1
        n_removed = np.concatenate([np.zeros(0, np.int64), *removed]).astype(np.int64)
        found = pa.StructArray.from_arrays([pa.array(n_words.astype(np.int64)), pa.array(n_removed), pa.array(kept, pa.string())], RESULT.names)
        yield passed(rows, names, out_col, found)

    return table.mapInArrow(finished, with_result(docs, out_col, RESULT))


def levels(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> Iterator[tuple[int, DataFrame]]:
    """(length, (chunk, start, hash) of the repeated windows of that length) for window, twice that, and so on while there are any.

    start: the number of a window's first word in its chunk; texts lie a window apart, so that none goes on in the next one.
    """
    chunked, table, plan = survived(docs, window, text_col)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                level, all_words, _ = walked(row, len(plan.steps) - 1, plan)
                lead = np.cumsum([0, *[len(w.hash) for w in all_words]])
                starts = np.concatenate([np.zeros(0, np.int64), *[s + n for s, n in zip(level.starts, lead, strict=False)]]) + level.owner() * window
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), row["chunk"], np.int64)), pa.array(starts), pa.array(level.hash().view(np.int64))], ["chunk", "start", "hash"])

    rows, length = table.mapInArrow(held, "chunk long, start long, hash long"), window
    while True:
        rows = materialize(rows, "level")
        repeated = rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
        rows = materialize(rows.join(repeated, "hash").select("chunk", "start", "hash"), "level")
        if rows.isEmpty():
            release(chunked)
            return
        yield length, rows
        second = rows.select("chunk", (F.col("start") - length).alias("start"), F.col("hash").alias("second"))
        rows = rows.join(second, ["chunk", "start"]).select("chunk", "start", F.xxhash64("hash", "second").alias("hash"))
        length *= 2
