"""Suffix-array dedup (operator 7): bytes of strings that occur more than once, by column-wise suffix sorting.

Every window of ``length`` bytes holds an anchor: the k-gram with the smallest hash in it, the same one in every
copy of the window.  Only anchors that occur more than once can lie in repeated windows, so only their contexts,
all bytes that a window around the anchor can reach, matter.  Contexts are counted first: one that is elsewhere as a whole is repeated
as a whole, and it is gathered once only.  Contexts gathered by anchor are
one collection of strings, aligned at their anchors, for the column-wise construction: going from the last column to the
first, one symbol of each string is inserted in front of its suffix; a stable sort by anchor and new symbol updates
the order of the suffixes (whose preceding symbols are the collection's Burrows-Wheeler transform), and minima over
the old common prefixes give those of the new neighbours.  A suffix that shares at least ``length`` symbols with a
neighbour starts a repeated window.  Equal windows are aligned at their anchor, so suffixes need only be compared
within a column, and no rank over all columns, as in the general construction, has to be kept.  The order and
common prefixes of a column are arrays of a task, a column at a time, in place of sequential files.

So that no task gathers an anchor that a large part of the corpus shares, the windows around anchors with more than ``HOT`` places are counted by 64-bit
hashes, with the same results but for collisions.  Anchors, whole contexts and such windows are counted by packed questions of chunks (see ``chunks``).

Edge cases: null and empty texts have no bytes; a text shorter than ``length`` has no window; matches never cross
documents; rows that agree in id and text are separate documents that repeat each other; a null id stays null; an
empty table gives no rows; other columns pass through ``without_repeats``, whatever their names, but one named like its own result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from xxhash import xxh3_64_intdigest

from ._work import materialize
from .chunks import answers, asked, bucket_count, bytes_of, cut, grouped, passed, passes, placed, thawed, with_answers, with_result
from .hashing import BYTE_VALUES, mixed, powers, slide

#: Bytes of an anchor.
GRAM = 64
#: Contexts sorted at once (more only if one anchor has more).
CONTEXTS = 5_000
#: Places of an anchor whose contexts one task gathers at most; windows around those that have more are counted by hashes.
HOT = 20_000
#: Anchors for each ``length - gram + 2`` bytes of text: two in random text, and room for more.
ANCHORS = 3.4
ODD = np.uint64(0x9E3779B97F4A7C15)
RESULT = StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary").add("spans", ArrayType(StructType().add("low", "integer").add("high", "integer")))
KIND = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each position on, never 0."""
    x, have, factor = data.astype(np.uint64) + np.uint64(1), 1, ODD
    with np.errstate(over="ignore"):
        while have < gram:
            x = x[:-have] * factor + x[have:]
            factor, have = factor * factor, have * 2
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x | np.uint64(1)


def anchors(data: np.ndarray, begin: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of each anchor of the texts of ``data``."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    first, size = begin[:-1], np.diff(begin)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    low = slide(h, width, np.minimum)  # by window start
    crossing = np.zeros(len(data) + 1, np.int32)  # windows that leave their text
    np.add.at(crossing, np.maximum(first, first + size - length + 1), 1)
    np.add.at(crossing, first + size, -1)
    low[np.cumsum(crossing)[: len(low)] > 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    best = slide(np.concatenate([pad, low, pad]), width, np.maximum)  # over the windows that hold a position
    at = np.flatnonzero(best == h)
    owner = np.searchsorted(first, at, "right") - 1
    return owner, at - first[owner], h[at]


def repeated_starts(group: np.ndarray, strings: list[bytes], left: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """For each string, by column: whether the ``length`` bytes from there on are found in another string of its group.

    ``left``: bytes before the anchor.  ``group`` must be sorted.  Columns are places relative to the anchor, from length - gram before it on.
    """
    n, reach = len(strings), length - gram
    columns = reach + length
    symbols = np.zeros((n, columns), np.int16)  # 0: outside of the document
    size = np.array([len(s) for s in strings], dtype=np.int64)
    begin = np.arange(n) * columns + reach - left
    cell = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    symbols.ravel()[cell] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    symbols = np.ascontiguousarray(symbols.T)
    dense = np.cumsum(np.concatenate([[0], np.diff(group) != 0])).astype(np.int64) * 257
    order, shared = np.arange(n), np.zeros(n + 1, np.int64)  # shared[i]: symbols that order[i - 1] and order[i] have in common
    found = np.zeros((reach + 1, n), dtype=bool)
    for column in range(columns - 1, -1, -1):
        symbol = symbols[column, order]
        key = dense[order] + symbol
        if (np.diff(key) < 0).any():
            new = np.argsort(key, kind="stable")
            order, symbol, key = order[new], symbol[new], key[new]
            before, now = new[:-1], new[1:]
            common = shared[now]
            far = np.flatnonzero((now != before + 1) & (key[1:] == key[:-1]))  # others came between them
            if len(far):
                common[far] = np.minimum.reduceat(shared, np.column_stack([before[far] + 1, now[far] + 1]).ravel())[::2]
        else:
            common = shared[1:n]
        same = (key[1:] == key[:-1]) & (symbol[1:] > 0)
        shared = np.zeros(n + 1, np.int64)
        shared[1:n] = np.where(same, common + 1, 0)
        if column <= reach:
            hit = shared[1:n] >= length
            found[column, order[1:][hit]] = True
            found[column, order[:-1][hit]] = True
    return found.T


class Places:
    """The anchors of a chunk's texts: of each, its text, position and hash."""

    def __init__(self, rows: bytes, text_at: int, length: int, gram: int):
        self.table = thawed(rows)
        self.data, self.begin = bytes_of(self.table.column(text_at))
        own, at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in passes(self.begin):
            o, p, h = anchors(self.data[self.begin[a] : self.begin[b]], self.begin[a : b + 1] - self.begin[a], length, gram)
            own.append(o + a)
            at.append(p)
            hashes.append(h)
        self.text, self.pos, self.hash = np.concatenate(own), np.concatenate(at), np.concatenate(hashes)

    def counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        order, start, _ = grouped(self.hash)
        return self.hash[order][start], [np.diff(np.append(start, len(order)))]

    def told(self, buckets: int, found: list[dict] | None) -> np.ndarray:
        """Of each anchor: 0 if it is there once, 1 if more often, 2 if very often."""
        order, start, group = grouped(self.hash)
        return placed(self.hash[order][start], buckets, found, "u1")[group]

    def contexts(self, chosen: np.ndarray, length: int, gram: int) -> dict[tuple[int, int, bytes], list[tuple[int, int]]]:
        """By anchor, bytes before it and context, in the order of places: the texts and positions that have it."""
        held: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
        reach, data, begin = length - gram, self.data.tobytes(), self.begin.tolist()
        for text, pos, anchor in zip(self.text[chosen].tolist(), self.pos[chosen].tolist(), self.hash[chosen].view(np.int64).tolist(), strict=True):
            first, end = begin[text], begin[text + 1]
            low = max(first, first + pos - reach)
            held.setdefault((anchor, first + pos - low, data[low : min(end, first + pos + length)]), []).append((text, pos))
        return held

    def windows(self, chosen: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, hash) of all windows of ``length`` bytes that hold a chosen anchor."""
        texts, starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for text in np.unique(self.text[chosen]).tolist():
            own = self.data[self.begin[text] : self.begin[text + 1]]
            up, down = powers(len(own) + 1)
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[own] * up[:-1], out=sums[1:])
            at = np.unique(self.pos[chosen & (self.text == text)][:, None] - np.arange(length - gram + 1))
            at = at[(at >= 0) & (at + length <= len(own))]
            texts.append(np.full(len(at), text))
            starts.append(at)
            hashes.append(mixed((sums[at + length] - sums[at]) * down[at]))
        return np.concatenate(texts), np.concatenate(starts), np.concatenate(hashes)


def busy(key: np.ndarray, values: list[np.ndarray], hot: int) -> np.ndarray:
    """Reply: 0 for an anchor that is there once, 1 if more often, 2 if more than ``hot`` times."""
    order, start, group = grouped(key)
    times = np.add.reduceat(values[0][order].astype(np.int64), start)
    return ((times > 1).astype(np.uint8) + (times > hot))[group]


def again(key: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Reply: 0 for what is there once; else 1 to the first chunk that asks, 2 to the others."""
    order, start, group = grouped(key)
    out = np.where(np.add.reduceat(values[0][order].astype(np.int64), start) > 1, 2, 0)[group].astype(np.uint8)
    out[order[start]] //= 2
    return out


class Contexts:
    """A chunk's contexts of repeated anchors, and windows around anchors with very many places, with the keys by which they are counted."""

    def __init__(self, row: dict, buckets: int, text_at: int, length: int, gram: int):
        self.places = places = Places(row["rows"], text_at, length, gram)
        told = places.told(buckets, row["anchors"])
        self.held = places.contexts(told == 1, length, gram)
        self.text, self.start, self.hash = places.windows(told == 2, length, gram)
        own = np.fromiter((xxh3_64_intdigest(c, left) for _, left, c in self.held), np.uint64, len(self.held))
        self.keys = np.concatenate([own, self.hash])
        self.times = np.concatenate([np.fromiter(map(len, self.held.values()), np.int64, len(self.held)), np.ones(len(self.hash), np.int64)])

    def questions(self) -> tuple[np.ndarray, list[np.ndarray]]:
        order, start, _ = grouped(self.keys)
        return self.keys[order][start], [np.minimum(np.add.reduceat(self.times[order], start), 2) if len(order) else self.times]

    def answered(self, buckets: int, found: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
        """The replies of ``again`` to the contexts and to the windows."""
        order, start, group = grouped(self.keys)
        told = placed(self.keys[order][start], buckets, found, "u1")[group]
        return told[: len(self.held)], told[len(self.held) :]


def context_rows(table: DataFrame, contexts_of: Callable, buckets: int) -> DataFrame:
    """(chunk, number, anchor, left, context) of the contexts of all chunks, each once; number: which one it is in its chunk, null if its answer is known."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                own = contexts_of(row)
                told = own.answered(buckets, row["again"])[0].tolist()
                sent = [(number if t == 0 else None, *x) for number, (x, t) in enumerate(zip(own.held, told, strict=True)) if t < 2]
                columns = [pa.array([x[i] for x in sent], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sent), row["chunk"], np.int64)), *columns], ["chunk", "number", "anchor", "left", "context"])

    return table.mapInArrow(rows, "chunk long, number int, anchor long, left int, context binary")


def repeated_runs(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(chunk, number, lows, highs): of contexts with repeated strings, the bytes that these cover, relative to the anchor."""
    reach = length - gram

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            if rows >= CONTEXTS:
                together = pd.concat(waiting, ignore_index=True)
                open_from = int(np.searchsorted(together["anchor"].to_numpy(), together["anchor"].iloc[-1]))
                yield from by_part(together.iloc[:open_from])
                waiting, rows = [together.iloc[open_from:]], len(together) - open_from
        if waiting:
            yield from by_part(pd.concat(waiting, ignore_index=True))

    def by_part(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cuts, at = part["anchor"].to_numpy(), 0
        while at < len(part):
            to = min(len(part), at + CONTEXTS)
            if to < len(part) and cuts[to] == cuts[to - 1]:
                back = int(np.searchsorted(cuts, cuts[to]))
                to = back if back > at else int(np.searchsorted(cuts, cuts[to], "right"))
            yield one(part.iloc[at:to])
            at = to

    def one(part: pd.DataFrame) -> pd.DataFrame:
        strings, own = part["context"].tolist(), part["left"].to_numpy().astype(np.int64)
        marks = repeated_starts(part["anchor"].to_numpy(), strings, own, length, gram)
        edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        lows, highs = [[] for _ in strings], [[] for _ in strings]
        row, low = np.nonzero(edge == 1)
        for r, a, b in zip(row.tolist(), low.tolist(), np.nonzero(edge == -1)[1].tolist(), strict=True):
            lows[r].append(a - reach)
            highs[r].append(b - 1 - reach + length)
        some = np.flatnonzero(np.array([bool(x) for x in lows], bool) & part["number"].notna().to_numpy())
        return pd.DataFrame([(part["chunk"].iloc[k], int(part["number"].iloc[k]), lows[k], highs[k]) for k in some.tolist()], columns=["chunk", "number", "lows", "highs"])

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(spans, "chunk long, number int, lows array<int>, highs array<int>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", out_col: str = "dedup", gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``docs`` with ``out_col``, a struct: n_bytes, n_removed, n_spans, kept (binary), spans (array of low, high)."""
    names, text_at = docs.columns, docs.columns.index(text_col)
    chunked = cut(docs, text_col, "chunks")
    buckets = bucket_count(chunked, ANCHORS / (length - gram + 2))
    asks = asked(chunked, lambda row: Places(row["rows"], text_at, length, gram).counts(), ["u4"], buckets)
    table = with_answers(chunked, answers(asks, ["u4"], lambda key, values: busy(key, values, hot), "anchors"))
    contexts_of = lambda row: Contexts(row, buckets, text_at, length, gram)
    table = with_answers(table, answers(asked(table, lambda row: contexts_of(row).questions(), ["u1"], buckets), ["u1"], again, "again"))
    runs = repeated_runs(context_rows(table, contexts_of, buckets), length, gram)
    table = with_answers(table, materialize(runs.groupBy("chunk").agg(F.collect_list(F.struct("number", "lows", "highs")).alias("runs")), "runs"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                own = contexts_of(row)
                whole_, single = own.answered(buckets, row["again"])
                members, spans = list(own.held.items()), {}
                for number in np.flatnonzero(whole_).tolist():  # all of it is elsewhere, too
                    (_, left, context), at = members[number]
                    for text, pos in at if len(context) >= length else ():
                        spans.setdefault(text, []).append((pos - left, pos - left + len(context)))
                for x in row["runs"] or ():
                    for text, pos in members[x["number"]][1]:
                        spans.setdefault(text, []).extend((pos + a, pos + b) for a, b in zip(x["lows"], x["highs"], strict=True))
                for text, at in zip(own.text[single > 0].tolist(), own.start[single > 0].tolist(), strict=True):
                    spans.setdefault(text, []).append((at, at + length))
                yield passed(own.places.table, names, out_col, removed(own.places, spans))

    return table.mapInArrow(finished, with_result(docs, out_col, RESULT))


def removed(places: Places, spans: dict[int, list[tuple[int, int]]]) -> pa.Array:
    """The result of each text of a chunk, from the spans to remove, which may overlap."""
    data, begin, out = places.data.tobytes(), places.begin.tolist(), []
    for text, (low, high) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
        runs = merged(spans.get(text, ()))
        kept, at = [], low
        for a, b in runs:
            kept.append(data[at : low + a])
            at = low + b
        rest = b"".join([*kept, data[at:high]])
        out.append({"n_bytes": high - low, "n_removed": high - low - len(rest), "n_spans": len(runs), "kept": rest, "spans": [{"low": a, "high": b} for a, b in runs]})
    return pa.array(out, KIND)
