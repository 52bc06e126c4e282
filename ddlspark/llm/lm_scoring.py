"""LM scoring (operator 10): a probabilistic suffix tree over the words of a text, and its root, a unigram baseline.

A text's symbols are its words (A-Z lower-cased) and an end.  Of each symbol the contexts are the one to ``order`` symbols before it; a mark
before the first one is the longest context that a text's beginning has.  Next symbols are counted by context over all training texts.  A context is
retained if it occurs at least ``LEAST`` times and its distribution diverges from the next shorter one's: smoothed without the occurrence that it predicts,
it gives its own occurrences a probability higher by ``GAIN`` nats in all.  (A plain divergence grows with chance alone where
counts are small; this one does not.)  A retained context's distribution is smoothed by ``KAPPA`` occurrences dealt out as its next shorter context
predicts; one that is not retained predicts as its next shorter one, so a symbol is scored by its longest retained suffix.  The root gives a symbol
(c + 1) / (N + V + 1), as the baseline does, which is all unseen symbols' share together.  No bound is a share of the corpus: the tree grows with it.

Probabilities are kept as decimal logarithms in steps of 1 / ``STEP``.  A context is extended only where its count reaches ``LEAST``, so levels thin out.
By level, chunks ask for their (context, symbol) pairs in packed form (see ``chunks``), with their counts and the next shorter context's probability;
a bucket holds all pairs of its contexts, so it decides on them and answers.  No part of the tree is collected or broadcast.
Contexts are 64-bit hashes, told apart in their bucket by 40 bits, and symbols of one context by 32 bits of theirs.

Edge cases: null and empty texts are only the end; without training rows N and V are 0 and the one unseen symbol has probability 1;
a null id is never a training row; repeated rows count and are scored one by one; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from .chunks import answers, asked, bucket_count, bytes_of, cut, passes, placed, settled, thawed, unsqueezed, whole, with_answers
from .hashing import mixed
from .words import Words

ORDER = 2
LEAST = 2
GAIN = 3.0
KAPPA = 5.0
STEP = 256
#: Of a context's hash, sent to its bucket, which holds some 10^5 contexts at any size.
CONTEXT_BITS = 40
END = np.uint64(0x2545F4914F6CDD1D)
MARK = np.uint64(0x9E6C63D0876A9A47)
ODD = np.uint64(0xD6E8FEB86659FD93)
#: Symbols for each byte of text, about.
SYMBOLS = 0.16
DOCUMENT, TEXT, TRAIN = range(3)  # columns of a chunk


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, group) as ``chunks.grouped``, equal keys in any order."""
    order = np.argsort(key)
    first = np.concatenate([np.ones(min(1, len(key)), bool), np.diff(key[order]) != 0])
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), group


def quantized(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit numbers."""
    return np.minimum(np.rint(-np.log10(p) * STEP), 65535).astype(np.uint32)


def restored(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) / -STEP)


class Symbols:
    """The symbols of a chunk's texts, one text after another."""

    def __init__(self, rows: bytes):
        self.table = thawed(rows)
        data, begin = bytes_of(self.table.column(TEXT))
        parts = [Words(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a], lower=True) for a, b in passes(begin)]
        words = np.concatenate([np.zeros(0, np.uint64), *[w.hash for w in parts]])
        self.size = np.concatenate([np.zeros(0, np.int64), *[w.size for w in parts]]) + 1
        self.first = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.hash = np.full(len(self.owner), END, np.uint64)
        last = np.zeros(len(self.owner), bool)
        last[self.first + self.size - 1] = True
        self.hash[~last] = words
        self.place = np.arange(len(self.owner)) - self.first[self.owner]
        self.train = np.asarray(whole(self.table.column(TRAIN)), dtype=bool)[self.owner]
        self.order, self.start, self.group = runs(self.hash)  # distinct symbols

    def counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The distinct symbols, and how often each is in training texts."""
        n = np.add.reduceat(self.train[self.order].astype(np.int64), self.start)
        return self.hash[self.order][self.start], [n]


class Walk:
    """A chunk on its way through the levels: the probability of each symbol so far, and which contexts may be extended."""

    def __init__(self, row: dict, buckets: int, n: int, v: int):
        self.symbols = s = Symbols(row["rows"])
        self.row, self.buckets = row, buckets
        key, _ = s.counts()
        self.seen = (placed(key, buckets, row["counts"], "u4") & FIRST_OFF)[s.group].astype(np.int64)
        self.q = quantized((self.seen + 1.0) / (n + v + 1.0))
        self.context = np.zeros(len(s.hash), np.uint64)
        self.alive = np.ones(len(s.hash), bool)
        self.level = 0

    def questions(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of the next level: contexts, sorted, and by pair the symbol's tag, its training count, and its probability so far."""
        s, k = self.symbols, self.level + 1
        before = np.full(len(s.hash), MARK, np.uint64)
        before[k:] = np.where(s.place[k:] >= k, s.hash[:-k], MARK)
        self.context = mixed(self.context * np.uint64(31) + before)
        self.at = np.flatnonzero(self.alive & (s.place >= k - 1))
        context, symbol = self.context[self.at], s.hash[self.at]
        order, start, self.pair = runs(mixed(context ^ (symbol * ODD)))
        one = order[start]
        n = np.add.reduceat(s.train[self.at][order].astype(np.int64), start) if len(start) else start
        self.by_context = np.argsort(context[one], kind="stable")
        one, n = one[self.by_context], n[self.by_context]
        return context[one], [symbol[one] & np.uint64(0xFFFFFFFF), n, self.q[self.at][one]]

    def advance(self) -> None:
        """Take the next level's answers."""
        key, _ = self.questions()
        self.level += 1
        told = placed(key, self.buckets, self.row[f"level{self.level}"], "u4")
        found = np.empty(len(told), np.uint32)
        found[self.by_context] = told
        found = found[self.pair]
        self.q[self.at] = found & 0xFFFF
        goes_on = np.zeros(len(self.q), bool)
        goes_on[self.at] = found >> 16 > 0
        self.alive = np.append(False, goes_on[:-1]) & (self.symbols.place > 0)


#: The highest bit of a count marks the first chunk that a symbol is answered to, so that sums count it once.
FIRST_ON, FIRST_OFF = np.uint32(1 << 31), np.uint32((1 << 31) - 1)


def totals(key: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Reply: a symbol's count, marked for one of those who ask."""
    order, start, group = runs(key)
    out = np.add.reduceat(values[0][order].astype(np.int64), start)[group].astype(np.uint32)
    out[order[start]] |= FIRST_ON
    return out


def decided(key: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Reply: each pair's probability after the level's retained contexts, and in bit 16 whether its context and symbol may be a context."""
    symbol, n, q = values
    order, start, pair = runs(mixed(key ^ (symbol.astype(np.uint64) * ODD)))
    times, one = np.add.reduceat(n[order].astype(np.int64), start), order[start]
    before = restored(q[one])
    c_order, c_start, context = runs(key[one])
    total = np.add.reduceat(times[c_order], c_start)[context]
    smooth = (times + KAPPA * before) / (total + KAPPA)
    without = (np.maximum(times - 1, 0) + KAPPA * before) / (np.maximum(total - 1, 0) + KAPPA)
    gain = np.add.reduceat((times * np.log(without / before))[c_order], c_start)[context]
    retained = (total >= LEAST) & (gain >= GAIN)
    out = np.where(retained, quantized(smooth), q[one]).astype(np.uint32) | ((times >= LEAST).astype(np.uint32) << np.uint32(16))
    return out[pair]


def sizes_of(counts: DataFrame) -> tuple[int, int]:
    """(N, V): how many symbols the training texts have, and how many different ones."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = 0
        for batch in batches:
            for answer in batch.column("counts").to_pylist():
                for x in answer:
                    c = unsqueezed(x["answer"], x["size"], "<u4")
                    c = (c & FIRST_OFF)[c >= FIRST_ON]
                    n, v = n + int(c.sum(dtype=np.int64)), v + int((c > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v])], ["n", "v"])

    found = counts.select("counts").mapInArrow(summed, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return found[0] or 0, found[1] or 0


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; ``train`` says which rows are learned from, ``order`` how many symbols a context has at most."""
    learned = F.coalesce(train, F.lit(False)) & F.col(id_col).isNotNull()
    chunked = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), learned.alias("train")), "text", "chunks")
    buckets = bucket_count(chunked, SYMBOLS)
    counts = answers(asked(chunked, lambda row: Symbols(row["rows"]).counts(), ["u4"], buckets), ["u4"], totals, "counts")
    n, v = sizes_of(counts)
    table = settled(chunked, counts, "chunks")

    def pairs(row: dict, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
        walk = Walk(row, buckets, n, v)
        for _ in range(level - 1):
            walk.advance()
        return walk.questions()

    for level in range(1, order + 1):
        questions = asked(table, lambda row, level=level: pairs(row, level), ["u4", "u4", "u2"], buckets, CONTEXT_BITS)
        found = answers(questions, ["u4", "u4", "u2"], decided, f"level{level}")
        table = settled(table, found, "chunks") if level < order else with_answers(table, found)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                walk = Walk({c: batch.column(c)[k].as_py() for c in batch.schema.names}, buckets, n, v)
                for _ in range(order):
                    walk.advance()
                s = walk.symbols
                by_text = lambda x: np.add.reduceat(x, s.first) if len(x) else np.zeros(0)
                base = by_text(np.log10(walk.seen + 1.0)) - s.size * np.log10(n + v + 1.0)
                columns = [whole(s.table.column(DOCUMENT)), s.size, by_text((walk.seen > 0).astype(np.int64)), np.full(len(s.size), n, np.int64), base, by_text(walk.q.astype(np.float64) / -STEP)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return table.mapInArrow(scored, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
