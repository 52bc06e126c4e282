"""Toxicity (operator 3): a linear-chain conditional random field over words tags toxic spans.

Labels are per document, so words are labelled first: a word of a toxic document is toxic if it, or its first
letters, are lexicon features, those that a likelihood-ratio test ties to toxic documents.  The chain (two
states; weights for the features and for the four transitions) is fitted to those labelled words by the gradient of
its conditional likelihood, in segments.  Forward-backward marginals of each word are added up to a document's
expected number of toxic words, from which a logistic regression gives the score; runs of words with marginals of a
half or more are the offending spans, with their character offsets.

Fitting takes a bounded sample of labelled rows: at most ``TRAIN_DOCS`` of each class count features, at most
``FIT_DOCS`` of each class fit the weights, picked by a hash of the id.  Their whole texts are read, but no text goes to the driver: it gets the lexicon,
the segments in which lexicon features are (others only as numbers of segments), and two numbers a document.  Scoring reads whole texts.

Edge cases: null and empty texts have no words and get the score of zero expected toxic words; null labels and
labels without a document are not used, and contradicting rows of one id count one by one; without rows of both
classes every document gets the share of toxic labels (0 if there are none); an empty table gives no rows; other
columns pass through, and the operator's own column must have a new name or it replaces that column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import materialize, release
from .words import batches_of

TRAIN_DOCS = 15_000
FIT_DOCS = 900
#: Share of the documents with a feature that must be toxic.
PURE = 0.8
PREFIXES = (4, 5, 6)
SEGMENT = 64
STEPS = 150
MEMO_WORDS = 100_000
#: Words times documents that a lockstep pass holds at most.
CELLS = 150_000
WORD = re.compile(r"[^\W\d_]+")
SPANS = "score double, spans array<struct<start:int,end:int,probability:double>>"


@dataclass
class Model:
    """Weights of the chain and of the document score."""

    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    move: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    logistic: np.ndarray | None = None
    prior: float = 0.0


def features(word: str) -> list[str]:
    """Of a lower-case word: itself, and its first letters."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def document_features(text: Column) -> Column:
    """The distinct features of a text, as ``features`` makes them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)")))
    heads = [F.transform(F.filter(words, lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]
    return F.array_distinct(F.concat(words, *heads))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> Model:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), without the ids for which ``held_out``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    if held_out is not None:
        known = known.filter(~held_out)
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    train = materialize(train, "labelled")
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    every = known.groupBy("toxic").count().collect()
    totals = {r["toxic"]: r["count"] for r in every}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if not (n.get(0) and n.get(1)):
        return Model(prior=prior)
    counts = train.select("toxic", F.explode(document_features(F.col("text"))).alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = materialize(counts, "features")
    a, b, rate = F.col("a"), F.col("b"), n[1] / (n[0] + n[1])
    both = a + b
    part = lambda x, share: F.when(x > 0, x * F.log(x / (both * share))).otherwise(0.0)
    scored = counts.filter((a >= 2) & (a > both * rate)).withColumn("g", 2 * (part(a, rate) + part(b, 1 - rate)))
    tested = max(2, counts.count())
    kept = scored.filter((F.col("g") > 2 * np.log(tested) + 2) & (a >= PURE * both)).orderBy(F.desc("g"), "feature").collect()
    model = Model(lexicon={r["feature"]: k for k, r in enumerate(kept)}, prior=prior)
    chosen = [train.filter(F.col("toxic") == k).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS) for k in (0, 1)]
    rows = train.join(F.broadcast(chosen[0].unionByName(chosen[1]).distinct()), "doc_id").select("toxic", "text")
    fit_chain(model, segments(rows, model.lexicon))
    fit_logistic(model, summaries(rows, model), prior)
    release(train, counts)
    return model


def segments(rows: DataFrame, lexicon: dict[str, int]) -> list[tuple[int, int, list[int], list[int], int]]:
    """(toxic, size, steps, features, times) of the segments of ``rows`` (toxic, text): where lexicon features are; segments that agree are one."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                words = WORD.findall(text.lower())
                for k in range(0, len(words), SEGMENT):
                    part = words[k : k + SEGMENT]
                    cells = [(t, lexicon[f]) for t, w in enumerate(part) for f in features(w) if f in lexicon]
                    out.append((toxic, len(part), [t for t, _ in cells], [f for _, f in cells]))
            yield pd.DataFrame(out, columns=["toxic", "size", "steps", "features"])

    found = rows.mapInPandas(cut, "toxic int, size int, steps array<int>, features array<int>")
    return sorted((r["toxic"], r["size"], list(r["steps"]), list(r["features"]), r["times"]) for r in found.groupBy("toxic", "size", "steps", "features").agg(F.count("*").alias("times")).collect())


def summaries(rows: DataFrame, model: Model) -> list[tuple[int, list[float]]]:
    """(toxic, inputs of the document score) of ``rows`` (toxic, text)."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.Series([inputs(p) for p in scorer.marginals(batch.tolist())], dtype=object)

    return sorted((r["toxic"], list(r["x"])) for r in rows.select("toxic", of(F.col("text")).alias("x")).collect())


def fit_chain(model: Model, found: list[tuple[int, int, list[int], list[int], int]]) -> None:
    """Gradient ascent on the mean log likelihood of the labelled words, over the segments of ``segments``."""
    lanes, n = len(found), len(model.lexicon)
    model.weights = np.zeros(n)
    if not lanes:
        return
    toxic, size, times = (np.array([x[k] for x in found]) for k in (0, 1, 4))
    lane = np.repeat(np.arange(lanes), [len(x[2]) for x in found])
    step, feature = (np.array([v for x in found for v in x[k]], dtype=np.int64) for k in (2, 3))
    there = np.arange(SEGMENT) < size[:, None]
    truth = np.zeros((lanes, SEGMENT))
    truth[lane, step] = toxic[lane]
    theta = np.zeros(n + 1 + 4)  # features, bias, transitions 00 01 10 11
    theta[n] = -3.0
    slope, square = np.zeros_like(theta), np.zeros_like(theta)  # Adam's running means
    weight = times.astype(float)
    real = np.array([(((truth[:, :-1] == a) & (truth[:, 1:] == b) & there[:, 1:]) * weight[:, None]).sum() for a in (0, 1) for b in (0, 1)])
    scale = max(1.0, (truth * weight[:, None]).sum())
    for k in range(1, STEPS + 1):
        e = np.full((lanes, SEGMENT), theta[n])
        np.add.at(e, (lane, step), theta[feature])
        move = np.exp(theta[n + 1 :]).reshape(2, 2)
        p, pairs = marginals(e, there, move, weight)
        gap = np.where(there, truth - p, 0.0) * weight[:, None]
        grad = np.concatenate([np.bincount(feature, gap[lane, step], n) if n else np.zeros(0), [gap.sum()], real - pairs]) / scale
        grad -= 1e-5 * theta
        slope, square = 0.9 * slope + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta += 0.15 * (slope / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    model.weights, model.bias, model.move = theta[:n], float(theta[n]), np.exp(theta[n + 1 :]).reshape(2, 2)


def marginals(e: np.ndarray, there: np.ndarray, move: np.ndarray, weight: np.ndarray | None = None):
    """P(toxic) of each word (rows are documents, ``e`` the scores of state 1); with a row's ``weight``: expected transitions 00 01 10 11, too.

    Forward and backward messages are kept as odds of state 1 over state 0, in lockstep over all rows.
    """
    lanes, steps = e.shape
    odds = np.exp(np.clip(e, -40, 40)).T
    on = there.T
    ahead, behind = np.empty((steps, lanes)), np.ones((steps, lanes))
    ahead[0] = odds[0]
    for t in range(1, steps):
        r = ahead[t - 1]
        ahead[t] = odds[t] * (r * move[1, 1] + move[0, 1]) / (r * move[1, 0] + move[0, 0])
    for t in range(steps - 2, -1, -1):
        s = odds[t + 1] * behind[t + 1]
        behind[t] = np.where(on[t + 1], (move[1, 1] * s + move[1, 0]) / (move[0, 1] * s + move[0, 0]), 1.0)
    both = ahead * behind
    p = np.where(on, both / (1 + both), 0.0).T
    if weight is None:
        return p
    r, s = ahead[:-1], (odds * behind)[1:]
    parts = [move[0, 0] * np.ones_like(r), move[0, 1] * s, move[1, 0] * r, move[1, 1] * r * s]
    whole = np.where(on[1:], sum(parts), np.inf)
    return p, np.array([(x / whole * weight).sum() for x in parts])


class Scorer:
    """A worker's scoring of texts by a model."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def emission(self, word: str) -> float:
        found = [self.model.lexicon[f] for f in features(word) if f in self.model.lexicon]
        return self.model.bias + float(self.model.weights[found].sum()) if found else self.model.bias

    def emissions(self, text: str) -> np.ndarray:
        memo, out = self.memo, []
        for w in WORD.findall(text.lower()):
            e = memo.get(w)
            if e is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                e = memo[w] = self.emission(w)
            out.append(e)
        return np.array(out)

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        rows = [self.emissions(x) for x in texts]
        out: list[np.ndarray] = [np.zeros(0)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        while order:
            longest, at = len(rows[order[-1]]), len(order)
            while at and (len(order) - at) * longest < CELLS and len(rows[order[at - 1]]) * 2 >= longest:
                at -= 1
            batch, order = order[at:], order[:at]
            e, there = np.zeros((len(batch), longest)), np.zeros((len(batch), longest), dtype=bool)
            for k, i in enumerate(batch):
                e[k, : len(rows[i])], there[k, : len(rows[i])] = rows[i], True
            for i, p in zip(batch, marginals(e, there, self.model.move), strict=True):
                out[i] = p[: len(rows[i])]
        return out

    def score(self, p: np.ndarray) -> float:
        if self.model.logistic is None:
            return self.model.prior
        return float(1 / (1 + np.exp(-np.clip(inputs(p) @ self.model.logistic, -40, 40))))

    def spans(self, text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
        hot = np.flatnonzero(p >= 0.5)
        if not len(hot):
            return []
        lower = text.lower()
        at = [(m.start(), m.end()) for m in WORD.finditer(lower if len(lower) == len(text) else text)]
        runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
        return [(at[r[0]][0], at[r[-1]][1], float(p[r].max())) for r in runs if r[-1] < len(at)]


def inputs(p: np.ndarray) -> np.ndarray:
    """What the document score is made of: the expected number of toxic words, and the surest one."""
    return np.array([1.0, np.log1p(p.sum()), p.max(initial=0.0)])


def fit_logistic(model: Model, rows: list[tuple[int, list[float]]], prior: float) -> None:
    """Ridge logistic regression by Newton steps; classes weigh as they do among all labels."""
    x = np.array([v for _, v in rows])
    y = np.array([k for k, _ in rows], dtype=float)
    w = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(3)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - q)) - 0.1 * beta
        beta = beta + np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3), grad)
    model.logistic = beta


def tagged(text: Column, model: Model) -> Column:
    """A struct of ``score`` and ``spans`` (character offsets, end exclusive, with the largest marginal) of a text."""

    @F.pandas_udf(SPANS)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            texts, scores, spans = batch.tolist(), [], []
            for at, to in batches_of(texts):
                found = scorer.marginals(texts[at:to])
                scores += [scorer.score(p) for p in found]
                spans += [[{"start": a, "end": b, "probability": q} for a, b, q in scorer.spans(t, p)] for t, p in zip(texts[at:to], found, strict=True)]
            yield pd.DataFrame({"score": scores, "spans": spans})

    return tag(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with the struct of ``tagged`` as ``out_col``."""
    return docs.withColumn(out_col, tagged(F.col(text_col), model))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
