"""Operators 3 and 10: held-out accuracy, and probabilities against a direct computation."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ddlspark.llm import lm_scoring, registry, toxicity

from .corpus import WORDS, frame, prose, rows, words


def labelled(n=300):
    rng, out, labels = random.Random(5), [], []
    for k in range(n):
        text, toxic = prose(rng, rng.randrange(5, 80)), k % 4 == 0
        if toxic:
            w = text.split()
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["Vilex", "vilexon", "grumf"]))
            text = " ".join(w)
        out.append((k, text))
        labels.append((k, int(toxic)))
    return out, labels


def test_toxicity_held_out(spark):
    pairs, labels = labelled()
    docs = frame(spark, [*pairs, (1000, None), (1001, ""), (None, "grumf vilex")])
    given = spark.createDataFrame([(i, 0, y) for i, y in labels] + [(None, 0, 1), (1000, 0, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, given, toxicity.fold(F.col("doc_id"), 5) == 0)
    got = {r.doc_id: r.toxicity for r in toxicity.score_documents(docs, model).collect()}
    held = [(got[i].score >= 0.5) == bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.97
    assert got[1000].score == got[1001].score < 0.5 and got[None].score > 0.5
    text = dict(pairs)[0]
    found = [text[s.start : s.end].lower() for s in got[0].spans]
    assert found and all(any(x in f for x in ("vilex", "grumf")) for f in found)


def test_marginals_against_all_label_sequences():
    rng = np.random.default_rng(2)
    e, move = rng.normal(size=(3, 6)) * 2, np.exp(rng.normal(size=(2, 2)))
    size, weight = [6, 1, 4], np.array([1.0, 3.0, 2.0])
    there = np.arange(6) < np.array(size)[:, None]
    p, pairs = toxicity.marginals(e, there, move, weight)
    want, moves = np.zeros((3, 6)), np.zeros(4)
    for k, n in enumerate(size):
        paths = {y: np.exp((e[k, :n] * y).sum()) * np.prod([move[a, b] for a, b in zip(y, y[1:])]) for y in itertools.product((0, 1), repeat=n)}
        whole = sum(paths.values())
        for y, q in paths.items():
            want[k, :n] += np.array(y) * q / whole
            for a, b in zip(y, y[1:]):
                moves[2 * a + b] += weight[k] * q / whole
    assert np.allclose(p, want) and np.allclose(pairs, moves)


def test_toxicity_query_held_out(spark):
    """The registered query at sf0.1: most held-out toxic documents are found, and few others."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [r for r in registry.queries()["op3_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    toxic, clean = ([r.predicted for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert sum(toxic) > 0.75 * len(toxic) and sum(clean) < 0.02 * len(clean)


def test_toxicity_without_classes(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    for given, want in ((labels, 1.0), (labels.filter("false"), 0.0)):
        assert {r.toxicity.score for r in toxicity.score_documents(docs, toxicity.fit(docs, given)).collect()} == {want}
    assert toxicity.score_documents(frame(spark, []), toxicity.Model()).count() == 0


def test_base_score(spark):
    train = toxicity.fold(F.col("doc_id"), 7) != 2
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_scoring.score_documents(frame(spark), train).collect())
    count = Counter()
    for i, t in rows():
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words(t, lower=True), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows():
        w = [*words(t, lower=True), None]
        want[i, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert got == want


def direct_scores(pairs, train, order=lm_scoring.ORDER):
    """The tree, built directly: contexts as tuples of words."""
    texts = [[*words(t, lower=True), None] for _, t in pairs]
    own = [t for (i, _), t in zip(pairs, texts) if train(i)]
    count = Counter(w for t in own for w in t)
    n, v = sum(count.values()), len(count)
    kept = lambda p: round(-math.log10(p) * lm_scoring.STEP) / lm_scoring.STEP
    context = lambda t, k, m: tuple(["<", *t][k + 1 - m : k + 1]) if m <= k + 1 else None
    pair = {m: Counter((context(t, k, m), w) for t in own for k, w in enumerate(t) if m <= k + 1) for m in range(1, order + 1)}
    memo = {}

    def chance(c, w):
        """As a decimal logarithm, negative sign left off."""
        if not c:
            return kept((count[w] + 1) / (n + v + 1))
        if (c, w) not in memo:
            total, nexts = totals[c], below[c]
            retained = total >= lm_scoring.LEAST and sum(x * math.log(((x - 1) + lm_scoring.KAPPA * 10 ** -chance(c[1:], y)) / (total - 1 + lm_scoring.KAPPA) / 10 ** -chance(c[1:], y)) for y, x in nexts.items()) >= lm_scoring.GAIN
            p = 10 ** -chance(c[1:], w)
            memo[c, w] = kept((nexts.get(w, 0) + lm_scoring.KAPPA * p) / (total + lm_scoring.KAPPA)) if retained else chance(c[1:], w)
        return memo[c, w]

    totals, below = Counter(), {}
    for m in pair:
        for (c, w), x in pair[m].items():
            totals[c] += x
            below.setdefault(c, {})[w] = x
    out = []
    for t in texts:
        score = 0.0
        for k, w in enumerate(t):
            m = min(order, k + 1)
            while m and totals[context(t, k, m)] < lm_scoring.LEAST:
                m -= 1
            score -= chance(context(t, k, m) if m else (), w)
        out.append(score)
    return out


@pytest.mark.parametrize("order", [2, 4])
def test_scores_equal_a_directly_built_tree(spark, order):
    rng = random.Random(1)
    phrases = [" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(6)]
    pairs = rows() + [(5000 + k, " ".join(rng.choice([*phrases, *WORDS]) for _ in range(40))) for k in range(60)]
    train = lambda i: i is not None and i % 3 != 0
    got = lm_scoring.score_documents(frame(spark, pairs), F.col("doc_id") % 3 != 0, order=order).collect()
    key = lambda x: (repr(x[0]), x[1])
    want = sorted(zip([i for i, _ in pairs], direct_scores(pairs, train, order)), key=key)
    have = sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [i for i, _ in have] == [i for i, _ in want]
    assert [s for _, s in have] == pytest.approx([s for _, s in want], abs=0.02)


def test_held_out_scores_beat_the_base(spark):
    """The registered query: on held-out documents the tree is better than its root, by document mostly."""
    for sf in ("sf0.01", "sf0.1"):
        held = [r for r in registry.queries()["op10_lm_scoring"](spark, f"/root/testdata/{sf}").filter("held_out").collect()]
        tokens = sum(r.n_tokens for r in held)
        assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.15
        assert sum(r.score > r.base_score for r in held) > 0.6 * len(held)


def test_rare_contexts_are_kept_in_a_large_corpus(spark):
    rng = random.Random(5)
    phrase = "zyx qwv kjh"  # 20 of over 500,000 positions
    pairs = [(k, " ".join(rng.choice(WORDS) for _ in range(9_000))) for k in range(60)]
    pairs += [(1000 + k, phrase) for k in range(20)] + [(2000, phrase), (2001, "zyx qwv hjk"), (2002, None), (2003, "é zyx")]
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(frame(spark, pairs), F.col("doc_id") < 2000).collect()}
    assert got[2000] > -9 and got[2001] < got[2000] - 4


def test_scoring_without_training_rows(spark):
    got = lm_scoring.score_documents(frame(spark, [(1, "a b"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_known, r.score, r.base_score) for r in got] == [(0, 0.0, 0.0)] * 2
    assert lm_scoring.score_documents(frame(spark, []), F.lit(True)).count() == 0
