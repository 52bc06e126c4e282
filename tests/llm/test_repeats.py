"""Operators 5, 6 and 7 against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from ddlspark.llm import jaccard_join, substrings, windows
from ddlspark.llm import registry as llm
from ddlspark.llm.components import components

from .corpus import frame, rows, words


def test_word_windows(spark):
    got = Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept) for r in windows.without_repeats(frame(spark)).collect())
    seen, want = {}, Counter()
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in ordered:
        w = words(text)
        gone, own = set(), set()
        for s in range(len(w) - 19):
            gram = tuple(w[s : s + 20])
            first = seen.setdefault(gram, doc_id)
            if first != doc_id or gram in own:
                gone.update(range(s, s + 20))
            own.add(gram)
        want[doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert got == want


def test_levels_double_until_nothing_is_left(spark):
    lengths = {n: t.count() for n, t in windows.levels(frame(spark))}
    assert list(lengths) == [20 * 2**k for k in range(len(lengths))] and len(lengths) >= 3
    texts = [words(t) for _, t in rows()]
    for n in lengths:
        grams = Counter(tuple(w[s : s + n]) for k, w in enumerate(texts) for s in range(len(w) - n + 1))
        assert lengths[n] == sum(c for c in grams.values() if c > 1)


@pytest.mark.parametrize("hot", [substrings.HOT, 3])
def test_byte_strings(spark, hot):
    got = Counter((r.doc_id, r.dedup.n_bytes, r.dedup.n_removed, r.dedup.n_spans, bytes(r.dedup.kept)) for r in substrings.without_repeats(frame(spark), hot=hot).collect())
    data = [(i, (t or "").encode()) for i, t in rows()]
    count = Counter(b[s : s + 400] for _, b in data for s in range(len(b) - 399))
    want = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        want[i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])), bytes(x for x, g in zip(b, gone) if not g)] += 1
    assert got == want


@pytest.mark.parametrize("n_bytes", [330, 399, 400, 401])
def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path, n_bytes):
    """op7's contract counts bytes: shared passages of 55 words and fewer bytes stay."""
    draw = random.Random(n_bytes)
    passage = [c for k in range(55) for c in (" " if k else "") + "".join(draw.choices("abcdefgh", k=5))]
    passage[3:3] = "x" * (n_bytes - len(passage))
    texts = [f"{'pqrs'[k]}{' '.join(draw.choices('ijklmno', k=150))}{'tuvw'[k]}" for k in range(4)]
    held = [texts[0] + "".join(passage) + texts[1], texts[2] + "".join(passage) + texts[3], texts[0]]
    assert len(passage) == n_bytes and len("".join(passage).split()) == 55
    frame(spark, list(enumerate(held))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in llm.queries()["op7_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    gone = n_bytes if n_bytes >= 400 else 0
    kept = [t.replace("".join(passage), "") if gone else t for t in held]
    assert got == {k: (len(t), len(t) - len(x), int(len(x) < len(t)), hashlib.sha256(x.encode()).hexdigest()) for k, (t, x) in enumerate(zip(held, kept))}


def test_other_columns_pass(spark):
    """Columns named as helpers might be come back as they were."""
    names = ["_key", "_lows", "_highs", "chunk", "rows", "n", "row", "hash", "level0", "anchors"]
    docs = spark.createDataFrame([(k, t, *[f"{c}{k}" for c in names]) for k, (_, t) in enumerate(rows())], ["doc_id", "text", *names])
    for out in (windows.without_repeats(docs), substrings.without_repeats(docs), jaccard_join.without_similar(docs)):
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def shingle_sets(texts):
    out = []
    for t in texts:
        w = words(t, lower=True)
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def least_ids(pairs):
    sets = shingle_sets([t for _, t in pairs])
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            if x and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                parent[root(a)] = root(b)
    group = [root(k) for k in range(len(pairs))]
    least = {}
    for (i, _), g in zip(pairs, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return Counter((i, len(s), least.get(g) if s else i) for (i, _), s, g in zip(pairs, sets, group))


def test_jaccard_groups(spark):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark)).collect())
    assert got == least_ids(rows())


def test_jaccard_chains_of_near_copies(spark):
    """Chains in which only neighbours link, so that leaders, units and derived answers all matter."""
    w = [f"w{k}" for k in range(400)]
    pairs = [(k, " ".join(w[7 * k : 7 * k + 100])) for k in range(30)] + [(100 + k, " ".join(w[5 * k + 90 : 5 * k + 150])) for k in range(30)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark, pairs)).collect())
    assert got == least_ids(pairs)


def test_jaccard_families_of_copies(spark):
    """Copies of copies with changes of their own and common ones: many miss their leader but link to one of its sets."""
    draw = random.Random(5)
    pairs = []
    for family in range(4):
        texts = [[f"f{family}w{k}" for k in range(140)]]
        for k in range(40):
            w = list(texts[0] if draw.random() < 0.5 else draw.choice(texts))
            for _ in range(draw.randint(1, 5)):
                at = draw.randrange(len(w))
                w[at : at + draw.randint(0, 1)] = [f"f{family}x{draw.randrange(60)}"] * draw.randint(0, 2)
            texts.append(w)
        pairs += [(1000 * family + k, " ".join(w)) for k, w in enumerate(texts)]
    draw.shuffle(pairs)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame(spark, pairs)).collect())
    assert got == least_ids(pairs)


def test_one_of_each_group_stays(spark):
    kept = jaccard_join.without_similar(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and not {24, 25} & set(ids) and 33 in ids


def test_all_rows_without_shingles_stay(spark):
    pairs = [(None, None), (None, ""), (None, None), (5, " \n"), (5, " \n"), (6, "a b c d e f g"), (7, "a b c d e f g"), (6, "a b c d e f g")]
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.without_similar(frame(spark, pairs)).collect()), key=repr)
    assert kept == sorted([*pairs[:5], (6, "a b c d e f g")], key=repr)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 10), (20, 21)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[10] == 1 and got[9] == 7 and got[21] == 20 and got[159] == 100 and got[230] == 200 and 5 not in got


def test_empty_tables(spark):
    none = frame(spark, [])
    for out in (windows.without_repeats(none), substrings.without_repeats(none), jaccard_join.similar_groups(none)):
        assert out.count() == 0
