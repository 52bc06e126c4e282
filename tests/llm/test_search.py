"""Operators 1, 8 and 9, and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ddlspark.llm import audio, decontamination, licenses
from ddlspark.llm import registry as llm

from .corpus import frame, prose, rows, words

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def items():
    rng, texts = random.Random(8), dict(rows())
    out = [(1, " ".join(words(texts[2])[5:25])), (2, texts[3][:150]), (10, "one two"), (11, "ONE, two!"), (3, None), (4, "..."), (5, prose(rng, 30)), (None, texts[7]), (6, "é"), (1, texts[8]), (7, "x y x y x y x y x y x y x y x y"), (8, "a" * 1300)]
    return out


def hits(item_list, text):
    w = words(text, PATTERN, lower=True)
    covered, found = set(), set()
    for i, t in item_list:
        q = words(t, PATTERN, lower=True)
        n = min(13, len(q))
        if i is None or not n:
            continue
        grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in grams:
                covered.update(range(s, s + n))
                found.add(str(i))
    return len(w), len(covered), ",".join(sorted(found)), bool(covered) and 20 * len(covered) >= len(w)


def test_decontamination(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    out = decontamination.contamination(frame(spark), bench).collect()
    got = Counter((r.doc_id, r.contamination.n_words, r.contamination.n_hit, ",".join(r.contamination["items"]), r.contamination.contaminated) for r in out)
    assert got == Counter((i, *hits(items(), t)) for i, t in rows())
    assert any(r.contamination.contaminated for r in out)
    assert decontamination.contamination(frame(spark), bench.filter("false")).filter("contamination.n_hit > 0").count() == 0
    assert decontamination.contamination(frame(spark, []), bench).count() == 0


def test_proximity(spark):
    docs = frame(spark, [(1, "red blue green"), (2, "green x x red x blue"), (3, "red x x x x x x blue green"), (4, "red blue")])
    terms = decontamination.item_terms(spark.createDataFrame([(1, "Green red blue")], "item_id long, text string"))
    found = decontamination.proximity_hits(decontamination.index(docs), terms, 5)
    key = {r.k: r.doc_id for r in docs.select("doc_id", decontamination.row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    assert {key[r.key] for r in found.collect()} == {1, 2}


def test_licenses(spark):
    rng = random.Random(2)
    mit = licenses.TEMPLATES["mit"].split()
    pairs = [(1, prose(rng, 50) + " " + licenses.TEMPLATES["apache-2.0"] + " " + prose(rng, 9)), (2, " ".join(mit[:25]) + " changed " + " ".join(mit[26:])), (3, "Released under the MIT License."), (4, " ".join(mit[:20])), (5, None), (6, ""), (7, "The MIT"), (8, "x " * 5000 + licenses.TEMPLATES["bsd"])]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)} or {tuple(t.lower().split())}
    want = {i: sorted(n for n, t in licenses.TEMPLATES.items() if len(shingles(t) & shingles(x or "")) >= 0.75 * len(shingles(t))) for i, x in pairs}
    got = {r.doc_id: r.licenses for r in licenses.scan_documents(frame(spark, pairs)).collect()}
    assert {i: [m.template for m in row] for i, row in got.items()} == want
    assert want[2] == ["mit"] and not want[4]
    assert got[1][-1].first_word == 50 if got[1][-1].template == "apache-2.0" else got[1][0].first_word == 50
    assert licenses.scan_documents(frame(spark, [])).count() == 0


def test_every_copy_of_a_license_is_a_match(spark):
    rng = random.Random(3)
    bsd, mit = licenses.TEMPLATES["bsd"], licenses.TEMPLATES["mit"]
    n, m = len(bsd.split()), len(mit.split())
    pairs = [(1, " ".join([bsd, prose(rng, 700), bsd, bsd, prose(rng, 30), mit, prose(rng, 5), mit]))]
    got = [(x.template, x.first_word, x.last_word) for x in licenses.scan_documents(frame(spark, pairs)).first().licenses]
    at = n + 700 + 2 * n + 30
    want = [("bsd", k, k + n) for k in (0, n + 700, 2 * n + 700)] + [("mit", k, k + m) for k in (at, at + m + 5)]
    assert got == want


def recording(rng, notes=90):
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (rng.integers(24) / 12) * np.arange(1500) / audio.RATE) for _ in range(notes)])


def test_audio_recall(spark):
    rng = np.random.default_rng(4)
    full = [recording(rng) for _ in range(12)]
    made = [(k, x.tolist()) for k, x in enumerate(full)]
    made += [(100 + k, (x[20 * audio.HOP :] + rng.normal(size=len(x) - 20 * audio.HOP) * 0.05).tolist()) for k, x in enumerate(full)]
    made += [(200, full[3].tolist()), (201, None), (202, [0.0] * 10), (203, [])]
    prints = spark.createDataFrame(made, "id long, samples array<double>").select("id", audio.fingerprints(F.col("samples")).alias("print"))
    out = audio.search(prints, F.col("id") < 100).collect()
    members = {(r.id, r.other) for r in out if r.kind == "member"}
    assert members == {(3, 200)}
    pairs = {(r.id, r.other): r for r in out if r.kind == "pair"}
    held = {r.id: np.array(r.print, np.int32) for r in prints.collect()}
    near = set()  # brute force: all alignments
    for a in range(12):
        for b in held:
            p, q = held[a], held[b]
            if a == b or not len(q) or (p.tobytes() == q.tobytes()):
                continue
            for o in range(-len(p) + 32, len(q) - 31):
                x, y = p[max(0, -o) : len(q) - o], q[max(0, o) : len(p) + o]
                n = min(len(x), len(y))
                if n >= 32 and np.bitwise_count((x[:n] ^ y[:n]).view(np.uint32)).mean() / 32 <= audio.ERRORS:
                    near.add((a, min(b, b)))
    assert len(near & pairs.keys()) >= 0.9 * len(near) and len(near) >= 12
    assert all(pairs[k, 100 + k].offset == -20 for k in range(12))


def brute_pairs(asking, known, errors=audio.ERRORS):
    """All alignments of all pairs: (asking, known) with at most that share of wrong bits at one of them."""
    near = set()
    for a, p in asking.items():
        for b, q in known.items():
            for o in range(audio.OVERLAP - len(p), len(q) - audio.OVERLAP + 1):
                x, y = p[max(0, -o) : len(q) - o], q[max(0, o) : len(p) + o]
                n = min(len(x), len(y))
                if n >= min(audio.OVERLAP, len(p), len(q)) and np.bitwise_count((x[:n] ^ y[:n]).view(np.uint32)).mean() / 32 <= errors:
                    near.add((a, b))
                    break
    return near


def test_audio_query_recall(spark):
    """The registered query against brute force over all alignments of all recordings."""
    sf = "/root/testdata/sf0.001"
    got = {(r.id, r.other) for r in llm.queries()["op9_audio_fingerprints"](spark, sf).collect() if r.kind == "pair"}
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    held = {r.id: np.array(r.print, np.int32) for r in vectors.select("id", audio.played(F.col("embedding")).alias("print")).collect()}
    clips = {r.id: np.array(r.print, np.int32) for r in vectors.filter("id % 50 = 0").select("id", audio.played(F.col("embedding"), F.col("id")).alias("print")).collect()}
    near = brute_pairs(clips, held)
    assert len(near) >= len(clips) and len(near & got) >= 0.9 * len(near) and got <= near


def test_audio_edges(spark):
    rows_ = [(1, None), (2, []), (3, [5] * 40), (4, [5] * 90), (None, [5] * 40), (3, [5] * 40), (6, [6] * 40), (7, [1, 2] * 30), (8, [9, 9, *[1, 2] * 29])]
    prints = spark.createDataFrame(rows_, "id long, print array<int>")
    out = audio.search(prints, F.col("id").isNotNull()).collect()
    assert {(r.id, r.other) for r in out if r.kind == "member"} == {(3, 3), (3, None)}
    assert {(r.id, r.other) for r in out if r.kind == "pair"} == {(3, 4), (4, 3), (7, 8), (8, 7)}
    assert audio.search(prints.filter("false"), F.lit(True)).count() == 0


def test_audio_meets_changed_recordings_but_few_others(spark):
    """Recall over tunes of which most notes are moved by a little, one row a clip with all matches, and few seeds in common with unlike tunes."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 64))
    vectors = np.concatenate([base + scale * rng.normal(size=base.shape) for scale in (0, 0.05, 0.08, 0.1)])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, embedding array<double>")
    known = table.select("id", audio.played(F.col("embedding")).alias("print"))
    clips = table.filter("id < 12").select("id", audio.played(F.col("embedding"), F.col("id")).alias("print"))
    out = [r for r in audio.aligned(clips, known, listed=True).collect() if r.kind == "pair"]
    assert len(out) == len({r.id for r in out}) == 12
    assert all(r.n_matches == len(r.matches) and r.matches[0] == (r.bit_errors, r.other, r.offset) and r.other == r.id for r in out)
    got = {(r.id, m.other) for r in out for m in r.matches}
    held, asked = ({r.id: np.array(r.print, np.int32) for r in x.collect()} for x in (known, clips))
    near = brute_pairs(asked, held)
    assert len(near) > 44 and len(near & got) >= 0.9 * len(near) and got <= near
    a, b = (x.withColumn("class", F.col("id")) for x in (clips, known))
    meets = audio.seeds(a).toDF("a", "ta", "seed").join(audio.seeds(b).toDF("b", "tb", "seed"), "seed")
    assert meets.filter("a % 12 <> b % 12").count() < 0.1 * 12 * 44


def test_audio_short_and_still_recordings(spark):
    rng = np.random.default_rng(7)
    tone = rng.integers(-(2**31), 2**31, 80).tolist()
    rows_ = [(1, tone), (2, tone[20:40]), (3, [0] * 70), (4, [0] * 33), (5, [*[0] * 60, *tone]), (6, [*tone[10:70], *[0] * 60])]
    prints = spark.createDataFrame(rows_, "id long, print array<int>")
    pairs = {(r.id, r.other): r.offset for r in audio.search(prints, F.lit(True)).collect() if r.kind == "pair"}
    assert pairs[2, 1] == 20 and pairs[1, 2] == -20 and pairs[6, 1] == 10 and pairs[1, 5] == 60 and pairs[5, 6] == -70
    assert {(3, 4), (4, 3)} <= pairs.keys()


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    pairs = rows() + [(2000 + k, prose(rng, 60)) for k in range(40)] + [(3000 + k, prose(rng, 30) + " grumf vilex " + prose(rng, 9)) for k in range(20)]
    frame(spark, pairs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    marks = [(i, 1, int(3000 <= i < 4000)) for i, _ in pairs if i is not None and i >= 2000]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not any(3000 <= i < 4000 for i in kept[0] if i is not None)
    assert len([i for i in kept[0] if i is not None and 2000 <= i < 3000]) == 40
    assert 24 not in kept[1] and 33 in kept[1] and kept[2] == kept[1]
    gone = {i for i, t in ((r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/2").collect()) if hits(items(), t)[3]}
    assert kept[3] == kept[2] - gone and gone
    assert kept[4] == kept[3]


def test_pipeline_cuts_passages_of_just_over_50_words(spark):
    rng = random.Random(12)
    passages = [" ".join(prose(rng, 60).split()[:51]) for _ in range(4)]
    texts = [prose(rng, 150) + " " + passages[k % 4] + " " + prose(rng, 90) for k in range(12)] + [prose(rng, 200) for _ in range(5)]
    assert all(200 <= len(p.encode()) < 400 for p in passages)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    for k, text in enumerate(texts):
        want = text.replace(passages[k % 4], "") if k < 12 else text
        assert abs(len(out[k].text) - len(want)) <= 8 and (k < 12 or out[k].text == text) and out[k].n_chars == len(out[k].text)
