"""A small corpus with nulls, empty and long texts, copies, near copies, repeated rows and a column that clashes."""

import random
import re

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, hash long, key string, id string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(30, 220)) for _ in range(24)]
    passage = prose(rng, 90)
    texts = list(base)
    texts += [base[0], base[0], base[1] + " Extra WORDS here", passage + " " + base[2], base[3] + " " + passage, passage.upper()]
    near = base[4].split()
    near[10] = "changed"
    texts += [" ".join(near), " ".join(near[:-3]), None, "", "   \n\t ", "one", "One two  three", "one two three", "a" * 1300, "x y " * 300, "idiot " * 4, prose(rng, 9000), "É é ß 日本語 " * 60, "tail " + base[5][:900] + "é" + base[5][:900]]
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(0, base[0]), (None, base[6]), (None, None), (None, prose(rng, 40))]
    return out


def frame(spark, pairs=None):
    full = [(i, t, "en", "s", len(t or ""), "x", 1, "y", "z") for i, t in (rows() if pairs is None else pairs)]
    return spark.createDataFrame(full, SCHEMA)


def words(text, pattern=r"[^\x20\x09-\x0D]+", lower=False):
    text = text or ""
    if lower:
        text = text.translate({i: i + 32 for i in range(65, 91)})
    return re.findall(pattern, text)
