"""Media columns (operator 9): chroma audio fingerprints of recordings, and their search.

Samples become frames of twelve pitch-class energies; an integral image over frames and classes gives the sums of any
rectangle; sixteen filters, differences of rectangle sums, quantized to two bits, make one 32-bit integer a frame.
Recordings meet where they share a seed: some bits, spread over a window of as many integers as two recordings must share, of filters that
noise seldom turns and that split recordings in halves, so that one changed note does not undo a seed and unlike recordings seldom have one in common.
There are several tables of other bits, and a seed of each at every window.
Recordings shorter than a window, or still, meet all others where their integers change in the same way: such a seed is two integers that follow each other, however long the
first one lasts.  Seeds at one frame offset are added up, in a histogram of offsets; at the best offset the bit errors of all overlapping integers decide.
Equal fingerprints are one class: only representatives are compared, and members are listed, so copies are never paired with each other.

Edge cases: a null recording, or one too short for a fingerprint, has an empty one and matches nothing; a recording of one integer all along, as
silence is, meets only others of that integer; windows that hardly change are no seeds; rows with a null id are members and representatives like others, with a null id; repeated rows and ids are members of
one class, each listed; of offsets with equal votes the largest counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import materialize

FRAME, HOP, RATE = 1024, 512, 8000
CLASSES = 12
SPAN = 8  # frames that a filter reaches
#: Shared changes at one offset that make a candidate of short recordings, and the share of differing bits that a match may have.
VOTES, ERRORS = 3, 0.2
#: Of a clip's noise, beside a tune's amplitude of 1.
NOISE = 0.02
#: Frames that two recordings must share, unless one of them is shorter.
OVERLAP = 32
PRINT = "array<int>"
#: Of a seed: integers of its window, bits taken from these, and tables of seeds.
WINDOW_INTS, SEED_BITS, TABLES = OVERLAP, 24, 4
#: Bits that compare halves in time (kind 0 of the filters): set in half of all frames, and differing in a tenth of those of near recordings.
STEADY = (31, 25, 19, 13)
#: Changes of integers that a window has at least, to be a seed.
CHANGES = WINDOW_INTS // 4


def filters() -> list[tuple[int, int, int, int, int]]:
    """(kind, first class, classes, first frame, frames) of sixteen rectangles: kind 0 compares halves in time, 1 in pitch, 2 the middle third in time."""
    return [(k % 3, (5 * k) % CLASSES % (CLASSES - 5), 4 + 2 * (k % 2), k % 3, SPAN - 2 - k % 3) for k in range(16)]


WINDOW = np.hanning(FRAME)
PITCH = np.fft.rfftfreq(FRAME, 1 / RATE)
USED = np.flatnonzero((PITCH > 100) & (PITCH < 3000))
PITCH_CLASS = np.round(12 * np.log2(PITCH[USED] / 440.0)).astype(int) % CLASSES
#: The used frequencies, class by class, and where each class starts (each has some).
USED = USED[np.argsort(PITCH_CLASS, kind="stable")]
STARTS = np.searchsorted(np.sort(PITCH_CLASS), np.arange(CLASSES))
#: The tones that a tune is played with, of FRAME samples each.
TONES = np.sin(2 * np.pi * 220.0 * 2 ** (np.arange(24) / 12)[:, None] * np.arange(FRAME) / RATE)


def chroma(samples: np.ndarray) -> np.ndarray:
    """One row a frame: energy by pitch class, adding up to 1 (or 0 in silence)."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    out = np.zeros((max(n, 0), CLASSES))
    for k in range(0, n, 256):  # of a long recording only so many frames are transformed at once
        part = samples[k * HOP : (min(n, k + 256) - 1) * HOP + FRAME]
        tones = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * WINDOW, axis=1)[:, USED]
        out[k : k + 256] = np.add.reduceat(tones.real**2 + tones.imag**2, STARTS, axis=1)
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each frame from which SPAN frames are there."""
    image = chroma(samples)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    whole = np.zeros((len(image) + 1, CLASSES + 1))
    whole[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return whole[t1 : t1 + n, c1] - whole[t0 : t0 + n, c1] - whole[t1 : t1 + n, c0] + whole[t0 : t0 + n, c0]

    bits = np.zeros(n, np.uint32)
    for kind, c, height, t, width in filters():
        if kind == 0:
            a, b = area(t, t + width // 2, c, c + height), area(t + width // 2, t + width, c, c + height)
        elif kind == 1:
            a, b = area(t, t + width, c, c + height // 2), area(t, t + width, c + height // 2, c + height)
        else:
            third = width // 3
            b = area(t + third, t + 2 * third, c, c + height)
            a = area(t, t + width, c, c + height) - b
        value = np.log((1 + a) / (1 + b))
        level = (value > -0.15).astype(np.uint32) + (value > 0) + (value > 0.15)
        bits = (bits << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # Gray code: near values differ in one bit
    return bits.view(np.int32)


def fingerprints(samples: Column) -> Column:
    """Of a column of PCM samples (array of numbers)."""

    @F.pandas_udf(PRINT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(np.asarray(x, dtype=np.float64)) if x is not None else np.zeros(0, np.int32) for x in batch], dtype=object)

    return of(samples)


def tune(values: np.ndarray) -> np.ndarray:
    """PCM samples of a tune of one note of FRAME samples a value, its pitch by the value."""
    return TONES[np.clip(np.floor(np.nan_to_num(values) * 40 + 12), 0, 23).astype(int)].ravel()


def played(values: Column, clip_of: Column | None = None) -> Column:
    """Fingerprints of the tunes of ``values`` (array of numbers), for tables that hold no recordings; a tune never leaves its task.

    With ``clip_of``, a number for each row: of a noisy clip, without the first frames and the last ones, that the number draws.
    """

    @F.pandas_udf(PRINT)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch, seeds in batches:
            out = []
            for x, seed in zip(batch, seeds, strict=True):
                samples = tune(np.asarray(x, float)) if x is not None and len(x) else np.zeros(0)
                if not pd.isna(seed) and len(samples):
                    rng = np.random.default_rng(abs(int(seed)))
                    first = int(rng.integers(5, 40)) * HOP
                    samples = samples[first : len(samples) - int(rng.integers(5, 40)) * HOP]
                    samples = samples + rng.normal(size=len(samples)) * NOISE
                out.append(fingerprint(samples))
            yield pd.Series(out, dtype=object)

    return of(values, F.lit(None).cast("long") if clip_of is None else clip_of)


def classes_of(prints: DataFrame, id_col: str, print_col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, print, class) with a fingerprint, and the classes (class, rep, print)."""
    rows = prints.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(print_col), F.array().cast(PRINT)).alias("print"))
    # filtered when read back: a filter before the write would make each fingerprint twice
    rows = materialize(rows.withColumn("class", F.xxhash64("print")), name).filter(F.size("print") > 0)
    return rows, materialize(rows.groupBy("class").agg(F.min("id").alias("rep"), F.any_value("print").alias("print")), name)


def chosen_bits() -> list[list[tuple[int, int]]]:
    """Of each table, SEED_BITS pairs: an integer of the window, and a bit of it."""
    rng = np.random.default_rng(0)
    return [[(k * WINDOW_INTS // SEED_BITS, STEADY[b]) for k, b in enumerate(rng.integers(0, len(STEADY), SEED_BITS).tolist())] for _ in range(TABLES)]


CHOSEN = chosen_bits()


def lively(ints: np.ndarray) -> np.ndarray:
    """Which windows of a fingerprint change CHANGES times or more."""
    changed = np.concatenate([[0], np.cumsum(ints[1:] != ints[:-1])])
    return changed[WINDOW_INTS - 1 :] - changed[: max(0, len(ints) - WINDOW_INTS + 1)] >= CHANGES


def brief(prints: Column) -> Column:
    """Whether fingerprints have no window that changes enough, being short or still."""

    @F.pandas_udf("boolean")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series([not lively(np.asarray(x, np.int32)).any() for x in values], dtype=bool)

    return of(prints)


def window_seeds(ints: np.ndarray) -> np.ndarray:
    """Seeds of a fingerprint, each as place << 32 | table << 24 | bits; of windows that hardly change or agree with the one before, none."""
    n, bits, out = len(ints) - WINDOW_INTS + 1, ints.view(np.uint32), []
    if n <= 0:
        return np.zeros(0, np.int64)
    moves = lively(ints)
    for number, chosen in enumerate(CHOSEN):
        seed = np.zeros(n, np.int64)
        for place, bit in chosen:
            seed = (seed << 1) | ((bits[place : place + n] >> np.uint32(bit)) & np.uint32(1))
        at = np.flatnonzero(moves & np.append(True, seed[1:] != seed[:-1]))
        out.append(at << 32 | number << SEED_BITS | seed[at])
    return np.concatenate(out)


def seeds(classes: DataFrame) -> DataFrame:
    """(class, at, seed) of the windows of all fingerprints."""

    @F.pandas_udf("array<long>")
    def of(prints: pd.Series) -> pd.Series:
        return pd.Series([window_seeds(np.asarray(x, np.int32)) for x in prints], dtype=object)

    x = F.col("x")
    found = classes.filter(F.size("print") >= WINDOW_INTS).select("class", of("print").alias("xs")).select("class", F.explode("xs").alias("x"))
    return found.select("class", F.shiftright(x, 32).cast("int").alias("at"), x.bitwiseAND(0xFFFFFFFF).cast("int").alias("seed"))


def change_seeds(classes: DataFrame) -> DataFrame:
    """(class, at, seed, brief): where a fingerprint's integer changes, and the two integers."""
    last = F.size("print") - 1
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda k: F.get("print", k) != F.get("print", k - 1))
    changes = F.transform(at, lambda k: F.struct(k.alias("at"), F.xxhash64(F.get("print", k - 1), F.get("print", k)).alias("seed")))
    alone = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.get("print", F.lit(0))).alias("seed")))
    return classes.select("class", brief("print").alias("brief"), F.explode(F.when(F.size(changes) > 0, changes).otherwise(alone)).alias("x")).select("class", "x.at", "x.seed", "brief")


def offset_votes(a: DataFrame, b: DataFrame, same: bool) -> DataFrame:
    """(a, b, offset, votes) of the classes of ``a`` and ``b`` that meet often enough."""

    def added(found: DataFrame) -> DataFrame:
        found = found if same else found.filter("a <> b")
        return found.groupBy("a", "b", (F.col("tb") - F.col("ta")).alias("offset")).agg(F.count("*").alias("votes"))

    votes = added(seeds(a).toDF("a", "ta", "seed").join(seeds(b).toDF("b", "tb", "seed"), "seed"))
    if a.select("print").unionAll(b.select("print")).filter(brief("print")).limit(1).count():
        left, right = change_seeds(a).toDF("a", "ta", "seed", "sa"), change_seeds(b).toDF("b", "tb", "seed", "sb")
        # one side at least is brief: no change seeds of two others meet
        found = left.filter("sa").join(right, "seed").unionByName(left.filter("not sa").join(right.filter("sb"), "seed"))
        least = left.groupBy("a").agg(F.count("*").alias("asked"))
        votes = votes.unionByName(added(found).join(least, "a").filter(F.col("votes") >= F.least(F.lit(VOTES), F.col("asked"))).drop("asked"))
    return votes


def search(prints: DataFrame, queries: Column, id_col: str = "id", print_col: str = "print") -> DataFrame:
    """``aligned`` for the rows of ``prints`` for which ``queries`` against all rows, without pairs of a class with itself."""
    return aligned(prints.filter(queries), prints, id_col, print_col, False)


def aligned(asking: DataFrame, known: DataFrame, id_col: str = "id", print_col: str = "print", same: bool = True, listed: bool = False) -> DataFrame:
    """(kind, id, other, offset, bit_errors): ``pair`` rows of matching classes; ``member`` rows of each further member of a class of ``known``, ``asker`` rows of one of ``asking``.

    A pair's id is the representative of a class of ``asking``, other one of ``known``; offset is how many frames the other one lies later; bit_errors the
    share of differing bits where both are.  ``same``: equal fingerprints of both sides are pairs too.
    ``listed``: one ``pair`` row for each class of ``asking`` that has any, of its best match, with ``matches``, all of them from the best on, and their number.
    """
    a_rows, a = classes_of(asking, id_col, print_col, "asking")
    b_rows, b = classes_of(known, id_col, print_col, "known")
    votes = offset_votes(a, b, same)
    best = votes.groupBy("a", "b").agg(F.max(F.struct("votes", F.col("offset"))).alias("best")).select("a", "b", "best.offset")
    x, y = a.toDF("a", "id", "pa"), b.toDF("b", "other", "pb")
    low, high = F.greatest(F.lit(0), -F.col("offset")), F.least(F.size("pa"), F.size("pb") - F.col("offset"))
    pairs = best.join(x, "a").join(y, "b").withColumn("n", high - low).filter(F.col("n") >= F.least(F.lit(OVERLAP), F.size("pa"), F.size("pb")))
    both = F.zip_with(F.slice("pa", low + 1, F.col("n")), F.slice("pb", low + F.col("offset") + 1, F.col("n")), lambda p, q: F.bit_count(p.bitwiseXOR(q).bitwiseAND(0xFFFFFFFF)))  # bit_count extends the sign to 64 bits
    wrong = F.aggregate(both, F.lit(0), lambda s, v: s + v) / (32 * F.col("n"))
    out = pairs.withColumn("bit_errors", wrong).filter(F.col("bit_errors") <= ERRORS)
    if listed:
        out = out.groupBy("a", "id").agg(F.array_sort(F.collect_list(F.struct("bit_errors", "other", "offset"))).alias("matches"))
        out = out.select("id", "matches", F.size("matches").alias("n_matches"), F.inline(F.slice("matches", 1, 1)))
    out = out.select(F.lit("pair").alias("kind"), "id", "other", "offset", "bit_errors", *(["n_matches", "matches"] if listed else []))
    for kind, rows, classes in (("member", b_rows, b), ("asker", a_rows, a)):
        if kind == "asker" and not same:
            continue
        # each row of a class but one of its representative's
        others = rows.groupBy("class", "id").agg(F.count("*").alias("n")).join(classes.select("class", "rep"), "class")
        others = others.withColumn("n", F.col("n") - F.col("id").eqNullSafe(F.col("rep")).cast("int")).filter("n > 0").select("rep", "id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        out = out.unionByName(others.select(F.lit(kind).alias("kind"), F.col("rep").alias("id"), F.col("id").alias("other"), F.lit(0).alias("offset"), F.lit(0.0).alias("bit_errors")), allowMissingColumns=listed)
    return out
