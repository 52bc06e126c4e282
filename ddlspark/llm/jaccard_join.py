"""N-gram Jaccard join (operator 5): documents whose shingle sets are alike, exactly, with set-relation skipping.

1. Sets are hashed; documents with equal sets are one class.  Only shingles that another set has can link.  A set that could
   be linked shares some of its ``reach`` smallest hashes with its partner, and enough of them; sets that share fewer are done.
2. The others are indexed by their rarest shingles (prefix filter), as many as a partner must hit.
3. Each set is compared with the leader that most of its lists name, and again, with the next, while lists name leaders it is not yet
   connected to, ``ROUNDS`` times.  A list's leader is the set whose shingles are most shared.  A set that links to its leader keeps only the
   shingles that it has more or less than the leader, and its distance to it.
4. In a list, a leader's sets are one unit.  Units of one component are skipped, and so are units at such positions of the list that
   the rests of their sets (the shingles that are not rarer) are too few for a link.  Units are skipped whose leaders are farther apart
   than the link distance and both units' radii (distances of sets obey the triangle inequality).  Leaders near enough link as they are.
5. Of the remaining units, the larger one's leader is compared with the sets of the other.  The answers of the leader's sets are derived
   from the leader's: only sets that differ from it by enough of the same shingles as the other set can link (see ``derived_links``).

Nothing is capped: every pair that is not answered by 4 is answered by 5.  Shingles are compared by 64-bit hashes, and
sets by a 64-bit sum of them; which shingles several sets have, and how many, chunks ask in packed form (see ``chunks``), with 32 bits of the set's name
to tell sets apart there.

Edge cases: null and empty texts, and white space alone, have no shingles and are linked with nothing; a text of fewer words than a shingle
is one shingle; a null id keeps its own row, with a null component unless a row with an id has the same set or links to it; repeated rows are one class;
an empty table gives no rows; other columns pass through ``without_similar``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import materialize
from .chunks import answers, asked, bucket_count, bytes_of, cut, distinct, grouped, passes, placed, squeezed, thawed, unsqueezed, whole, with_answers
from .components import components
from .words import Words


#: How often sets look for a leader; what remains is left to steps 4 and 5.
ROUNDS = 2
#: Hashes in the heads of a text's set for each of its bytes, about; hashes in a bundle of sets.
HEADS, BUNDLE = 0.05, 300_000


def least_shared(n):
    """Shingles that a set of ``n`` must share with a linked one: three quarters, rounded up."""
    return (3 * n + 3) // 4


def spare(n):
    """By how much the hash prefix is longer than it must be, and so how many hashes a linked set shares in it."""
    return np.maximum(1, n // 20)


def shingle_sets(w: Words, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    full = w.hashes(words)
    for first, size in zip(w.first.tolist(), w.size.tolist(), strict=True):
        if size >= words:
            yield distinct(full[first : first + size - words + 1])
        else:
            yield w.hashes(size, np.array([first])) if size else np.zeros(0, np.uint64)


def set_name(x: np.ndarray) -> int:
    """A hash of a set, whatever the order of its elements."""
    mixed = (x * np.uint64(0xD1342543DE82EF95)) ^ (x >> np.uint64(29))
    return int(mixed.sum(dtype=np.uint64).astype(np.int64)) ^ (len(x) << 40)


def wide(hashes: np.ndarray) -> bytes:
    """Sorted hashes, packed."""
    return squeezed(np.diff(hashes, prepend=np.uint64(0)))


def narrow(packed: bytes, n: int) -> np.ndarray:
    """What ``wide`` was given, as signed numbers."""
    return np.cumsum(unsqueezed(packed, n, "<u8")).astype(np.int64)


class Sets:
    """The shingle sets of a chunk's texts, by row, and their names."""

    def __init__(self, rows: bytes, text_at: int, words: int):
        self.table = thawed(rows)
        data, begin = bytes_of(self.table.column(text_at))
        self.sets = [x for a, b in passes(begin) for x in shingle_sets(Words(data[begin[a] : begin[b]], begin[a : b + 1] - begin[a], lower=True), words)]
        self.names = [set_name(x) for x in self.sets]
        self.heads = [x[: len(x) - least_shared(len(x)) + int(spare(len(x)))] if len(x) else x for x in self.sets]

    def questions(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The heads' distinct hashes; of each the smallest tag of a set with it, and what the largest one differs by."""
        once = {name: k for k, name in enumerate(self.names)}.values()  # equal sets ask once
        hashes = np.concatenate([np.zeros(0, np.uint64), *(self.heads[k] for k in once)])
        tags = np.repeat(np.array([self.names[k] & 0xFFFFFFFF for k in once], np.uint32), [len(self.heads[k]) for k in once])
        order, start, _ = grouped(hashes)
        if not len(hashes):
            return hashes, [tags, tags]
        low, high = np.minimum.reduceat(tags[order], start), np.maximum.reduceat(tags[order], start)
        return hashes[order][start], [low, low ^ high]


def several(key: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Reply: 1 for hashes that sets of different tags have."""
    order, start, group = grouped(key)
    low, high = values[0][order], (values[0] ^ values[1])[order]
    return (np.minimum.reduceat(low, start) != np.maximum.reduceat(np.maximum(low, high), start))[group].astype(np.uint8)


def total(key: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Reply: the sum of the values of a key."""
    order, start, group = grouped(key)
    return np.add.reduceat(values[0][order], start)[group].astype(np.uint32)


def scanned(chunked: DataFrame, words: int, id_at: int, text_at: int) -> DataFrame:
    """(chunk, row, id, set, n, hashes) of all rows of the chunks; the packed hashes only of sets that could be linked, once a chunk."""
    buckets = bucket_count(chunked, HEADS)
    questions = asked(chunked, lambda row: Sets(row["rows"], text_at, words).questions(), ["u4", "u4"], buckets)
    table = with_answers(chunked, answers(questions, ["u4", "u4"], several, "shared"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                own = Sets(row["rows"], text_at, words)
                key, _ = own.questions()
                shared = key[placed(key, buckets, row["shared"], "u1") > 0]
                packed, seen = [], set()
                for x, head, name in zip(own.sets, own.heads, own.names, strict=True):
                    open_ = len(x) and name not in seen and np.isin(head, shared, assume_unique=True).sum() >= max(1, least_shared(len(x)) // 20)
                    seen.add(name)
                    packed.append(wide(x) if open_ else None)
                ids = whole(own.table.column(id_at)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), row["chunk"], np.int64)), pa.array(np.arange(len(packed), dtype=np.int64)), ids, pa.array(own.names, pa.int64()), pa.array([len(x) for x in own.sets], pa.int64()), pa.array(packed, pa.binary())], ["chunk", "row", "id", "set", "n", "hashes"])

    return materialize(table.mapInArrow(found, "chunk long, row long, id long, set long, n long, hashes binary"), "scanned")


def bundled(sets: DataFrame) -> DataFrame:
    """``sets`` (set, n, hashes) as a materialized table of bundles (chunk, bytes, sets, sizes, hashes)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends, low = np.cumsum(n), 0
            while low < len(n):
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + BUNDLE, "right")))
                values = [[part << 32 | seq], [int(ends[high - 1]) - before], [batch.column("set")[low:high].to_pylist()], [n[low:high].tolist()], [batch.column("hashes")[low:high].to_pylist()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())), strict=True)], ["chunk", "bytes", "sets", "sizes", "hashes"])
                low, seq = high, seq + 1

    return materialize(sets.select("set", "n", "hashes").mapInArrow(made, "chunk long, bytes long, sets array<long>, sizes array<long>, hashes array<binary>"), "bundles")


def bundle_counts(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct hashes of a bundle, and how many of its sets have each."""
    h = np.sort(np.concatenate([np.zeros(0, np.uint64), *[narrow(x, n).view(np.uint64) for x, n in zip(row["hashes"], row["sizes"], strict=True)]]))
    first = np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]])
    return h[first], [np.diff(np.append(np.flatnonzero(first), len(h)))]


def indexed(bundles: DataFrame) -> DataFrame:
    """(hash, set, n, rest, score): each set's rarest shingles, as many as one of them must be shared with any linked set.

    rest: how many of the set's shingles are not rarer; sets whose first common shingle this is share no more than the smaller rest.
    score: how many sets have a shingle of the set, on average; in a group of copies it is highest for the set that they come from.
    """
    buckets = bucket_count(bundles, 1.0)
    table = with_answers(bundles, answers(asked(bundles, bundle_counts, ["u4"], buckets), ["u4"], total, "df"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                key, _ = bundle_counts(row)
                times, out = placed(key, buckets, row["df"], "u4"), []
                for name, packed, n in zip(row["sets"], row["hashes"], row["sizes"], strict=True):
                    h = narrow(packed, n).view(np.uint64)
                    df = times[np.searchsorted(key, h)].astype(np.int64)
                    rarest = np.lexsort((h, df))[: n - least_shared(n) + 1]  # hashes that no other set has come first and fill part of the prefix
                    rest = n - np.arange(len(rarest))
                    rarest, rest = rarest[df[rarest] > 1], rest[df[rarest] > 1]
                    out.append((h[rarest].view(np.int64), np.full(len(rarest), name), np.full(len(rarest), n), rest, np.full(len(rarest), df[df > 1].sum() / n)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["hash", "set", "n", "rest", "score"])

    return materialize(table.mapInArrow(lists, "hash long, set long, n long, rest long, score double"), "lists")


def overlap(x, y) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def link_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b): with ``linked``, ``distance`` and, where linked, what a has ``more`` and ``less`` than b."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, *packed in zip(batch["a"], batch["b"], batch["x"], batch["nx"], batch["y"], batch["ny"], strict=True):
                x, y = narrow(*packed[:2]), narrow(*packed[2:])
                both = np.intersect1d(x, y, assume_unique=True)
                union = len(x) + len(y) - len(both)
                linked = 4 * len(both) >= 3 * union
                more, less = (np.setdiff1d(x, both, True), np.setdiff1d(y, both, True)) if linked else ([], [])
                out.append((a, b, linked, 1 - len(both) / union, more, less))
            yield pd.DataFrame(out, columns=["a", "b", "linked", "distance", "more", "less"])

    x, y = sets.select("set", "hashes", "n").toDF("a", "x", "nx"), sets.select("set", "hashes", "n").toDF("b", "y", "ny")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "nx", "y", "ny").mapInPandas(compare, "a long, b long, linked boolean, distance double, more array<long>, less array<long>")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (leader, b): ``short``, by how much they miss a link (none if 0 or less), and the shingles that one of both has."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for leader, b, *packed in zip(batch["leader"], batch["b"], batch["x"], batch["nx"], batch["y"], batch["ny"], strict=True):
                x, y = narrow(*packed[:2]), narrow(*packed[2:])
                short = 3 * (len(x) + len(y)) - 7 * overlap(x, y)
                out.append((leader, b, short, np.setxor1d(x, y, assume_unique=True) if short > 0 else []))
            yield pd.DataFrame(out, columns=["leader", "b", "short", "delta"])

    x, y = sets.select("set", "hashes", "n").toDF("leader", "x", "nx"), sets.select("set", "hashes", "n").toDF("b", "y", "ny")
    return pairs.join(x, "leader").join(y, "b").select("leader", "b", "x", "nx", "y", "ny").mapInPandas(compare, "leader long, b long, short long, delta array<long>")


def rare_part(rows: DataFrame, often: DataFrame, names: list[str]) -> DataFrame:
    """(names, e): of each row's ``delta`` the elements of ``often`` (leader, e, df), rarest first, ``need`` - 1 of them left off."""
    entries = rows.select(*names, "need", F.explode("delta").alias("e")).join(often, ["leader", "e"])
    own = entries.groupBy(*names, "need").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("own"))
    kept = own.withColumn("length", (F.size("own") - F.col("need") + 1).cast("int")).filter("length > 0")
    return kept.select(*names, F.explode(F.slice("own", 1, F.col("length"))).alias("d")).select(*names, F.col("d.e").alias("e"))


def derived_links(pairs: DataFrame, stars: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of b to the leader, or to sets of the leader's unit, for all ``pairs`` (leader, b).

    A member m lacks l shingles of its leader and has k others.  With b it shares what the leader shares with b, less and more
    what m differs by, so m and b link if and only if 7 c >= short + 4 l + 3 k, c being the shingles by which both m and b differ from the leader.
    As c must be that large, m and b meet in the rarest of those shingles (prefix filter); then c is counted.
    """
    found = materialize(differences(pairs, sets), "differences")
    theirs = found.filter("short > 0").withColumn("need", F.ceil(F.col("short") / 4))
    least = theirs.groupBy("leader").agg(F.min("short").alias("least"))
    own = stars.select(F.col("b").alias("leader"), "a", F.concat("less", "more").alias("delta"), (4 * F.size("less") + 3 * F.size("more")).alias("cost"))
    own = own.join(least, "leader").filter("7 * size(delta) >= cost + least").withColumn("need", F.ceil((F.col("least") + F.col("cost")) / 7))
    own = materialize(own.drop("least"), "members")
    often = materialize(own.select("leader", F.explode("delta").alias("e")).groupBy("leader", "e").agg(F.count("*").alias("df")), "deltas")
    x = rare_part(own.withColumn("tx", F.size("delta")), often, ["leader", "a", "cost", "tx"])
    y = rare_part(theirs.withColumn("ty", F.size("delta")), often, ["leader", "b", "short", "ty"])
    met = x.join(y, ["leader", "e"]).filter("7 * least(tx, ty) >= short + cost").select("leader", "a", "b").distinct()
    both = met.join(own.select("leader", "a", "cost", F.col("delta").alias("dx")), ["leader", "a"]).join(theirs.select("leader", "b", "short", F.col("delta").alias("dy")), ["leader", "b"])
    linked = both.filter(7 * F.size(F.array_intersect("dx", "dy")) >= F.col("short") + F.col("cost")).select("a", "b")
    return linked.unionByName(found.filter("short <= 0").select(F.col("leader").alias("a"), "b"))


def links(bundles: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the sets that all links connect; the sets of ``bundles`` are distinct."""
    lists = indexed(bundles)
    one = F.explode(F.arrays_zip("sets", "sizes", "hashes")).alias("x")
    sets = bundles.select(one).select(F.col("x.sets").alias("set"), F.col("x.sizes").alias("n"), "x.hashes")
    asked = edges = stars = None
    at = None
    for _ in range(ROUNDS):
        now = lists if at is None else lists.join(at.toDF("set", "component"), "set", "left")
        own = now.withColumn("own", F.coalesce("component", "set") if at is not None else F.col("set"))
        lead = own.groupBy("hash").agg(F.max(F.struct("score", "set", "own")).alias("l"), F.count("*").alias("m")).filter("m > 1").select("hash", F.col("l.set").alias("leader"), F.col("l.own").alias("theirs"))
        votes = own.join(lead, "hash").filter("own <> theirs").groupBy(F.col("set").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("votes"))
        if asked is not None:
            votes = votes.join(asked, ["a", "b"], "left_anti")
        best = votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("best")).select("a", "best.b")
        compared = materialize(link_pairs(best, sets), "stars")
        found = compared.filter("linked")
        asked = compared.select("a", "b") if asked is None else asked.unionByName(compared.select("a", "b"))
        # a set keeps the first leader that it links to
        stars = found if stars is None else stars.unionByName(found.join(stars.select("a"), "a", "left_anti"))
        edges = found.select("a", "b") if edges is None else edges.unionByName(found.select("a", "b"))
        at = components(edges)
    # units: the sets of a leader in a list
    of = stars.select(F.col("a").alias("set"), F.col("b").alias("leader"), "distance")
    at_units = lists.join(of, "set", "left").join(at.withColumnRenamed("node", "set"), "set", "left")
    at_units = materialize(at_units.select("hash", "set", "n", "rest", F.coalesce("leader", "set").alias("leader"), F.coalesce("distance", F.lit(0.0)).alias("distance"), F.coalesce("component", "set").alias("component")), "at_units")
    mixed = at_units.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("hash")
    open_ = materialize(at_units.join(mixed, "hash"), "open")
    units = open_.groupBy("hash", "leader", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    radius = at_units.groupBy("leader").agg(F.max("distance").alias("radius"))
    x, y = units.toDF("hash", "a", "ca", "lowa", "higha", "resta"), units.toDF("hash", "b", "cb", "lowb", "highb", "restb")
    near = x.join(y, "hash").filter("a < b and ca <> cb and 4 * highb >= 3 * lowa and 4 * higha >= 3 * lowb and 7 * least(resta, restb) >= 3 * (lowa + lowb)").select("a", "b").distinct()
    compared = materialize(link_pairs(near, sets).select("a", "b", "linked", "distance"), "near")
    direct = compared.filter("linked").select("a", "b")
    edges = edges.unionByName(direct)
    unclear = compared.filter("not linked").join(radius.toDF("a", "ra"), "a").join(radius.toDF("b", "rb"), "b").filter("distance <= 0.25 + ra + rb + 1e-9").select("a", "b")
    unclear = materialize(unclear, "unclear")
    if unclear.isEmpty():
        return edges
    at = components(edges).withColumnRenamed("node", "set").withColumnRenamed("component", "now")
    members = materialize(open_.join(at, "set", "left").select("hash", "set", "leader", F.coalesce("now", "set").alias("now")), "members")
    # each set of the smaller unit is held against the leader of the larger one
    size = members.groupBy("leader").agg(F.count("*").alias("size"))
    sized = unclear.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    asked = sized.select(F.expr("if(na >= nb, a, b)").alias("leader"), F.expr("if(na >= nb, b, a)").alias("other"))
    led = members.select("hash", "leader", F.col("now").alias("ours")).distinct()
    pairs = asked.join(members.withColumnRenamed("leader", "other"), "other").join(led, ["hash", "leader"]).filter("now <> ours").select("leader", F.col("set").alias("b")).distinct()
    return edges.unionByName(derived_links(pairs, stars, sets))


def grouped_rows(docs: DataFrame, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The chunks of ``docs``, and (chunk, row, id, n, component_id, group) of all their rows; group is null without shingles."""
    chunked = cut(docs, text_col, "chunks")
    rows = scanned(chunked, words, docs.columns.index(id_col), docs.columns.index(text_col))
    bundles = bundled(rows.filter("hashes is not null").select("set", "n", "hashes").dropDuplicates(["set"]))
    at = components(links(bundles)).toDF("set", "component")
    classes = rows.filter("n > 0").groupBy("set").agg(F.min("id").alias("rep")).join(at, "set", "left").withColumn("component", F.coalesce("component", "set"))
    classes = materialize(classes, "classes")
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    answer = classes.join(least, "component").select("set", "component_id", F.col("component").alias("group"))
    joined = rows.drop("hashes").join(answer, "set", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return chunked, joined.select("chunk", "row", "id", "n", "component_id", "group")


def similar_groups(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links of a Jaccard similarity of 0.75 or more."""
    _, rows = grouped_rows(docs.select(id_col, text_col), words, id_col, text_col)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def without_similar(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id, rows without one last.  All rows without shingles stay."""
    chunked, rows = grouped_rows(docs, words, id_col, text_col)
    names = docs.columns
    rows = materialize(rows.filter("group is not null"), "groups")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "chunk", "row")).alias("first")).select("first.chunk", "first.row", F.lit(True).alias("stays"))
    gone = rows.select("chunk", "row").join(first, ["chunk", "row"], "left_anti").groupBy("chunk").agg(F.collect_list("row").alias("gone"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                table = thawed(batch.column("rows")[k].as_py())
                stay = np.ones(table.num_rows, bool)
                stay[np.array(batch.column("gone")[k].as_py() or [], np.int64)] = False
                columns = [whole(c).filter(pa.array(stay)) for c in table.columns]
                yield pa.RecordBatch.from_arrays(columns, names)

    return chunked.join(gone, "chunk", "left").mapInArrow(kept, docs.schema)
