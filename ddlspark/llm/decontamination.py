"""Benchmark decontamination (operator 1): exact phrases and near ones by a distributed positional inverted index.

``index`` stores postings, (term, document, position), of the training texts' words: each task sorts its own
segment by term and writes it, so building shuffles nothing and lookups skip the row groups of other terms.  Given
a vocabulary, only its words are stored.  ``phrase_hits`` takes the windows of test items, picks the two rarest terms of each by the
index's own counts, and intersects their posting lists after taking off the terms' offsets, so that equal rests
(diagonals) of an item and a document mean aligned words.  All terms of an item are then intersected along the diagonals that are left,
and runs of aligned words that are as long as a window are the hits.  All of it is DataFrame operations.

Edge cases: null and empty texts have no words; an item without words or with a null id is not looked for; an item shorter than a
window is one window; items that agree in id count once by id; documents that agree in id and text share
postings and answers; a null document id stays null; empty tables give no hits; other columns pass through.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import broadcast_if, materialize

#: All but 0-9, a-z and what is not ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows that a broadcast may hold; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), BETWEEN), "")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, size, offset, term) of the words of ``items``; item is a hash of id and text."""
    own = items.filter(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("item"), F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    own = own.dropDuplicates(["item"]).withColumn("size", F.size("words"))
    return own.select("item", "item_id", "size", F.posexplode("words").alias("offset", "term"))


def index(docs: DataFrame, vocabulary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, key, pos): the postings of ``docs``, written in segments sorted by term.  term is a hash of the word; ``vocabulary``: (word)."""
    text = F.col(text_col)
    rows = docs.select(row_key(F.col(id_col), text).alias("key"), F.posexplode(words_of(text)).alias("pos", "word"))
    if vocabulary is not None:
        known = materialize(vocabulary.select("word").distinct(), "vocabulary")
        rows = rows.join(broadcast_if(known, known.count(), BROADCAST_ROWS), "word")
    return materialize(rows.select(F.xxhash64("word").alias("term"), "key", "pos").sortWithinPartitions("term", "key", "pos"), "index")


def aligned(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """(item, key, diagonal, offset): postings of probe terms (item, offset, term), less the probes' offsets."""
    found = postings.join(broadcast_if(probes, probes.count(), BROADCAST_ROWS), "term")
    return found.select("item", "key", (F.col("pos") - F.col("offset")).alias("diagonal"), "offset")


def phrase_hits(postings: DataFrame, terms: DataFrame, window: int = 13) -> DataFrame:
    """(item, item_id, key, pos, length): maximal runs of words of a document that windows of an item cover.

    ``terms`` as of ``item_terms``.  An item of fewer than ``window`` words is one window.
    """
    terms = materialize(terms.withColumn("term", F.xxhash64("term")).withColumn("w", F.least("size", F.lit(window))), "terms")
    wanted = terms.select("term").distinct()
    counts = materialize(postings.join(broadcast_if(wanted, wanted.count(), BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("df")), "counts")
    starts = terms.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - F.col("w") + 1), F.least(F.col("offset"), F.col("size") - F.col("w")))))
    counted = starts.join(counts, "term", "left")
    per_window = Window.partitionBy("item", "start")
    ranked = counted.withColumn("missing", F.max(F.col("df").isNull()).over(per_window)).filter("not missing")
    ranked = ranked.withColumn("rank", F.row_number().over(per_window.orderBy("df", "offset")))
    probes = materialize(ranked.filter("rank <= 2").select("item", "offset", "term", "w").distinct(), "probes")
    need = F.least(F.lit(2), F.max("w"))
    sizes = broadcast_if(terms.select("item", "w").distinct(), terms.count(), BROADCAST_ROWS)
    meeting = aligned(postings, probes.drop("w")).groupBy("item", "key", "diagonal").agg(F.count("*").alias("n"))
    left = materialize(meeting.join(sizes, "item").groupBy("item", "key", "diagonal").agg(F.max("n").alias("n"), need.alias("need")).filter("n >= need").select("item", "key", "diagonal"), "diagonals")
    documents = left.select("key").distinct()
    near = postings.join(broadcast_if(documents, documents.count(), BROADCAST_ROWS), "key")
    everywhere = terms.select("item", "item_id", "term", "offset", "w")
    asked = left.join(broadcast_if(everywhere, terms.count(), BROADCAST_ROWS), "item").withColumn("pos", F.col("diagonal") + F.col("offset"))
    matched = asked.join(near, ["key", "term", "pos"]).select("item", "item_id", "key", "diagonal", "offset", "w").distinct()
    along = Window.partitionBy("item", "key", "diagonal").orderBy("offset")
    runs = matched.withColumn("run", F.col("offset") - F.row_number().over(along)).groupBy("item", "item_id", "key", "diagonal", "run", "w").agg(F.min("offset").alias("first"), F.count("*").alias("length"))
    return runs.filter("length >= w").select("item", "item_id", "key", (F.col("diagonal") + F.col("first")).alias("pos"), "length")


def proximity_hits(postings: DataFrame, terms: DataFrame, within: int) -> DataFrame:
    """(item, item_id, key, pos): places of an item's rarest term with all its other terms at most ``within`` words away, in any order."""
    distinct = materialize(terms.select("item", "item_id", F.xxhash64("term").alias("term")).distinct(), "terms")
    size = distinct.groupBy("item").agg(F.count("*").alias("terms"))
    asked = broadcast_if(distinct, distinct.count(), BROADCAST_ROWS)
    lists = postings.join(asked, "term")
    counts = materialize(lists.groupBy("item", "term").agg(F.count("*").alias("df")), "counts")
    complete = counts.groupBy("item").agg(F.count("*").alias("found"), F.min(F.struct("df", "term")).alias("rarest")).join(size, "item").filter("found = terms")
    rare = complete.select("item", F.col("rarest.term").alias("rare"), "terms")
    places = lists.join(rare, "item").filter("term = rare").select("item", "item_id", "key", F.col("pos").alias("place"), "terms")
    close = lists.select("item", "key", "term", "pos").join(places, ["item", "key"]).filter(F.abs(F.col("pos") - F.col("place")) <= within)
    return close.groupBy("item", "item_id", "key", "place", "terms").agg(F.count_distinct("term").alias("met")).filter("met = terms").select("item", "item_id", "key", F.col("place").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, per_words: int = 20, id_col: str = "doc_id", text_col: str = "text", out_col: str = "contamination") -> DataFrame:
    """``docs`` with ``out_col``, a struct: n_words, n_hit, n_items, items (sorted ids as strings), contaminated.

    A document is contaminated if at least one word of each ``per_words``, and one at all, lies in a window of an item.
    """
    terms = item_terms(items)
    postings = index(docs, terms.select(F.col("term").alias("word")), id_col, text_col)
    hits = materialize(phrase_hits(postings, terms, window), "hits")
    covered = hits.select("key", F.explode(F.sequence("pos", F.col("pos") + F.col("length").cast("int") - 1)).alias("word")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    answers = materialize(covered.join(named, "key"), "answers")
    own = answers.select(F.col("key").alias("_key"), F.col("n_hit").alias("_hit"), F.col("items").alias("_items"))
    text = F.col(text_col)
    counted = docs.withColumns({"_key": row_key(F.col(id_col), text), "_words": F.size(words_of(text)).cast("long")})
    joined = counted.join(broadcast_if(own, own.count(), BROADCAST_ROWS), "_key", "left")
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    listed = F.coalesce("_items", F.array().cast("array<string>"))
    guilty = (n_hit > 0) & (per_words * n_hit >= F.col("_words"))
    found = F.struct(F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), guilty.alias("contaminated"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != out_col], found.alias(out_col))
