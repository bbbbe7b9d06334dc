"""Benchmark decontamination by a positional inverted index over the training texts.

Each test window (some consecutive words of an item) stands under the pair of
its two rarest words. The index keeps, for the words of such pairs, a posting
for every place where a training text has them. A pair's two posting lists,
each shifted by the word's offset, are intersected; where they agree a window
may stand, and the words kept around the rarest one's posting decide it. Where
they agree but for a few words, the pair is a proximity match.

Only DataFrame and SQL functions are used. Terms are 64-bit hashes of words;
what is found is compared word by word, so a collision costs only time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import stored

#: What separates words, and A-Z as a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of fixed width (at most 40 bytes) that are sent to all executors at once; longer tables go in several blocks.
BLOCK_ROWS = 1_000_000

#: Starts of a pair that are joined under one key.
SPAN = 64


def _split(text: Column) -> Column:
    """The words of a text in order; a text that begins or ends with a separator has an empty one there."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), SEPARATORS, -1)


def _blocks(table: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """``table`` as blocks of some ``rows`` rows, cut by a hash of ``key``, each to be broadcast."""
    n = max(1, -(-table.count() // rows))
    return [F.broadcast(table.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)) == i)) for i in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def item_windows(items: DataFrame, words: int) -> DataFrame:
    """(item_id, window): the distinct runs of ``words`` words of each item, joined by spaces; fewer words are one run, no words none."""
    of_item = items.select("item_id", F.filter(_split(F.col("text")), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1)))
    return of_item.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.array_join(F.slice("w", F.col("s"), words), " ").alias("window")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(term, n) of the ``terms`` (term, distinct) that occur in the texts: how often."""
    tokens = docs.select(F.explode(_split(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("term"))
    return _union([tokens.join(block, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")) for block in _blocks(terms, "term", block_rows)])


def rarest_pairs(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, length, a, pair, term, other, delta) of the distinct windows whose words all occur.

    ``term`` is the rarest word and stands ``a`` words behind the start;
    ``other``, the next, stands ``delta`` words behind ``term``. Of equally
    frequent words the earlier counts as rarer; a word twice in a window is two.
    A window of one word is paired with itself.
    """
    placed = windows.select("window", F.posexplode(F.split("window", " ")).alias("p", "word")).withColumn("term", F.xxhash64("word"))
    known = placed.join(counts, "term", "left")
    ranked = known.groupBy("window").agg(F.count(F.lit(1)).cast("int").alias("length"), F.count("n").alias("_known"), F.sort_array(F.collect_list(F.struct("n", "p", "term"))).alias("_by"))
    lead, other = F.col("_by")[0], F.coalesce(F.get(F.col("_by"), F.lit(1)), F.col("_by")[0])
    paired = ranked.where(F.col("_known") == F.col("length")).select("window", "length", lead["p"].alias("a"), lead["term"].alias("term"), other["term"].alias("other"), (other["p"] - lead["p"]).alias("delta"))
    return paired.withColumn("pair", F.xxhash64("term", "other", "delta"))


def build_index(docs: DataFrame, terms: DataFrame, around: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The stored index: a posting (row, term, at, near) for each place of a term, and a row (row, doc_id, n_words) for each text.

    ``terms`` are (term, lead); for those that lead a pair ``near`` keeps the
    words from ``around`` before to ``around`` behind. ``row`` numbers the rows
    of ``docs``, so equal ids, null ids and equal texts stay apart and no key is
    hotter than the longest text. Numbers and postings are written in one pass.
    """
    w = F.col("w")
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _split(F.col("text")).alias("w"))
    n_words = F.size(w) - F.when(F.element_at(w, 1) == "", 1).otherwise(0) - F.when((F.element_at(w, -1) == "") & (F.size(w) > 1), 1).otherwise(0)
    # The text's own row comes with its postings, as the entry behind the last word.
    placed = numbered.select("doc_id", "row", "w", F.posexplode(F.concat(w, F.array(F.lit(None).cast("string")))).alias("at", "word"))
    hashed = placed.withColumn("term", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
    at = F.col("at")
    near = F.when(F.col("lead"), F.slice(w, F.greatest(at - around, F.lit(0)) + 1, around + 1 + F.least(at, F.lit(around))))
    parts = []
    for i, block in enumerate(_blocks(terms, "term", block_rows)):
        joined = hashed.join(block, "term", "left")
        is_text = F.col("word").isNull()
        kept = joined.where(F.col("lead").isNotNull() | is_text if i == 0 else F.col("lead").isNotNull())
        parts.append(kept.select("row", "term", F.when(~is_text, at).alias("at"), near.alias("near"), F.when(is_text, F.col("doc_id")).alias("doc_id"), F.when(is_text, n_words).cast("long").alias("n_words")))
    return stored(_union(parts), "postings")


def pair_matches(index: DataFrame, pairs: DataFrame, slop: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, pair, at, near, off): where a pair's lists agree, shifted by the offset, but for ``off`` words, at most ``slop``.

    ``at`` is the place of the rarest word and ``off`` how far the other one is
    from its place. Each list is cut into spans of places; the other word's
    entries near the end of a span are in the next one as well, so both lists
    are joined on equal keys. Every agreement is given once.
    """
    postings = index.where("term IS NOT NULL")
    leads, others = [], []
    distinct = stored(pairs.select("pair", "term", "other", "delta").distinct(), "pairs")
    for block in _blocks(distinct, "pair", block_rows):
        leads.append(postings.join(block.select("pair", "term"), "term").select("row", "pair", "at", "near"))
        others.append(postings.select("row", "at", "term").join(block.select("pair", F.col("other").alias("term"), "delta"), "term").select("row", "pair", (F.col("at") - F.col("delta")).alias("at_other")))
    lead = _union(leads).withColumn("span", F.floor(F.col("at") / SPAN))
    span = lambda shift: F.floor((F.col("at_other") + shift) / SPAN)
    other = _union(others).withColumn("span", F.explode(F.array_distinct(F.array(span(-slop), span(slop)))))
    met = lead.join(other, ["row", "pair", "span"]).withColumn("off", F.abs(F.col("at") - F.col("at_other")))
    return met.where(F.col("off") <= slop).select("row", "pair", "at", "near", "off")


def phrase_matches(found: DataFrame, pairs: DataFrame, around: int) -> DataFrame:
    """(row, start, length, window): every place of a text where a whole window stands, of the ``pair_matches``.

    A pair leads at most one window for each place and length that it can have
    in one; which window stands there is an equi-join on its words.
    """
    shapes = pairs.select("pair", "a", "length").distinct()
    before = F.least(F.col("at"), F.lit(around))
    # Spark may work out the cut ahead of the filter, so its start stays valid for those that are filtered.
    cut = F.array_join(F.slice("near", F.greatest(before - F.col("a") + 1, F.lit(1)), F.col("length")), " ")
    tried = found.where("off = 0").join(shapes, "pair").where(F.col("a") <= before)
    return tried.select("row", "pair", (F.col("at") - F.col("a")).alias("start"), "length", cut.alias("window")).join(pairs.select("pair", "window", "length"), ["pair", "window", "length"]).select("row", "start", "length", "window")


def find_items(docs: DataFrame, items: DataFrame, words: int = 10, slop: int = 4) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(index, windows of items, phrase matches, proximity matches) of ``items`` (item_id, text) in ``docs`` (doc_id, text).

    Phrase matches are (row, start, length, window); proximity matches are
    (row, window, at, off) with every window whose two rarest words stand at
    most ``slop`` words off their places to each other, phrase matches included.
    """
    around = words - 1
    of_items = stored(item_windows(items, words), "item_windows")
    windows = of_items.select("window").distinct()
    vocabulary = stored(windows.select(F.explode(F.split("window", " ")).alias("word")).select(F.xxhash64("word").alias("term")).distinct(), "vocabulary")
    counts = stored(term_counts(docs, vocabulary), "term_counts")
    pairs = stored(rarest_pairs(windows, counts), "window_pairs")
    leading = pairs.select("term", F.lit(True).alias("lead")).union(pairs.select("other", F.lit(False)))
    terms = stored(leading.groupBy("term").agg(F.max("lead").alias("lead")), "terms")
    index = build_index(docs, terms, around)
    found = stored(pair_matches(index, pairs, slop), "pair_matches")
    phrases = stored(phrase_matches(found, pairs, around), "phrases")
    return index, of_items, phrases, found.join(pairs.select("pair", "window"), "pair").select("row", "window", "at", "off")


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 10, slop: int = 4) -> DataFrame:
    """For each row of ``docs`` the words that stand in a window of an item, and the items.

    Columns: doc_id, n_words, n_hit (words inside any occurrence of a window),
    n_items and item_ids (distinct items with such, sorted as strings),
    contaminated (n_hit > 0), n_near (items with a proximity match). Null and
    empty texts have no words; equal rows give equal rows; a null item_id is an
    item whose id reads as empty text; equal items are found together. Empty
    tables of either kind give rows without hits, or none. The hits of a text
    and its item ids are gathered by row, so the largest group is what the
    longest text holds.
    """
    index, of_items, phrases, near = find_items(docs, items, words, slop)
    named = of_items.select("window", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    spans = phrases.groupBy("row", "start").agg((F.col("start") + F.max("length")).alias("end"))
    covered = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(covered), F.lit(0)))))
    hits = new.groupBy("row").agg(F.sum("new").alias("n_hit"))
    held = phrases.select("row", "window").distinct().join(named, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    close = near.select("row", "window").distinct().join(named, "window").groupBy("row").agg(F.count_distinct("item").alias("n_near"))
    texts = index.where("term IS NULL").select("row", "doc_id", "n_words")
    joined = texts.join(hits, "row", "left").join(held, "row", "left").join(close, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
