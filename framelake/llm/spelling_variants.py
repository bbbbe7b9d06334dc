"""Spelling variants: words at distance one, found by their shared deletions, and the commoner form that each follows.

Every word emits itself and its single deletions as keys. Two words of one
length are at distance one exactly if they share a deletion at the same place
(the place that was replaced); two words whose lengths differ by one are so
exactly if one is a deletion of the other. So the shared key together with the
place is the exact test: what meets there needs no comparison letter by letter,
and a group is counted without listing its pairs. A group of a key and place
holds at most one word for each letter of the alphabet.

Keys are 124 bits of polynomials over the letters, worked out from running
sums, so that a word of n letters costs n steps and n rows of fixed width,
however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.shared import discard, stored
from framelake.llm.wordhash import mix

#: The letters of runs, and A-Z as a-z.
LETTERS = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A prime under 2^31, so that products fit in 64 bits, and four bases.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_220_703_125, 950_706_376, 742_938_285)

#: Letters whose keys are made at once; a longer word is still worked on whole.
CHUNK_LETTERS = 1 << 17

KEY_DDL = "k1 long, k2 long, place int, first boolean, id long, n long"


def letter_runs(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, run): every maximal run of letters of at least ``least_chars`` in every text, with A-Z as a-z; null texts have none."""
    found = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", UPPER, UPPER.lower()).alias("run"))


def with_dropped_letters(runs: DataFrame, every: int) -> DataFrame:
    """(word): the runs, of which about one in ``every`` lost a letter; which ones follows from doc_id and run alone.

    A known share of known misspellings is what a speller is measured with. A
    null doc_id counts as empty text.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, least_chars: int, least_count: int) -> DataFrame:
    """(word, n) of the words of at least ``least_chars`` code points that occur at least ``least_count`` times."""
    counts = words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % PRIME])
    return out


def _word_keys(ids: np.ndarray, counts: np.ndarray, words: list[str]) -> pa.RecordBatch:
    """The key of each word (place -1) and of each deletion (its place; ``first`` of the places that give the same)."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(letters)) - bounds[owner]
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
    halves = []
    for base in BASES:
        powers = _powers(base, 1 << int(lengths.max(initial=1)).bit_length())
        values = mix(letters.astype(np.uint64) + np.uint64(base)) % PRIME
        sums = np.concatenate([[0], np.cumsum(values * powers[place] % PRIME)]).astype(np.uint64)
        whole = (sums[bounds[1:]] - sums[bounds[:-1]]) % PRIME
        before = sums[:-1] - sums[bounds[owner]]
        after = (sums[bounds[owner + 1]] - sums[1:]) % PRIME * np.uint64(pow(base, -1, PRIME))
        halves.append(np.concatenate([whole, (before % PRIME + after % PRIME) % PRIME]).astype(np.int64))
    every = np.concatenate([np.arange(len(words)), owner])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(halves[0] << 31 | halves[1]),
            pa.array(halves[2] << 31 | halves[3]),
            pa.array(np.concatenate([np.full(len(words), -1), place]).astype(np.int32)),
            pa.array(np.concatenate([np.ones(len(words), bool), first])),
            pa.array(ids[every]),
            pa.array(counts[every]),
        ],
        names=["k1", "k2", "place", "first", "id", "n"],
    )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // CHUNK_LETTERS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if stop > start:
                part = batch.slice(start, stop - start)
                yield _word_keys(part.column("id").to_numpy(), part.column("n").to_numpy(), part.column("word").to_pylist())


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best_id) of the words (id, word, n) that have near words: how many, and the most frequent, of equals the least id.

    Groups are worked on by windows over keys that are hashed evenly; the rows
    of a key are at most the word itself and one for each place and letter.
    """
    keys = words.select("id", "n", "word").mapInArrow(_keys, KEY_DDL)
    same_place = Window.partitionBy("k1", "k2", "place").orderBy(F.col("n").desc(), "id")
    whole_place = same_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same_key = Window.partitionBy("k1", "k2")
    this = F.struct(F.col("n"), (-F.col("id")).alias("i"))
    replaced = keys.select(
        "*",
        (F.count(F.lit(1)).over(whole_place) - 1).alias("_others"),
        F.first(this).over(whole_place).alias("_best"),
        F.nth_value(this, 2).over(whole_place).alias("_second"),
    )
    is_word, deletion = F.col("place") == -1, (F.col("place") >= 0) & F.col("first")
    met = replaced.select(
        "id",
        "n",
        "_others",
        F.when(F.col("_best.i") == -F.col("id"), F.col("_second")).otherwise(F.col("_best")).alias("_replaced"),
        is_word.alias("_is_word"),
        deletion.alias("_deletion"),
        F.max(F.when(is_word, this)).over(same_key).alias("_word"),
        F.max(F.when(deletion, this)).over(same_key).alias("_longer"),
        F.count(F.when(deletion, 1)).over(same_key).alias("_n_longer"),
    )
    inserted = F.when(F.col("_is_word"), F.col("_n_longer")).when(F.col("_deletion") & F.col("_word").isNotNull(), 1).otherwise(0)
    other = F.when(F.col("_is_word"), F.col("_longer")).when(F.col("_deletion"), F.col("_word"))
    found = met.select("id", (F.col("_others") + inserted).alias("found"), F.greatest(F.col("_replaced"), other).alias("best")).where("found > 0")
    return found.groupBy("id").agg(F.sum("found").alias("n_near"), F.max("best").alias("best")).select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.i")).alias("best_id"))


def follow_to_roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): the end of each chain of forms, by joining each word with the form of its form.

    Chains are followed twice as far in each round. Along a chain counts grow
    tenfold, so there is no ring and the rounds are few.
    """
    reached = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("id").alias("_at"), F.col("root").alias("_further"))
        joined = reached.join(further, reached.root == further._at, "left")
        before, reached = reached, stored(joined.select("id", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")), "roots")
        discard(before)
        if reached.where("moved").limit(1).isEmpty():
            return reached.select("id", "root")


def spelling_variants(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """Every word of ``counts`` (word, n) with its near words, the form it is a variant of and the root of its forms.

    Columns: word, form, root, n, n_near, form_n. Near words differ by exactly
    one inserted, deleted or replaced code point. ``form`` is the near word of
    largest n (of equals the first in code-point order) if its n is at least
    ``ratio`` times the word's, else null; ``root`` follows forms to the last.
    ``ratio`` is at least 2. Words are distinct and not null; an empty table
    gives an empty one.
    """
    # Numbers in the order of the words stand for them from here on: ties need no texts.
    words = stored(counts.select("word", "n").orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    near = stored(near_words(words), "near_words")
    named = words.join(near, "id", "left")
    form: Column = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_id"))
    numbered = stored(named.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form_id"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "word_forms")
    with_form = numbered.where("form_id IS NOT NULL")
    roots = follow_to_roots(with_form.select("id", F.col("form_id").alias("form")))
    form_word = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    root_word = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    variants = with_form.join(roots, "id").join(form_word, "form_id").join(root_word, "root").select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = numbered.where("form_id IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return variants.union(alone)
