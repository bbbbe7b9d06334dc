"""LM scoring: documents under a unigram model of subwords, over all segmentations.

The pieces are those of an existing vocabulary. Their scores start from their
ranks there and are re-estimated once from all training words, each split over
all its segmentations. A word's probability discounts its own count, per class
of documents, and leaves the rest to its lattice; a document's is the product
over its words and its end, summed over the classes.

Only words go over the network: counts per word, and of the rare words that
each document holds. The frequent words, of which there can only be a fixed
number, are sent to every task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.lattice import lattice_of
from framelake.llm.shared import row_chunks, stored

#: Document classes of the mixture, the last for all that are not among the most frequent.
CLASSES = 6

#: At most so many words are sent to every task: those of at least one in HEAD_WORDS tokens.
HEAD_WORDS = 300_000

#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 1_000_000

#: Added to every count in the base model.
BASE_ADDED = 0.1

#: Weight of all classes' scores in those of each class.
SHARED_SCORES = 0.05

#: Expected uses that every piece has at least.
LEAST_USES = 1e-3


def _count_words(docs: DataFrame, classes: int) -> DataFrame:
    """word and its training counts c0.. per class; words of held-out documents alone have zeros. docs: text, class, learn."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(classes)]
        others: set[bytes] = set()

        def flushed() -> pa.RecordBatch:
            words, kinds, numbers = [], [], []
            for k, counted in enumerate(counts):
                words += counted.keys()
                kinds += repeat(k, len(counted))
                numbers += counted.values()
            rest = [w for w in others if not any(w in counted for counted in counts)]
            out = pa.RecordBatch.from_arrays([pa.array(words + rest, pa.binary()), pa.array(kinds + [0] * len(rest), pa.int32()), pa.array(numbers + [0] * len(rest), pa.int64())], names=["word", "class", "n"])
            for counted in counts:
                counted.clear()
            others.clear()
            return out

        for batch in row_chunks(batches):
            for text, k, learn in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                words = (text or "").encode().lower().split()
                if learn:
                    counts[k].update(words)
                else:
                    others.update(words)
            if sum(map(len, counts)) + len(others) > COUNTED_WORDS:
                yield flushed()
        yield flushed()

    found = docs.select("text", "class", "learn").mapInArrow(count, "word binary, class int, n long")
    return found.groupBy("word").agg(*(F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(classes)))


@dataclass
class WordModel:
    """Figures of the training text; arrays run over the classes."""

    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_documents: np.ndarray
    discounts: np.ndarray
    kept_back: np.ndarray
    discount: float
    kept_back_all: float
    scores: np.ndarray | None = None

    @property
    def documents(self) -> int:
        return int(self.class_documents.sum())

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + BASE_ADDED) / (self.tokens + BASE_ADDED * (self.distinct + 1)))

    def end_score(self) -> np.ndarray:
        """log10 probability of the end per class."""
        return np.log10(self.class_documents / np.maximum(self.class_tokens, 1), where=self.class_documents > 0, out=np.full(len(self.class_documents), -np.inf))

    def word_scores(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 probability per word and class from training counts and the lattice's natural logarithm per class."""
        total = counts.sum(axis=1)
        words = max(self.tokens - self.documents, 1)
        shared = (np.maximum(total - self.discount, 0) / words)[:, None] + self.kept_back_all * np.exp(lattice)
        own = np.maximum(counts - self.discounts, 0) / np.maximum(self.class_tokens - self.class_documents, 1) + self.kept_back * shared
        # The lattice of a very long word is too small for a double: its logarithm is kept instead.
        tiny = own <= 1e-300
        logs = np.log10(np.where(tiny, 1, own))
        far = np.log10(np.maximum(self.kept_back * self.kept_back_all, 1e-300)) + lattice / math.log(10)
        share = 1 - self.class_documents / np.maximum(self.class_tokens, 1)
        return np.where(tiny, far, logs) + np.log10(np.maximum(share, 1e-300))


def _figures(words: DataFrame, classes: list[int]) -> WordModel:
    """The model's figures from counts of the word table; ``classes`` holds the training documents of each class."""
    k = len(classes)
    total = sum((F.col(f"c{i}") for i in range(1, k)), F.col("c0"))
    columns = [*(F.col(f"c{i}") for i in range(k)), total]
    parts: list[Column] = []
    for i, c in enumerate(columns):
        parts += [F.sum(c).alias(f"n{i}"), *(F.count_if(hit).alias(f"{name}{i}") for name, hit in (("v", c > 0), ("once", c == 1), ("twice", c == 2)))]
    r = words.agg(*parts).first()
    n, v, once, twice = (np.array([float(r[f"{name}{i}"] or 0) for i in range(k + 1)]) for name in ("n", "v", "once", "twice"))
    discounts = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
    kept_back = np.where(n > 0, discounts * v / np.maximum(n, 1), 1.0)
    documents = np.array(classes, float)
    return WordModel(int(n[k] + documents.sum()), int(v[k] + (documents.sum() > 0)), n[:k] + documents, documents, discounts[:k], kept_back[:k], float(discounts[k]), float(kept_back[k]))


def _piece_scores(words: DataFrame, pieces: tuple[bytes, ...], shipped, k: int) -> np.ndarray:
    """Natural logarithms of piece probabilities, pieces x classes, re-estimated twice over all training words.

    The first round is common to the classes, the second has their own uses. A
    word weighs as the root of its count, as what is left to the lattice is
    mostly rare words. The driver gets a number per piece and class.
    """
    lattice = lattice_of(pieces)
    scores = -np.log(lattice.ids + 1_000.0)
    scores -= np.log(np.exp(scores).sum())
    counts = [f"c{i}" for i in range(k)]
    total = sum((F.col(c) for c in counts[1:]), F.col("c0"))
    for columns in ([F.sqrt(total)], [F.sqrt(c) for c in counts]):
        weighed = words.where(total > 0).select("word", *(c.alias(f"w{i}") for i, c in enumerate(columns)))
        width, start = len(columns), scores

        def expect(batches: Iterator[pa.RecordBatch], width=width, start=start) -> Iterator[pa.RecordBatch]:
            own = lattice_of(shipped.value)
            uses = np.zeros((len(own), width))
            for batch in row_chunks(batches, 1 << 16):
                uses += own.expected_counts(batch.column(0).to_pylist(), np.stack([batch.column(1 + i).to_numpy() for i in range(width)], axis=1), start)
            at = np.flatnonzero(uses.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(uses[at, i])) for i in range(width))], names=["piece", *(f"u{i}" for i in range(width))])

        names = [f"u{i}" for i in range(width)]
        rows = weighed.mapInArrow(expect, "piece long" + "".join(f", {n} double" for n in names)).groupBy("piece").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        uses = np.full((len(lattice), width), LEAST_USES)
        uses[rows.column("piece").to_numpy()] += np.stack([rows.column(n).to_numpy() for n in names], axis=1)
        shared = uses.sum(axis=1, keepdims=True)
        scores = np.log((1 - SHARED_SCORES) * uses / uses.sum(axis=0) + SHARED_SCORES * shared / shared.sum())
        if width == 1:
            scores = scores[:, 0]
    return scores


def _score_words(words: DataFrame, model: WordModel, shipped, k: int) -> DataFrame:
    """word, n (its training count) and s0.., its log10 probability per class."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(shipped.value)
        for batch in row_chunks(batches, 1 << 16):
            counts = np.stack([batch.column(1 + i).to_numpy() for i in range(k)], axis=1)
            found = model.word_scores(counts, lattice.log_probability(batch.column(0).to_pylist(), model.scores))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.sum(axis=1)), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(k))], names=["word", "n", *(f"s{i}" for i in range(k))])

    return stored(words.select("word", *(f"c{i}" for i in range(k))).mapInArrow(score, "word binary, n long" + "".join(f", s{i} double" for i in range(k))), "scored_words")


def _read_documents(docs: DataFrame, model: WordModel, head: dict[bytes, int], counts: np.ndarray, scores: np.ndarray) -> DataFrame:
    """doc_id, held_out and the sums over a document's frequent words and its end, with its rare words and how often each occurs."""
    k = scores.shape[1]
    shipped = docs.sparkSession.sparkContext.broadcast((head, counts, scores))
    end, end_base = model.end_score(), float(model.base(np.array([model.documents]))[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word, count, score = shipped.value
        base = model.base(count)
        known = count > 0
        for batch in row_chunks(batches):
            rows: list[tuple] = []
            rare_words, rare_counts = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().lower().split()
                at = np.fromiter(map(of_word.get, words, repeat(-1)), np.int64, len(words))
                rare: Counter = Counter()
                if len(at) and at.min() < 0:
                    rare.update(words[i] for i in np.flatnonzero(at < 0).tolist())
                    at = at[at >= 0]
                rows.append((len(words) + 1, int(known[at].sum()) + (model.documents > 0), float(base[at].sum()) + end_base, *(score[at].sum(axis=0) + end).tolist()))
                rare_words.append(list(rare.keys()))
                rare_counts.append(list(rare.values()))
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), *repeat(pa.float64(), k)), strict=False)]
            columns += [pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_counts, pa.list_(pa.int32()))]
            names = ["n_tokens", "n_known", "base_score", *(f"s{i}" for i in range(k)), "rare", "times"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out")), *columns], names=["row", "doc_id", "held_out", *names])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double" + "".join(f", s{i} double" for i in range(k)) + ", rare array<binary>, times array<int>"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return stored(numbered.mapInArrow(read, schema), "read_documents")


def score_documents(docs: DataFrame, pieces: tuple[bytes, ...], class_column: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Training documents are those with crc32(doc_id as text) mod 10 other than
    0, and those without an id. Tokens are the words of the text, A-Z taken as
    a-z, and one end; a null text is empty. ``class_column`` names a column
    whose most frequent values have a word model of their own in the mixture;
    it is looked at in training only. A table without training documents gives
    a base score of 0 for each token and -infinity as score; an empty table
    gives no rows. Repeated rows count and are scored each; other columns are
    ignored.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    named = docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out"), (F.col(class_column).cast("string") if class_column else F.lit(None).cast("string")).alias("_class"))
    learned = named.where("not held_out")
    frequent = learned.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).where("_class is not null").orderBy(F.desc("n"), "_class").limit(CLASSES - 1).collect()
    k = len(frequent) + 1
    kind = F.lit(k - 1)
    for i, r in enumerate(frequent):
        kind = F.when(F.col("_class") == r["_class"], F.lit(i)).otherwise(kind)
    classes = [r["n"] for r in frequent] + [learned.count() - sum(r["n"] for r in frequent)]
    words = stored(_count_words(named.select("text", F.coalesce(kind, F.lit(k - 1)).cast("int").alias("class"), (~F.col("held_out")).alias("learn")), k), "words")
    shipped = spark.sparkContext.broadcast(pieces)
    model = _figures(words, classes)
    model.scores = _piece_scores(words, pieces, shipped, k)
    scored = _score_words(words, model, shipped, k)
    # A word of at least this count: there are at most HEAD_WORDS of them.
    least = max(1, -(-model.tokens // HEAD_WORDS))
    head = scored.where(F.col("n") >= least).toArrow()
    names = [f"s{i}" for i in range(k)]
    table = np.stack([head.column(c).to_numpy() for c in names], axis=1)
    read = _read_documents(named, model, {w: i for i, w in enumerate(head.column("word").to_pylist())}, head.column("n").to_numpy(), table)
    rare = read.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("word"), F.col("t.times").alias("times"))
    tail = scored.where(F.col("n") < least)
    base = F.log10((F.col("n") + BASE_ADDED) / F.lit(model.tokens + BASE_ADDED * (model.distinct + 1)))
    sums = rare.join(tail, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("t_known"), F.sum(F.col("times") * base).alias("t_base"), *(F.sum(F.col("times") * F.col(s)).alias(f"t_{s}") for s in names)
    )
    priors = np.log10((np.array(classes) + 1) / (sum(classes) + k))
    joined = read.drop("rare", "times").join(sums.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    logs = [F.col(s) + F.coalesce(F.col(f"t_{s}"), F.lit(0.0)) + F.lit(float(p)) for s, p in zip(names, priors, strict=True)]
    best = F.greatest(*logs) if k > 1 else logs[0]
    joined = joined.select("*", *(x.alias(f"l_{s}") for x, s in zip(logs, names, strict=True)), best.alias("_best"))
    spread = sum((F.pow(F.lit(10.0), F.col(f"l_{s}") - F.col("_best")) for s in names[1:]), F.pow(F.lit(10.0), F.col("l_s0") - F.col("_best")))
    score = F.when(F.col("_best") > float("-inf"), F.col("_best") + F.log10(spread)).otherwise(F.lit(float("-inf")))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("t_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
    )
