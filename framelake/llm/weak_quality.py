"""Quality classifier: overlapping heuristic labellers, a label model, a hashed linear scorer.

Labellers vote good, bad or abstain on each text. Expectation-maximisation over
the counts of vote patterns estimates each labeller's accuracy without any
given label; the posterior of a pattern is the training target of a logistic
scorer on hashed features, which then decides about every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from framelake.llm.shared import Memo, row_chunks

ABSTAIN, BAD, GOOD = 0, 1, 2

#: Documents the linear scorer is fitted on at most.
TRAIN_DOCUMENTS = 8_000

#: Tasks that read these texts.
TRAIN_TASKS = 64

#: Size of the hashed feature space.
FEATURES = 1 << 16

#: Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in """the of and to in is that for it as was with on by be are this or an at from which
    le la les de des et en un une du que est pour par dans sur qui au pas il
    der die und das den von zu mit dem ein eine ist nicht sich auf für des im
    el los las y del se por con para una su al lo como más""".split()
)

#: Bytes that count as symbols, as ends of sentences, as capitals.
SYMBOLS = np.frombuffer(b"#$%&*|<>{}[]\\^~=_@", np.uint8)
SENTENCE_ENDS = np.frombuffer(b".!?", np.uint8)
CAPITALS = np.arange(ord("A"), ord("Z") + 1)
SMALLS = np.arange(ord("a"), ord("z") + 1)

#: Letters outside ASCII start with a byte from here on in UTF-8.
LEAD_BYTE = 0xC3

#: Capitals of Latin-1 as their second byte in UTF-8.
LATIN_CAPITALS = re.compile(rb"\xc3[\x80-\x9e]")

@dataclass(frozen=True)
class TextProfile:
    """What the labellers and the scorer look at."""

    words: int
    letters: float
    symbols: float
    upper: float
    distinct: float
    top: float
    function: float
    repeated_lines: float
    sentence: float
    word_length: float
    echoes: float


def profile(data: bytes, words: list[bytes]) -> TextProfile:
    """``words`` are the words of ``data``. Shares come from one count of its bytes."""
    counts = Counter(words)
    n = max(len(words), 1)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    wide = int(seen[LEAD_BYTE:].sum())
    upper = int(seen[CAPITALS].sum()) + (len(LATIN_CAPITALS.findall(data)) if wide else 0)
    letters = int(seen[CAPITALS].sum() + seen[SMALLS].sum()) + wide
    chars = max(len(data) - wide, 1)
    lines = [x for x in data.split(b"\n") if x]
    return TextProfile(
        words=len(words),
        letters=letters / chars,
        symbols=(int(seen[SYMBOLS].sum()) + data.count(b"!!")) / n,
        upper=upper / max(letters, 1),
        distinct=len(counts) / n**0.8,
        top=max(counts.values(), default=0) / n,
        function=sum(counts[w] for w in FUNCTION_WORDS if w in counts) / n,
        repeated_lines=1 - len(set(lines)) / len(lines) if lines else 0.0,
        sentence=n / max(int(seen[SENTENCE_ENDS].sum()), 1),
        word_length=sum(map(len, words)) / n,
        echoes=max(sum(map(eq, words, words[k:])) for k in (1, 2)) / n,
    )


def _between(value: float, bad_below: float, good_from: float) -> int:
    return BAD if value < bad_below else GOOD if value >= good_from else ABSTAIN


#: Each labeller looks at one side of a text; none is right alone.
LABELLERS: dict[str, Callable[[TextProfile], int]] = {
    "length": lambda p: BAD if p.words < 2 else GOOD if p.words >= 40 else ABSTAIN,
    "symbols": lambda p: BAD if p.symbols > 0.4 else GOOD if p.symbols < 0.08 else ABSTAIN,
    "case": lambda p: BAD if p.upper > 0.4 else GOOD if p.upper < 0.15 else ABSTAIN,
    "variety": lambda p: ABSTAIN if p.words < 20 else _between(p.distinct, 0.3, 0.9),
    "top_word": lambda p: ABSTAIN if p.words < 12 else BAD if p.top > 0.25 else GOOD if p.top < 0.08 else ABSTAIN,
    "echoes": lambda p: ABSTAIN if p.words < 12 else BAD if p.echoes > 0.3 else GOOD if p.echoes < 0.1 else ABSTAIN,
    "function_words": lambda p: ABSTAIN if p.words < 12 else _between(p.function, 0.06, 0.15),
    "lines": lambda p: BAD if p.repeated_lines > 0.5 else GOOD if p.repeated_lines < 0.1 else ABSTAIN,
    "sentences": lambda p: ABSTAIN if p.words < 12 else GOOD if 4 <= p.sentence <= 40 else BAD,
}


def pattern_of(votes: list[int]) -> int:
    """The votes as one number in base 3."""
    code = 0
    for v in votes:
        code = code * 3 + v
    return code


def votes_of(pattern: int, labellers: int = len(LABELLERS)) -> list[int]:
    out = []
    for _ in range(labellers):
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


@dataclass
class LabelModel:
    """Class prior and, per labeller and class, the chances of its votes."""

    good: float
    chances: np.ndarray  # labellers x classes (bad, good) x votes (bad, good)
    posterior: dict[int, float]

    @property
    def accuracies(self) -> dict[str, float]:
        """Chance that a labeller is right where it votes."""
        return {name: float((1 - self.good) * c[0, 0] + self.good * c[1, 1]) for name, c in zip(LABELLERS, self.chances, strict=True)}


def fit_label_model(patterns: dict[int, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over pattern counts; labellers are independent given the class.

    An abstention says nothing about the class. Starts from the share of good
    votes, which also fixes which class is which. No pattern at all gives a
    model without opinion.
    """
    m = len(LABELLERS)
    codes = sorted(patterns)
    votes = np.array([votes_of(c) for c in codes], dtype=int).reshape(-1, m)
    weight = np.array([patterns[c] for c in codes], dtype=float)
    goods, bads = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    posterior = (goods + 1.0) / (goods + 3.0 * bads + 2.0)
    cast = np.stack([votes == BAD, votes == GOOD], axis=2).astype(float)
    prior, chances = 0.5, np.full((m, 2, 2), 0.5)
    for _ in range(rounds):
        classes = np.stack([1 - posterior, posterior]) * weight
        prior = (classes[1].sum() + 1) / (weight.sum() + 2)
        chances = np.einsum("cp,pmv->mcv", classes, cast) + 0.5
        chances /= chances.sum(2, keepdims=True)
        logs = np.einsum("pmv,mcv->cp", cast, np.log(chances)) + np.log([[1 - prior], [prior]])
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return LabelModel(float(prior), chances, dict(zip(codes, posterior.tolist(), strict=True)))


#: Bytes to the class that an outline shows: capital, other letter, digit, or the byte itself.
OUTLINE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in range(256))

def word_feature(word: bytes) -> int:
    """Words of up to four bytes stand for themselves, longer ones for the outline of their ends (Aa-a., aa-!!)."""
    return zlib.crc32(word if len(word) <= 4 else (word[:2] + word[-3:]).translate(OUTLINE)) % FEATURES


def _step(name: str, size: int) -> list[int]:
    return [zlib.crc32(f"{name}={k}".encode()) % FEATURES for k in range(size)]


#: Per part of the profile: its step, and the hashed feature of each step.
STEPS = [
    (lambda p: 2 * np.log2(p.words + 1), _step("words", 48)),
    (lambda p: 10 * p.symbols, _step("symbols", 12)),
    (lambda p: 10 * p.upper, _step("upper", 11)),
    (lambda p: 5 * p.distinct, _step("distinct", 16)),
    (lambda p: 10 * p.top, _step("top", 11)),
    (lambda p: 12 * p.function, _step("function", 13)),
    (lambda p: 8 * p.repeated_lines, _step("lines", 9)),
    (lambda p: 2 * np.log2(p.sentence + 1), _step("sentence", 32)),
    (lambda p: p.word_length, _step("word_length", 24)),
    (lambda p: 10 * p.echoes, _step("echoes", 11)),
]


class Featurizer:
    """Texts to votes and hashed features; the memo lives as long as the task."""

    def __init__(self):
        self.word = Memo(word_feature)

    def read(self, text: str | None) -> tuple[int, list[bytes], TextProfile]:
        """Vote pattern, words and profile of a text; null counts as empty."""
        data = (text or "").encode()
        words = data.split()
        p = profile(data, words)
        return pattern_of([f(p) for f in LABELLERS.values()]), words, p

    def features(self, words: list[bytes], p: TextProfile) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features with repeats and their weights: each word 1 / n, each step 0.5."""
        index = [*map(self.word.__getitem__, words), *(of[min(int(step(p)), len(of) - 1)] for step, of in STEPS)]
        value = np.full(len(index), 0.5)
        value[: len(words)] = 1 / max(len(words), 1)
        return np.array(index, np.int64), value


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int = 15, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets by mini-batch AdaGrad. No rows give a scorer that keeps all."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not rows:
        return weights, 1.0
    lengths = np.array([len(i) for i, _ in rows])
    ends = np.cumsum(lengths)
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    squares, bias_square = np.full(FEATURES, 1e-6), 1e-6
    batches = max(1, len(rows) // 256)
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for batch in np.array_split(order, batches):
            picks = np.concatenate([np.arange(ends[r] - lengths[r], ends[r]) for r in batch])
            owner = np.repeat(np.arange(len(batch)), lengths[batch])
            i, v = index[picks], value[picks]
            z = np.bincount(owner, weights[i] * v, len(batch)) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets[batch]
            gradient = np.bincount(i, error[owner] * v, FEATURES) / len(batch)
            touched = np.unique(i)
            g = gradient[touched] + ridge * weights[touched]
            squares[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(squares[touched])
            g = error.mean()
            bias_square += g * g
            bias -= rate * g / np.sqrt(bias_square)
    return weights, float(bias)


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of vote patterns per input batch, so that only patterns are shuffled."""
    maker = Featurizer()
    counts: Counter = Counter()
    for batch in row_chunks(batches):
        counts.update(maker.read(x)[0] for x in batch.column(0).to_pylist())
    yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(counts.keys()), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (text, drawn) to vote pattern, hashed features and drawn."""
    maker = Featurizer()
    for batch in row_chunks(batches):
        out: dict[str, list] = {"pattern": [], "index": [], "value": []}
        for x in batch.column(0).to_pylist():
            pattern, words, p = maker.read(x)
            index, value = maker.features(words, p)
            once, at = np.unique(index, return_inverse=True)
            out["pattern"].append(pattern)
            out["index"].append(once.astype(np.int32))
            out["value"].append(np.bincount(at, value).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(out["pattern"], pa.int64()), pa.array(out["index"], pa.list_(pa.int32())), pa.array(out["value"], pa.list_(pa.float32())), batch.column(1)], names=["pattern", "index_", "value", "drawn"])


def _cut(lists: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The lists of a column, none of them null."""
    out: list[np.ndarray] = []
    for chunk in lists.chunks:
        values = chunk.flatten().to_numpy().astype(kind)
        ends = np.cumsum(chunk.value_lengths().to_numpy())
        out += np.split(values, ends[:-1]) if len(ends) else []
    return out


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    @staticmethod
    def fit(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> QualityModel:
        """Label model over all texts; linear scorer on the ``train_documents`` texts of least hash.

        The driver gets at most 3^9 pattern counts and the features of
        ``train_documents`` texts.
        """
        texts = docs.select("text")
        counted = texts.mapInArrow(_vote_batches, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
        patterns = {r.pattern: r.n for r in counted.collect()}
        labels = fit_label_model(patterns)
        total = sum(patterns.values())
        # As Arrow batches: as rows of lists, each number would be an object in the driver's JVM and again in its Python.
        rows = _training_texts(docs, train_documents, total).mapInArrow(_feature_batches, "pattern long, index_ array<int>, value array<float>, drawn long").toArrow()
        # The texts come from several tasks; the scorer depends on their order. Equal hashes are equal rows.
        rows = rows.take(np.argsort(rows.column("drawn").to_numpy(), kind="stable"))
        targets = np.array([labels.posterior[k] for k in rows.column("pattern").to_pylist()])
        weights, bias = fit_scorer(list(zip(_cut(rows.column("index_"), np.int64), _cut(rows.column("value"), np.float64), strict=True)), targets)
        return QualityModel(labels, weights.astype(np.float32), bias)

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with quality_pattern long, quality_label and quality_score double.

        quality_label is the label model's posterior of the text's votes,
        quality_score the linear scorer's probability that the text is good.
        Null texts count as empty; every row and column stays.
        """
        fields = [f for f in docs.schema.fields if f.name.lower() not in QUALITY_COLUMNS]
        kept = docs.select(*[F.col(f"`{f.name}`") for f in fields])
        schema = StructType([*fields, *QUALITY_FIELDS])
        at, labels, weights, bias = kept.columns.index("text"), self.labels, self.weights, self.bias

        def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            maker = Featurizer()
            for batch in row_chunks(batches):
                patterns, scores = [], []
                for x in batch.column(at).to_pylist():
                    pattern, words, p = maker.read(x)
                    index, value = maker.features(words, p)
                    patterns.append(pattern)
                    scores.append(1 / (1 + np.exp(-np.clip(weights[index] @ value + bias, -30, 30))))
                added = [pa.array(patterns, pa.int64()), pa.array([labels.posterior.get(k, labels.good) for k in patterns], pa.float64()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

        return kept.mapInArrow(score_batches, schema)


QUALITY_FIELDS = [StructField("quality_pattern", LongType()), StructField("quality_label", DoubleType()), StructField("quality_score", DoubleType())]
QUALITY_COLUMNS = {f.name for f in QUALITY_FIELDS}

#: A document is kept from this score on.
KEEP_FROM = 0.5


def _training_texts(docs: DataFrame, bound: int, total: int) -> DataFrame:
    """At most ``bound`` texts (text, drawn), those of the least hash, dealt over tasks; the hash first thins out what is sorted."""
    drawn = F.xxhash64("doc_id", "text")
    share = min(1.0, 2.0 * bound / max(total, 1) + 0.001)
    return docs.select("text", drawn.alias("drawn")).where(F.pmod("drawn", F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("drawn", "text").limit(bound).repartition(TRAIN_TASKS, "drawn")


def classify_quality(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS, keep_from: float = KEEP_FROM) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any other columns) with the quality columns and ``quality_keep``.

    A null or empty text is scored as an empty one, which the length labeller
    calls bad. Repeated rows and copies get equal scores. An empty table gives
    an empty result. Columns of ``docs`` named like the quality columns are
    replaced.
    """
    scored = QualityModel.fit(docs, train_documents).score(docs)
    return scored.withColumn("quality_keep", F.col("quality_score") >= keep_from)


def reject_low_quality(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns of ``docs``."""
    kept = classify_quality(docs, train_documents, keep_from).where("quality_keep")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
