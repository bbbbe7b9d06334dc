"""Quality classifier, token counts and packing: brute force, held-out accuracy and edge cases."""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from framelake.llm import packing, queries, token_counts, weak_quality

SF = "/root/testdata/sf0.001"

#: Rows that every operator has to bear: nulls, empty, blank, tied, repeated, long; with a clashing extra column.
ODD = [(1, None, "en", "a"), (2, "", None, None), (3, " \n ", "en", "a"), (4, "the same text", "en", "b"), (5, "the same text", "de", "a"), (5, "the same text", "de", "a"), (None, "no id", "en", "a"), (6, "word " * 60_000, "en", "a"), (7, "x" * 200_000, "en", None), (8, "Ünïcödé \U0001f600 <|endoftext|>", "en", "a")]
DDL = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, DDL).withColumn("n_words", F.lit("clash")).withColumn("quality_score", F.lit("clash")).withColumn("sequence_id", F.lit(1))


def empty(spark):
    return spark.createDataFrame([], DDL)


def test_quality_agrees_with_the_labels(spark):
    found = {r.doc_id: r.quality_keep for r in queries.op10_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [found[r.doc_id] for r in labels if r.quality == 1]
    bad = [found[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean(good) > 0.97 and (not bad or np.mean(bad) < 0.2)


def test_features_reach_the_driver_as_arrow(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    collect = type(docs).collect

    def collected(self):
        assert "index_" not in self.columns, "each number would be an object"
        return collect(self)

    monkeypatch.setattr(type(docs), "collect", collected)
    model = weak_quality.QualityModel.fit(docs)
    # The same as from rows of plain lists, in the order of their hash.
    texts = weak_quality._training_texts(docs, weak_quality.TRAIN_DOCUMENTS, docs.count())
    rows = sorted(texts.mapInArrow(weak_quality._feature_batches, "pattern long, index_ array<int>, value array<float>, drawn long").toLocalIterator(), key=lambda r: r.drawn)
    targets = np.array([model.labels.posterior[r.pattern] for r in rows])
    weights, bias = weak_quality.fit_scorer([(np.array(r.index_, np.int64), np.array(r.value)) for r in rows], targets)
    assert len(rows) == docs.count() and (model.weights == weights.astype(np.float32)).all() and model.bias == bias


def test_label_model_finds_the_bad_labeller():
    rng = random.Random(1)
    patterns: dict[int, int] = {}
    for _ in range(4000):
        truth = weak_quality.GOOD if rng.random() < 0.7 else weak_quality.BAD
        votes = []
        for k in range(len(weak_quality.LABELLERS)):
            right = 0.5 if k == 0 else 0.9
            votes.append(weak_quality.ABSTAIN if rng.random() < 0.3 else truth if rng.random() < right else 3 - truth)
        code = weak_quality.pattern_of(votes)
        assert weak_quality.votes_of(code) == votes
        patterns[code] = patterns.get(code, 0) + 1
    model = weak_quality.fit_label_model(patterns)
    values = list(model.accuracies.values())
    assert abs(values[0] - 0.5) < 0.08 and all(abs(v - 0.9) < 0.05 for v in values[1:]) and abs(model.good - 0.7) < 0.05


def test_quality_edge_cases(spark, odd):
    rows = weak_quality.classify_quality(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.quality_score <= 1 for r in rows)
    assert len({r.quality_score for r in rows if r.text == "the same text"}) == 1
    assert weak_quality.classify_quality(empty(spark)).count() == 0
    assert weak_quality.reject_low_quality(odd).columns == odd.columns


# The classifier again, plainly: text by text, in loops and dictionaries.


def plain_profile(text: str) -> dict:
    words = re.findall(rb"[^ \t-\r]+", text.encode())
    n = max(len(words), 1)
    letters = sum(c.isascii() and c.isalpha() or c >= "À" for c in text)
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    return {
        "words": len(words),
        "symbols": (sum(c in "#$%&*|<>{}[]\\^~=_@" for c in text) + text.count("!!")) / n,
        "upper": sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in text) / max(letters, 1),
        "distinct": len(counts) / n**0.8,
        "top": max(counts.values(), default=0) / n,
        "function": sum(w in weak_quality.FUNCTION_WORDS for w in words) / n,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "sentence": n / max(sum(c in ".!?" for c in text), 1),
        "word_length": sum(len(w) for w in words) / n,
        "echoes": max(sum(words[i] == words[i + k] for i in range(len(words) - k)) for k in (1, 2)) / n,
    }


def plain_votes(p: dict) -> list[int]:
    """0 abstains, 1 is bad, 2 is good."""
    short, tiny = p["words"] < 12, p["words"] < 20
    return [
        1 if p["words"] < 2 else 2 if p["words"] >= 40 else 0,
        1 if p["symbols"] > 0.4 else 2 if p["symbols"] < 0.08 else 0,
        1 if p["upper"] > 0.4 else 2 if p["upper"] < 0.15 else 0,
        0 if tiny else 1 if p["distinct"] < 0.3 else 2 if p["distinct"] >= 0.9 else 0,
        0 if short else 1 if p["top"] > 0.25 else 2 if p["top"] < 0.08 else 0,
        0 if short else 1 if p["echoes"] > 0.3 else 2 if p["echoes"] < 0.1 else 0,
        0 if short else 1 if p["function"] < 0.06 else 2 if p["function"] >= 0.15 else 0,
        1 if p["lines"] > 0.5 else 2 if p["lines"] < 0.1 else 0,
        0 if short else 2 if 4 <= p["sentence"] <= 40 else 1,
    ]


def plain_posteriors(votes: list[tuple], rounds: int = 100) -> tuple[dict, float]:
    """Chance of being good, per tuple of votes, by expectation-maximisation over the texts."""
    n = Counter(votes)
    good = {v: (v.count(2) + 1) / (v.count(2) + 3 * v.count(1) + 2) for v in n}
    for _ in range(rounds):
        prior = (sum(n[v] * good[v] for v in n) + 1) / (len(votes) + 2)
        chance = {}
        for k in range(len(votes[0])):
            for c in (0, 1):
                cast = [0.5 + sum(n[v] * (good[v] if c else 1 - good[v]) for v in n if v[k] == vote) for vote in (1, 2)]
                for vote in (1, 2):
                    chance[k, c, vote] = cast[vote - 1] / sum(cast)
        for v in n:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[k, 1, x] / chance[k, 0, x]) for k, x in enumerate(v) if x)
            good[v] = 1 / (1 + math.exp(-odds))
    return good, prior


def plain_features(text: str, p: dict) -> dict[int, float]:
    out: dict[int, float] = {}
    words = re.findall(rb"[^ \t-\r]+", text.encode())
    for word in words:
        if len(word) > 4:
            ends = re.sub(rb"[a-z\x80-\xff]", b"a", word[:2] + word[-3:])
            word = re.sub(rb"[0-9]", b"9", re.sub(rb"[A-Z]", b"A", ends))
        at = zlib.crc32(word) % 65536
        out[at] = out.get(at, 0.0) + 1 / len(words)
    steps = {"words": (2 * math.log2(p["words"] + 1), 48), "symbols": (10 * p["symbols"], 12), "upper": (10 * p["upper"], 11), "distinct": (5 * p["distinct"], 16), "top": (10 * p["top"], 11)}
    steps |= {"function": (12 * p["function"], 13), "lines": (8 * p["lines"], 9), "sentence": (2 * math.log2(p["sentence"] + 1), 32), "word_length": (p["word_length"], 24), "echoes": (10 * p["echoes"], 11)}
    for name, (step, size) in steps.items():
        at = zlib.crc32(f"{name}={min(int(step), size - 1)}".encode()) % 65536
        out[at] = out.get(at, 0.0) + 0.5
    return out


def plain_scorer(rows: list[dict], targets: list[float]) -> tuple[dict, float]:
    """Logistic regression by AdaGrad, feature by feature."""
    weight: dict[int, float] = {}
    square: dict[int, float] = {}
    bias, bias_square = 0.0, 1e-6
    for epoch in range(15):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for batch in np.array_split(order, max(1, len(rows) // 256)):
            gradient: dict[int, float] = {}
            errors = []
            for r in batch:
                z = bias + sum(weight.get(f, 0.0) * v for f, v in rows[r].items())
                errors.append(1 / (1 + math.exp(-z)) - targets[r])
                for f, v in rows[r].items():
                    gradient[f] = gradient.get(f, 0.0) + errors[-1] * v / len(batch)
            for f, g in gradient.items():
                g += 1e-4 * weight.get(f, 0.0)
                square[f] = square.get(f, 1e-6) + g * g
                weight[f] = weight.get(f, 0.0) - 0.5 * g / math.sqrt(square[f])
            g = sum(errors) / len(errors)
            bias_square += g * g
            bias -= 0.5 * g / math.sqrt(bias_square)
    return weight, bias


def test_quality_equals_a_plain_rewrite(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text or "" for r in docs.orderBy(F.xxhash64("doc_id", "text"), "text").select("text").collect()]
    profiles = [plain_profile(t) for t in texts]
    votes = [tuple(plain_votes(p)) for p in profiles]
    good, _ = plain_posteriors(votes)
    features = [plain_features(t, p) for t, p in zip(texts, profiles, strict=True)]
    weight, bias = plain_scorer(features, [good[v] for v in votes])
    want = {}
    for t, v, row in zip(texts, votes, features, strict=True):
        z = bias + sum(weight.get(f, 0.0) * x for f, x in row.items())
        want[t] = (sum(x * 3 ** (8 - k) for k, x in enumerate(v)), good[v], 1 / (1 + math.exp(-z)))
    found = queries.op10_quality(spark, "/root/testdata/sf0.01")
    rows = found.join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        pattern, label, score = want[r.text or ""]
        assert (r.quality_pattern, r.quality_keep) == (pattern, r.quality_score >= 0.5)
        assert abs(r.quality_label - label) < 1e-9 and abs(r.quality_score - score) < 1e-3


def longest_match(word: bytes, pieces: set[bytes], longest: int) -> int:
    n = at = 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return -1
    return n


def test_automaton_equals_longest_match():
    rng = random.Random(2)
    for _ in range(200):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = token_counts.LongestMatch(tuple(pieces))
        for _ in range(30):
            word = bytes(rng.choices(b"abc", k=rng.randint(0, 12)))
            assert automaton.count(word) == longest_match(word, pieces, 5)


def test_token_counts_equal_brute_force(spark, odd):
    pieces = token_counts.vocabulary_pieces(queries._tokenizer_file("byte_bpe_50k.tiktoken"))
    known, longest = set(pieces), max(map(len, pieces))
    for r in token_counts.count_tokens(odd, pieces).collect():
        words = (r.text or "").encode().split()
        assert (r.n_words, r.n_unknown) == (len(words), 0)
        if len(words) < 1000:
            assert r.n_pieces == sum(longest_match(b" " + w, known, longest) for w in words)
    some = token_counts.count_tokens(odd, (b" the", b" ", b"same")).where("doc_id = 4").first()
    assert (some.n_words, some.n_pieces, some.n_unknown) == (3, 4, 1)
    assert token_counts.count_tokens(empty(spark), pieces).count() == 0


def test_histogram_packing_is_sound_and_tight():
    for seed in range(60):
        rng = random.Random(seed)
        capacity = rng.choice([10, 64, 1024])
        counts: dict[int, int] = {}
        for _ in range(rng.randint(0, 300)):
            length = min(capacity, 1 + int(rng.expovariate(3 / capacity)))
            counts[length] = counts.get(length, 0) + 1
        bins = packing.pack_histogram(counts, capacity)
        used: dict[int, int] = {}
        for b in bins:
            assert sum(b.lengths) <= capacity
            for length in b.lengths:
                used[length] = used.get(length, 0) + b.repeats
        assert used == counts
        least = -(-sum(n * k for n, k in counts.items()) // capacity)
        assert sum(b.repeats for b in bins) <= least * 1.15 + 2


def test_best_two_fit_replaces_the_smallest():
    # 6 + 3 leaves 1; the pair 2 + 2 fills the gap of 3 + 1.
    assert packing.pack_histogram({6: 1, 3: 1, 2: 2}, 10)[0] == packing.Bin([6, 2, 2], 1)


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries._tokenizer_file("byte_bpe_50k.json"))
    want = []
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (start, length) in enumerate(packing.piece_bounds(len(ids), capacity)):
            want.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length])))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // capacity) * 1.05 + 1


def test_packing_round_trip(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(queries.op5_packing(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()], 1024)
    check_packing(packing.pack_documents(odd, queries.document_vocabulary(), 64).collect(), [r[:2] for r in ODD], 64)
    assert packing.pack_documents(empty(spark), queries.document_vocabulary()).count() == 0


def test_tokenize_keeps_ids(spark):
    docs = spark.createDataFrame([(1, "one two three " * 10)], "doc_id long, text string")
    rows = packing.tokenize(docs, queries.document_vocabulary(), 8, keep_ids=True).orderBy("piece").collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length for r in rows) and len(rows[-1].ids) == 8


def test_ids_equal_the_default_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries._tokenizer_file("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"  {end}  \n x", f"don't{end}'s 12{end}3", "<|endoftext|", "<|endoftext |>", f"Ü\U0001f600{end}\U0001f600", "\t\n  ", f"x{end}\n\n{end} \u3000y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: list(r.ids) for r in packing.tokenize(docs, queries.document_vocabulary(), keep_ids=True).collect()}
    assert found == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    assert found[0] == [64, 220, 50256, 275, 2]
    runs = ["a" + " " * 1_200_000 + "b\n" + "\n" * 150_000, "x" * 300_000, "é" * 50_000 + " " * 99_999]
    assert [packing.encoded(queries.document_vocabulary(), t) for t in runs] == [tokenizer.encode(t, add_special_tokens=False).ids for t in runs]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    crc = {r.doc_id: r.ids_crc32 for r in queries.op5_packing(spark, str(tmp_path)).collect()}
    assert crc == {k: zlib.crc32(np.array(ids, "<u4")) for k, ids in found.items()}


def test_vocabulary_stays_outside():
    assert os.path.exists(queries._tokenizer_file("byte_bpe_50k.json"))
