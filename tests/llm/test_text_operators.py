"""PII, LM scoring, fingerprints and the Jaccard join: brute force and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import components, jaccard_join, lm_scoring, order_minhash, pii, queries, wordhash
from framelake.llm.components import connected_components
from framelake.llm.lattice import Lattice

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en"), (2, "", None), (3, " \n ", "en"), (4, "the same text", "en"), (5, "the same text", "de"), (5, "the same text", "de"), (None, "no id at all here", "en"), (6, "word " * 30_000, "en"), (7, "x" * 100_000, "en"), (8, "Ünï \U0001f600", "en")]
DDL = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DDL).withColumn("n_chars", F.lit("clash")).withColumn("class", F.lit("clash")).withColumn("pii_count", F.lit("clash"))


def empty(spark):
    return spark.createDataFrame([], DDL)


# PII


def luhn(number: str) -> bool:
    digits = [int(c) for c in reversed(number)]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def swap(spark, texts, key="k"):
    rows = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.pii_count for r in rows]


def reference_digits(key: str, kind: str, digits: str) -> str:
    """The permutation of a run of digits, written again in plain Python."""
    key, half = hashlib.sha256(key.encode()).hexdigest(), len(digits) // 2
    sides = [int(digits[:half] or 0), int(digits[half:])]
    sizes = [10**half, 10 ** (len(digits) - half)]
    for i in range(pii.ROUNDS):
        k = i % 2
        move = int(hashlib.sha256(f"{key}|{kind}|{i}|{sides[1 - k]}".encode()).hexdigest()[:15], 16)
        sides[k] = (sides[k] + move) % sizes[k]
    return f"{sides[0]:0{half}d}{sides[1]:0{len(digits) - half}d}"


def test_cards_equal_the_reference_and_stay_valid(spark):
    cards = ["4111111111111111", "5500 0000 0000 0004", "3782-822463-10005", "4111111111111112", "6011111111111117"]
    out, counts = swap(spark, [f"a {c}, b" for c in cards])
    for card, text, n in zip(cards, out, counts, strict=True):
        plain = re.sub(r"\D", "", card)
        new = text[2:-3]
        assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", card)
        if not luhn(plain):
            assert (new, n) == (card, 0)
            continue
        digits = re.sub(r"\D", "", new)
        assert luhn(digits) and digits[:-1] == reference_digits("k", "card", plain[:-1]) and n == 1


def test_equal_values_stay_linked_and_keys_matter(spark):
    texts = ["call +1 (017) 555-7713 now", "again +1 (017) 555-7713!", "at 1999-12-31", "on 31.12.1999", "ip 10.0.0.255 x", "token = \"b44e15e09fd311c3cf31\"", "ssn 123-45-6789", "Und.34@mail7.example.com"]
    one, counts = swap(spark, texts)
    two, _ = swap(spark, texts, "other")
    assert counts == [1] * len(texts) and all(a != b and a != t for a, b, t in zip(one, two, texts, strict=True))
    assert one[0][5:-4] == one[1][6:-1]
    assert one[2][3:] == "-".join(reversed(one[3][3:].split(".")))
    assert all(0 <= int(x) <= 255 for x in one[4][3:-2].split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{20}"', one[5]) and re.fullmatch(r"[A-Z][a-z]{2}\.\d\d@mail7\.example\.com", one[7])
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", one[6])


def test_permutations_are_one_to_one(spark):
    days = spark.range(0, pii.DATE_LEFT * pii.DATE_RIGHT, 7).select(F.expr("date_format(date_add(date'1900-01-01', cast(id as int)), 'yyyy-MM-dd')").alias("text"), F.col("id").alias("doc_id"))
    out = pii.pseudonymize(days, "k")
    assert out.select("text").distinct().count() == days.count() and out.where("pii_count = 0").count() <= 3
    areas = spark.range(100, 800).select(F.concat("id", F.lit("-45-6789")).alias("text"), F.col("id").alias("doc_id"))
    assert pii.pseudonymize(areas, "k").select("text").distinct().count() == 700


def test_secrets_of_letters_and_of_any_length(spark):
    word, long = "abcdefghijklmnopqrst", "Ab0_" * 400
    texts = [f'password = "{word}"', f'password = "{word}" 1', f'API_KEY: "{word}"', f"secret='{long}'", f"token = '{'x' * 513}'"]
    out, counts = swap(spark, texts)
    assert counts == [1] * len(texts) and all(word not in t for t in out) and out[0][:32] == out[1][:32]
    assert re.fullmatch(r"secret='([A-Z][a-z]\d_){400}'", out[3]) and out[3] != texts[3] and out[4] != texts[4]


def test_a_phone_has_one_pseudonym_in_all_spellings(spark):
    spelt = [("+15551234567", "+1 555 123 4567", "+1 (555) 123-4567"), ("+35312345678", "+353 1 234 5678"), ("+4930123456", "+49 (30) 123456"), ("+79161234567", "+7 916 123 45 67"), ("+442079460958", "+44 20 7946 0958"), ("+2902345678", "+290 234 5678")]
    out, _ = swap(spark, [f"a {p}, b" for group in spelt for p in group])
    digits = iter(re.sub(r"\D", "", text) for text in out)
    for group in spelt:
        got = {next(digits) for _ in group}
        assert len(got) == 1
        code = {"1": 1, "3": 3, "4": 2, "7": 1, "2": 3}[group[0][1]]
        new, old = got.pop(), group[0][1:]
        assert new[:code] == old[:code] and new[code:] != old[code:]


def test_phones_are_permuted_among_those_of_their_length(spark):
    numbers = [f"+1{n:07d}" for n in range(0, 10_000_000, 20_011)]
    out, _ = swap(spark, [f"a {p}, b" for p in numbers])
    assert len(set(out)) == len(numbers) and all(re.fullmatch(r"a \+1\d{7}, b", t) for t in out)


def test_phones_of_several_countries(spark):
    phones = ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "+33 (0)1 23 45 67 89", "+49 (0)30 123456", "+49 (0) 30 1234567", "+49 176 12345678", "+44 20 7946 0958", "+32 2 123 45 67", "+14155552671", "+1 (415) 555-2671", "+45 12 34 56 78", "+91 98765 43210", "+353-1-234-5678", "+33123456789", "+290 2345", "+1234567890123456"]
    out, counts = swap(spark, [f"a {p}, b" for p in phones])
    for phone, text, n in zip(phones, out, counts, strict=True):
        new = text[2:-3]
        assert n == 1 and new != phone and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", phone), (phone, text)
        # All of the number is taken, so its last group moves with the rest.
        assert pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first().pii_count == 1
    assert out[0][5:-3].replace(" ", "") == out[13][5:-3]
    (dated,), _ = swap(spark, ["+33 1 23 45 67 89 2020-02-29"])
    assert dated[:17] == out[0][2:-3] and re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", dated[18:])
    clean = ["+1.5 2.5 3.5 4.5", "+1 2 3 4 5 6 7 8", "+123456", "+1 + 22 + 333 + 4444"]
    assert swap(spark, clean) == (clean, [0] * len(clean))


def test_days_of_all_years_move(spark):
    days = spark.range(0, 3_652_425, 101).select(F.expr("date_format(date_add(date'0000-01-01', cast(id as int)), 'yyyy-MM-dd')").alias("text"), F.col("id").alias("doc_id"))
    out = pii.pseudonymize(days, "k").cache()
    assert out.select("text").distinct().count() == days.count() and out.where("pii_count = 0").count() <= 5
    assert out.where("date_format(try_to_timestamp(text, 'yyyy-MM-dd'), 'yyyy-MM-dd') = text").count() == days.count()
    near = lambda c: F.col(c).between("1900-01-01", "2100-05-01")
    both = out.join(days.withColumnRenamed("text", "old"), "doc_id")
    assert both.where(near("text") != near("old")).count() == 0
    assert swap(spark, ["1899-12-31", "31.12.2345", "12/13/1850"])[1] == [1, 1, 1]


def test_clean_and_odd_texts_stay(spark, odd):
    clean = ["version 2.0.1 of 2024", "300.1.1.1", "666-12-1234", "2020-02-30", "1234567", "a@b", "x 12-34 (5)"]
    assert swap(spark, clean) == (clean, [0] * len(clean))
    rows = pii.pseudonymize(odd, "k").collect()
    assert sorted(map(str, (r.text for r in rows))) == sorted(map(str, (r[1] for r in ODD))) and {r.pii_count for r in rows} == {0}
    assert pii.pseudonymize(empty(spark), "k").count() == 0


# LM scoring


def test_lattice_equals_plain_recursion():
    rng = random.Random(4)
    pieces = tuple({bytes([b]) for b in b" abc"} | {b" " * rng.randint(0, 1) + bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(30)})
    lattice = Lattice(pieces)
    scores = np.log(np.random.default_rng(0).dirichlet(np.ones(len(lattice))))
    of = {pieces[i]: s for i, s in zip(lattice.ids, scores, strict=True)}
    words = [bytes(rng.choices(b"abc", k=rng.randint(1, 9))) for _ in range(100)]

    def ways(word: bytes):
        if not word:
            yield 0.0, []
        for end in range(1, len(word) + 1):
            if word[:end] in of:
                for p, rest in ways(word[end:]):
                    yield of[word[:end]] + p, [word[:end], *rest]

    got = lattice.log_probability(words, scores)
    uses = lattice.expected_counts(words, np.ones((len(words), 1)), scores)[:, 0]
    want: Counter = Counter()
    for word, logp in zip(words, got, strict=True):
        cuts = list(ways(b" " + word))
        total = sum(math.exp(p) for p, _ in cuts)
        assert math.isclose(math.log(total), logp, rel_tol=1e-9)
        for p, cut in cuts:
            for piece in cut:
                want[piece] += math.exp(p) / total
    assert np.allclose(uses, [want[pieces[i]] for i in lattice.ids], rtol=1e-4, atol=1e-4)
    assert lattice.log_probability([b"z"], scores)[0] == -np.inf


def test_long_words_take_runs_of_positions(monkeypatch):
    """A long word is scored and used as in a table, and a very long one of random bytes in seconds."""
    import time

    from framelake.llm import lattice as module

    rng = random.Random(4)
    pieces = tuple({bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(60)} | {b"a", b"b", b"c", b" ", b" a", b" ab", b"abcabcabcabcabc"})
    lattice, words = Lattice(pieces), [bytes(rng.choices(b"abc", k=n)) for n in (9, 40, 90, 300)] + [b"abc" * 60, b"ax"]
    scores, weights = np.log(np.random.default_rng(2).dirichlet(np.ones(len(lattice)), 2).T), np.random.default_rng(3).random((len(words), 2))
    want, uses = lattice.log_probability(words, scores), lattice.expected_counts(words, weights, scores[:, 0])
    monkeypatch.setattr(module, "LONG_BYTES", 20)
    monkeypatch.setattr(module, "RUN_BYTES", 16)
    assert np.allclose(lattice.log_probability(words, scores), want) and np.allclose(lattice.expected_counts(words, weights, scores[:, 0]), uses, rtol=1e-4)
    monkeypatch.undo()
    whole = Lattice(tuple({bytes([k]) for k in range(256)} | {bytes(rng.choices(b"abcdefgh", k=rng.randint(2, 5))) for _ in range(5_000)}))
    began = time.time()
    assert np.isfinite(whole.log_probability([bytes(rng.choices(b"abcdefghijklmnop", k=200_000))], np.full(len(whole), -8.0))).all()
    assert time.time() - began < 20


def test_base_scores_and_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    end = object()
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), end] for r in docs}
    counts = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    rows = queries.op2_lm_scoring(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(own), sum(counts[t] > 0 for t in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_rare_words_take_the_shuffled_way(spark, monkeypatch):
    pieces = tuple(bytes([b]) for b in range(256)) + (b" the", b" of")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    whole = {r.doc_id: r for r in lm_scoring.score_documents(docs, pieces, "lang").collect()}
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 20)
    for r in lm_scoring.score_documents(docs, pieces, "lang").collect():
        w = whole[r.doc_id]
        assert (r.n_tokens, r.n_known) == (w.n_tokens, w.n_known) and math.isclose(r.score, w.score, rel_tol=1e-9) and math.isclose(r.base_score, w.base_score, rel_tol=1e-9)


def test_word_probabilities_sum_to_at_most_one(spark):
    pieces = (b" ", b"a", b"b", b" a", b"ab")
    rows = [(i, " ".join(random.Random(i).choices(["a", "b", "ab", "ba"], k=6)), "en") for i in range(1, 40)]
    probes = ["".join(w) for n in (1, 2, 3) for w in __import__("itertools").product("ab", repeat=n)]
    probe_rows = [(10_000 + i, w, "en") for i, w in enumerate(probes)]
    held = [(d, w, x) for d, w, x in ((k, w, "en") for (_, w, _), k in zip(probe_rows, (n for n in range(10_000, 30_000) if zlib.crc32(str(n).encode()) % 10 == 0), strict=False))]
    scored = {r.doc_id: r.score for r in lm_scoring.score_documents(spark.createDataFrame(rows + held, DDL), pieces, "lang").collect()}
    # A one-word text is the word and an end, so all of them together stay below one.
    assert 0 < sum(10 ** scored[d] for d, _, _ in held) < 1


def test_lm_edge_cases(spark, odd):
    pieces = tuple(bytes([b]) for b in range(256))
    rows = lm_scoring.score_documents(odd, pieces, "lang").collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert len({r.score for r in rows if r.n_tokens == 4}) == 1
    assert lm_scoring.score_documents(empty(spark), pieces, "lang").count() == 0
    one = spark.createDataFrame([(next(n for n in range(100) if zlib.crc32(str(n).encode()) % 10 == 0), "a b", "en")], DDL)
    r = lm_scoring.score_documents(one, pieces, "lang").first()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, -math.inf)


# Word hashes


def test_word_hashes_tell_words_apart():
    texts = [b"", b"  ", b"one two\x0bONE", b"\x85x\x1cy z", b"tail ", b"x" * (1 << 19) + b" end"]
    hashes, counts = wordhash.word_hashes(*wordhash.joined_bytes(texts))
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    folded, _ = wordhash.word_hashes(*wordhash.joined_bytes([b"One oNE", "Éa éa".encode()]), fold=True)
    assert folded[0] == folded[1] and folded[2] != folded[3]


# Fingerprints


def test_fingerprint_edits_equal_brute_force(spark):
    method = order_minhash.OrderMinHash()
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in queries.op6_order_minhash(spark, SF).collect()}
    assert len(rows) == len(docs)
    prints = dict(zip((d for d, _ in docs), method.fingerprints([t for _, t in docs]), strict=True))
    for k, (doc_id, text) in enumerate(docs):
        next_id, following = docs[(k + 1) % len(docs)]
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        own = method.fingerprints([changed])
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == order_minhash.printed(np.stack([prints[doc_id], own[0]]))
        assert math.isclose(r.near_edited, (prints[doc_id] == own[0]).mean()) and math.isclose(r.near_next, (prints[doc_id] == prints[next_id]).mean())


def test_order_counts_and_likeness_falls_with_edits():
    method, rng = order_minhash.OrderMinHash(size=256), random.Random(0)
    words = [f"w{k}" for k in range(300)]
    half = words[150:] + words[:150]
    near = []
    for edits in (0, 5, 40, 150):
        changed = list(words)
        for k in rng.sample(range(300), edits):
            changed[k] = f"new{k}"
        a, b = method.fingerprints([" ".join(words), " ".join(changed)])
        near.append((a == b).mean())
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.7 and near[3] < 0.4
    a, b = method.fingerprints([" ".join(words), " ".join(half)])
    assert 0.3 < (a == b).mean() < 0.8


def test_fingerprint_edge_cases(spark, odd):
    rows = order_minhash.fingerprint_edits(odd).collect()
    assert len(rows) == len(ODD)
    by_text = {}
    for r in order_minhash.fingerprint(odd).collect():
        by_text.setdefault(dict((i, t) for i, t, _ in ODD)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert order_minhash.fingerprint_edits(empty(spark)).count() == 0
    single = order_minhash.fingerprint_edits(spark.createDataFrame([(1, "abcdef", "en")], DDL)).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


# Jaccard join


def brute_components(rows, words, percent):
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    root[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def brute_links(rows, words, percent):
    """(doc_id, class_id, n_links) of every row, and the pairs of classes that are linked, by least id."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    least: dict = {}
    for (doc_id, _), own in zip(rows, sets, strict=True):
        if doc_id is not None:
            least[own] = min(least.get(own, doc_id), doc_id)
    alike = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    counts = [sum(alike(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    distinct = sorted(set(sets), key=lambda x: least.get(x, -1))
    pairs = [(least.get(a), least.get(b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if alike(a, b)]
    return sorted(((d, least.get(s) if s else d, n) for (d, _), s, n in zip(rows, sets, counts, strict=True)), key=str), sorted(pairs)


def near_copies(seed, groups, copies, length, most):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, most)):
                text[rng.randrange(length)] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows) + 1, " ".join(text)))
    return rows


@pytest.mark.parametrize("paired", [32, 3])
def test_components_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(jaccard_join, "PAIRED_CLASSES", paired)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(jaccard_join, "TABLE_COLUMNS", 50)
    rows = near_copies(1, 4, 40, 90, 6) + [(None, None), (900, ""), (901, " "), (902, "Two Words"), (903, "two words"), (904, "two words")]
    rows += [(1_000 + n, text) for n, text in near_copies(2, 2, 40, 200, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)
    counts, pairs = brute_links(rows, 4, 85)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == counts
    assert len(pairs) > 100 and sorted((r.a, r.b) for r in jaccard_join.jaccard_links(docs).collect()) == pairs


def test_components_on_the_supplied_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op8_jaccard_join(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute_links(rows, 4, 85)[0]


def test_jaccard_edge_cases(spark, odd):
    rows = jaccard_join.jaccard_components(odd).collect()
    want = brute_components([r[:2] for r in ODD], 4, 85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == want
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=str) == brute_links([r[:2] for r in ODD], 4, 85)[0]
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    assert jaccard_join.jaccard_links(empty(spark)).count() == 0
    kept = jaccard_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "2", "3", "4", "6", "7", "8", "None"]
    assert jaccard_join.keep_one_of_each(empty(spark)).count() == 0


def test_repeated_rows_and_ids_keep_one(spark):
    rows = [(7, "one two three four five")] * 3 + [(7, "another text of some words"), (9, "ONE two three four five"), (None, "third text that has no id")] + [(None, "third text that has no id")]
    got = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[3], rows[5]], key=str)


def test_many_texts_that_share_rare_tokens_and_are_not_alike(spark, monkeypatch):
    """A rare passage in many texts: all hold its tokens in their prefixes, and few are alike."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 256)
    rng = random.Random(5)
    passage = " ".join(f"rare{k}" for k in range(6))
    common = [f"w{k}" for k in range(12)]
    rows = [(n, f"{passage} " + " ".join(rng.choice(common) for _ in range(40))) for n in range(2_000)]
    rows += [(2_000 + n, rows[n][1] + " more") for n in range(0, 2_000, 400)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {n: n for n, _ in rows} | {2_000 + n: n for n in range(0, 2_000, 400)}
    assert {r.doc_id: r.component_id for r in got} == want


def test_sets_are_sent_only_where_maps_of_bits_allow_a_link(spark, monkeypatch):
    """Many texts that share rare tokens and are not alike: their maps tell them apart, so no sets are sent for the tokens."""
    sent, described = [], jaccard_join._described

    def counted(*args):
        found = described(*args)
        sent.append(found.count() if "tokens" in args[4] else 0)
        return found

    monkeypatch.setattr(jaccard_join, "_described", counted)
    rng = random.Random(6)
    passage = " ".join(f"rare{k}" for k in range(6))
    rows = [(n, f"{passage} " + " ".join(rng.choice("abcdefghijkl") for _ in range(40))) for n in range(300)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc_id == r.component_id and r.n_links == 0 for r in got)
    assert sum(sent) < 30


def test_maps_between_blocks_and_forest():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 40, n)).astype(np.uint64) for n in (0, 3, 10, 17, 60, 64, 70)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 1 << 40, 1).astype(np.uint64)])) for s in sets[1:]] + sets[1:]
    bits, sizes = [jaccard_join.bits_of(s) for s in sets], np.array([len(s) for s in sets])
    got = jaccard_join.may_link([np.frombuffer(b, np.uint8) for b in bits], sizes, [np.frombuffer(b, np.uint8) for b in bits[3:]], sizes[3:], np.ones((len(sets), len(sets) - 3), bool), 85)
    fit = lambda a, b: 100 * min(a, b) >= 85 * max(a, b)
    assert got.tolist() == [[fit(n, m) and jaccard_join.may_be_alike(a, int(n), b, int(m), 85) for b, m in zip(bits[3:], sizes[3:], strict=True)] for a, n in zip(bits, sizes, strict=True)]
    joined = rng.random((30, 40)) < 0.03
    reach = lambda pairs: {frozenset(c) for c in _joined([(x, 100 + y) for x, y in zip(*pairs, strict=True)])}
    rows, columns = jaccard_join.forest(joined)
    assert joined[rows, columns].all() and reach((rows, columns)) == reach(np.nonzero(joined))
    assert len(rows) == sum(len(c) - 1 for c in reach((rows, columns)))


def _joined(pairs):
    groups: list[set] = []
    for pair in pairs:
        near = [g for g in groups if g & set(pair)]
        groups = [g for g in groups if not g & set(pair)] + [set(pair).union(*near)]
    return groups


def test_shared_counts():
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 40, 20)).astype(np.uint64) for _ in range(n)] for n in (7, 5))
    assert jaccard_join.shared_counts(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_connected_components_on_a_path(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_of_components_shrink_to_the_nodes(spark, monkeypatch):
    """A group whose nodes are all linked with the same twenty: only the first table of edges holds all links."""
    sizes, stored = [], components.stored

    def counted(df, name):
        table = stored(df, name)
        sizes.extend([table.count()] if name == "edges" else [])
        return table

    monkeypatch.setattr(components, "stored", counted)
    links = [(k, 20 + n) for n in range(300) for k in range(20)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(k, 0) for k in range(320)]
    assert sizes[0] == len(links) and len(sizes) > 1 and max(sizes[1:]) < 320


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(450)]
    want = {node: min(group) for group in _joined([x for x in links if x[0] != x[1]]) for node in group}
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_tokens_of_the_same_classes_give_the_same_pairs(spark):
    """The pairs that join classes do not depend on the order in which rows arrive."""
    rng = random.Random(4)
    bits = jaccard_join.bits_of(np.arange(30, dtype=np.uint64))
    members = [(token, c, c, 40) for token in range(6) for c in rng.sample(range(40), 40)]
    maps = spark.createDataFrame([(c, 30, bits) for c in range(40)], "class long, size long, bits binary")
    pairs = jaccard_join._maybe_linked(spark.createDataFrame(members, "shared_by long, class long, component long, held_by long").coalesce(1), maps, jaccard_join.Shingles())
    assert pairs.count() == 6 * pairs.distinct().count()
