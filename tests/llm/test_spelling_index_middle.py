"""Spelling variants, the positional index and fill-in-the-middle against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import fill_in_middle, positional_index, spelling_variants


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i if ids is None else ids[i], t, 5, "x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, word string, row double")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio):
    rows, forms = {}, {}
    for w, n in counts.items():
        close = [x for x in counts if x != w and near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = (n, len(close))
    root = lambda w: w if forms[w] is None else root(forms[w])
    return sorted((w, forms[w], root(w), n, k, counts[forms[w]] if forms[w] else None) for w, (n, k) in rows.items())


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("aab𝄞") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 2, 20, 25, 300, 4000, 50000]) for _ in range(150)}
    words |= {"z" * 40: 2, "z" * 41: 30, "z" * 42: 500, "z" * 30 + "y" + "z" * 10: 500, "é": 1}
    got = spelling_variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"), ratio=10).collect()
    assert sorted(tuple(r) for r in got) == variants(words, 10)
    assert spelling_variants.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_documents_lose_letters_as_stated(spark):
    rng = random.Random(2)
    letters = "abcdeÀÿ×QZ"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)) for _ in range(12)] + [None, "", "12 ab, é", "ab" * 5000]
    texts += texts[:3]
    ids = [*range(len(texts) - 1), None]
    want = Counter()
    for doc_id, text in zip(ids, texts, strict=True):
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    runs = spelling_variants.letter_runs(documents(spark, texts, ids), least_chars=6)
    got = spelling_variants.word_counts(spelling_variants.with_dropped_letters(runs, every=3), least_chars=6, least_count=2)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n >= 2 and len(w) >= 6}


def test_a_very_long_word_costs_its_length(spark):
    a = "ab" * 100_000
    counts = spark.createDataFrame([(a, 2), (a[:70_000] + "z" + a[70_000:], 40), (a[:500] + "z" + a[501:], 30)], "word string, n long")
    got = {len(r.word): (r.n_near, r.form_n) for r in spelling_variants.spelling_variants(counts).where("n = 2").collect()}
    assert got == {200_000: (2, 40)}


SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def index_words(text):
    return SPLIT.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def decontaminated(texts, items, size, slop):
    windows = {}
    for item, text in items:
        w = index_words(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add("" if item is None else str(item))
    counts = Counter(w for t in texts for w in index_words(t))
    out = []
    for text in texts:
        w = index_words(text)
        hit, found, close = set(), set(), set()
        for window, names in windows.items():
            if not all(counts[x] for x in window):
                continue
            rarest = sorted(range(len(window)), key=lambda i: (counts[window[i]], i))
            a, b = rarest[0], rarest[min(1, len(window) - 1)]
            for i, x in enumerate(w):
                if x == window[a]:
                    if i >= a and tuple(w[i - a : i - a + len(window)]) == window:
                        hit |= set(range(i - a, i - a + len(window)))
                        found |= names
                    if any(y == window[b] and abs(j - (b - a) - i) <= slop for j, y in enumerate(w)):
                        close |= names
        out.append((len(w), len(hit), len(found), sorted(found), bool(hit), len(close)))
    return out


@pytest.mark.parametrize("block_rows", [3, 1_000_000])
def test_decontamination_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(positional_index, "BLOCK_ROWS", block_rows)
    for name in ("term_counts", "build_index", "pair_matches"):
        function = getattr(positional_index, name)
        monkeypatch.setattr(function, "__defaults__", (block_rows,))
    rng = random.Random(3)
    vocabulary = ["a", "the", "é", "x1", "Q", "zz", "日本", "of", "and"]
    prose = lambda n: rng.choice(["", ".", " "]) + "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    texts = [prose(rng.choice([3, 20, 60])) for _ in range(14)] + [None, "", "...", "a " * 200]
    spans = [" ".join(index_words(rng.choice(texts[:14]))[i : i + n]) for i, n in ((2, 6), (0, 9), (5, 4), (1, 12), (3, 2))]
    texts += [*texts[:3], prose(5) + spans[1] + " a " + prose(9)]
    items = [*enumerate(spans), (7, "unseen words only"), (8, None), (9, "..."), (10, "Q"), (None, spans[0]), (11, spans[0]), (11, spans[0]), (12, prose(30)), (13, "a " * 9)]
    got = positional_index.decontaminate(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"), words=4, slop=2)
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated, r.n_near) for r in got.collect()}
    assert len(rows) == len(texts)
    assert [rows[i] for i in range(len(texts))] == decontaminated(texts, items, 4, 2)


def test_decontamination_of_null_ids_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, ["x one two three y", "x one two three y", "one two", None], [None, None, 3, None])
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in positional_index.decontaminate(docs, items).collect())
    assert got == [("3", 2, 0), ("None", 0, 0), ("None", 5, 3), ("None", 5, 3)]
    assert [r.n_hit for r in positional_index.decontaminate(docs, none).collect()] == [0] * 4
    assert positional_index.decontaminate(documents(spark, []), items).count() == 0


def test_phrases_give_places(spark):
    docs = documents(spark, ["b a b c d e", "q"])
    items = spark.createDataFrame([(1, "B c d"), (2, "q")], "item_id long, text string")
    _, _, phrases, near = positional_index.find_items(docs, items, words=3)
    assert sorted((r.start, r.length, r.window) for r in phrases.collect()) == [(0, 1, "q"), (2, 3, "b c d")]
    assert {r.window for r in near.collect()} == {"q", "b c d"}


def cut_plainly(text, units, draws):
    if units == "characters":
        starts = list(range(len(text)))
    elif units == "words":
        starts = [m.start() for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
    else:
        starts = [m.start() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
    n = len(starts)
    ranks = sorted(d % (n + 1) for d in draws)
    return n, [0 if k == 0 else len(text) if k == n else starts[k] for k in ranks]


@pytest.mark.parametrize("units", ["characters", "words", "lines"])
def test_chunks_cut_where_a_scan_does(units):
    rng = random.Random(4)
    texts = ["", "é", "\n", " \n a", "ab\n\ncd", *("".join(rng.choice(["a", "é", "日", "𝄞", " ", "\n", "\t"]) for _ in range(rng.randint(1, 200))) for _ in range(120))]
    for text in texts:
        draws = (rng.randint(0, 1 << 32), rng.randint(0, 1 << 32))
        n, places = cut_plainly(text, units, draws)
        want = (n, *(len(text[:p].encode()) for p in places))
        for chunk in (1, 2, 3, 7, 64, 1 << 16):
            assert fill_in_middle.cut_text(np.frombuffer(text.encode(), np.uint8), draws, fill_in_middle.UNITS[units], chunk) == want


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "é", "日", "𝄞", "<", ">", "P", "S", "M", "\n"]) for _ in range(rng.choice([1, 5, 40]))) for _ in range(150)] + [None, "", "has <M> in it", "日" * 70_000]
    texts += texts[:5]
    ids = [*range(len(texts) - 2), None, None]
    got = fill_in_middle.fill_in_middle(documents(spark, texts, ids)).collect()
    want = []
    for doc_id, text in zip(ids, texts, strict=True):
        text = text or ""
        digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        p, m, s = text[:a], text[a:b], text[b:]
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want.append((doc_id, len(text), "plain", None, None, text, text))
        elif h4 % 100 < 20:
            want.append((doc_id, len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", text))
        else:
            want.append((doc_id, len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", text))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_fill_in_middle_by_words_and_of_nothing(spark):
    rows = fill_in_middle.fill_in_middle(documents(spark, ["one two  three\nfour"] * 3), units="words", plain_percent=0).collect()
    assert {r.n for r in rows} == {4} and all(r.restored == "one two  three\nfour" for r in rows)
    assert fill_in_middle.fill_in_middle(documents(spark, [])).select(F.count("*")).first()[0] == 0
