"""One query per operator over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import ann_partitions, fill_in_middle, jaccard_join, kd_shards, lm_scoring, order_minhash, packing, pfair_mix, pii, positional_index, spelling_variants, token_counts, weak_quality


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; FRAMELAKE_TOKENIZERS names a folder of one's own."""
    folder = os.environ.get("FRAMELAKE_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


#: Key of the pseudonyms; FRAMELAKE_PII_KEY holds the one of a production run.
PII_KEY = "framelake"


def pii_key() -> str:
    return os.environ.get("FRAMELAKE_PII_KEY", PII_KEY)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymize(docs, pii_key())


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.vocabulary_pieces(_tokenizer_file("byte_bpe_50k.tiktoken"))
    return lm_scoring.score_documents(_documents(spark, sf_dir), pieces, class_column="lang")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_documents(_documents(spark, sf_dir), shards=16)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.vocabulary_pieces(_tokenizer_file("byte_bpe_50k.tiktoken"))
    return token_counts.count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), pieces).drop("text")


#: Fixed value: how the byte-level vocabularies split a text before merging.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Fixed value: the added tokens of byte_bpe_50k.json.
BYTE_BPE_SPECIAL = (("<|endoftext|>", 50256),)


def document_vocabulary() -> packing.Vocabulary:
    return packing.Vocabulary.read(_tokenizer_file("byte_bpe_50k.tiktoken"), BYTE_BPE_PATTERN, _tokenizer_file("byte_bpe_50k.json"), BYTE_BPE_SPECIAL)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), document_vocabulary())


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(_documents(spark, sf_dir))


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_partitions.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    sizes = pfair_mix.source_sizes(docs)
    return pfair_mix.mix_sources(docs, pfair_mix.root_weights(sizes), sizes).drop("text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weak_quality.classify_quality(_documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "quality_pattern", "quality_label", "quality_score", "quality_keep")


def op11_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling_variants.letter_runs(_documents(spark, sf_dir), least_chars=7)
    counts = spelling_variants.word_counts(spelling_variants.with_dropped_letters(runs, every=31), least_chars=7, least_count=2)
    return spelling_variants.spelling_variants(counts, ratio=10)


def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = positional_index.decontaminate(_documents(spark, sf_dir).select("doc_id", "text"), items, words=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256).alias(f"{name}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_kd_shards": op3_kd_shards,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_order_minhash": op6_order_minhash,
    "op7_learned_partitions": op7_learned_partitions,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_pfair_mix": op9_pfair_mix,
    "op10_quality": op10_quality,
    "op11_symmetric_delete": op11_symmetric_delete,
    "op12_positional_index": op12_positional_index,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op9_pfair_mix": """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(source, '') AS s, md5(concat_ws(chr(1), CAST(doc_id AS VARCHAR), text)) AS k,
         CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS b
  FROM documents),
sizes AS (SELECT s, CAST(sum(b) AS BIGINT) AS b FROM rows_ GROUP BY s),
block AS (SELECT CAST(65536 * pow(2, greatest(0, ceil(log2(sum(b) / 8589934592.0)))) AS BIGINT) AS block FROM sizes),
sources AS (SELECT s, CAST(floor(sqrt(CAST(b AS DOUBLE))) AS BIGINT) AS w, (b + block - 1) // block AS n FROM sizes, block),
lists AS (SELECT list(w ORDER BY s) AS w, list(n ORDER BY s) AS n, list(s ORDER BY s) AS s, CAST(sum(w) AS BIGINT) AS t, count(*) AS c FROM sources),
plan AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS BIGINT) AS i FROM lists
  UNION ALL
  SELECT slot, list_transform(done, lambda v, j: CASE WHEN j = pick THEN v + 1 ELSE v END), pick, done[pick]
  FROM (
    SELECT slot, done, list_sort(list_transform(
      list_filter(open_, lambda j: (done[j] * t) // w[j] <= slot),
      lambda j: struct_pack(d := ((done[j] + 1) * t + w[j] - 1) // w[j], j := j)))[1].j AS pick
    FROM (
      SELECT greatest(slot + 1, list_min(list_transform(open_, lambda j: (done[j] * t) // w[j]))) AS slot, done, open_, w, t
      FROM (SELECT slot, done, w, t, list_filter(range(1, c + 1), lambda j: done[j] < n[j]) AS open_ FROM plan, lists)
      WHERE len(open_) > 0))),
slots AS (SELECT lists.s[pick] AS s, i, slot, (i * t) // w[pick] AS release, ((i + 1) * t + w[pick] - 1) // w[pick] AS deadline FROM plan, lists WHERE pick IS NOT NULL),
placed AS (
  SELECT doc_id, source, s, coalesce(sum(b) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM rows_)
SELECT doc_id, source, CAST(at_ // block AS BIGINT) AS mix_block, CAST(release AS BIGINT) AS mix_release, CAST(deadline AS BIGINT) AS mix_deadline,
       CAST(slot AS BIGINT) AS mix_slot, CAST(at_ % block AS BIGINT) AS mix_offset
FROM placed JOIN block ON true JOIN slots ON slots.s = placed.s AND slots.i = at_ // block
""",
    "op11_symmetric_delete": r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || ':' || run, ''),
      lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(ord(ch) - 64 AS BIGINT)] END))),
    lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS BIGINT)) AS h
  FROM runs, steps),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT w.word, w.n, c.word, c.n FROM words w JOIN cuts c ON c.key = w.word
  UNION
  SELECT c.word, c.n, w.word, w.n FROM words w JOIN cuts c ON c.key = w.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(struct_pack(o := other, m := m) ORDER BY m DESC, other) AS b FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.o END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at_, form AS next_ FROM forms
  UNION ALL
  SELECT chain.word, chain.next_, f.form FROM chain JOIN forms f ON f.word = chain.next_)
SELECT word, form, at_ AS root, n, n_near, form_n FROM forms JOIN chain USING (word) WHERE next_ IS NULL
""",
    "op12_positional_index": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS size_, array_to_string(w[s + 1:s + 10], ' ') AS window_
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, size_, s, array_to_string(w[s + 1:s + size_], ' ') AS window_
  FROM (SELECT r, w, size_, unnest(range(0, len(w) - size_ + 1)) AS s FROM d, (SELECT DISTINCT size_ FROM windows))),
found AS MATERIALIZED (SELECT r, s, places.size_, item FROM places JOIN windows ON places.window_ = windows.window_ AND places.size_ = windows.size_),
hits AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + size_)) AS p FROM found) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r),
tokens AS MATERIALIZED (SELECT r, word, p FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d)),
counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
ranked AS (
  SELECT window_, word, p, row_number() OVER (PARTITION BY window_ ORDER BY n, p) AS k, count(n) OVER (PARTITION BY window_) AS known, count(*) OVER (PARTITION BY window_) AS size_
  FROM (SELECT window_, unnest(string_split(window_, ' ')) AS word, unnest(range(0, size_)) AS p FROM (SELECT DISTINCT window_, size_ FROM windows)) LEFT JOIN counts USING (word)),
pairs AS MATERIALIZED (
  SELECT a.window_, a.word AS lead_, b.word AS other, b.p - a.p AS delta FROM ranked a JOIN ranked b ON a.window_ = b.window_ AND a.k = 1 AND b.k = least(2, a.size_) WHERE a.known = a.size_),
close AS (
  SELECT r, count(*) AS n_near FROM (
    SELECT DISTINCT a.r, item FROM pairs JOIN tokens a ON a.word = lead_ JOIN tokens b ON b.r = a.r AND b.word = other AND abs(b.p - delta - a.p) <= 4 JOIN windows ON windows.window_ = pairs.window_) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hits USING (r) LEFT JOIN held USING (r) LEFT JOIN close USING (r)
""",
    "op13_fill_in_middle": """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM drawn),
cut AS (
  SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
""",
}
