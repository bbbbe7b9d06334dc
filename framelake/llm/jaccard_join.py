"""N-gram Jaccard join: prefixes under several global token orders, then exact verification.

Two sets that are alike enough share a token among the first few of each, under
any order of all tokens. In the first order used here a token comes the earlier
the rarer its rarest word is, by a sketch of how often words occur, so few texts
share a prefix token by chance; the other orders are those of hashes, which know
nothing of the first.

1. Texts become sets of shingles; equal sets are one class.
2. Classes that share a token of the first order's prefix are tested against
   one of them, a different one for each token, so work grows with the rows
   and not with the square of a group.
3. What that links forms clusters. Pairs that share a prefix token but lie in
   different clusters are then all tested, so no link between clusters is lost:
   as rows where few classes share the token; where many do, maps of bits are
   tested block against block inside tasks, and whole sets only among classes
   that these maps join. Tokens that the same classes share are one group.

4. Links lie inside components only. To list or count them, the pairs of each
   component of three or more classes go through the filters and the exact test,
   in blocks of bounded size.

Before two sets are fetched or compared they must share a prefix token under
every other order too; maps of bits then tell most pairs that still differ in
too many tokens. Neither filter loses a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.components import connected_components
from framelake.llm.shared import discard, row_chunks, stored
from framelake.llm.wordhash import mix, sequence_hashes, text_bytes, word_hashes

#: Counters of the sketch of word frequencies; its size does not depend on the data.
SKETCH = 1 << 20

#: A token is the level of its rarest word in the upper bits, then bits of its hash.
LEVEL_BITS = 6

#: The level of a word whose counter is at the mean; two levels double it.
MEAN_LEVEL = 24

#: Seeds of the hash orders that filter the candidates of the first order.
ORDERS = (0x51ED270B, 0x2545F491)

#: From this level on, a token's texts are dealt over 2, 4, 8 tasks and so on, two levels each.
HOT_LEVEL = 32

#: Tokens are compared by so many low bytes.
TOKEN_BYTES = 6

#: Least bits for each token in the maps that tell apart what shares its prefixes and is not alike.
BITS = 4

#: Classes that share a token are paired one by one up to this many, block by block beyond.
PAIRED_CLASSES = 32

#: Classes of a block, and tokens that are compared at once between two blocks.
BLOCK_CLASSES = 512
TABLE_COLUMNS = 4096

#: Tokens of a block of a component, unless one set has more.
BLOCK_TOKENS = 4_000_000

#: A class of over this part of all rows is dealt in pieces of that size when its rows are joined; so few are broadcast.
DEALT_CLASSES = 10_000

#: Classes that a worker remembers to have seen.
SEEN_CLASSES = 1_000_000

#: Up to so many candidate documents their ids are sent to every task, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Shingles:
    """Sets of ``words``-word shingles, alike when 100 * shared >= ``percent`` * union."""

    words: int = 4
    percent: int = 85

    def sets(self, column: pa.Array, levels: np.ndarray) -> list[np.ndarray]:
        """Sorted distinct tokens of each text; few words make one shingle, none an empty set."""
        hashes, counts = word_hashes(*text_bytes(column), fold=True)
        level = levels[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)]
        grams = tokens_of(hashes, level, self.words)
        out = []
        end = 0
        for count in counts.tolist():
            start, end = end, end + count
            if count >= self.words:
                found = np.sort(grams[start : end - self.words + 1])
                fresh = np.ones(len(found), bool)
                fresh[1:] = found[1:] != found[:-1]
                out.append(found[fresh])
            else:
                out.append(tokens_of(hashes[start:end], level[start:end], count) if count else np.zeros(0, np.uint64))
        return out

    def prefix_length(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1 if n else 0

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        shared = int((b[at] == a).sum()) if len(b) else 0
        return 100 * shared >= self.percent * (len(a) + len(b) - shared) and shared > 0

    def sizes_fit(self, a: str, b: str):
        return (100 * F.least(a, b) >= self.percent * F.greatest(a, b)).alias("fit")


def class_of(tokens: np.ndarray) -> int:
    """One number for a set: equal for equal sets."""
    if not len(tokens):
        return 0
    total = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total]))[0].astype(np.int64))


def tokens_of(hashes: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
    """A token per run of ``k`` words."""
    n = max(0, len(hashes) - k + 1)
    least = level[:n].copy()
    for j in range(1, k):
        np.minimum(least, level[j : j + n], out=least)
    return (least.astype(np.uint64) << np.uint64(64 - LEVEL_BITS)) | (sequence_hashes(hashes, k) >> np.uint64(LEVEL_BITS))


def first_in_order(tokens: np.ndarray, seed: int, first: int) -> np.ndarray:
    """The first so many tokens in the order of a hash with the seed."""
    if first >= len(tokens):
        return tokens
    return tokens[np.argpartition(mix(tokens ^ np.uint64(seed)), first - 1)[:first]]


def word_levels(docs: DataFrame) -> np.ndarray:
    """The level of each counter of the sketch; SKETCH bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in row_chunks(batches):
            hashes, _ = word_hashes(*text_bytes(batch.column(0)), fold=True)
            np.add.at(total, (hashes & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["counter", "n"])

    counted = docs.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(SKETCH)
    totals[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    relative = np.log2(np.maximum(totals, 1) / max(totals.mean(), 1))
    return np.clip(np.floor(2 * relative) + MEAN_LEVEL, 0, (1 << LEVEL_BITS) - 1).astype(np.uint8)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _classes(docs: DataFrame, shingles: Shingles, levels) -> DataFrame:
    """doc_id, text_hash, n_shingles, class and the first order's prefix array<long> of every document.

    A class that a task has met before has an empty prefix.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in row_chunks(batches):
            sets = shingles.sets(batch.column(2), levels.value)
            classes, prefixes = [class_of(s) for s in sets], []
            for tokens, own in zip(sets, classes, strict=True):
                if own in seen or not len(tokens):
                    prefixes.append(np.zeros(0, np.int64))
                    continue
                if len(seen) >= SEEN_CLASSES:
                    seen.clear()
                seen.add(own)
                prefixes.append(tokens[: shingles.prefix_length(len(tokens))].astype(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), _lists(prefixes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "class", "prefix"])

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return stored(source.mapInArrow(read, "doc_id long, text_hash long, n_shingles long, class long, prefix array<long>"), "classes")


def _described(docs: DataFrame, shingles: Shingles, levels, wanted: DataFrame, columns: dict[str, tuple[str, Callable]], name: str) -> DataFrame:
    """class and, by name, what each of ``columns`` (type, function of cut and sorted sets) makes of its set.

    ``wanted`` holds the doc_id of one document for each class; a class may stand twice.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in row_chunks(batches):
            classes, sets = [], []
            for tokens in shingles.sets(batch.column(0), levels.value):
                own = class_of(tokens)
                if own in seen:
                    continue
                if len(seen) >= SEEN_CLASSES:
                    seen.clear()
                seen.add(own)
                classes.append(own)
                sets.append(np.sort(tokens & np.uint64((1 << 8 * TOKEN_BYTES) - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), *(make(sets, shingles) for _, make in columns.values())], names=["class", *columns])

    ids = stored(wanted.select(F.col("doc_id").alias("_wanted")).distinct(), "wanted")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    texts = source.join(few, source._id.eqNullSafe(few._wanted), "left_semi").select("text")
    found = stored(texts.mapInArrow(read, "class long" + "".join(f", {c} {kind}" for c, (kind, _) in columns.items())), name)
    discard(ids)
    return found


def _prefixes(seed: int) -> Callable:
    """32 bits of each token of a prefix: enough to pass few pairs too many, and none too few."""
    return lambda sets, shingles: _lists([first_in_order(cut, seed, shingles.prefix_length(len(cut))).astype(np.uint32).view(np.int32) for cut in sets], pa.int32())


def bits_of(tokens: np.ndarray) -> bytes:
    """A map with the bit of each token set; its size is a power of two of at least BITS bits a token."""
    size = max(64, 1 << (BITS * len(tokens) - 1).bit_length()) if len(tokens) else 64
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """Whether sets of n and m tokens with these maps can be alike: a bit that only one has is a token that only one has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    # The larger map is folded to the size of the smaller.
    if len(x) > len(y):
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)))
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)))
    lost_n, lost_m = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    shared = min(n - lost_n, m - lost_m)
    return 100 * shared >= percent * (n + m - shared)


def may_link(left: list[np.ndarray], n: np.ndarray, right: list[np.ndarray], m: np.ndarray, maybe: np.ndarray, percent: int) -> np.ndarray:
    """What ``may_be_alike`` says of each on the left with each on the right, among the pairs that ``maybe`` holds."""
    maybe = maybe & (100 * np.minimum(n[:, None], m) >= percent * np.maximum(n[:, None], m))
    out = np.zeros_like(maybe)
    lengths = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    for p in np.unique(lengths[0]):
        for q in np.unique(lengths[1]):
            rows, columns = np.flatnonzero(lengths[0] == p), np.flatnonzero(lengths[1] == q)
            some = maybe[np.ix_(rows, columns)]
            rows, columns = rows[some.any(axis=1)], columns[some.any(axis=0)]
            if not len(rows):
                continue
            least = min(p, q)
            x, y = (np.bitwise_or.reduce(np.stack([side[k] for k in some]).reshape(len(some), -1, least), axis=1) for side, some in ((left, rows), (right, columns)))
            both = np.zeros((len(rows), len(columns)), np.float32)
            for start in range(0, least, TABLE_COLUMNS // 8):
                one, other = (np.unpackbits(z[:, start : start + TABLE_COLUMNS // 8], axis=1).astype(np.float32) for z in (x, y))
                both += one @ other.T
            held_x, held_y = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x, y))
            shared = np.minimum(n[rows][:, None] - held_x[:, None], m[columns] - held_y) + both
            cell = np.ix_(rows, columns)
            out[cell] = maybe[cell] & (100 * shared >= percent * (n[rows][:, None] + m[columns] - shared))
    return out


#: What the filters compare, and what the verification does.
FILTERS = {f"order{k}": ("array<int>", _prefixes(seed)) for k, seed in enumerate(ORDERS, 1)} | {
    "size": ("long", lambda sets, _: pa.array([len(cut) for cut in sets], pa.int64())),
    "bits": ("binary", lambda sets, _: pa.array([bits_of(cut) for cut in sets], pa.binary())),
}
MAPS = {c: FILTERS[c] for c in ("size", "bits")}
TOKENS = {"tokens": ("binary", lambda sets, _: pa.array([cut.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes() for cut in sets], pa.binary()))}


def unpacked(data: bytes) -> np.ndarray:
    """Tokens from TOKEN_BYTES bytes each."""
    wide = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.view("<u8").ravel()


def _filtered(pairs: DataFrame, filters: DataFrame, shingles: Shingles) -> DataFrame:
    """The pairs (a, b) of classes that share a prefix token under every hash order, and whose maps of bits allow it."""
    for side in ("a", "b"):
        pairs = pairs.join(filters.select(F.col("class").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in FILTERS)), side)
    for k in range(1, len(ORDERS) + 1):
        pairs = pairs.where(F.arrays_overlap(f"a_order{k}", f"b_order{k}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches):
            maybe = [may_be_alike(*row, shingles.percent) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(maybe, pa.bool_()))

    kept = pairs.select("a", "b", "a_bits", "a_size", "b_bits", "b_size").mapInArrow(compare, "a long, b long")
    return stored(kept.distinct(), "filtered")


def _verified(pairs: DataFrame, sets: DataFrame, shingles: Shingles) -> DataFrame:
    """The pairs (a, b) of classes that are alike."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches):
            alike = [shingles.alike(unpacked(x), unpacked(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"class": "a", "tokens": "a_tokens"}), "a").join(sets.withColumnsRenamed({"class": "b", "tokens": "b_tokens"}), "b")
    return stored(both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(compare, "a long, b long"), "links")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _dealt(token: str, own: str) -> Column:
    """The token, with the part that a frequent one's class falls in set in its bits; applied again it takes it out."""
    level = F.shiftrightunsigned(token, 64 - LEVEL_BITS)
    parts = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({token}, {64 - LEVEL_BITS}) - {HOT_LEVEL} as int) div 2 + 1)")
    return F.col(token).bitwiseXOR(F.when(level >= HOT_LEVEL, F.shiftleft(F.pmod(F.xxhash64(own), parts), 20)).otherwise(F.lit(0)))


def _postings(classes: DataFrame) -> DataFrame:
    """(token, shared_by, class, n, pivot, pivot_n) of the prefix tokens that more than one class may hold.

    The pivot of a token is its class of the least hash with that token; a
    frequent token has one for each of the tasks that it is dealt over.
    ``shared_by`` is the token of a frequent one, and else stands for the
    classes that hold it, so tokens of the same classes have it in common.
    """
    rows = classes.select("class", F.col("n_shingles").cast("int").alias("n"), F.explode("prefix").alias("token")).select(_dealt("token", "class").alias("token"), "class", "n")
    # Dealt out first: the hashes that the windows go by need not be sent.
    rows = rows.repartition("token")
    by_hash = Window.partitionBy("token").orderBy(F.xxhash64("class", "token"), "class")
    whole = by_hash.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = rows.select(
        "*",
        F.first("class").over(whole).alias("pivot"),
        F.first("n").over(whole).alias("pivot_n"),
        F.last("class").over(whole).alias("_last"),
        F.bit_xor(F.xxhash64("class")).over(whole).alias("_classes"),
        F.lag("class").over(by_hash).alias("_before"),
    )
    hot = F.shiftrightunsigned("token", 64 - LEVEL_BITS) >= HOT_LEVEL
    # Copies that several tasks have met stand next to each other.
    shared = ranked.where(hot | (F.col("pivot") != F.col("_last"))).where("_before is null or _before <> class")
    shared = shared.select(_dealt("token", "class").alias("token"), "_classes", "class", "n", "pivot", "pivot_n")
    return stored(shared.select("token", F.when(hot, F.col("token")).otherwise(F.col("_classes")).alias("shared_by"), "class", "n", "pivot", "pivot_n"), "postings")


def _unsettled(postings: DataFrame, clusters: DataFrame) -> DataFrame:
    """(shared_by, class, n, component, held_by) of what several components share; held_by: by how many classes.

    Of several that the same classes share one is kept.
    """
    members = postings.groupBy("shared_by", "class").agg(F.min("n").alias("n")).join(clusters, F.col("class") == F.col("node"), "left").select("shared_by", "class", "n", F.coalesce("component", "class").alias("component"))
    several = members.groupBy("shared_by").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("held_by"), F.bit_xor(F.xxhash64("class")).alias("_classes")).where("_low < _high")
    several = several.groupBy("held_by", "_classes", "_low", "_high").agg(F.min("shared_by").alias("shared_by")).select("shared_by", "held_by")
    return stored(members.join(several, "shared_by"), "unsettled")


def _across(members: DataFrame, shingles: Shingles) -> DataFrame:
    """Pairs of classes (a, b) of different components in groups of at most PAIRED_CLASSES."""
    groups = members.groupBy("shared_by").agg(F.collect_list(F.struct("class", "component", "n")).alias("m"))
    fit = f"x.class < y.class and x.component <> y.component and 100L * least(x.n, y.n) >= {int(shingles.percent)} * greatest(x.n, y.n)"
    pairs = groups.select(F.explode(F.expr(f"flatten(transform(m, x -> transform(filter(m, y -> {fit}), y -> struct(x.class as a, y.class as b))))")).alias("p"))
    return pairs.select("p.a", "p.b").distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left shares with each on the right."""
    tokens, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    on_left = owner < len(left)
    both = (np.bincount(code[on_left], minlength=len(tokens)) > 0) & (np.bincount(code[~on_left], minlength=len(tokens)) > 0)
    column = (np.cumsum(both) - 1)[code]
    use = both[code]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(both.sum()), TABLE_COLUMNS):
        some = use & (column >= start) & (column < start + TABLE_COLUMNS)
        table = np.zeros((len(left) + len(right), TABLE_COLUMNS), np.float32)
        table[owner[some], column[some] - start] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


def alike_between(left: list[np.ndarray], right: list[np.ndarray], maybe: np.ndarray, shingles: Shingles) -> np.ndarray:
    """Which sets on the left are alike to which on the right, among the pairs that ``maybe`` holds.

    Pairs must share a prefix token under each hash order before whole sets are compared.
    """
    a, b = (np.array([len(x) for x in side]) for side in (left, right))
    maybe = maybe & (100 * np.minimum(a[:, None], b) >= shingles.percent * np.maximum(a[:, None], b))
    out = np.zeros_like(maybe)
    rows, columns = np.arange(len(left)), np.arange(len(right))
    for seed in ORDERS:
        rows, columns = rows[maybe[np.ix_(rows, columns)].any(axis=1)], columns[maybe[np.ix_(rows, columns)].any(axis=0)]
        if not len(rows):
            return out
        prefixes = [[first_in_order(side[i], seed, shingles.prefix_length(len(side[i]))) for i in some] for side, some in ((left, rows), (right, columns))]
        maybe[np.ix_(rows, columns)] &= shared_counts(*prefixes) > 0
    rows, columns = rows[maybe[np.ix_(rows, columns)].any(axis=1)], columns[maybe[np.ix_(rows, columns)].any(axis=0)]
    if len(rows):
        shared = shared_counts([left[i] for i in rows], [right[i] for i in columns])
        cell = np.ix_(rows, columns)
        out[cell] = maybe[cell] & (shared > 0) & (100 * shared >= shingles.percent * (a[rows][:, None] + b[columns] - shared))
    return out


def forest(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of as few of the ``joined`` pairs as join the same rows and columns."""
    rows_left, columns_left = (np.ones(n, bool) for n in joined.shape)
    found = []
    for start in np.flatnonzero(joined.any(axis=1)).tolist():
        reached = [start] if rows_left[start] else []
        rows_left[start] = False
        while reached:
            row = reached.pop()
            columns = np.flatnonzero(joined[row] & columns_left)
            columns_left[columns] = False
            for column in columns.tolist():
                more = np.flatnonzero(joined[:, column] & rows_left).tolist()
                rows_left[more] = False
                found += [(row, column), *((other, column) for other in more)]
                reached += more
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def _maybe_linked(members: DataFrame, maps: DataFrame, shingles: Shingles) -> DataFrame:
    """Pairs (a, b) that join all classes of different components that share a token and whose maps of bits allow a link.

    They are found block against block inside tasks, and of the pairs of two
    blocks only as many are returned as join the same classes.
    """
    blocks = members.withColumn("_blocks", F.ceil(F.col("held_by") / F.lit(BLOCK_CLASSES)).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("_blocks")).cast("int"))
    dealt = blocks.select("shared_by", "class", "component", "block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    dealt = dealt.select("shared_by", "class", "component", "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, classes, component, size = (table.column(c).to_numpy() for c in ("block", "class", "component", "size"))
        # In the order of their numbers, so that tokens which the same classes share give the same pairs.
        order = np.argsort(classes)
        left, right = order[block[order] == i], order[block[order] == j]
        apart = component[left][:, None] != component[right][None]
        bits = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        x, y = forest(may_link([bits[k] for k in left], size[left], [bits[k] for k in right], size[right], apart, shingles.percent))
        return pa.table({"a": pa.array(classes[left[x]], pa.int64()), "b": pa.array(classes[right[y]], pa.int64())})

    known = maps.select(F.col("class").alias("_class"), "size", "bits").dropDuplicates(["_class"])
    rows = dealt.join(known, F.col("class") == F.col("_class")).select("shared_by", "i", "j", "block", "class", "component", "size", "bits")
    return stored(rows.groupBy("shared_by", "i", "j").applyInArrow(compare, "a long, b long"), "maybe")


def _blockwise(members: DataFrame, described: Callable, shingles: Shingles) -> DataFrame:
    """Links (a, b) that join all components that are linked among classes that share a token.

    Sets are sent for the classes that maps of bits join, once for each block of
    what they join, and not for each token that a class shares.
    """
    maps = described(members.select("class"), MAPS, "maps")
    maybe = _maybe_linked(members, maps, shingles)
    groups = connected_components(maybe)
    sized = maps.select("class", F.col("size").alias("n"), F.lit(1).cast("long").alias("n_rows")).dropDuplicates(["class"])
    blocks = _component_blocks(groups.select(F.col("node").alias("class"), "component").join(sized, "class"), least=2)
    sets = described(blocks.select("class"), TOKENS, "sets")
    links = _within(blocks, sets, shingles, pairs=True, fewest=True)
    discard(maps, maybe, groups, sets)
    return links


def _component_blocks(linked: DataFrame, least: int = 3) -> DataFrame:
    """slot, i, j, block, component, class, n_rows: the pairs of blocks in which each component's pairs are tested.

    ``linked`` is class, n, n_rows, component; components of fewer than ``least``
    classes are left out. A component takes as many blocks
    as its classes and tokens ask for. Those of one block are put together,
    by hash, in slots of about a block each.
    """
    need = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_CLASSES), F.sum("n") / F.lit(BLOCK_TOKENS))
    sized = linked.groupBy("component").agg(F.count(F.lit(1)).alias("_classes"), need.alias("_need")).where(F.col("_classes") >= least)
    sized = stored(sized.select(F.col("component").alias("_component"), F.ceil("_need").cast("int").alias("_blocks"), "_need"), "component_sizes")
    slots = int(sized.where("_blocks = 1").agg(F.sum("_need")).first()[0] or 0) + 1
    members = linked.join(sized, F.col("component") == F.col("_component"))
    slot = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(slots))).otherwise(F.col("component"))
    members = members.select((F.col("_blocks") > 1).alias("large"), slot.alias("slot"), "component", "class", "n_rows", F.pmod(F.xxhash64("class"), F.col("_blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return members.select("large", "slot", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "component", "class", "n_rows")


def _within(blocks: DataFrame, sets: DataFrame, shingles: Shingles, pairs: bool, fewest: bool = False) -> DataFrame:
    """All links inside the components of ``blocks``, as pairs (a, b), or as class, n_links: rows behind them.

    A class has a count for each of the block pairs that it is in. Where
    ``fewest`` pairs are asked for, only as many are listed as join the same classes.
    """

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.sort_by("component")
        component, block, classes, n_rows = (table.column(c).to_numpy() for c in ("component", "block", "class", "n_rows"))
        packed = table.column("tokens")
        ends = [*np.flatnonzero(component[1:] != component[:-1]) + 1, len(component)]
        one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in zip([0, *ends], ends, strict=False):
            tokens = [unpacked(x) for x in packed.slice(start, end - start).to_pylist()]
            left, right = np.flatnonzero(block[start:end] == i), np.flatnonzero(block[start:end] == j)
            maybe = np.triu(np.ones((len(left), len(right)), bool), 1) if i == j else np.ones((len(left), len(right)), bool)
            if not maybe.any():
                continue
            alike = alike_between([tokens[k] for k in left], [tokens[k] for k in right], maybe, shingles)
            own, near = classes[start:end], n_rows[start:end]
            if pairs:
                x, y = forest(alike) if fewest else np.nonzero(alike)
                a, b = own[left[x]], own[right[y]]
                one.append(np.minimum(a, b))
                other.append(np.maximum(a, b))
            else:
                one += [own[left], own[right]]
                other += [alike @ near[right], near[left] @ alike]
        return pa.table({names[0]: pa.array(np.concatenate(one), pa.int64()), names[1]: pa.array(np.concatenate(other), pa.int64())})

    names = ("a", "b") if pairs else ("class", "n_links")
    known = sets.select(F.col("class").alias("_class"), "tokens").dropDuplicates(["_class"])
    rows = blocks.join(known, F.col("class") == F.col("_class")).select("large", "slot", "i", "j", "block", "component", "class", "n_rows", "tokens")
    return stored(rows.groupBy("large", "slot", "i", "j").applyInArrow(compare, f"{names[0]} long, {names[1]} long"), "within")


def _linked(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """class, n, least, n_rows, component of every class that is linked to another."""
    counted = rows.where("n_shingles > 0").groupBy("class").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    return stored(counted.join(clusters, F.col("class") == F.col("node")).select("class", "n", "least", "n_rows", "component"), "linked")


def _all_links(linked: DataFrame, described: Callable, shingles: Shingles, pairs: bool) -> DataFrame:
    """Every link between different classes, as pairs (a, b) or as class, n_links."""
    both = linked.groupBy("component").agg(F.count(F.lit(1)).alias("_classes"), F.min("class").alias("_a"), F.max("class").alias("_b"), F.sum("n_rows").alias("_rows")).where("_classes = 2")
    if pairs:
        found = both.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    else:
        found = linked.join(both, "component").select("class", (F.col("_rows") - F.col("n_rows")).alias("n_links"))
    blocks = _component_blocks(linked)
    if blocks.isEmpty():
        return found
    sets = described(blocks.select("class"), TOKENS, "sets")
    more = _within(blocks, sets, shingles, pairs)
    discard(sets)
    found = found.union(more)
    return found if pairs else found.groupBy("class").agg(F.sum("n_links").alias("n_links"))


def jaccard_clusters(docs: DataFrame, shingles: Shingles = Shingles()) -> tuple[DataFrame, DataFrame, Callable]:
    """Documents by class, and the exact component of every class that is linked to another.

    The first is doc_id, text_hash, n_shingles, class; the second node,
    component; the third fetches the sets of classes.
    """
    levels = docs.sparkSession.sparkContext.broadcast(word_levels(docs))
    classes = _classes(docs, shingles, levels)
    postings = _postings(classes)
    ids = classes.groupBy("class").agg(F.min("doc_id").alias("doc_id"))

    def described(wanted: DataFrame, columns: dict, name: str) -> DataFrame:
        return _described(docs, shingles, levels, ids.join(wanted.distinct(), "class", "left_semi"), columns, name)

    def tested(pairs: DataFrame) -> DataFrame:
        both = lambda some: some.select(F.col("a").alias("class")).union(some.select("b"))
        filters = described(both(pairs), FILTERS, "filters")
        filtered = _filtered(pairs, filters, shingles)
        discard(filters)
        sets = described(both(filtered), TOKENS, "sets")
        links = _verified(filtered, sets, shingles)
        discard(filtered, sets)
        return links

    near = stored(postings.where("class <> pivot").where(shingles.sizes_fit("n", "pivot_n")).select(*_ordered("class", "pivot")).distinct(), "pairs")
    links = tested(near)
    clusters = connected_components(links)
    members = _unsettled(postings, clusters)
    discard(postings)
    few, many = members.where(F.col("held_by") <= PAIRED_CLASSES), members.where(F.col("held_by") > PAIRED_CLASSES)
    rest = stored(_across(few, shingles).join(near, ["a", "b"], "left_anti"), "pairs")
    discard(near)
    found = [tested(rest)] if not rest.isEmpty() else []
    if not many.isEmpty():
        found.append(_blockwise(many, described, shingles))
    if found:
        for more in found:
            links = links.union(more)
        discard(clusters)
        clusters = connected_components(links)
    discard(members, rest)
    return classes.select("doc_id", "text_hash", "n_shingles", "class"), clusters, described


def _with_class(rows: DataFrame, by_class: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` with what ``by_class`` says of their class (_class), which null and empty texts do not have.

    The rows of one text can be a third of all, so those of frequent classes
    are dealt in pieces. ``counted`` is class, n_rows.
    """
    piece = max(1, rows.count() // DEALT_CLASSES)
    frequent = stored(counted.where(F.col("n_rows") > piece).select(F.col("class").alias("_frequent"), F.ceil(F.col("n_rows") / F.lit(piece)).cast("long").alias("_pieces")), "frequent")
    parts = F.broadcast(frequent)
    dealt = rows.join(parts, F.col("class") == F.col("_frequent"), "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("_pieces")), F.lit(0))).drop("_frequent", "_pieces")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1)).alias("_of")
    copied = by_class.join(parts, F.col("_class") == F.col("_frequent"), "left").select(*by_class.columns, every)
    return dealt.join(copied, (F.col("class") == F.col("_class")) & (F.col("_piece") == F.col("_of")) & (F.col("n_shingles") > 0), "left")


def jaccard_components(docs: DataFrame, shingles: Shingles = Shingles()) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of every row of ``docs``.

    component_id is the least doc_id that links reach, class_id the least with
    an equal set, and n_links the number of other rows that the row itself is
    linked with: those of equal sets and of sets that are alike. Texts are
    compared by their sets, so rows with one id and different texts are told
    apart, and rows without an id link others but are nobody's least id. A null
    or empty text has no shingles, its own id as component and class, and no
    links; equal sets are linked without being paired. An empty table gives no
    rows; other columns are ignored.
    """
    rows, clusters, described = jaccard_clusters(docs, shingles)
    linked = _linked(rows, clusters)
    links = _all_links(linked, described, shingles, pairs=False)
    by_component = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = linked.join(by_component, "component").join(links, "class").select(F.col("class").alias("_linked"), "component_id", "n_links")
    counted = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_rows"))
    by_class = counted.join(reached, F.col("class") == F.col("_linked"), "left").select(
        F.col("class").alias("_class"),
        "class_id",
        F.when(F.col("_linked").isNull(), F.col("class_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("n_rows") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )
    joined = _with_class(rows, by_class, counted)
    own = F.col("n_shingles") > 0
    return joined.select(
        "doc_id",
        "n_shingles",
        F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def jaccard_links(docs: DataFrame, shingles: Shingles = Shingles()) -> DataFrame:
    """Every link between different sets as one row (a, b), by the least doc_ids of the two.

    With class_id of ``jaccard_components`` these are all links: rows of one
    class are linked with each other and with all rows of a linked class.
    Classes without any id have null; null and empty texts have no links.
    """
    rows, clusters, described = jaccard_clusters(docs, shingles)
    linked = _linked(rows, clusters)
    links = _all_links(linked, described, shingles, pairs=True)
    for side in ("a", "b"):
        links = links.join(linked.select(F.col("class").alias(side), F.col("least").alias(f"_{side}")), side)
    return links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def keep_one_of_each(docs: DataFrame, shingles: Shingles = Shingles()) -> DataFrame:
    """One row of ``docs`` of each component: that of the least doc_id, of these of the least hash of its text.

    Rows without an id come last. Of repeated rows one stays. Texts without
    shingles are linked with nothing and all stay. The columns are those of
    ``docs``; an empty table stays empty.
    """
    rows, clusters, _ = jaccard_clusters(docs, shingles)
    held = rows.where("n_shingles > 0").groupBy("doc_id", "text_hash", "class").agg(F.count(F.lit(1)).alias("n_rows"))
    # First the row of each class, as one class may have a third of all rows.
    by_class = held.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n_rows")).alias("first"))
    labelled = by_class.join(clusters, F.col("class") == F.col("node"), "left").select("first", F.coalesce("component", "class").alias("component"))
    chosen = labelled.groupBy("component").agg(F.min("first").alias("one"))
    bare = rows.where("n_shingles = 0").select(F.col("doc_id").alias("_fl_id"), F.col("text_hash").alias("_fl_hash"), F.lit(1).cast("long").alias("_fl_rows")).distinct()
    kept = stored(chosen.select(F.col("one.doc_id").alias("_fl_id"), F.col("one.text_hash").alias("_fl_hash"), F.col("one.n_rows").alias("_fl_rows")).union(bare), "kept")
    hashed = docs.withColumn("_fl_text_hash", F.xxhash64("text"))
    same = lambda some: hashed.doc_id.cast("long").eqNullSafe(some._fl_id) & (hashed._fl_text_hash == some._fl_hash)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = kept.where("_fl_rows > 1")
    if repeated.isEmpty():
        return hashed.join(kept, same(kept), "left_semi").select(*columns)
    once = kept.where("_fl_rows = 1")
    single = hashed.join(once, same(once), "left_semi")
    first = hashed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "_fl_text_hash"])
    return single.unionByName(first).select(*columns)
