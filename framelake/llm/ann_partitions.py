"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a graph of nearest neighbours. The graph
is cut into balanced parts, so that neighbours mostly share one, and a small
softmax classifier learns to tell the part of a vector. Every vector is filed
under its most probable parts; a query is sent to several and compared exactly
with what is filed there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import stored

#: Vectors that the graph and the classifier are fitted on at most.
SAMPLE = 8_192

#: Vectors of a part, as far as the sample can tell so many parts apart.
PART_VECTORS = 1_500
MOST_PARTS = 256

#: Neighbours of a vector in the graph.
GRAPH_NEIGHBOURS = 10

#: A query visits as many parts as it takes to reach this probability and hold enough vectors, and so many at least.
PROBABILITY, LEAST_PROBES = 0.995, 3

#: A task compares about so many vectors of a part with about so many queries.
SPLIT_VECTORS, BLOCK_QUERIES = 1_024, 4_096


def exact_neighbours(points: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other points of each point."""
    square = (points**2).sum(axis=1)
    out = np.empty((len(points), k), np.int64)
    for start in range(0, len(points), 1024):
        block = points[start : start + 1024]
        distance = square[None] - 2 * block @ points.T
        distance[np.arange(len(block)), start + np.arange(len(block))] = np.inf
        out[start : start + 1024] = np.argpartition(distance, k - 1, axis=1)[:, :k]
    return out


def _bisect(members: np.ndarray, neighbours: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``members`` with few graph edges between them.

    A random vector smoothed over the graph nears the direction along which it
    falls apart; the halves are taken at its median and then exchange points
    that have more neighbours on the other side, in pairs.
    """
    position = np.full(len(neighbours), -1)
    position[members] = np.arange(len(members))
    local = position[neighbours[members]]
    inside = local >= 0
    local = np.where(inside, local, 0)
    value = rng.standard_normal(len(members))

    def gathered(x: np.ndarray) -> np.ndarray:
        ahead = (x[local] * inside).sum(axis=1)
        return ahead + np.bincount(local.ravel(), (x[:, None] * inside).ravel(), len(x))

    degree = np.maximum(gathered(np.ones(len(members))), 1)
    for _ in range(60):
        value = 0.5 * value + 0.5 * gathered(value) / degree
        value -= (value * degree).sum() / degree.sum()
        value /= np.abs(value).max() + 1e-300
    side = np.zeros(len(members), bool)
    side[np.argsort(value, kind="stable")[len(members) // 2 :]] = True
    for _ in range(10):
        gain = gathered(np.where(side, 1.0, -1.0)) * np.where(side, -1, 1)
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        swap = int((gain[left[:n]] + gain[right[:n]] > 1).sum()) // 2
        if not swap:
            break
        side[left[:swap]], side[right[:swap]] = True, False
    return members[~side], members[side]


def balanced_parts(neighbours: np.ndarray, parts: int) -> np.ndarray:
    """The part of each point of the graph; sizes differ by a few points."""
    rng = np.random.default_rng(11)
    out = np.zeros(len(neighbours), np.int64)
    pending = [(np.arange(len(neighbours)), parts)]
    label = 0
    while pending:
        members, n = pending.pop()
        if n <= 1 or len(members) < 2:
            out[members] = label
            label += 1
            continue
        low, high = _bisect(members, neighbours, rng)
        pending += [(low, n // 2), (high, n - n // 2)]
    return out


@dataclass
class Router:
    """Softmax over the parts, linear in a scaled vector and its square."""

    mean: np.ndarray
    scale: float
    weights: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) * self.scale
        return np.concatenate([z, (z**2).sum(axis=1, keepdims=True), np.ones((len(z), 1))], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.features(x) @ self.weights
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    @staticmethod
    def fit(points: np.ndarray, part: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 300, rate: float = 0.05) -> Router:
        """Adam on the shares of each point's neighbourhood among the parts."""
        mean = points.mean(axis=0)
        router = Router(mean, 1 / max(float((points - mean).std()), 1e-12), np.zeros((points.shape[1] + 2, parts)))
        x = router.features(points)
        target = np.zeros((len(points), parts))
        np.add.at(target, (np.arange(len(points)), part), 1)
        for column in neighbours.T:
            np.add.at(target, (np.arange(len(points)), part[column]), 0.3)
        target /= target.sum(axis=1, keepdims=True)
        first, second = np.zeros_like(router.weights), np.zeros_like(router.weights)
        for t in range(1, rounds + 1):
            batch = np.random.default_rng(t).integers(0, len(x), min(2048, len(x)))
            s = x[batch] @ router.weights
            s = np.exp(s - s.max(axis=1, keepdims=True))
            gradient = x[batch].T @ (s / s.sum(axis=1, keepdims=True) - target[batch]) / len(batch)
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            router.weights -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        return router


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal length as an array of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def sound_vectors(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors of the commonest length that are neither null nor zero nor hold what is no number."""
    v = F.col(vector_column).cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & sound)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (common["n"] if common else 0))


def _distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its k + 1 least ids, least first; no query needs more of equal vectors."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame({"vec_id": batch.column(0).to_numpy(), "at": np.arange(batch.num_rows), "key": [x.tobytes() for x in batch.column(1).to_numpy(zero_copy_only=False)]}).sort_values("vec_id", kind="stable")
            yield batch.take(pa.array(np.sort(frame[frame.groupby("key").cumcount() <= k]["at"].to_numpy())))

    thinned = rows.mapInArrow(thin, rows.schema)
    dealt = thinned.withColumn("_deal", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    some = dealt.groupBy("embedding", "_deal").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    return some.groupBy("embedding").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


@dataclass
class Index:
    """Vectors filed by part, and the router that filed them."""

    filed: DataFrame
    router: Router
    parts: int


def build_index(rows: DataFrame, k: int = 10, sample: int = SAMPLE) -> Index:
    """Files all of ``rows`` (vec_id, embedding); fitted on the ``sample`` distinct vectors of least hash."""
    distinct = stored(_distinct_vectors(rows, k), "vectors")
    n = distinct.count()
    share = min(1.0, 2.0 * sample / max(n, 1) + 0.01)
    drawn = F.xxhash64("embedding")
    taken = distinct.where(F.pmod(drawn, F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(drawn).limit(sample).select("embedding").toArrow()
    points = _vectors(taken.column(0).combine_chunks()) if taken.num_rows else np.zeros((0, 1))
    parts = int(np.clip(n // PART_VECTORS, 1, min(MOST_PARTS, max(1, len(points) // 32))))
    if parts > 1:
        neighbours = exact_neighbours(points, min(GRAPH_NEIGHBOURS, len(points) - 1))
        router = Router.fit(points, balanced_parts(neighbours, parts), neighbours, parts)
    else:
        width = points.shape[1]
        router = Router(np.zeros(width), 1.0, np.zeros((width + 2, 1)))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.probabilities(_vectors(batch.column(0))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["embedding", "ids", "part"])

    filed = distinct.select("embedding", "ids").mapInArrow(file, "embedding array<double>, ids array<long>, part int")
    return Index(stored(filed, "index"), router, parts)


def part_counts(rows: DataFrame, parts: int) -> np.ndarray:
    """The number of ``rows`` of each part; the driver holds at most MOST_PARTS numbers."""
    counts = np.zeros(parts, np.int64)
    for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["part"]] = r["n"]
    return counts


def _shares(counts: np.ndarray, most: int) -> Column:
    """Into how many shares of about ``most`` rows each part's rows are dealt."""
    table = F.array(*(F.lit(max(1, -(-n // most))) for n in counts.tolist()))
    return F.element_at(table, F.col("part") + 1)


def parts_to_visit(probabilities: np.ndarray, counts: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and parts: for each row its likeliest parts until they reach PROBABILITY and hold ``wanted`` vectors."""
    order = np.argsort(-probabilities, axis=1, kind="stable")
    likely, held = np.take_along_axis(probabilities, order, axis=1), counts[order]
    reached, covered = np.cumsum(likely, axis=1) - likely, np.cumsum(held, axis=1) - held
    row, column = np.nonzero((reached < PROBABILITY) | (covered < wanted) | (np.arange(order.shape[1]) < LEAST_PROBES))
    return row, order[row, column]


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest other vectors found for each of ``queries`` (vec_id, embedding).

    Nearest by Euclidean distance, ties to the lesser id. Equal queries are
    answered once. Parts are visited until the router is sure and they hold
    k + 1 distinct vectors, so k are found wherever there are k others. The vectors of a part and the queries sent to it are both
    dealt into shares by hash, and each pair of shares is compared by itself,
    so a task stays small however many of either a part has.
    """
    router, counts = index.router, part_counts(index.filed, index.parts)
    asked = queries.groupBy("embedding").agg(F.xxhash64("embedding").alias("query"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, part = parts_to_visit(router.probabilities(_vectors(batch.column(1))), counts, k + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(part.astype(np.int32))], names=["query", "embedding", "part"])

    routed = stored(asked.select("query", "embedding").mapInArrow(route, "query long, embedding array<double>, part int"), "routed")
    splits, blocks = _shares(counts, SPLIT_VECTORS), _shares(part_counts(routed, index.parts), BLOCK_QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sent = routed.select("part", every(splits).alias("split"), F.pmod("query", blocks).cast("int").alias("block"), "query", "embedding")
    filed = index.filed.select("part", F.pmod(F.xxhash64("embedding"), splits).cast("int").alias("split"), every(blocks).alias("block"), "embedding", "ids")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            points, ids = _vectors(right.column("embedding").combine_chunks()), right.column("ids").to_pylist()
            for query, vector in zip(left.column("query").to_pylist(), _vectors(left.column("embedding").combine_chunks()), strict=True):
                distance = np.sqrt(((points - vector) ** 2).sum(axis=1))
                # The query's own row may be among them, so one more than k is kept.
                near = np.flatnonzero(distance <= np.partition(distance, min(k, len(distance) - 1))[min(k, len(distance) - 1)])
                found = sorted((float(distance[i]), v) for i in near.tolist() for v in ids[i][: k + 1])[: k + 1]
                out["query"] += [query] * len(found)
                out["score"] += [d for d, _ in found]
                out["vec_id"] += [v for _, v in found]
        return pa.table({"query": pa.array(out["query"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = sent.groupBy("part", "split", "block").cogroup(filed.groupBy("part", "split", "block")).applyInArrow(compare, "query long, vec_id long, score double")
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("near"))
    answered = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("_query")).distinct().join(best, F.col("_query") == F.col("query"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("rank", "n")).select("query_id", (F.col("rank") + 1).alias("rank"), "n.vec_id", "n.score")


def nearest_neighbours(embeddings: DataFrame, every: int = 100, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest of all other rows found for each row whose id is divisible by ``every``.

    Vectors that are null or zero or hold null or non-finite components take no
    part. Equal vectors are compared once and answer with their least ids; a
    repeated id counts once. With fewer than k others all are returned. An
    empty table gives no rows; other columns are ignored.
    """
    rows = sound_vectors(embeddings, id_column, vector_column)
    return search(build_index(rows, k), rows.where(F.col("vec_id") % every == 0), k)
