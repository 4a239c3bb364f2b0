"""Approximate nearest neighbours by balanced posting lists (operator 3).

Centroids come from a bounded sample, by k-means whose sizes are held in
balance; every row is indexed, a boundary vector in the lists of several near
centroids. A query walks a graph over the centroids in memory, and the ratio of
its distances to the nearest centroid's prunes the lists it looks into. That
ratio is set on the sample, so that recall against brute force there is reached.
Lists are as many as the square root of the rows at most, so that both the
centroids in memory and the length of a list grow with that root.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import materialize
from sessionloom.llm.vectors import BLOCK, classes, in_blocks, matrix, sample, usable

#: Distances that are held at once.
HELD = 4_000_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def blockwise(a: np.ndarray, b: np.ndarray):
    """(first row, distances) of runs of rows of ``a`` to all of ``b``."""
    step = max(1, HELD // max(1, len(b)))
    for at in range(0, len(a), step):
        yield at, distances(a[at : at + step], b)


def balanced_centroids(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means in which a cluster's distance grows with its excess over the mean size."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), k, replace=False)]
    penalty, mean = np.zeros(k), len(points) / k
    for _ in range(rounds):
        found = [((d * d + penalty).argmin(1), (d * d).min(1)) for _, d in blockwise(points, centers)]
        nearest = np.concatenate([f[0] for f in found])
        sizes = np.bincount(nearest, minlength=k)
        penalty += 0.05 * np.concatenate([f[1] for f in found]).mean() * (sizes / mean - 1)
        penalty -= penalty.min()
        order = np.argsort(nearest, kind="stable")
        filled = np.flatnonzero(sizes)
        sums = np.add.reduceat(points[order], (np.cumsum(sizes) - sizes)[filled])
        centers[filled] = sums / sizes[filled, None]
        empty = np.flatnonzero(sizes == 0)
        centers[empty] = points[rng.choice(len(points), len(empty))]
    return centers


@dataclass
class CentroidGraph:
    """Centroids joined to near ones and a few at random; searched best first."""

    centers: np.ndarray
    links: np.ndarray

    @staticmethod
    def build(centers: np.ndarray, near: int = 24, far: int = 8, seed: int = 0) -> CentroidGraph:
        near = min(near + 1, len(centers))
        order = [np.argpartition(d, near - 1, axis=1)[:, :near] for _, d in blockwise(centers, centers)]
        shortcuts = np.random.default_rng(seed).integers(0, len(centers), (len(centers), far))
        return CentroidGraph(centers, np.concatenate([np.concatenate(order), shortcuts], axis=1))

    def search(self, query: np.ndarray, ratio: float, beam: int = 24) -> tuple[np.ndarray, np.ndarray, int]:
        """The centroids it met, nearest first, their distances, and how many are within ``ratio`` times the nearest one's.

        It ends when what is open is further than that, and than the ``beam`` nearest so far.
        """
        length = lambda at: np.sqrt(((self.centers[at] - query) ** 2).sum(1)).tolist()
        seen = np.zeros(len(self.centers), bool)
        start = np.unique(np.linspace(0, len(self.centers) - 1, 8).astype(int))
        seen[start] = True
        met = list(zip(length(start), start.tolist(), strict=True))
        open_, best = met.copy(), sorted(d for d, _ in met)[:beam]
        heapq.heapify(open_)
        while open_:
            d, at = heapq.heappop(open_)
            if len(best) == beam and d > max(best[-1], ratio * best[0]):
                break
            new = np.unique(self.links[at][~seen[self.links[at]]])
            if len(new):
                seen[new] = True
                found = list(zip(length(new), new.tolist(), strict=True))
                met += found
                for x in found:
                    heapq.heappush(open_, x)
                best = sorted(best + [x[0] for x in found])[:beam]
        met.sort()
        d = np.array([x[0] for x in met])
        return np.array([x[1] for x in met]), d, int((d <= ratio * d[0] + 1e-12).sum())


def rivals(points: np.ndarray, centers: np.ndarray, most: int):
    """For each vector its nearest centroids on different sides: none is nearer to one before it than to the vector; (centroid, distance) pairs."""
    near = min(2 * most, len(centers))
    for _, d in blockwise(points, centers):
        order = np.argpartition(d, near - 1, axis=1)[:, :near]
        for row, at in zip(d, order, strict=True):
            chosen: list[tuple[int, float]] = []
            for c in at[np.argsort(row[at], kind="stable")].tolist():
                if all(((centers[c] - centers[o]) ** 2).sum() > row[c] ** 2 for o, _ in chosen):
                    chosen.append((c, float(row[c])))
                    if len(chosen) == most:
                        break
            yield chosen


def lists_of(points: np.ndarray, centers: np.ndarray, replicas: int, boundary: float) -> list[list[int]]:
    """The posting lists of each vector: the nearest centroid's, and those of its rivals within ``boundary`` times that distance."""
    return [[c for c, d in chosen if d <= boundary * chosen[0][1]] for chosen in rivals(points, centers, replicas)]


def tuned_boundary(points: np.ndarray, centers: np.ndarray, share: float, most: float = 1.5) -> float:
    """The boundary, ``most`` at most, with which ``share`` of the sample's vectors that have a rival stand in its list too."""
    second = [chosen[1][1] / max(chosen[0][1], 1e-12) for chosen in rivals(points, centers, 2) if len(chosen) > 1]
    return min(most, float(np.quantile(second, share))) if second else 1.0


def tuned_ratio(points: np.ndarray, graph: CentroidGraph, held: list[list[int]], n: int, k: int, aim: float, queries: int = 400) -> float:
    """The smallest distance ratio with which sample queries find ``aim`` of their true nearest in the sample.

    As many nearest ones are asked for as the sample is likely to hold of the k nearest of all ``n``, 3 at least.
    """
    k = max(3, round(k * len(points) / n))
    if len(points) <= k + 1:
        return float("inf")
    asked_at = np.arange(0, len(points), max(1, len(points) // queries))
    asked = points[asked_at]
    to_center = distances(asked, graph.centers)
    nearest = to_center.min(1)
    need = []
    for at, d in blockwise(asked, points):
        for i, found in enumerate(np.argpartition(d, k + 1, axis=1)[:, : k + 1], at):
            need += [to_center[i][held[p]].min() / max(nearest[i], 1e-12) for p in found if asked_at[i] != p]
    return float(np.quantile(need, aim)) + 1e-6


def found_rows(best: dict[int, dict]) -> pa.RecordBatch:
    rows = [(q, c, ids, x) for q, known in best.items() for c, (x, ids, _) in known.items()]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "class", "ids", "score"])


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, k: int = 10, list_rows: int = 128, fit: int = 16, replicas: int = 4, share: float = 0.4, aim: float = 0.97, seed: int = 11,
) -> DataFrame:
    """For each query row its ``k`` nearest other rows by Euclidean distance, by the index.

    Both tables have vec_id and embedding. The index holds every row, in a list
    for ``list_rows`` vectors but no more lists than the root of their number; it is fitted on at most
    ``fit`` distinct vectors for each list. About ``share`` of the vectors stand
    in a second list, none in more than ``replicas``. Returns query_id, rank
    (from 1), vec_id and score, the distance of the original vectors in double
    precision; ties go to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do null ids. A query leaves out rows of its own vec_id; equal
    vectors under other ids count each. Where the lists within the ratio hold too few
    vectors, a query goes on to the next ones. An empty table gives no rows; further
    columns are ignored. All vectors must have the same length.
    """
    unique = materialize(classes(usable(rows), k + 1).withColumn("class", F.element_at("ids", 1)), "classes")
    asked = usable(queries).dropDuplicates(["vec_id"])
    n = unique.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = max(1, min(n // list_rows, isqrt(n)))
    points = sample(unique, n, max(1024, fit * count), seed)
    centers = balanced_centroids(points, count, seed) if count > 1 else points.mean(0)[None]
    graph, boundary = CentroidGraph.build(centers), tuned_boundary(points, centers, share)
    ratio = tuned_ratio(points, graph, lists_of(points, centers, replicas, boundary), n, k, aim)

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                held = lists_of(matrix(batch.column("embedding")), centers, replicas, boundary)
                at = np.repeat(np.arange(len(held)), [len(h) for h in held])
                names = ["class", "ids", "embedding"]
                columns = [batch.column(c).take(pa.array(at)) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([c for h in held for c in h], pa.int64()), *columns], ["list", *names])

    postings = unique.select("class", "ids", "embedding").mapInArrow(index, "list long, class long, ids array<long>, embedding array<float>")
    postings = materialize(postings, "postings")
    # one row a list: the root of the number of vectors at most
    of_list = postings.groupBy("list").agg(F.count("*").alias("vectors"), F.sum(F.size("ids")).alias("ids")).toArrow()
    pieces, within = np.zeros(count, np.int64), np.zeros(count, np.int64)
    at = of_list.column(0).to_numpy()
    pieces[at], within[at] = -(-of_list.column(1).to_numpy() // BLOCK), of_list.column(2).to_numpy()
    enough = replicas * (k + 1)

    def lists_for(query: np.ndarray) -> np.ndarray:
        near, _, many = graph.search(query, ratio)
        if within[near].sum() < enough:
            near = np.argsort(((centers - query) ** 2).sum(1), kind="stable")
        return near[: max(many, int(np.searchsorted(np.cumsum(within[near]), enough)) + 1)]

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                found = [lists_for(v) for v in matrix(batch.column("embedding"))]
                near = np.concatenate(found)
                at = np.repeat(np.repeat(np.arange(len(found)), [len(f) for f in found]), pieces[near])
                lists = np.repeat(near, pieces[near])
                piece = np.arange(len(lists)) - np.repeat(np.cumsum(pieces[near]) - pieces[near], pieces[near])
                columns = [batch.column(c).take(pa.array(at)) for c in ("vec_id", "embedding")]
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(piece), *columns], ["list", "piece", "vec_id", "embedding"])

    probes = asked.mapInArrow(probe, "list long, piece long, vec_id long, embedding array<float>")
    # a long list is many pieces, each met by its queries under a key of its own
    blocks = in_blocks(postings, ["list"], ["class", "ids", "embedding"], "class").select("list", F.col("part").cast("long").alias("piece"), F.col("items").alias("block"))
    asks = in_blocks(materialize(probes, "probes"), ["list", "piece"], ["vec_id", "embedding"], "vec_id").select("list", "piece", F.col("items").alias("asks"))
    pairs = blocks.join(asks, ["list", "piece"])

    def search(batches):
        held, best = 0, {}  # what this task has found so far for each query
        for batch in batches:
            for block, asks in zip(batch.column(0), batch.column(1), strict=True):
                block, asks = block.values, asks.values
                these, own = matrix(block.field("embedding")), matrix(asks.field("embedding"))
                names, ids, d = block.field("class").to_numpy(), block.field("ids"), distances(own, these)
                most = min(k + 1, len(these))
                kth = np.partition(d, most - 1, axis=1)[:, most - 1]
                near = d <= kth[:, None] * (1 + 1e-9) + 1e-6  # with all that may tie
                for row, query in enumerate(asks.field("vec_id").to_pylist()):
                    places = np.flatnonzero(near[row])
                    exact = np.sqrt(((own[row] - these[places]) ** 2).sum(1))
                    known = best.get(query, {})
                    held -= len(known)
                    known |= {int(names[at]): (float(x), at, ids) for x, at in zip(exact, places.tolist(), strict=True)}
                    least = sorted(known.items(), key=lambda x: (x[1][0], x[0]))[: k + 1]
                    best[query] = {c: (x, at if got is None else got[at].as_py(), None) for c, (x, at, got) in least}
                    held += len(best[query])
                if held > 500_000:
                    yield found_rows(best)
                    held, best = 0, {}
        yield found_rows(best)

    found = pairs.select("block", "asks").mapInArrow(search, "query_id long, class long, ids array<long>, score double")
    by_query = Window.partitionBy("query_id")
    found = found.dropDuplicates(["query_id", "class"])
    found = found.withColumn("n", F.row_number().over(by_query.orderBy("score", "class"))).where(F.col("n") <= k + 1)
    others = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    ranked = others.withColumn("rank", F.row_number().over(by_query.orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
