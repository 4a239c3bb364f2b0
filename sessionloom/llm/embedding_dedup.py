"""Near-duplicate embeddings by cover-tree dual traversal (operator 4).

Unit vectors with a cosine of t or more lie within sqrt(2 - 2t) of each other.
Pivots from a bounded sample, the top of the tree, deal the vectors out to cells; a
vector also visits those cells that both the cell's covering radius and the bound
to its border allow. How many cells there are is set by what they cost on the
sample: where no cell prunes, as with vectors that lie everywhere alike, there are few. In a cell, blocks of
vectors are held as cover trees, nested levels with halving radii, and pairs of
nodes are pruned by their covering radii until only pairs of vectors are left,
which are compared in double precision. Each task returns counts and a spanning
forest of the links it found, never the pairs themselves.
"""

from __future__ import annotations

import pickle
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import connected_components, drop_tables, materialize
from sessionloom.llm.vectors import classes, in_blocks, matrix, sample, usable

#: Vectors in a block, and as many comparisons as one more copy of a vector costs.
TREE_ROWS, COPY_COST = 2048, 4096
#: Radii of the levels of a tree below its root, which holds the whole sphere.
LEVELS = (1.0, 0.5, 0.25, 0.125)


def units(points: np.ndarray) -> np.ndarray:
    scaled = points / np.abs(points).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points, the top of a cover tree of the sample."""
    chosen, nearest = [0], spans(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)):
        far = int(nearest.argmax())
        if nearest[far] <= 1e-9:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, spans(points, points[far : far + 1])[:, 0])
    return points[chosen]


def visits(d: np.ndarray, apart: np.ndarray, radii: np.ndarray, eps: float) -> np.ndarray:
    """Which cells each vector belongs to or visits, by its distances to the pivots; of two cells the later one's vectors visit the earlier."""
    rows, home = np.arange(len(d)), d.argmin(1)
    own = d[rows, home]
    border = (d * d - (own * own)[:, None]) / (2 * apart[home])
    out = (border <= eps) & (d <= radii + eps) & (np.arange(d.shape[1]) < home[:, None])
    out[rows, home] = True
    return out


def cells(points: np.ndarray, tops: np.ndarray, n: int, eps: float) -> int:
    """How many of the pivots, a power of two or all, make the work on ``n`` vectors least, by the sample."""
    d, apart, costs = spans(points, tops), spans(tops, tops) + np.eye(len(tops)), {}
    for count in sorted({len(tops), *(1 << k for k in range(len(tops).bit_length()) if 1 << k <= len(tops))}):
        part = d[:, :count]
        home = part.argmin(1)
        radii = np.zeros(count)
        np.maximum.at(radii, home, part.min(1))
        seen = visits(part, apart[:count, :count], radii, eps)
        at_home = np.bincount(home, minlength=count)
        pairs = (at_home * (seen.sum(0) - at_home / 2)).sum() * (n / len(points)) ** 2
        costs[count] = pairs + seen.sum() * n / len(points) * COPY_COST
    return min(costs, key=costs.get)


def tree_levels(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A cover tree of unit vectors: per level of nested nets the nodes' points, covering radii and parents; the last level is all points."""
    near = points.astype(np.float32)
    d = np.sqrt(np.maximum(2 - 2 * (near @ near.T), 0))
    rows, levels = np.arange(len(points)), []
    net = np.zeros(0, np.int64)  # point numbers of the level's nodes; those of the level above stay in it
    above = np.zeros(len(points), np.int64)
    for radius in LEVELS:
        nodes = net.tolist()
        open_ = (d[:, net] > radius).all(1) if len(net) else np.ones(len(points), bool)
        while open_.any():
            first = int(open_.argmax())
            nodes.append(first)
            open_ &= d[first] > radius
        new = np.array(nodes)
        parent = above[new]
        # a point goes to the nearest child of the node that it belongs to
        at = d[:, new].argmin(1) if not levels else np.where(parent == above[:, None], d[:, new], np.float32(9)).argmin(1)
        reach = np.zeros(len(new), np.float32)
        np.maximum.at(reach, at, d[rows, new[at]])
        levels.append((new, reach, parent))
        net, above = new, at
    return [*levels, (rows, np.zeros(len(rows), np.float32), above)]


def linked(a: np.ndarray, tree_a: list, b: np.ndarray, tree_b: list, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of two trees, each unordered pair once, with a cosine of ``least`` or more.

    Node pairs further apart than their covering radii and the links' length
    allow are pruned, with room for single precision; what is left of the
    points is compared in double precision.
    """
    eps = np.float32(np.sqrt(2 - 2 * least) + 1e-3)
    rows = cols = np.zeros(1, np.int64)
    live = np.ones((1, 1), bool)
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    for (na, ra, up_a), (nb, rb, up_b) in zip(tree_a, tree_b, strict=True):
        sides = []
        for kept, up in ((rows, up_a), (cols, up_b)):
            place = np.full(int(up.max()) + 1 if len(up) else 1, -1)
            place[kept[kept < len(place)]] = np.flatnonzero(kept < len(place))
            own = place[up]
            sides.append((np.flatnonzero(own >= 0), own[own >= 0]))
        (rows, from_a), (cols, from_b) = sides
        far = np.minimum(ra[rows][:, None] + rb[cols] + eps, np.float32(2.01))
        live = live[from_a][:, from_b] & (a32[na[rows]] @ b32[nb[cols]].T >= 1 - far * far / 2)
        used, seen = live.any(1), live.any(0)
        if not used.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, cols, live = rows[used], cols[seen], live[used][:, seen]
    i, j = np.nonzero(live)
    i, j = rows[i], cols[j]
    if same:
        i, j = i[i < j], j[i < j]
    exact = np.concatenate([(a[i[k : k + 100_000]] * b[j[k : k + 100_000]]).sum(1) >= least for k in range(0, max(1, len(i)), 100_000)])
    return i[exact], j[exact]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches by the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(rows: DataFrame, least: float = 0.95, fit_rows: int = 4096, seed: int = 5) -> DataFrame:
    """Link all pairs of vectors with a cosine of ``least`` or more.

    ``rows`` has vec_id and embedding, all of one length. Returns one row per row: vec_id,
    n_links, component_id (the smallest vec_id reachable) and kept. The result
    is exact; pivots are chosen on at most ``fit_rows`` distinct vectors, and are no
    more than the root of the number of vectors.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing and are their own component; a null vec_id too, with a null
    component, and is kept. Equal vectors under different ids link with each other. A
    repeated vec_id counts each of its rows. An empty table gives no rows; further
    columns are ignored.
    """
    spark = rows.sparkSession
    ok = materialize(usable(rows), "vectors")
    unique = materialize(classes(ok, 1).select(F.element_at("ids", 1).alias("id"), "copies", "embedding"), "classes")
    n = unique.count()
    none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return none
    points, eps = units(sample(unique, n, fit_rows, seed)), float(np.sqrt(2 - 2 * least)) + 1e-6
    tops = pivots(points, max(1, isqrt(n)))
    tops = tops[: cells(points, tops, n, eps)]
    apart = spans(tops, tops) + np.eye(len(tops))

    def reach(batches):
        radii = np.zeros(len(tops))
        for batch in batches:
            if batch.num_rows:
                d = spans(units(matrix(batch.column(0))), tops)
                np.maximum.at(radii, d.argmin(1), d.min(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(radii))), pa.array(radii)], ["cell", "radius"])

    radii = np.zeros(len(tops))
    for r in unique.select("embedding").mapInArrow(reach, "cell long, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # one row a pivot
        radii[r.cell] = r.radius + 1e-6

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = spans(units(matrix(batch.column("embedding"))), tops)
            at, cell = np.nonzero(visits(d, apart, radii, eps))
            names = ["id", "copies", "embedding"]
            columns = [pa.array(cell, pa.int64()), pa.array(d.argmin(1)[at] == cell), *(batch.column(c).take(pa.array(at)) for c in names)]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "home", *names])

    kinds = "cell long, home boolean, id long, copies long, embedding array<float>"
    dealt = materialize(unique.select("id", "copies", "embedding").mapInArrow(deal, kinds), "dealt")
    gathered = in_blocks(dealt, ["cell", "home"], ["id", "copies", "embedding"], "id", TREE_ROWS)

    def build(batches):
        for batch in batches:
            trees = [pickle.dumps(tree_levels(units(matrix(x.values.field("embedding"))))) for x in batch.column("items")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, pa.binary())], [*batch.schema.names, "tree"])

    item = "array<struct<id:long,copies:long,embedding:array<float>>>"
    built = gathered.select("cell", "home", "part", "items").mapInArrow(build, f"cell long, home boolean, part int, items {item}, tree binary")
    blocks = materialize(built, "blocks")  # each block's tree is made once, however many blocks it meets
    # pairs of blocks first, by number; then each pair fetches its two blocks, so that a dense cell is many keys
    narrow = blocks.select("cell", "home", "part")
    one, other = (narrow.select("cell", F.col("home").alias(f"home_{x}"), F.col("part").alias(f"part_{x}")) for x in "ab")
    pairs = one.where("home_a").join(other, "cell").where("not home_b or part_a <= part_b")
    held_a, held_b = (blocks.select("cell", F.col("home").alias(f"home_{x}"), F.col("part").alias(f"part_{x}"), F.col("items").alias(x), F.col("tree").alias(f"tree_{x}")) for x in "ab")
    pairs = pairs.join(held_a, ["cell", "home_a", "part_a"]).join(held_b, ["cell", "home_b", "part_b"])
    pairs = pairs.select((F.col("home_b") & (F.col("part_a") == F.col("part_b"))).alias("same"), "a", "tree_a", "b", "tree_b")

    def traverse(batches):
        for batch in batches:
            for same, a, tree_a, b, tree_b in zip(*(batch.column(k) for k in range(5)), strict=True):
                same, a, b = same.as_py(), a.values, b.values
                points = [units(matrix(x.field("embedding"))) for x in (a, b)]
                i, j = linked(points[0], pickle.loads(tree_a.as_py()), points[1], pickle.loads(tree_b.as_py()), same, least)
                ids = np.concatenate([x.field("id").to_numpy() for x in (a, b)])
                copies = np.concatenate([x.field("copies").to_numpy() for x in (a, b)])
                j = j if same else j + len(a)
                links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                touched = np.flatnonzero(links)
                root = forest(i, j, len(ids))[touched]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[touched]), pa.array(ids[root]), pa.array(links[touched].astype(np.int64))], ["a", "b", "links"]
                )

    found = materialize(pairs.mapInArrow(traverse, "a long, b long, links long"), "links")
    drop_tables(spark, dealt, blocks)
    counted = found.groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("a", "b"))
    per_class = (
        unique.select("id", "copies", "embedding")
        .join(counted, unique.id == counted.a, "left")
        .join(parts, unique.id == parts.node, "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    per_class = materialize(per_class, "per_class")
    plain = ok.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast("float")))
    done = plain.join(per_class, "embedding").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    part = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    out = F.col("vec_id").isNull() | ~F.coalesce(part, F.lit(False))
    return done.unionByName(rows.where(out).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
