"""Exact top-k inner-product search with dual cover trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viaduct.llm.common import bounded, cut_lineage

LEAF = 48
CHILDREN = 24
QUERY_GROUP = 65_536
BLOCK_ROWS = 32_768
BLOCK_BYTES = 32 << 20
MOST_CELLS = 512
SAMPLE_ROWS = 8192
SCORED = 4096


@dataclass
class Node:
    """A ball around a data point that covers the rows ``at``; leaves have no children."""

    center: np.ndarray
    norm: float
    radius: float
    at: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, at: np.ndarray) -> Node:
    """Cover tree of the rows ``at`` of x.

    Children are balls of half their parent's radius around points further than that from each
    other.  Points left over once there are CHILDREN balls, or in balls too small to prune by, stay
    together as a leaf around the parent's center, whose radius is exact; so dense parts get deep and
    scattered ones stay flat.
    """
    center = x[at[0]]
    far = _distances(x[at], center)
    node = Node(center, float(np.sqrt(center @ center)), float(far.max()), at)
    if len(at) <= LEAF or node.radius == 0:
        return node
    rest, loose = at, []
    while len(rest) and len(node.children) + len(loose) < CHILDREN:
        near = _distances(x[rest], x[rest[0]]) <= node.radius / 2
        if near.all() and len(rest) == len(at):
            break
        if near.sum() >= LEAF // 4:
            node.children.append(cover_tree(x, rest[near]))
        else:
            loose.append(rest[near])
        rest = rest[~near]
    if node.children:
        rest = np.concatenate([*loose, rest])
        if len(rest):
            node.children.append(Node(center, node.norm, float(_distances(x[rest], center).max()), rest))
    return node


def _distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    d = x - center
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def bound(center_product: np.ndarray | float, a_norm, a_radius, b_norm, b_radius):
    """No two points of balls a and b have a larger inner product; the slack covers rounding of each term."""
    terms = a_radius * b_norm + b_radius * a_norm + a_radius * b_radius
    return center_product + terms + 1e-9 * (1 + a_norm * b_norm + terms)


class Search:
    """The best k of each query so far, refined over one tree of candidates after the other.

    ``worst`` are known lower bounds of the queries' kth scores.  Of candidates that equal a query in
    ``own`` (its row's name) none counts.
    """

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.q, self.own, self.k = queries, own, k
        self.worst = np.full(len(queries), -np.inf) if worst is None else worst.copy()
        self.found: list[list[np.ndarray]] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query row, score, id
        self.tree = cover_tree(queries, np.arange(len(queries)))

    def add(self, x: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Candidates with their ids and their rows' names (-1: no query's row)."""
        self._descend(self.tree, cover_tree(x, np.arange(len(x))), x, ids, own)

    def _bound(self, a: Node, b: Node) -> float:
        return bound(a.center @ b.center, a.norm, a.radius, b.norm, b.radius)

    def _descend(self, a: Node, b: Node, x: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        if self._bound(a, b) < self.worst[a.at].min():
            return
        if not a.children and not b.children:
            for lo in range(0, len(b.at), SCORED):
                self._score(a.at, b.at[lo : lo + SCORED], x, ids, own)
        elif a.children and (not b.children or a.radius > b.radius):
            for child in a.children:
                self._descend(child, b, x, ids, own)
        else:
            for child in sorted(b.children, key=lambda c: -self._bound(a, c)):
                self._descend(a, child, x, ids, own)

    def _score(self, rows: np.ndarray, at: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        for lo in range(0, len(rows), 1024):
            some = rows[lo : lo + 1024]
            score = self.q[some] @ x[at].T
            score[self.own[some][:, None] == own[at][None, :]] = -np.inf
            least = self.worst[some]
            if len(at) > self.k:
                least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            if not len(i):
                continue
            touched = np.unique(some[i])
            mine = np.isin(self.found[0], touched, assume_unique=False)
            row = np.concatenate([self.found[0][mine], some[i]])
            got = np.concatenate([self.found[1][mine], score[i, j]])
            key = np.concatenate([self.found[2][mine], ids[at[j]]])
            order = np.lexsort((key, -got, row))
            row, got, key = row[order], got[order], key[order]
            begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            place = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
            full = place == self.k - 1
            self.worst[row[full]] = got[full]
            kept = place < self.k
            self.found = [np.concatenate([old[~mine], new[kept]]) for old, new in zip(self.found, (row, got, key), strict=True)]


def scaled(column: pa.Array | pa.ChunkedArray, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as double."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(-1, dim)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """A level of a cover tree of the sample: rows further than a radius from each other, at most ``most``.

    The radius is halved from the sample's until the level is full, or holds every different row.
    """
    level = sample[:1]
    radius = float(_distances(sample, sample[0]).max()) if len(sample) else 0.0
    while len(level) < most and radius > 0:
        radius /= 2
        for row in sample:
            if len(level) == most:
                break
            if _distances(level, row).min() > radius:
                level = np.concatenate([level, row[None]])
        if radius < 1e-9:
            break
    return level


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row and the distance to it."""
    square = (centers * centers).sum(1)
    at = np.concatenate([(square - 2 * (x[lo : lo + 4096] @ centers.T)).argmin(1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
    d = x - centers[at]
    return at, np.sqrt(np.einsum("ij,ij->i", d, d))


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, most_cells: int = MOST_CELLS, query_group: int = QUERY_GROUP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each query row the k other rows with the largest integer inner product.

    Components become floor(scale * x).  Returns query_id, rank (from 1), vec_id, score; ties go to
    the smaller id; fewer rows if there are fewer candidates.

    A level of a cover tree of at most SAMPLE_ROWS sampled vectors divides all rows into at most
    ``most_cells`` cells with their covering radii; the sample also gives every query a first lower
    bound of its kth score.  A cell's candidates (in blocks of bounded rows and bytes) travel to a
    group of queries only where the bound of the two cells reaches the group's worst kth score, so
    a pair that cannot matter is never shuffled.  A task holds one block and one group, indexes both by cover trees and
    descends them together.  Each gives at most k rows a query, which a window merges.

    Null, empty, or partly null or non-finite vectors take no part, nor do null ids; vectors meet
    only those of their own length; a repeated id names several rows, each a candidate for all others
    and, if it is a query, with k rows of its own (rows equal in id and vector travel as one); an
    empty table gives no rows; other columns are ignored.  Sums beyond 2**53 are computed with Python
    integers and stop at the range of a long.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).cast("long").alias("asks"))
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("copies"), F.sum("asks").alias("asks")).withColumn("dim", F.size("v"))
    n = vectors.count()
    sample = rows.select("v", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # pivots, sampled vectors and their ids, by dimension
    sizes = sample.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        part = sample.filter(pa.array(sizes == dim))
        x = scaled(part.column("v"), dim, scale)
        known[dim] = pivots(x[:2048], max(1, min(most_cells, math.isqrt(n) // 16))), x, part.column("id").to_numpy()
    held = spark.sparkContext.broadcast(known)  # SAMPLE_ROWS vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            dims, asks, ids = (batch.column(c).to_numpy() for c in ("dim", "asks", "id"))
            cell, far, worst = np.zeros(len(dims), np.int32), np.zeros(len(dims)), np.full(len(dims), -np.inf)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = scaled(batch.column("v").take(pa.array(at)), dim, scale)
                centers, some, names = held.value.get(dim, (np.zeros((1, dim)),) * 2 + (np.zeros(0, np.int64),))
                cell[at], far[at] = nearest(x, centers)
                query = np.flatnonzero(asks[at] > 0)
                if len(names) > k and len(query):
                    score = x[query] @ some.T
                    score[ids[at[query]][:, None] == names[None, :]] = -np.inf
                    worst[at[query]] = np.partition(score, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(worst)], [*batch.schema.names, "cell", "far", "worst"])

    kind = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("cell int, far double, worst double").fields])
    placed = cut_lineage(rows.mapInArrow(place, kind))
    query = F.col("asks") > 0
    stats = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.sum(query.cast("long")).alias("asked"), F.max(F.when(query, F.col("far"))).alias("reach"), F.min(F.when(query, F.col("worst"))).alias("worst")).toPandas()  # a row for each cell
    plan = spark.createDataFrame(_meetings(stats, known, query_group, block_rows), "dim int, cell int, blocks int, groups array<struct<g:int,parts:int>>")
    own_group = spark.createDataFrame(_groups(stats, known, query_group), "dim int, cell int, g int, parts int")
    seat = lambda m: F.pmod(F.xxhash64("id", "v"), m).cast("int")
    candidates = placed.join(F.broadcast(plan), ["dim", "cell"]).withColumn("block", seat(F.col("blocks"))).select("*", F.explode("groups").alias("to"))
    candidates = candidates.select("dim", "cell", "block", "to.g", F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1)).alias("part"), "id", "v", "copies", F.lit(0).cast("long").alias("asks"), "worst")
    meets = plan.select("dim", F.col("cell").alias("other"), "blocks", F.explode("groups.g").alias("g"))
    asked = placed.where(query).join(F.broadcast(own_group), ["dim", "cell"]).withColumn("part", seat(F.col("parts"))).drop("cell")
    asked = asked.join(F.broadcast(meets), ["dim", "g"]).select("dim", F.col("other").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "g", "part", "id", "v", "copies", "asks", "worst")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x, ids, asks, copies, worst = scaled(table.column("v"), dim, scale), *(table.column(c).to_numpy() for c in ("id", "asks", "copies", "worst"))
        q, c = np.flatnonzero(asks > 0), np.flatnonzero(asks == 0)
        if not len(q) or not len(c):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "q", "vec_id", "score", "asks")})
        own = _names(table.column("v"), ids)
        times = np.minimum(copies[c], k + 1)
        first = np.cumsum(times) - times
        c = np.repeat(c, times)
        names = np.full(len(c), -1)
        names[first] = own[c[first]]  # a row's copies are others to it
        if np.abs(x[q]).max() * np.abs(x[c]).max() * dim >= 2.0**53:
            row, got, key_ = _by_integers(x[q], own[q], x[c], ids[c], names, k)
        else:
            search = Search(x[q], own[q], k, worst[q])
            search.add(x[c], ids[c], names)
            row, got, key_ = search.found
        return pa.table({"query_id": ids[q][row], "q": own[q][row], "vec_id": key_, "score": got.astype(np.int64), "asks": asks[q][row]})

    part = candidates.unionByName(asked).groupBy("dim", "cell", "block", "g", "part").applyInArrow(run, "query_id long, q long, vec_id long, score long, asks long")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    top = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "asks"))).drop("col")


def _names(vectors: pa.ChunkedArray, ids: np.ndarray) -> np.ndarray:
    """A number for each different (id, vector), the same in every task."""
    from xxhash import xxh64_intdigest

    column = vectors.combine_chunks()
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    return np.array([xxh64_intdigest(flat[a : a + m].tobytes(), int(k) & 0xFFFFFFFF) >> 1 for a, m, k in zip(start.tolist(), size.tolist(), ids.tolist(), strict=True)], np.int64)


def _groups(stats: pd.DataFrame, known: dict, most: int) -> list[tuple[int, int, int, int]]:
    """(dim, cell, group, parts): cells that are near each other share a group of about ``most`` queries,
    and a cell with more is a group of several parts."""
    out = []
    for dim, cells in stats[stats.asked > 0].groupby("dim"):
        centers = known[dim][0] if dim in known else np.zeros((1, dim))
        along = centers - centers.mean(0)
        place = along @ np.linalg.svd(along, full_matrices=False)[2][0] if len(centers) > 1 else np.zeros(1)
        g, held = 0, 0
        for r in sorted(cells.itertuples(), key=lambda r: place[r.cell]):
            if held and held + r.asked > most:
                g, held = g + 1, 0
            held += r.asked
            out.append((int(dim), int(r.cell), g, max(1, -(-int(r.asked) // most))))
    most_parts: dict[tuple[int, int], int] = {}
    for dim, _, g, parts in out:
        most_parts[dim, g] = max(most_parts.get((dim, g), 1), parts)
    return [(dim, cell, g, most_parts[dim, g]) for dim, cell, g, _ in out]


def _meetings(stats: pd.DataFrame, known: dict, query_group: int, block_rows: int) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(dim, cell, blocks, groups): the groups of queries that a cell's candidates may matter to."""
    grouped: dict[int, list[tuple[int, int, int]]] = {}
    for dim, cell, g, parts in _groups(stats, known, query_group):
        grouped.setdefault(dim, []).append((cell, g, parts))
    out = []
    for dim, cells in stats.groupby("dim"):
        if dim not in grouped:
            continue
        centers = known[dim][0] if dim in known else np.zeros((1, int(dim)))
        norm = np.sqrt((centers * centers).sum(1))
        by_cell = {r.cell: r for r in cells.itertuples()}
        rows = max(1, min(block_rows, BLOCK_BYTES // (8 * int(dim))))
        asked = [(by_cell[cell], g, parts) for cell, g, parts in grouped[dim]]
        at = np.array([r.cell for r, _, _ in asked])
        reach, worst = np.array([r.reach for r, _, _ in asked]), np.array([r.worst for r, _, _ in asked])
        for r in cells.itertuples():
            near = ~(bound(centers[at] @ centers[r.cell], norm[at], reach, norm[r.cell], r.radius) < worst)  # not a number: unknown
            groups = sorted({(g, parts) for (_, g, parts), hit in zip(asked, near, strict=True) if hit})
            if groups:
                out.append((int(dim), int(r.cell), -(-int(r.n) // rows), groups))
    return out


def _by_integers(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As the search, with Python integers, a query at a time."""
    low, high = -(1 << 63), (1 << 63) - 1
    whole = np.frompyfunc(int, 1, 1)(x)
    out = []
    for row, a in enumerate(np.frompyfunc(int, 1, 1)(q)):
        scores = ((max(low, min(high, int(s))), int(i)) for s, i, name in zip((whole * a).sum(1), ids, names, strict=True) if name != own[row])
        out += [(row, score, i) for score, i in heapq.nsmallest(k, scores, key=lambda s: (-s[0], s[1]))]
    return tuple(np.array(c, np.int64) for c in (zip(*out, strict=True) if out else ([], [], [])))
