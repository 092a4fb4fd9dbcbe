"""Embedding near-duplicates by sorted projection passes over bounded neighbour windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viaduct.llm.common import bounded, connected_components, cut_lineage

BLOCK = 8192
GRAINS = 8
MOST_BLOCKS = 8192
SAMPLE_ROWS = 65_536
MOST_PASSES = 256
KEY_BITS = 62
LEVELS = 32_767
CHUNK = 2048


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 unit vectors) for each dimension that occurs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    out = []
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        x = flat[start[rows][:, None] + np.arange(dim)]
        x /= np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
        out.append((rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def coded(x: np.ndarray) -> np.ndarray:
    """Unit vectors in 16 bits a component, scaled so that the largest uses them all."""
    return np.rint(x * (LEVELS / np.abs(x).max(axis=1, keepdims=True))).astype(np.int16)


def decoded(code: np.ndarray) -> np.ndarray:
    x = code.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def doubt(dim: int) -> float:
    """How far the single-precision product of two decoded vectors can be from their cosine.

    Rounding moves a component by half a level of its vector's largest, which is at most the length:
    a vector by sqrt(dim) / 2 levels, twice that once it is scaled to length one again; a product of
    two vectors by as much for each.  Single precision adds dim roundings of products of unit vectors.
    """
    return 2 * math.sqrt(dim) / LEVELS + (dim + 4) * 2.0**-23


def planes(p: int, dim: int, seed: int) -> np.ndarray:
    """Whole-numbered random directions of pass ``p``, so that a key is the same however it is computed."""
    return np.rint(1000 * np.random.default_rng([seed, p, dim]).standard_normal((dim, KEY_BITS)))


def keys(code: np.ndarray, p: int, seed: int) -> np.ndarray:
    """The concatenated sign bits of each vector's projections in pass ``p``, leading bit first."""
    weight = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
    return (code.astype(np.float64) @ planes(p, code.shape[1], seed) > 0) @ weight


@dataclass
class Order:
    """Where the sorted order of each pass is cut into grains; GRAINS of them are a block.

    A vector is compared with its whole block and, as a neighbour, with the block after its own if it
    is in the last grain.
    """

    cuts: dict[int, list[np.ndarray]]  # for each dimension and pass, the first key of each grain but the first
    seed: int

    def passes(self, dim: int) -> int:
        return len(self.cuts.get(dim, [None]))

    def grain(self, code: np.ndarray, p: int) -> np.ndarray:
        """The grain of each vector; all are in one where the dimension was not sampled."""
        cuts = self.cuts.get(code.shape[1])
        if cuts is None or not len(cuts[p]):
            return np.zeros(len(code), np.int64)
        return np.searchsorted(cuts[p], keys(code, p, self.seed), side="right")

    @staticmethod
    def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether vectors of these grains are compared."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = high // GRAINS - low // GRAINS
        return (apart == 0) | (apart == 1) & (low % GRAINS == GRAINS - 1)


def plan(codes: np.ndarray, n: int, block: int, least: float, recall: float, seed: int, passes: int | None) -> list[np.ndarray]:
    """Cuts of as many passes as the wanted recall takes, as measured on the sample.

    Each of up to 1000 sampled vectors gets a partner at cosine ``least`` in a random direction; passes
    are added until the expected share of such pairs that met is ``recall`` over all of the sample and
    over each quarter of it, ordered by how crowded the vectors' surroundings are (so a hot topic
    cannot hide behind the rest).
    """
    blocks = min(MOST_BLOCKS, -(-n // block))
    if blocks <= 1:
        return [np.zeros(0, np.int64)]
    rng = np.random.default_rng(seed)
    probe = decoded(codes[rng.permutation(len(codes))[:1000]])
    side = rng.standard_normal(probe.shape)
    side -= (side * probe).sum(1, keepdims=True) * probe
    mate = least * probe + math.sqrt(1 - least * least) * side / np.sqrt((side * side).sum(1, keepdims=True))
    crowd = np.argsort((probe @ probe.T).mean(1), kind="stable")
    quarters = np.array_split(crowd, 4)
    a, b = coded(probe), coded(mate)
    found, out = np.zeros(len(a), bool), []
    while True:
        order = np.sort(keys(codes, len(out), seed))
        at = np.unique(np.arange(1, blocks * GRAINS) * len(order) // (blocks * GRAINS))
        out.append(order[at])
        part = Order({codes.shape[1]: out}, seed)
        found |= Order.met(part.grain(a, len(out) - 1), part.grain(b, len(out) - 1))
        reached = min(found[q].mean() for q in quarters if len(q))
        if len(out) == passes or not passes and reached >= recall:
            return out
        if not passes and len(out) == MOST_PASSES:
            raise RuntimeError(f"{MOST_PASSES} passes bring {reached:.3f} of sampled pairs together; ask for less recall, larger blocks or a number of passes")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, passes: int | None = None, block: int | None = None, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """Links of cosine at least ``least`` found in any pass: id_col, n_links, component_id, kept.

    In each pass vectors are ordered by concatenated random sign hashes, and each is compared with its
    block of about ``block`` vectors in that order and with the neighbours just before it (see
    :class:`Order`); links of all passes are united.  Where the order is cut, and how many passes
    bring ``recall`` of pairs at the threshold together, follows from a sample of at most SAMPLE_ROWS
    vectors; every vector is compared in every pass.  Blocks hold a sixth of a small table
    and 8192 vectors of a larger one, more only beyond MOST_BLOCKS blocks.  A block that is larger
    than planned is dealt out as pairs of chunks, all compared.

    What is shuffled are codes of 16 bits a component.  They decide all pairs but those within
    :func:`doubt` of the threshold, whose vectors then meet in full.  A pair counts in the first pass
    that compares it; passes before are worked out from the codes, so there is no list of pairs.
    Equal vectors are compared as one and counted as many.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths do not link; a row with a null id links with nothing and has a null
    component; repeated rows are vectors of their own (equal, so linked), and different vectors under
    one id share its links: their numbers are added and their components joined; an empty table gives
    no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("name"), F.when(F.col(id_col).isNotNull() & usable(F.col(vector_col)), F.col(vector_col)).alias("v"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))  # 128 bits stand for a vector
    # From here to the end a distinct vector goes by a number of its own, as several may have one id.
    usable_rows = rows.where("v is not null")
    named = usable_rows.groupBy("h1", "h2", "name").agg(F.count("*").alias("copies"))
    classes = usable_rows.groupBy("h1", "h2").agg(F.min("name").alias("least"), F.count("*").alias("m"), F.first("v").alias("v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for at, x in unit_rows(batch.column("v")):
                code = coded(x)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in code], pa.binary())], [*batch.schema.names, "code"])

    kind = T.StructType([*classes.withColumn("id", F.lit(0).cast("long")).schema.fields, T.StructField("code", T.BinaryType())])
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()).mapInArrow(encode, kind))
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("h1", "h2"), "id").limit(SAMPLE_ROWS).select("code").toArrow().column("code").to_pylist() if n else []
    size = block or max(1024, min(BLOCK, n // 6))
    cuts = {}
    for width in {len(c) for c in sample}:
        codes = np.frombuffer(b"".join(c for c in sample if len(c) == width), np.int16).reshape(-1, width // 2)
        cuts[width // 2] = plan(codes, -(-n * len(codes) // len(sample)), size, least, recall, seed, passes)
    order = Order(cuts, seed)
    held = spark.sparkContext.broadcast(order)  # MOST_BLOCKS * GRAINS numbers a pass at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pass and block: ``grain`` is negative (its complement) for a neighbour of the block."""
        order = held.value
        for batch in bounded(batches):
            raw = batch.column("code").to_pylist()
            width = np.fromiter(map(len, raw), np.int64, len(raw))
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                code = np.frombuffer(b"".join(raw[k] for k in at), np.int16).reshape(-1, w // 2)
                for p in range(order.passes(w // 2)):
                    grain = order.grain(code, p)
                    for some, step in ((np.arange(len(at)), 0), (np.flatnonzero(grain % GRAINS == GRAINS - 1), 1)):
                        part = batch.take(pa.array(at[some]))
                        made = [np.full(len(some), w // 2), np.full(len(some), p), grain[some] // GRAINS + step, ~grain[some] if step else grain[some]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in made), *(part.column(c) for c in ("id", "m", "code"))], ["dim", "pass", "block", "grain", "id", "m", "code"])

    dealt = classes.select("id", "m", "code").mapInArrow(deal, "dim int, pass int, block int, grain int, id long, m long, code binary")
    most = 2 * size
    sizes = classes.select("id", "m", "code").mapInArrow(deal, dealt.schema).groupBy("dim", "pass", "block").count().where(F.col("count") > most) if cuts and n > most else None
    crowded = cut_lineage(sizes) if sizes is not None else None
    one = F.lit(0)
    if crowded is None or crowded.isEmpty():
        dealt = dealt.select("*", one.alias("left"), one.alias("right"), one.alias("chunk"))
    else:  # every pair of chunks of a crowded block meets in a task of its own
        chunks = F.ceil(F.col("count") / F.lit(size)).cast("int")
        found = dealt.join(F.broadcast(crowded.withColumn("chunks", chunks).drop("count")), ["dim", "pass", "block"], "left")  # at most passes * n / size rows
        own = F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
        dealt = found.withColumn("chunk", own).select("*", other.alias("o")).select(*dealt.columns, F.least("chunk", "o").alias("left"), F.greatest("chunk", "o").alias("right"), "chunk")
    group = ("dim", "pass", "block", "left", "right")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        return _compare(table, key, held.value, least)

    shape = "dim int, pass int, block int, left int, right int, id long, links long, root long, unsure boolean"
    sure = cut_lineage(dealt.groupBy(*group).applyInArrow(compare, shape))
    open_ = sure.where("unsure").select(*group, "id")
    found = sure.where("NOT unsure").select("id", "links", "root")
    if not open_.isEmpty():
        full = dealt.join(open_, [*group, "id"]).join(classes.select("id", "v"), "id")
        found = found.unionByName(cut_lineage(full.groupBy(*group).applyInArrow(compare, shape)).select("id", "links", "root"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = cut_lineage(named.join(classes.select("h1", "h2", "id"), ["h1", "h2"]).select("name", "id", "copies"))
    shared = by_class.groupBy("name").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("b < last").drop("last").join(by_class, "name")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(shared.select(F.col("id").alias("a"), "b"))
    roots = connected_components(edges)
    facts = classes.select("id", "least", "m").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    facts = cut_lineage(facts.select("id", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")))
    smallest = facts.groupBy("root").agg(F.min("least").alias("component_id"))
    known = facts.join(smallest, "root").select("id", "n_links", "component_id")
    by_name = by_class.join(known, "id").groupBy("name").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"), F.sum("copies").alias("copies"))
    out = by_name.select("name", "n_links", "component_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
    out = out.unionByName(rows.where("v is null").select("name", F.lit(0).cast("long").alias("n_links"), F.col("name").alias("component_id")))
    return out.select(F.col("name").alias(id_col), "n_links", "component_id", F.coalesce(F.col("name") == F.col("component_id"), F.lit(True)).alias("kept"))


def _compare(table: pa.Table, key: tuple, order: Order, least: float) -> pa.Table:
    """Links of a block, or of two of its chunks; a row for each vector that has any.

    ``unsure`` rows are vectors with pairs too close to the threshold for codes to say.  Where the
    table has the vectors themselves, only such pairs are settled.
    """
    dim, p, block, left, right = (k.as_py() for k in key)
    ids, m, grain, chunk = (table.column(c).to_numpy() for c in ("id", "m", "grain", "chunk"))
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int16).reshape(-1, dim)
    x = decoded(code).astype(np.float32)
    full = unit_rows(table.column("v"))[0][1] if "v" in table.column_names else None
    neighbour, margin = grain < 0, doubt(dim)
    earlier = [order.grain(code, q) for q in range(p)]
    links, root, open_ = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)
    first, second = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
    for lo in range(0, len(first), CHUNK):
        a = first[lo : lo + CHUNK]
        for hi in range(lo if left == right else 0, len(second), CHUNK):
            b = second[hi : hi + CHUNK]
            rough = x[a] @ x[b].T
            s, t = np.nonzero(rough >= least - margin)
            near = rough[s, t]
            s, t = a[s], b[t]
            keep = ~(neighbour[s] & neighbour[t])  # two neighbours meet in their own block
            if left == right:
                keep &= s < t
            for q in range(p):  # compared in an earlier pass
                if not keep.any():
                    break
                keep &= ~Order.met(earlier[q][s], earlier[q][t])
            s, t, near = s[keep], t[keep], near[keep]
            close = near < least + margin
            if full is None:
                open_[s[close]] = open_[t[close]] = True
                hit = ~close
            else:
                hit = close.copy()
                hit[close] = np.einsum("ij,ij->i", full[s[close]], full[t[close]]) >= least
            s, t = s[hit], t[hit]
            links += (np.bincount(s, m[t], len(ids)) + np.bincount(t, m[s], len(ids))).astype(np.int64)
            _unite(root, s, t)
    smallest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, ids)
    linked, unsure = np.flatnonzero(links), np.flatnonzero(open_)
    at = np.concatenate([linked, unsure])
    names = ("dim", "pass", "block", "left", "right")
    return pa.table(
        {n: pa.array(np.full(len(at), k), pa.int32()) for n, k in zip(names, (dim, p, block, left, right), strict=True)}
        | {"id": ids[at], "links": np.where(np.arange(len(at)) < len(linked), links[at], 0), "root": smallest[root[at]], "unsure": np.arange(len(at)) >= len(linked)}
    )


def _unite(root: np.ndarray, s: np.ndarray, t: np.ndarray) -> None:
    """Merges the sets of s[k] and t[k]; root holds each set's smallest row number."""
    while True:
        a, b = root[s], root[t]
        differs = a != b
        if not differs.any():
            return
        low, high = np.minimum(a, b)[differs], np.maximum(a, b)[differs]
        target = np.arange(len(root))
        np.minimum.at(target, high, low)
        while (target[target] != target).any():
            target = target[target]
        root[:] = target[root]
