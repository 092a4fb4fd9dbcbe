"""SimHash near-duplicates: fingerprints of word shingles, compared in bit-sliced form."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.common import bounded, connected_components, cut_lineage, every_column, fresh

SEED = 42
SLICE_BYTES = 1 << 20
HOT_KEY = 4096
_SPACE = re.compile(rb"[\x09-\x0d ]")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text, as a signed integer; 0 if it has no words."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode().lower()  # bytes.lower touches A-Z only
    total, ones, carried, at = 0, np.zeros(64, np.int64), [], 0
    while at < len(raw) or not at:
        end = len(raw)
        if end - at > SLICE_BYTES and (found := _SPACE.search(raw, at + SLICE_BYTES)):
            end = found.start()
        words = carried + raw[at:end].split()
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        if end == len(raw) and not total and 0 < len(words) < shingle:
            grams = [b" ".join(words)]
        hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        total += len(hashes)
        for k in range(0, len(hashes), 8192):
            part = hashes[k : k + 8192].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        carried = words[1 - shingle :] if shingle > 1 else []
        at = max(end, 1)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")
    return out.withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- bit-sliced comparison


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Plane k holds bit k of all values, 64 values in a word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    padded = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _moved(planes: np.ndarray, d: int) -> np.ndarray:
    """Planes whose bit i is bit i + d of ``planes``."""
    words, bits = divmod(d, 64)
    out = np.zeros_like(planes)
    left = planes[..., words:]
    if bits:
        out[..., : left.shape[-1]] = left >> np.uint64(bits)
        out[..., : left.shape[-1] - 1] |= left[..., 1:] << np.uint64(64 - bits)
    else:
        out[..., : left.shape[-1]] = left
    return out


def within(planes: np.ndarray, wanted: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Mask of positions i in ``wanted`` whose value differs from that at i + d in at most ``radius`` bits.

    Differences of three planes at a time go through a carry-save adder into vertical counters that
    start so that the first overflow means "beyond the radius"; the block is abandoned once every
    wanted position has overflowed.
    """
    levels = max(1, radius.bit_length())
    spare = (1 << levels) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counter = [np.full(planes.shape[1], full if spare >> k & 1 else 0, np.uint64) for k in range(levels)]
    alive = wanted.copy()
    for at in range(0, 64, 3):
        x = planes[at : at + 3] ^ _moved(planes[at : at + 3], d)
        if len(x) == 3:
            half = x[0] ^ x[1]
            ones, twos = half ^ x[2], (x[0] & x[1]) | (half & x[2])
        else:
            ones, twos = x[0], None
        carry = counter[0] & ones
        counter[0] ^= ones
        for k in range(1, levels):
            if k == 1 and twos is not None:  # counter, carry and twos have the same weight
                half = counter[1] ^ carry
                carry, counter[1] = (counter[1] & carry) | (half & twos), half ^ twos
                continue
            carry, counter[k] = counter[k] & carry, counter[k] ^ carry
        if levels == 1 and twos is not None:
            alive &= ~twos
        alive &= ~carry
        if not alive.any():
            break
    return alive


def _positions(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the sets of a[k] and b[k]; root holds the smallest index of each set, fully compressed."""
    differs = root[a] != root[b]
    if not differs.any():
        return
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    for x, y in set(zip(root[a[differs]].tolist(), root[b[differs]].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    moved = np.array(sorted(parent), np.int64)
    target = np.arange(len(root))
    target[moved] = [top(int(x)) for x in moved]
    root[:] = target[root]


def linked_sets(values: np.ndarray, group: np.ndarray, radius: int, wide: int = 32) -> np.ndarray:
    """Smallest index of the set that each value is linked into; only values of a group are compared.

    Equal groups must be adjacent.  Distances below ``wide`` run over all values at once, larger ones
    over each large group.
    """
    n = len(values)
    root = np.arange(n)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))

    def compare(lo: int, hi: int, distances: range) -> None:
        planes = bit_planes(values[lo:hi])
        g = group[lo:hi]
        for d in distances:
            same = np.zeros(planes.shape[1] * 64, np.uint8)
            same[: hi - lo - d] = g[d:] == g[:-d]
            found = _positions(within(planes, np.packbits(same, bitorder="little").view("<u8"), d, radius), hi - lo)
            if len(found):
                _unite(root, found + lo, found + lo + d)

    if n:
        compare(0, n, range(1, min(wide, int(sizes.max()))))
    for lo, size in zip(starts[sizes > wide].tolist(), sizes[sizes > wide].tolist(), strict=True):
        compare(lo, lo + size, range(wide, size))
    return root


def masks(blocks: int, radius: int) -> list[int]:
    """Masks of which two values within ``radius`` bits agree on at least one (pigeonhole over blocks)."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    out = [sum(block[k] for k in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def near_components(fps: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(node, root) of each fingerprint that has another within ``radius`` bits, over distinct ``fp``.

    Candidates share the bits of one of C(blocks, radius) masks, so no pair is lost.  ``blocks`` only
    trades shuffled rows for bucket size; by default it is the least that keeps an even bucket under
    64 values.  A bucket over HOT_KEY values is dealt out as pairs of sub-blocks, all compared.
    """
    if blocks is None:
        n = fps.count()
        blocks = next((b for b in range(radius + 1, 7) if n < 64 << (64 * (b - radius) // b)), 7)
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(blocks, radius))])).alias("k")
    spread = fps.select("fp", keys).select("fp", "k.t", "k.key")
    counted = spread.groupBy("t", "key").agg(F.count("*").alias("n"))
    hot = cut_lineage(counted.where(F.col("n") > HOT_KEY))
    if hot.isEmpty():
        dealt = spread.withColumn("part", F.lit(0).cast("long"))
    else:
        s = F.ceil(F.col("n") / F.lit(HOT_KEY))
        own = F.pmod(F.xxhash64("fp"), F.col("s"))
        pairs = F.when(F.col("s").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda u: F.least(u, F.col("own")) * F.col("s") + F.greatest(u, F.col("own"))))
        dealt = spread.join(hot.withColumn("s", s), ["t", "key"], "left").withColumn("own", own)
        dealt = dealt.select("fp", "t", "key", F.explode(pairs).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1)) if len(rows) else np.zeros(0, bool)
            root = linked_sets(rows[:, 3].copy().view(np.uint64), np.cumsum(new), radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(rows[moved, 3]), pa.array(rows[root[moved], 3])], ["a", "b"])

        for batch in batches:
            held.append(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]))
            if sum(map(len, held)) < 8192:
                continue
            rows = np.concatenate(held)
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
            keep = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if keep:
                yield edges(rows[:keep])
            held = [rows[keep:]]
        if held:
            yield edges(np.concatenate(held))

    ordered = dealt.select("t", "key", "part", "fp").repartition("t", "key", "part").sortWithinPartitions("t", "key", "part", "fp")
    return connected_components(ordered.mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3, blocks: int | None = None) -> DataFrame:
    """Fingerprint and component of every row: id_col, fingerprint (16 hex digits), component_id.

    Rows link if their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    id reachable.  Copies collapse into their fingerprint before any comparison.  Null and blank
    texts have fingerprint zero and link like any other; rows with a null id are kept, take part and
    get their component's smallest id (null if it has none); repeated rows each get a row; an empty
    table gives no rows; other columns are ignored.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    classes = cut_lineage(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = near_components(classes.select("fp"), radius, blocks)
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(least, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: that with the smallest id, nulls last.

    A document is an id and a text, so null and repeated ids lose none: of several texts under the
    smallest id one of that component stays, and of rows equal in both whichever comes first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))  # null and empty have one fingerprint
    own = F.col(id_col).cast("string")
    key = F.sha2(F.concat(F.length(own).cast("string"), F.lit(":"), own, F.lit("/"), text), 256)
    key = F.coalesce(key, F.sha2(F.concat(F.lit("/"), text), 256))  # of an id and a text, or of a text without an id
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), key.alias("key")).alias("doc"), F.col(text_col).alias("text"))
    found = near_duplicates(keyed, "doc", "text", **options)
    name = fresh("doc_key", docs)
    kept = found.where(F.col("doc") == F.col("component_id")).select(F.col("doc.key").alias(name)).distinct()
    # Both steps go by the one key, so the texts are shuffled once.
    return docs.withColumn(name, key).join(kept, name, "left_semi").dropDuplicates([name]).select(*every_column(docs))
