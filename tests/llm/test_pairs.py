"""Top-k search, SimHash and embedding near-duplicates against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from pyspark.sql import functions as F
from viaduct.llm import embed_dedup, simhash, topk
from viaduct.llm.common import connected_components
from viaduct.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import SMALL, duck, rows

VECTORS = "vec_id long, embedding array<float>, label string, id string, v int, q int, pass int, block int"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert rows(QUERIES[name](spark, SMALL).toArrow()) == rows(duck(SMALL).execute(ORACLE_SQL[name]).to_arrow_table())


def vectors(spark, n=260, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).round(1)
    x[n // 2 :] = x[: n - n // 2] + rng.choice([0.0, 0.1], (n - n // 2, dim))
    held = [(k, row.tolist(), "a", "x", 1, 2, 3, 4) for k, row in enumerate(x)]
    odd = [None, [], [None] * dim, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [0.0] * dim]
    held += [(n + k, v, None, None, None, None, None, None) for k, v in enumerate(odd)]
    held += [(None, x[0].tolist(), None, None, None, None, None, None), (n + 50, [1.0, 2.0], None, None, None, None, None, None)]
    return held, spark.createDataFrame(held, VECTORS)


def usable(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v)


def test_top_k_equals_brute_force(spark):
    held, df = vectors(spark)
    whole = {k: np.floor(256 * np.float32(v).astype(float)).astype(int) for k, v, *_ in held if k is not None and usable(v)}
    want = set()
    for a in (k for k in whole if k % 50 == 0):
        scores = sorted((-int(whole[a] @ v), b) for b, v in whole.items() if b != a and len(v) == len(whole[a]))
        want |= {(a, r + 1, b, -s) for r, (s, b) in enumerate(scores[:5])}
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).isEmpty()


def test_embedding_links_equal_brute_force(spark):
    held, df = vectors(spark)
    ok = [(k, np.float32(v).astype(float)) for k, v, *_ in held if k is not None and usable(v) and any(v)]
    links = {k: set() for k, *_ in held if k is not None}
    for a, x in ok:
        for b, y in ok:
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].add(b)
    roots = _roots(links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {k: (len(links[k]), roots[k], roots[k] == k) for k in links}
    assert embed_dedup.near_duplicates(df.limit(0)).isEmpty()


def test_small_blocks_keep_recall_and_dense_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1, 16))
    dense = base + 0.05 * rng.standard_normal((300, 16))
    pairs = np.repeat(rng.standard_normal((300, 16)), 2, axis=0) + 0.05 * rng.standard_normal((600, 16))
    x = np.concatenate([dense, pairs])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, block=64).collect()}
    want = hit.sum(1)
    assert all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.95 * want.sum()


def test_different_vectors_under_one_id_share_its_links(spark):
    held = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (5, [1.0, 0.1, 0.0]), (5, [0.0, 0.1, 1.0]), (7, [0.0, 0.0, 1.0]), (8, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(held, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(df, passes=3).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (5, 3, 1, False), (5, 3, 1, False), (7, 1, 1, False), (8, 0, 8, True)]


def test_recall_holds_within_a_hot_topic(spark):
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    spread, topic = unit(rng.standard_normal((4000, 64))), unit(rng.standard_normal(64))
    own = unit(rng.standard_normal((2000, 64)))
    far = unit(rng.standard_normal((1000, 64)))
    mate = rng.uniform(0.52, 0.64, (1000, 1))  # cosine of a pair's own parts: 0.90 to 0.93 with the topic
    own[1000:] = mate * own[:1000] + np.sqrt(1 - mate**2) * unit(far - (far * own[:1000]).sum(1, keepdims=True) * own[:1000])
    x = np.concatenate([spread, unit(np.sqrt(0.8) * topic + np.sqrt(0.2) * own)])
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, block=64).collect()}
    want = hit.sum(1)
    assert all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.97 * want.sum() > 0


def test_crowded_blocks_and_close_calls_are_settled(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    x = np.concatenate([base + 0.3 * rng.standard_normal((400, 8)), rng.standard_normal((200, 8))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    least = float(np.sort((unit @ unit.T)[np.triu_indices(600, 1)])[-30_000])  # a pair lies on the threshold
    hit = np.einsum("ik,jk->ij", unit, unit) >= least - 1e-15
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embed_dedup, "SAMPLE_ROWS", 4)  # blocks come out uneven, and are dealt as chunks
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, least=least, block=40, passes=12).collect()}
    assert all(got[k] <= n for k, n in enumerate(hit.sum(1).tolist()))
    assert sum(got.values()) >= 0.97 * hit.sum()


def test_codes_stay_within_their_doubt():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 64, 1000):
        x = rng.standard_normal((50, dim)) * rng.choice([1e-3, 1.0], (50, dim))
        ((_, unit),) = embed_dedup.unit_rows(pa.array(x.tolist()))
        back = embed_dedup.decoded(embed_dedup.coded(unit))
        rough = back.astype(np.float32) @ back.astype(np.float32).T
        assert np.abs(rough - unit @ unit.T).max() <= embed_dedup.doubt(dim)


def test_recall_on_many_blocks_of_real_vectors_with_planted_pairs(spark):
    """A figure of the README: pairs at cosine 0.90 to 0.95 planted among all vectors of sf0.1."""
    held = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").toArrow().column(0).to_pylist()
    x = np.array([v for v in held if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v) and any(v)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(8)
    side = rng.standard_normal(unit.shape)
    side -= (side * unit).sum(1, keepdims=True) * unit
    c = rng.uniform(0.9, 0.95, (len(unit), 1))
    unit = np.concatenate([unit, c * unit + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1, keepdims=True)])
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(unit)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in embed_dedup.near_duplicates(df, block=128).collect())
    print("recall", found / hit.sum())
    assert hit.sum() >= found >= 0.95 * hit.sum() > 1000


def test_top_k_over_many_cells_blocks_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    centers = 4 * rng.standard_normal((30, 8))
    x = (centers[rng.integers(0, 30, 1500)] + 0.1 * rng.standard_normal((1500, 8))).round(2)
    ids = np.arange(1500)
    ids[700:720] = 50  # one id names many rows
    x[900:910], ids[900:910] = x[0], 0  # rows repeated in full
    df = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * x).astype(int)
    want = []
    for a in np.flatnonzero(ids % 50 == 0).tolist():
        scores = sorted((-int(whole[a] @ whole[b]), int(ids[b])) for b in range(1500) if b != a)
        want += [(int(ids[a]), r + 1, b, -s) for r, (s, b) in enumerate(scores[:5])]
    for options in ({}, {"most_cells": 40, "query_group": 7, "block_rows": 50}):
        got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, **options)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_huge_components_are_summed_as_integers(spark):
    df = spark.createDataFrame([(0, [1e7, 3.0]), (1, [1e7 + 1, -1.0]), (2, [1e7 + 2, 5.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    whole = [[math.floor(256 * c) for c in v] for v in ([1e7, 3.0], [1e7 + 1, -1.0], [1e7 + 2, 5.0])]
    score = lambda a, b: min((1 << 63) - 1, sum(p * q for p, q in zip(whole[a], whole[b], strict=True)))
    assert got == [(0, 1, 3, (1 << 63) - 1), *sorted([(0, 2, 2, score(0, 2)), (0, 3, 1, score(0, 1))], key=lambda r: r[1])]


def test_fingerprints_do_not_notice_slices(monkeypatch):
    texts = [t for t in corpus() if t and len(t) < 5000]
    want = [simhash.fingerprint(t) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash, "SLICE_BYTES", size)
        assert [simhash.fingerprint(t) for t in texts] == want


def _roots(links):
    root = {}
    for k in sorted(links):
        stack = [k]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = k
                stack += links[x]
    return root


def brute_fingerprint(text, n=3):
    import re

    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", raw)
    grams = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeXYZé") for _ in range(rng.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    texts += [t.replace("a", "a", 1) + " end" for t in texts[:30]] + [t.upper() for t in texts[:10]] + texts[:10]
    return [*texts, "", None, " \t\n ", "one", "two words", "a\x1cb c\u00a0d e", "x " * 200_000]


def test_simhash_equals_brute_force(spark):
    texts = corpus()
    fps = [brute_fingerprint(t) for t in texts]
    links = {a: {b for b in range(len(fps)) if a != b and (fps[a] ^ fps[b]).bit_count() <= 3} for a in range(len(fps))}
    roots = _roots(links)
    df = spark.createDataFrame([(k, t, "c", "f", 1) for k, t in enumerate(texts)], "doc_id long, text string, component_id string, fp string, least int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {k: (f"{fps[k]:016x}", roots[k]) for k in range(len(texts))}
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))
    assert simhash.near_duplicates(df.limit(0)).isEmpty()


def test_keep_first_leaves_one_of_each_component_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    text = [" ".join(str(rng.randrange(1000)) for _ in range(40)) for _ in range(6)]
    held = [(None, text[0]), (None, text[0]), (None, text[1]), (None, text[2]), (3, text[2]), (4, text[3]), (4, text[4]), (4, text[4]), (9, text[4]), (1, text[5]), (2, text[5]), (None, None), (None, "")]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(None if k is None else str(k) if kind == "string" else k, t) for k, t in held], f"doc_id {kind}, text string")
        got = sorted((str(r.doc_id), r.text or "") for r in simhash.keep_first(df).collect())
        assert got == sorted([("None", text[0]), ("None", text[1]), ("3", text[2]), ("4", text[3]), ("4", text[4]), ("1", text[5]), ("None", "")])


@pytest.mark.parametrize("blocks", [4, 6])
def test_bit_slices_lose_no_pair_and_split_hot_keys(spark, monkeypatch, blocks):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = seeds[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    hot = (np.uint64(0xABCDEF) << np.uint64(40)) | rng.integers(0, 1 << 16, 300).astype(np.uint64)
    values = np.unique(np.concatenate([seeds, near, hot]))
    monkeypatch.setattr(simhash, "HOT_KEY", 64)
    signed = values.view(np.int64).tolist()
    links = {a: {b for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3} for a in signed}
    roots = _roots(links)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in simhash.near_components(fps, blocks=blocks).collect()}
    assert got == {k: roots[k] for k in signed if links[k]}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 180)] + [(5, k) for k in range(6, 60)] + [(7, 7), (None, 3), (300, 299)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 181)} | {k: 5 for k in range(5, 60)} | {299: 299, 300: 299}


def test_passes_that_run_out_are_an_error(monkeypatch):
    x = np.random.default_rng(3).standard_normal((600, 16))
    codes = embed_dedup.coded(x / np.sqrt((x * x).sum(1, keepdims=True)))
    monkeypatch.setattr(embed_dedup, "MOST_PASSES", 2)
    assert len(embed_dedup.plan(codes, 30_000, 64, 0.9, 0.999, 7, 2)) == 2
    with pytest.raises(RuntimeError, match="2 passes bring"):
        embed_dedup.plan(codes, 30_000, 64, 0.9, 0.999, 7, None)
