"""Curriculum mixing, the divergence audit and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F
from viaduct.llm import common, curriculum, divergence, periodic, queries

MEDIUM = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, size int, target string, runs string, collapsed int, slot int, position int"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y", 1, 2, 3) for r in rows], DOCS)


# ---------------------------------------------------------------- mixing

RAMP = [(0.0, 3.0), (0.5, 1.0), (1.0, 2.0)]


def mixed_rows(seed=3):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows = [(k, text(rng.randrange(40)), "en", rng.choice(["hot", "hot", "hot", "b", "c", None])) for k in range(200)]
    return rows + [(500, None, "en", "b"), (501, "", "en", "b"), (502, " \t\x0b\n", "en", "b"), (None, "no id", "en", "b"), (None, "no id", "en", "b"), (3, rows[3][1], "en", rows[3][3]), (503, None, "en", "empty"), (504, text(30_000), "en", "b")]


def schedules(spark, knots):
    return spark.createDataFrame([(s, [(float(a), float(w)) for a, w in k]) for s, k in knots.items()], "source string, knots array<struct<at:double,weight:double>>")


def filled(sizes, weights, share, most):
    """The targets by filling up in turn."""
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), {s for s in sizes if weights[s] > 0}
    while open_ and left > 1e-9:
        rate = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + rate * weights[s] >= most * sizes[s]}
        for s in full or open_:
            step = most * sizes[s] - target[s] if full else rate * weights[s]
            target[s] += step
            left -= step
        if not full:
            break
        open_ -= full
    return target


@pytest.mark.parametrize("share", [0.3, 1.5, 2.0, 5.0])
def test_mix_meets_its_targets(spark, share):
    rows = mixed_rows()
    knots = {"hot": RAMP, "b": [(0, 1), (1, 3)], "c": [(0, 0), (1, 2)], None: [(0, 4), (0.25, 0), (1, 0)], "empty": [(0, 1), (1, 1)]}
    weights = {s: sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(k, k[1:], strict=False)) for s, k in knots.items()}
    got = curriculum.mix(table(spark, rows), schedules(spark, knots), share, 2.0).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], words(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = filled(sizes, weights, share, 2.0)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sizes[s] and mine[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in mine) == int(mine[0].target + 1e-9) and all(0 <= r.taken <= 2 * r.size for r in mine)
    for r in got:
        assert r.taken == sum(p.words for p in r.passes) and all(0 <= p.position <= 1 for p in r.passes)
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and all(r.position is None for r in got[len(placed) :])


def test_positions_invert_the_integral(spark):
    rows = [(k, "w " * 10, "en", "a" if k % 2 else "b") for k in range(400)]
    got = curriculum.mix(table(spark, rows), schedules(spark, {"a": RAMP, "b": [(0, 1), (1, 1)]}), 1.0, 1.0)
    for s, knots in (("a", RAMP), ("b", [(0.0, 1.0), (1.0, 1.0)])):
        mine = [(p.position, p.words, r.target) for r in got.collect() if r.source == s for p in r.passes]
        at, w = np.linspace(0, 1, 20_001), np.interp(np.linspace(0, 1, 20_001), *zip(*knots, strict=True))
        whole = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(at))))
        given = 0
        for position, words, target in sorted(mine):
            assert np.interp(position, at, whole) / whole[-1] == pytest.approx(given / target, abs=1e-4)
            given += words


def test_mix_is_the_same_again_and_of_nothing(spark):
    docs = table(spark, mixed_rows())
    plan = schedules(spark, {"hot": RAMP, "b": RAMP})
    once, twice = (sorted(map(str, curriculum.mix(d, plan).drop("passes", "position").collect())) for d in (docs, docs.repartition(7)))
    assert once == twice
    assert curriculum.mix(docs.limit(0), plan).isEmpty()
    order = curriculum.training_order(curriculum.mix(docs, plan)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and {r["pass"] for r in order} <= {0, 1}


def test_running_sums_across_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v")).repartition(5)
    got = {r.id: r.v_before for r in common.running_sums(df, [F.col("id")], v=F.col("v")).collect()}
    assert got == {k: sum(x % 7 for x in range(k)) for k in range(1000)}


# ---------------------------------------------------------------- divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, least=10, top=10):
    """The audit by its definition, in whole numbers."""
    docs = [((r[2] or ""), (r[3] or ""), [w.translate(LOWER) for w in WORD.findall(r[1] or "")]) for r in rows]
    in_docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        in_docs[lang].update(set(words))
        groups[lang].add(source)
        n[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, k in in_docs[lang].items() if k >= least), key=lambda t: t.encode())
        whole = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(n[lang, s]) for s in sources}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-apart(p[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


def told(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()}


def divergent_rows(seed=1):
    rng = random.Random(seed)
    words = ["été", "Ünder", "ΑΒγ", "İx", "ﬀ", "x²", "the", "The", "THE", *(f"w{chr(97 + k)}" for k in range(24)), "漢字", "a b", "😀"]
    rows = []
    for k in range(260):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "s3", None])
        pool = words[: 10 + 7 * len(source or "")] if k % 3 else words
        rows.append((k, "".join(rng.choice(pool) + rng.choice([" ", "\n", "1", ",", "_", "\x7f", "{"]) for _ in range(rng.randrange(60))), lang, source))
    return rows + [(None, "the the", "en", "s1"), (9, rows[9][1], rows[9][2], rows[9][3]), (600, None, "fr", "only"), (601, "the", "it", "a"), (602, "one", "it", "b"), (603, "123 ...", "en", "wordless"), (604, "the " * 40_000 + "été", "en", "s2")]


def test_audit_equals_its_definition(spark, monkeypatch):
    rows = divergent_rows()
    want = audited(rows)
    assert told(divergence.audit(table(spark, rows))) == want and {r[0] for r in want} >= {"", "en", "de", "it"}
    monkeypatch.setattr(divergence, "SHARD_TERMS", 5)  # many shards, some of them empty, and as many sweeps
    monkeypatch.setattr(divergence, "SWEEP_BYTES", 4000)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 16)
    assert told(divergence.audit(table(spark, rows))) == want
    assert told(divergence.audit(table(spark, rows), least_docs=40, top=2)) == audited(rows, 40, 2)


def test_audit_without_terms_or_rows(spark):
    rows = [(k, "rare", "en", f"s{k}") for k in range(3)]
    assert told(divergence.audit(table(spark, rows))) == audited(rows) and len(audited(rows)) == 6
    assert divergence.audit(table(spark, rows).limit(0)).isEmpty()


def test_perfect_hash_knows_its_terms_and_no_others(monkeypatch):
    terms = [f"t{k}é".encode() for k in range(5000)]
    for levels in (24, 2):  # too few levels leave terms that are kept by name
        monkeypatch.setattr(divergence, "LEVELS", levels)
        made = divergence.PerfectHash.build(terms)
        got = made.slots(terms, divergence.hashes_of(terms))
        assert sorted(got.tolist()) == list(range(5000)) and [made.terms[int(k)].as_py() for k in got] == terms
        others = [f"u{k}".encode() for k in range(5000)]
        assert (made.slots(others, divergence.hashes_of(others)) == -1).all() and bool(made.rest) == (levels == 2)
    assert (divergence.PerfectHash.build([]).slots([b"x"], divergence.hashes_of([b"x"])) == -1).all()


def test_dense_counts_are_handed_on_when_they_take_too_much(spark, monkeypatch):
    rows = divergent_rows(2)
    monkeypatch.setattr(divergence, "SLOT_BYTES", 100)
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    assert told(divergence.audit(table(spark, rows))) == audited(rows)


# ---------------------------------------------------------------- periodic runs


def every_run(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k + q < len(words):
            end = k
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end - k >= max(least, 2 * q) - q:
                found.setdefault((k, end + q), q)
            k = end + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repetitive(rng):
    pick = lambda n, al: [rng.choice(al) for _ in range(n)]
    kind = rng.randrange(7)
    if kind == 0:
        return pick(rng.randrange(700), "ab")
    if kind == 1:
        unit = pick(rng.randrange(1, 300), "abcdefgh")
        return pick(rng.randrange(90), "xyz") + (unit * 9)[: rng.randrange(2 * len(unit), 6 * len(unit))] + pick(40, "xyz")
    if kind == 2:
        return [w for _ in range(4) for w in ["a"] * rng.randrange(250) + ["b"] * rng.randrange(3)]
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        while len(b) < 700:
            a, b = b, b + a
        return b
    if kind == 4:
        inner = pick(rng.randrange(1, 9), "ab")
        unit = (inner * 99)[: rng.randrange(60, 260)] + pick(rng.randrange(2), "abc")
        return (unit * 6)[: rng.randrange(2 * len(unit), 6 * len(unit))]
    if kind == 5:
        return [w for _ in range(5) for w in (["a", "b"] * rng.randrange(10, 120))[rng.randrange(2) :]]
    twice = pick(rng.randrange(70, 200), "abcd") * 2
    for _ in range(rng.randrange(4)):
        twice[rng.randrange(len(twice))] = rng.choice("abcd")
    return twice * 3


@pytest.mark.parametrize("seed", range(12))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    texts = [" ".join(repetitive(rng)) for _ in range(12)] + ["", None, "a", "a " * 11, "a " * 12, "a b " * 12, "\x0ba\x1cb\tc " * 8]
    for text, (runs, left) in zip(texts, periodic.annotate(texts), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert runs == every_run(words) and left.decode() == collapsed(words, runs)


def test_runs_in_the_midst_of_long_texts():
    rng = random.Random(4)
    words = [str(int(rng.paretovariate(0.7))) for _ in range(60_000)]
    words[20_000:45_000] = (words[20_000:28_000] * 4)[:25_000]
    words[100:4100] = ["x"] * 4000
    runs, _ = periodic.annotate([" ".join(words)])[0]
    assert any(s <= 20_000 and q == 8000 and n >= 25_000 for s, n, q in runs) and any(q == 1 and n >= 4000 for _, n, q in runs)


def test_runs_of_a_table(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(repetitive(rng)), "en", None) for k in range(20)] + [(None, "a " * 30, None, None), (3, None, None, None), (3, "", None, None)]
    got = periodic.periodic_runs(table(spark, rows), ["doc_id", "text"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    for r in got:
        words = (r.text or "").split()
        assert [(x.start, x.length, x.period) for x in r.runs] == every_run(words) and r.collapsed == collapsed(words, every_run(words))
    assert periodic.periodic_runs(table(spark, rows).limit(0), ["doc_id"]).isEmpty()


def test_query_of_runs_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_runs(spark, MEDIUM).collect()}
    assert set(got) == set(docs)
    planted = 0
    for key, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(key).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = words[:a] + [words[a + (k - a) % p] for k in range(a, n)], planted + 1
        if n > 1500:
            continue  # the brute force takes a square of the words
        runs = every_run(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[key] == (len(runs), *first, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(collapsed(words, runs)))
    assert planted > 50
