"""How the sources of a language differ in their words: an exact recount through minimal perfect hashes."""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from viaduct.llm.common import beside, bounded, cut_lineage

LEAST_DOCS, TOP = 10, 10
SHARD_TERMS = 1 << 16  # of a language's terms in one perfect hash, on average
SWEEP_BYTES = 64 << 20  # of perfect hashes that are broadcast at once
HELD_TERMS = 1 << 18  # of different terms counted before a task hands them on
SLOT_BYTES = 128 << 20  # of dense counters in a task
BLOCK_CELLS = 1 << 17  # sources times terms compared at once
LEVELS = 24
SEED = 42  # of Spark's xxhash64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Stretches of letters A-Z, a-z and signs beyond ASCII, of which A-Z alone are lower-cased."""
    return text.encode().translate(_FOLD).split()


def spread(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(t, SEED) for t in terms), np.uint64, len(terms))


@dataclass
class PerfectHash:
    """Slots 0 to n - 1 of n terms, and the terms themselves by slot.

    A term stands at the first level at which it shares its bit with no other term left; its slot
    is the number of bits set before.  What no level parts, equal hashes above all, is kept by name.
    """

    sizes: list[int]
    bits: np.ndarray
    before: np.ndarray
    terms: pa.Array
    rest: dict[bytes, int]

    @classmethod
    def build(cls, terms: list[bytes]) -> PerfectHash:
        left, names = hashes_of(terms), np.arange(len(terms))
        sizes, bits, owners = [], [], []
        while len(left) and len(sizes) < LEVELS:
            size = 64 * -(-2 * len(left) // 64)
            at = (spread(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            mask, owner = np.zeros(size, bool), np.zeros(size, np.int64)
            mask[at[alone]], owner[at[alone]] = True, names[alone]
            sizes.append(size)
            bits.append(np.packbits(mask, bitorder="little").view(np.uint64))
            owners.append(owner[mask])
            left, names = left[~alone], names[~alone]
        words = np.concatenate(bits) if bits else np.zeros(0, np.uint64)
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        order = np.concatenate([*owners, names]).astype(np.int64).tolist()
        first = len(order) - len(names)
        return cls(sizes, words, before, pa.array([terms[k] for k in order], pa.binary()), {terms[k]: first + n for n, k in enumerate(names.tolist())})

    def slots(self, terms: list[bytes], keys: np.ndarray) -> np.ndarray:
        """Each term's slot, -1 for others; ``keys`` are the terms' hashes."""
        found, left, offset = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = spread(keys[left], level) % np.uint64(size) + np.uint64(offset)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            there = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[left[there]] = (self.before[word] + np.bitwise_count(below))[there]
            left, offset = left[~there], offset + size
        some = np.flatnonzero(found >= 0)
        held = pc.equal(self.terms.take(pa.array(found[some])), pa.array(terms, pa.binary()).take(pa.array(some)))
        found[some[~held.to_numpy(zero_copy_only=False)]] = -1
        if self.rest:
            for k in left.tolist():
                found[k] = self.rest.get(terms[k], -1)
        return found


def _plain(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source"), F.coalesce(text_col, F.lit("")).alias("text"))


def _rows(names: list[str], columns: list[list], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def frequent_terms(plain: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, docs) of the terms in at least ``least_docs`` documents of a language.

    A task counts up to HELD_TERMS different terms before it hands them on, so what is shuffled is
    counts, never the words of a document.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, seen in held.items():
                names = list(seen)
                for at in range(0, len(names), 1 << 16):
                    some = names[at : at + (1 << 16)]
                    term = pa.array(some, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), term, pa.array([seen[t] for t in some], pa.int64())], ["lang", "term", "docs"])
            held.clear()

        for batch in bounded(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang].update(set(terms_of(text)))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from hand_on()
        yield from hand_on()

    partial = plain.select("lang", "text").mapInArrow(count, "lang string, term string, docs long")
    return partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)


def perfect_hashes(vocabulary: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, shard, terms, hash, names) for shards of about SHARD_TERMS terms by the term's hash."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash.build([t.encode() for t in sorted(group["term"])])
        names = made.terms.cast(pa.string()).to_pylist()
        return pd.DataFrame({"lang": [group["lang"].iat[0]], "shard": [group["shard"].iat[0]], "terms": [len(names)], "hash": [pickle.dumps(made, protocol=5)], "names": [names]})

    shards = F.ceil(F.col("kept") / SHARD_TERMS)
    dealt = vocabulary.join(beside(kept), "lang").select("lang", "term", F.pmod(F.xxhash64("term"), shards).alias("shard"))
    return dealt.groupBy("lang", "shard").applyInPandas(build, "lang string, shard long, terms long, hash binary, names array<string>")


def recount(plain: DataFrame, hashes: DataFrame) -> DataFrame:
    """(lang, source, slot, n), n > 0: how often a group has the term of a slot.

    ``hashes`` comes from :func:`perfect_hashes`, cut from its lineage.  Hashes of up to SWEEP_BYTES
    (or a single shard) are broadcast at once; a larger vocabulary takes several sweeps over the
    texts.  A task increments a dense array for each group that it meets and hands on what is not
    zero when those take SLOT_BYTES.  A slot counts from the first shard of its language on.
    """
    shards = sorted(hashes.select("lang", "shard", "terms", F.octet_length("hash")).collect())  # a row for SHARD_TERMS terms
    base, at, sweeps = {}, Counter(), []
    for lang, shard, terms, size in shards:
        base[lang, shard] = at[lang]
        at[lang] += terms
        if not sweeps or sum(x for *_, x in sweeps[-1]) + size > SWEEP_BYTES:
            sweeps.append([])
        sweeps[-1].append((lang, shard, terms, size))
    total = {lang: -(-n // SHARD_TERMS) for lang, n in at.items()}  # shards, empty ones included
    spark, kinds = plain.sparkSession, [pa.string(), pa.string(), pa.int64(), pa.int64()]
    counted = []
    for sweep in sweeps:
        wanted = spark.createDataFrame([(lang, shard) for lang, shard, *_ in sweep], "lang string, shard long")
        blobs = {(r.lang, r.shard): bytes(r.hash) for r in hashes.select("lang", "shard", "hash").join(F.broadcast(wanted), ["lang", "shard"]).collect()}
        span = {lang: (min(base[x, s] for x, s, *_ in sweep if x == lang), sum(n for x, _, n, _ in sweep if x == lang)) for lang, *_ in sweep}
        held = spark.sparkContext.broadcast((blobs, {k: base[k] for k in blobs}, {lang: total[lang] for lang in span}, span))

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            blobs, base, total, span = held.value
            known = {k: pickle.loads(v) for k, v in blobs.items()}
            slots: dict[tuple[str, str], np.ndarray] = {}

            def hand_on() -> Iterator[pa.RecordBatch]:
                for (lang, source), dense in slots.items():
                    some = np.flatnonzero(dense)
                    for at in range(0, len(some), 1 << 16):
                        part = some[at : at + (1 << 16)]
                        yield _rows(["lang", "source", "slot", "n"], [[lang] * len(part), [source] * len(part), part + span[lang][0], dense[part]], kinds)
                slots.clear()

            for batch in bounded(batches):
                seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
                for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if lang in span:
                        seen[lang, source].update(terms_of(text))
                for (lang, source), words in seen.items():
                    names, often = list(words), np.fromiter(words.values(), np.int64, len(words))
                    keys = hashes_of(names)
                    of = (keys.view(np.int64) % total[lang]) if total[lang] > 1 else np.zeros(len(keys), np.int64)
                    if (lang, source) not in slots:
                        if slots and sum(x.nbytes for x in slots.values()) + 8 * span[lang][1] > SLOT_BYTES:
                            yield from hand_on()
                        slots[lang, source] = np.zeros(span[lang][1], np.int64)
                    dense = slots[lang, source]
                    for shard in np.unique(of).tolist():
                        if (lang, shard) in known:
                            mine = np.flatnonzero(of == shard)
                            slot = known[lang, shard].slots([names[k] for k in mine.tolist()], keys[mine])
                            there = slot >= 0
                            dense[slot[there] + base[lang, shard] - span[lang][0]] += often[mine[there]]
            yield from hand_on()

        counted.append(plain.mapInArrow(count, "lang string, source string, slot long, n long"))
    if not counted:
        return spark.createDataFrame([], "lang string, source string, slot long, n long")
    every = counted[0]
    for more in counted[1:]:
        every = every.unionByName(more)
    return every.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def share(n: str | Column, total: str, kept: str) -> Column:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * kept)), exactly."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {kept} AS DECIMAL(20,0))")


def between(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); the square of a share fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def compare_pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all pairs of sources of a language, in both orders.

    ``counts``: (lang, slot, source, p) where a source has the term; ``groups``: (lang, source, p,
    kept, sources), p of a term that the source lacks.  A language's slots are cut into blocks of
    BLOCK_CELLS cells over its sources; a block's shares form a table of sources by slots.
    """
    wide = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_CELLS) / F.col("sources")))
    blocks = groups.withColumn("wide", wide).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("kept") - 1, F.lit(0)) / F.col("wide")))))
    width = cut_lineage(groups.select("lang", wide.alias("wide")).distinct())
    cells = counts.join(beside(width), "lang").withColumn("block", F.floor(F.col("slot") / F.col("wide")))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sources = sorted(right["source"])
        if len(sources) < 2:
            return pd.DataFrame({c: np.array([], object) for c in ("lang", "source", "item", "value")})
        place, lacking = {s: k for k, s in enumerate(sources)}, dict(zip(right["source"], right["p"], strict=True))
        block, wide, kept = int(right["block"].iat[0]), int(right["wide"].iat[0]), int(right["kept"].iat[0])
        slots = max(0, min(wide, kept - block * wide))
        p = np.repeat(np.array([lacking[s] for s in sources], np.int64)[:, None], slots, axis=1)
        if len(left):
            p[left["source"].map(place).to_numpy(), left["slot"].to_numpy() - block * wide] = left["p"].to_numpy()
        one, two, value = [], [], []
        for k in range(len(sources) - 1):
            apart, both = p[k + 1 :] - p[k], p[k + 1 :] + p[k]
            value += (apart * apart // both).sum(1).tolist()
            one += [sources[k]] * (len(sources) - k - 1)
            two += sources[k + 1 :]
        text = lambda x: np.array(x, object)
        return pd.DataFrame({"lang": text([right["lang"].iat[0]] * 2 * len(one)), "source": text(one + two), "item": text(two + one), "value": np.array(value + value, np.int64)})

    met = cells.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block"))
    return met.applyInPandas(compare, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others.

    A language keeps the terms in at least ``least_docs`` of its documents; a group's share of a term
    is its smoothed count per thousand million.  Part ``pair``: each other source, by the sum over all
    kept terms of the squared difference of shares over their sum.  Part ``term``: up to ``top`` terms
    that the source has more of than the language.  All numbers are exact.

    A first pass finds the kept terms, a second counts them through broadcast perfect hashes that
    check the term itself.  Results for pairs are as many as there are pairs of sources.

    Null texts, languages and sources are read as ''; a language without kept terms has distances
    of 0; of equal values the smaller item comes first; repeated rows count as often as they come;
    very long texts are read whole; an empty table gives no rows; other columns are not read.
    """
    plain = _plain(docs, lang_col, source_col, text_col)
    vocabulary = cut_lineage(frequent_terms(plain, least_docs))
    kept = cut_lineage(vocabulary.groupBy("lang").agg(F.count("*").alias("kept")))
    hashes = cut_lineage(perfect_hashes(vocabulary, kept))
    counts = cut_lineage(recount(plain, hashes))

    shards = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = hashes.select("lang", "names", F.coalesce(F.sum("terms").over(shards), F.lit(0)).alias("base"))
    lexicon = based.select("lang", "base", F.posexplode("names").alias("k", "term")).select("lang", (F.col("base") + F.col("k")).alias("slot"), "term")

    groups = plain.select("lang", "source").distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    many = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").join(many, "lang").fillna(0, ["total", "kept"])
    groups = cut_lineage(groups.withColumn("p", F.when(F.col("kept") > 0, share("0", "total", "kept")).otherwise(0)))
    whole = cut_lineage(groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("kept").alias("kept")))

    named = counts.groupBy("lang", "slot").agg(F.sum("n").alias("lang_n")).join(lexicon, ["lang", "slot"]).join(beside(whole), "lang")
    named = named.select("lang", "slot", "term", share("lang_n", "lang_total", "kept").alias("q"))
    shares = counts.join(beside(groups.select("lang", "source", "total", "kept")), ["lang", "source"]).select("lang", "source", "slot", share("n", "total", "kept").alias("p"))
    more = shares.join(named, ["lang", "slot"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), between("p", "q").alias("value"))
    pairs = compare_pairs(shares, groups.drop("total")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
