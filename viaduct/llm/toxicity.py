"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding disguised letters."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viaduct.llm.common import bounded, cut_lineage, every_column, fresh

TOXIC_ROWS = 4000
CLEAN_ROWS = 12_000
LEAST_SUPPORT = 6
LEAST_WEIGHT = 3.0
BEGINNING = (3, 12)
BREAK = "|"

# Letters that look like Latin ones, and signs that stand for letters inside words.
_LOOK_ALIKE = str.maketrans("абвеікмнорстухѕјһԁԛԝαβεικνορτυχωı", "abbeikmhopctyxsjhdqwabeikvoptuxwi")
_LIKE = re.compile(f"[{''.join(map(chr, _LOOK_ALIKE))}]")
_STAND_IN = str.maketrans("013457@$", "oieasta" + "s")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_HAS_STAND_IN = re.compile("[013457@$]")
_MIXED = re.compile(r"(?<![\w@$])[^\W013457]*+[013457@$][\w@$]*+")
_ASCII = str.maketrans({chr(k): chr(k).lower() if chr(k).isalpha() else BREAK if chr(k).isdigit() or chr(k) in "_\n" else " " for k in range(128)})
_STOPS = re.compile(r"[\d_\n]+")
_GAPS = re.compile(rf"[^\w{BREAK}]+")


def fold(text: str) -> str:
    """The words of a text in lower case, each between two spaces.

    Compatibility forms and look-alike letters become Latin ones, and digits and signs that stand for
    letters inside words become those.  Digits by themselves and line ends become BREAK, which no
    phrase crosses; other signs between words are one space.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
        text = _INVISIBLE.sub("", text)
        if _LIKE.search(text):
            text = text.translate(_LOOK_ALIKE)
    if _HAS_STAND_IN.search(text):
        text = _MIXED.sub(lambda m: m.group().translate(_STAND_IN) if m.group().strip("0123456789_@$") else m.group(), text)
    if text.isascii():
        text = text.translate(_ASCII)
    else:
        text = _GAPS.sub(" ", _STOPS.sub(BREAK, text.replace(BREAK, " ")))
    return f" {' '.join(text.replace(BREAK, f' {BREAK} ').split())} "


@dataclass
class Model:
    """Word beginnings with weights, phrases that excuse the words in them, and a logistic curve.

    An entry of fewer than BEGINNING[0] letters stands for a whole word.
    """

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    level: float = 0.0

    def __post_init__(self) -> None:
        self._machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of matched word beginnings, the longest at each start, exceptions left out."""
        import ahocorasick

        if self._machine is None:
            machine = ahocorasick.Automaton()
            for p, w in self.weights.items():
                whole = len(p) < BEGINNING[0]
                machine.add_word(f" {p} " if whole else f" {p}", (len(p), int(whole), w))
            for p in self.exceptions:
                machine.add_word(f" {p} ", (len(p), 1, None))
            machine.make_automaton()
            self._machine = machine
        if not len(self._machine):
            return []
        found: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for last, (size, after, weight) in self._machine.iter(folded):
            end = last + 1 - after
            if weight is None:
                excused.append((end - size, end))
            else:
                found[end - size] = (end, weight)  # matches at one start come by length
        if excused:
            last = Counter()  # the furthest end of the phrases that begin at a place
            for a, b in excused:
                last[a] = max(last[a], b)
            starts, reach = sorted(last), 0
            ends = []
            for a in starts:
                reach = max(reach, last[a])
                ends.append(reach)
            found = {s: x for s, x in found.items() if not ((k := bisect_right(starts, s)) and x[0] <= ends[k - 1])}
        return [(s, e, w) for s, (e, w) in found.items()]

    def density(self, text: str | None) -> float:
        """Matched weight of a whole text against the logarithm of its length."""
        total = sum(w for _, _, w in self.matches(fold(text or "")))
        return total / (1 + math.log1p(len(text or "") / 1000))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.density(text) + self.level))))


def _beginnings(text: str) -> set[str]:
    low, high = BEGINNING
    words = set(fold(text).split()) - {BREAK}
    return {w[:k] for w in words for k in range(low, min(len(w), high) + 1)} | words


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """(key, text, y) of at most ``toxic_rows`` and ``clean_rows`` labelled documents, picked by a hash of the id."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    order = F.xxhash64(F.col(id_col))
    picked = one.where("y = 1").orderBy(order, id_col).limit(toxic_rows).unionByName(one.where("y = 0").orderBy(order, id_col).limit(clean_rows))
    picked = F.broadcast(picked.select(F.col(id_col).alias("picked"), "y"))  # at most toxic_rows + clean_rows rows
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))  # other columns may be named like ours
    rows = texts.join(picked, F.col("doc") == F.col("picked")).select("text", "y")
    return rows.mapInArrow(_marked, "key long, text string, y int").groupBy("key").agg(F.max_by("text", F.struct("y", "text")).alias("text"), F.max("y").alias("y"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of a text's four-word shingles: near copies mostly share it."""
    from xxhash import xxh64_intdigest

    for batch in bounded(batches):
        keys = []
        for text in batch.column(0).to_pylist():
            words = text.encode().split()
            keys.append(min(map(xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(4)), strict=False))), default=xxh64_intdigest(text.encode())))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), *batch.columns], ["key", "text", "y"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int) -> Model:
    """Learns weights, exceptions and the curve from a bounded sample of labelled rows.

    ``bounds`` are sample_rows' toxic_rows and clean_rows, which bound all that is learned.  Entries
    are words, and word beginnings of BEGINNING[0] to BEGINNING[1] letters, with LEAST_SUPPORT toxic
    documents and log-odds of at least LEAST_WEIGHT: the shortest that have both.  A run of letters
    counts as a word, so scripts without spaces match by the beginnings of their runs.  Near copies
    count as one document, so that words do not seem toxic because one toxic text is repeated.  A
    phrase of a matched word and a neighbour seen in three clean documents and no toxic one becomes
    an exception.
    """
    sample = cut_lineage(sample_rows(docs, labels, id_col, text_col, label_col, **bounds))
    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos:
        return Model({}, [], 1.0, -4.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            out = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(out, ["entry", "clean", "toxic"])

        for batch in bounded(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(_beginnings(text))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield rows()
        yield rows()

    toxic, clean = F.sum("toxic"), F.sum("clean")
    counted = sample.select("text", "y").mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(toxic.alias("toxic"), clean.alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (pos + 1)) - F.log((F.col("clean") + 0.5) / (neg + 1))
    good = counted.withColumn("weight", weight).where((F.col("toxic") >= LEAST_SUPPORT) & (F.col("weight") >= LEAST_WEIGHT))
    model = Model(_roots({r.entry: r.weight for r in good.collect()}))  # of at most toxic_rows documents
    model.exceptions = _exceptions(sample, model)
    return _curve(sample, model)


def _roots(weights: dict[str, float]) -> dict[str, float]:
    """Leaves out entries that start with another one, unless they weigh clearly more."""
    chosen: dict[str, float] = {}
    for e in sorted(weights, key=lambda e: (len(e), e)):
        if all(weights[e] > chosen[e[:k]] + 1 for k in range(BEGINNING[0], len(e)) if e[:k] in chosen):
            chosen[e] = weights[e]
    return chosen


def _exceptions(sample: DataFrame, model: Model) -> list[str]:
    held = sample.sparkSession.sparkContext.broadcast(model)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out: list[tuple[str, int]] = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, folded = set(), fold(text)
                for start, _, _ in held.value.matches(folded):
                    end = folded.index(" ", start)
                    after = folded[end + 1 : max(folded.find(" ", end + 1), 0)]
                    before = folded[folded.rfind(" ", 0, max(start - 1, 0)) + 1 : start - 1]
                    word = folded[start:end]
                    seen |= {f"{word} {after}"} if after and after != BREAK else set()
                    seen |= {f"{before} {word}"} if before and before != BREAK else set()
                out += [(p, y) for p in seen]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int64())], ["phrase", "y"])

    found = sample.select("text", "y").mapInArrow(phrases, "phrase string, y long").groupBy("phrase").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    return sorted(r.phrase for r in found.where("toxic = 0 and n >= 3").collect())  # of at most clean_rows documents


def _curve(sample: DataFrame, model: Model) -> Model:
    """Logistic regression of the label on the density, a little regularised."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([pa.array([held.value.density(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1).cast(pa.int64())], ["x", "y"])

    got = sample.select("text", "y").mapInArrow(measure, "x double, y long").toPandas()  # at most the sample's rows
    x, y = got["x"].to_numpy(), got["y"].to_numpy()
    design, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2), design.T @ (y - p) - 0.05 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.level = float(beta[0]), float(beta[1])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", into: str | None = None) -> DataFrame:
    """(id_col, score, predicted) for every row, or all columns of ``docs`` and these two as one struct
    named ``into``.

    Null and empty texts match nothing and get the score of a text without matches.  Null ids and
    repeated rows pass through; an empty table gives no rows; a very long text is matched in one
    piece, whatever its length.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learned from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            got = [held.value.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = pa.StructArray.from_arrays([pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], ["score", "predicted"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], verdict])

    kept = docs.select(*every_column(docs)) if into else docs.select(id_col)
    verdict, text = into or fresh("verdict", kept), fresh("text", kept)
    schema = T.StructType([*kept.schema.fields, T.StructField(verdict, T.StructType.fromDDL("score double, predicted int"))])
    out = docs.select(*every_column(kept), F.col(text_col).alias(text)).mapInArrow(run, schema)
    return out if into else out.select(id_col, f"{verdict}.*")
