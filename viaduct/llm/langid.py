"""Language identification with error-correcting output codes over byte n-gram classifiers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viaduct.llm.common import bounded, every_column, fresh

BUCKET_BITS = 16
SAMPLE_ROWS = 3000
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"
_WORDY = re.compile(r"[^\W\d_]")  # letters, and numbers such as ½ that are no digits
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def has_letter(text: str) -> bool:
    """Whether any sign is of Unicode's category L."""
    return any(m.group().isalpha() for m in _WORDY.finditer(text))


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 for each class: all two-way splits of up to six classes, else random ones."""
    if classes < 2:
        return np.zeros((classes, 0), np.int8)
    if classes <= 6:
        splits = np.arange(1, 1 << (classes - 1))
        return np.where(splits[None, :] >> np.arange(classes)[:, None] & 1, 1, -1).astype(np.int8)
    rng, bits = np.random.default_rng(seed), 10 * math.ceil(math.log2(classes))
    while True:
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        if len(np.unique(code, axis=0)) == classes and (np.abs(code.sum(0, dtype=int)) < classes).all():
            return code


def grams(raw: bytes) -> Iterator[np.ndarray]:
    """Buckets of all byte trigrams of a text with A-Z lower-cased and a space at either end."""
    for at in range(0, max(len(raw), 1), SLICE_BYTES):
        part = b" " * (at < 2) + raw[max(at - 2, 0) : at] + raw[at : at + SLICE_BYTES] + (b" " if at + SLICE_BYTES >= len(raw) else b"")
        x = _LOWER[np.frombuffer(part, np.uint8)].astype(np.uint32)
        if len(x) > 2:
            yield ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    """weights: (buckets, bits); code: (languages, bits); scale and trust: of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, raw: bytes) -> np.ndarray:
        """Each bit's mean log-odds over the text's trigrams."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for idx in grams(raw):
            total += self.weights[idx].sum(0, dtype=np.float64)
            n += len(idx)
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous): loss-weighted decoding to the nearest codeword."""
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        z = self.margins(text.encode()) / self.scale
        loss = (np.logaddexp(0, -4 * self.code * z) * self.trust).sum(1) / self.trust.mean()
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(share.argmax())
        return self.languages[best], float(share[best]), bool(share[best] < 0.5)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most about ``sample_rows`` rows of each language, picked by a hash of the id.

    Rows without a language are not learned from.  Every bit is a naive Bayes classifier in which the
    languages on a side weigh the same; a second pass over the sample finds each bit's scale and how
    far it can be trusted.  What reaches the driver are sums for each language and bucket.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((1 << BUCKET_BITS, 0), np.float32), np.ones(0), np.ones(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, sample_rows / counts[k])])
    point = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    sample = rows.where(point < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
        place = {k: n for n, k in enumerate(languages)}
        for batch in bounded(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for idx in grams((text or "").encode()):
                    seen[place[lang]] += np.bincount(idx, minlength=1 << BUCKET_BITS)
        lang, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(bucket, pa.int64()), pa.array(seen[lang, bucket], pa.int64())], ["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((len(languages), 1 << BUCKET_BITS))
    seen[sums["lang"], sums["bucket"]] = sums["n"]
    p = (seen + 0.5) / (seen.sum(1, keepdims=True) + 0.5 * seen.shape[1])
    weights = np.stack([np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], axis=1).astype(np.float32)
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: n for n, k in enumerate(languages)}
        for batch in bounded(batches):
            side = [(code[place[lang]], model.margins(text.encode())) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text]
            if side:
                toward = np.array([c * m for c, m in side])
                bits = np.tile(np.arange(toward.shape[1]), len(toward))
                yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64()), pa.array(toward.ravel())], ["bit", "toward"])

    got = sample.mapInArrow(measure, "bit long, toward double").groupBy("bit").agg(F.avg("toward").alias("mean"), F.avg((F.col("toward") > 0).cast("double")).alias("right")).toPandas()
    for r in got.itertuples():
        model.scale[r.bit] = max(r.mean, 1e-6)
        model.trust[r.bit] = max(2 * r.right - 1, 0.05)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", into: str | None = None) -> DataFrame:
    """(id_col, lang_pred, score, ambiguous) for every row, or all columns of ``docs`` and these three
    as one struct named ``into``.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no language
    was learned.  Ambiguous: no language has half of the weight.  Null ids and repeated rows pass
    through; an empty table gives no rows; a very long text is read whole, a slice at a time, and
    gets what it would get in one piece.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages times buckets
    shape = "lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.float64(), pa.bool_())
        for batch in bounded(batches):
            got = [held.value.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = pa.StructArray.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)], ["lang_pred", "score", "ambiguous"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], verdict])

    kept = docs.select(*every_column(docs)) if into else docs.select(id_col)
    verdict, text = into or fresh("verdict", kept), fresh("text", kept)
    schema = T.StructType([*kept.schema.fields, T.StructField(verdict, T.StructType.fromDDL(shape))])
    out = docs.select(*every_column(kept), F.col(text_col).alias(text)).mapInArrow(run, schema)
    return out if into else out.select(id_col, f"{verdict}.*")
