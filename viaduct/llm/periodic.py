"""Runs of repeating words: direct scans for short periods, minimizers of doubling scales for the others."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viaduct.llm.common import bounded, fresh

LEAST_WORDS = 12
#: Periods below it are scanned directly; scales of FIRST_SCALE * 2**k take the others.
FIRST_SCALE = 64
PAIRS_AT_ONCE = 1 << 20
SHAPE = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class Runs:
    """Stretches (start, end, period) of a sequence, each with its smallest period."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Of stretches with the same ends the smallest period stays: the others are its multiples."""
        s, e, p = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((p, e, s))
        s, e, p = s[order], e[order], p[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        self.start, self.end, self.period = s[first], e[first], p[first]

    def holding(self, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place: the run of period ``words / 2`` or less that holds ``words`` words from
        there on, else -1, and whether the same words stand a period earlier in that run.

        At most one such run holds them, as two would share a period.
        """
        some = (2 * self.period <= words) & (self.end - self.start >= words)
        start, last, period = self.start[some], self.end[some] - words, self.period[some]
        if not len(start):
            return np.full(len(at), -1), np.zeros(len(at), bool)
        k = np.searchsorted(start, at, "right") - 1
        inside = (k >= 0) & (at <= last[k])
        return np.where(inside, k, -1), inside & (at - period[k] >= start[k])


def direct(ids: np.ndarray, lag: int, least: int, into: Runs) -> None:
    """All runs of period ``lag`` or a divisor of it: stretches in which every word equals that ``lag`` further on."""
    if len(ids) <= lag:
        return
    same = ids[lag:] == ids[:-lag]
    edges = np.flatnonzero(same[1:] != same[:-1]) + 1
    edges = np.concatenate(([0] * bool(same[0]), edges, [len(same)] * bool(same[-1]))).astype(np.int64)
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= max(least, 2 * lag) - lag
    if long.any():
        into.add(begin[long], end[long] + lag, np.full(int(long.sum()), lag))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(grams: np.ndarray, words: int) -> np.ndarray:
    """Hashes of twice as many words from hashes of ``words`` words."""
    return mixed(grams[:-words] * np.uint64(0x9E3779B97F4A7C15) + grams[words:])


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every ``window`` (a power of two) places in a row, the leftmost of equal ones."""
    value, place, width = grams, np.arange(len(grams)), 1
    while width < window:
        later = value[width:] < value[:-width]
        place = np.where(later, place[width:], place[:-width])
        value = np.where(later, value[width:], value[:-width])
        width *= 2
    return place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place


def extended(ids: np.ndarray, x: int, y: int) -> tuple[int, int]:
    """(begin, end) of the stretch around ``x`` that equals the one around ``y``."""
    ends = []
    for step in (-1, 1):
        a, b, size = (x - 1, y - 1, 64) if step < 0 else (x, y, 64)
        while True:
            n = min(size, a + 1 if step < 0 else len(ids) - b)
            if n <= 0:
                break
            one, two = (ids[a - n + 1 : a + 1][::-1], ids[b - n + 1 : b + 1][::-1]) if step < 0 else (ids[a : a + n], ids[b : b + n])
            differ = one != two
            at = int(differ.argmax())
            if differ[at]:
                a += step * at
                break
            a, b, size = a + step * n, b + step * n, min(2 * size, 1 << 20)
        ends.append(a + 1 if step < 0 else a)
    return ends[0], ends[1]


def seeds(place: np.ndarray, key: np.ndarray, doc: np.ndarray, scale: int, runs: Runs, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of equal minimizers of a document that are ``scale`` to ``2 * scale - 1`` words apart.

    A pair inside one shorter run says nothing new.  Where neither minimizer is the first of its kind
    in its shorter run, the stretch around the pair begins at one that is, which yields its own pair.
    So one of a pair is such a first one or in no shorter run, and constant text has few pairs.
    """
    held, repeated = runs.holding(place, words)
    order = np.lexsort((place, key, doc))
    place, key, doc, held, repeated = place[order], key[order], doc[order], held[order], repeated[order]
    group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
    line = group * (int(place.max()) + 4 * scale) + place
    first = np.flatnonzero(~repeated)
    for near, far in ((scale, 2 * scale), (1 - 2 * scale, 1 - scale)):
        low, high = np.searchsorted(line, line[first] + near), np.searchsorted(line, line[first] + far)
        some = high > low
        one, low, n = first[some], low[some], (high - low)[some]
        at = 0
        while at < len(one):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), PAIRS_AT_ONCE, "right")) + at)
            x = np.repeat(one[at:upto], n[at:upto])
            y = np.repeat(low[at:upto] - np.concatenate(([0], np.cumsum(n[at:upto])[:-1])), n[at:upto]) + np.arange(len(x))
            new = (held[x] < 0) | (held[x] != held[y])
            x, y = place[x[new]], place[y[new]]
            yield np.minimum(x, y), np.abs(y - x)
            at = upto


def find_runs(ids: np.ndarray, starts: np.ndarray, least: int = LEAST_WORDS) -> Runs:
    """All runs of documents that stand one after the other in ``ids``, each followed by an id of its own.

    A run is a stretch with smallest period q and a length of at least ``least`` and 2 q that neither
    neighbour extends.  ``starts`` are the documents' first places.

    At scale Q the windows are Q/2 grams of Q/4 words.  The windows at the beginning of a run with
    Q <= q < 2 Q and of its second period lie in the run and are equal, so are their minimizers, q
    words apart.  Every pair of equal minimizers that far apart is extended on the words themselves.
    """
    runs, size = Runs(), np.diff(np.append(starts, len(ids))) - 1
    most = int(size.max(initial=0)) // 2
    for lag in range(1, min(FIRST_SCALE - 1, most) + 1):
        direct(ids, lag, least, runs)
    place, scale, words = np.arange(len(ids)), FIRST_SCALE, 1
    doc = np.repeat(np.arange(len(starts)), size + 1)
    grams = mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(1))
    while scale <= most:
        if (size < 2 * scale).any():
            long = size[doc[place]] >= 2 * scale
            grams, place = grams[long[: len(grams)]], place[long]
        while words < scale // 4:
            grams, words = doubled(grams, words), words * 2
        chosen = minimizers(grams, scale // 2)
        found: list[tuple[int, int, int]] = []
        if len(chosen):
            for at, lag in seeds(place[chosen], grams[chosen], doc[place[chosen]], scale, runs, words):
                order = np.lexsort((at, lag))
                known, end = -1, -1
                for x, q in zip(at[order].tolist(), lag[order].tolist(), strict=True):
                    if q == known and x < end:
                        continue
                    begin, end = extended(ids, x, x + q)
                    known = q
                    if end - begin >= q:
                        found.append((begin, end + q, q))
        if found:
            runs.add(*np.array(found, np.int64).T)
        scale *= 2
    return runs


def annotate(texts: Sequence[str | None], least: int = LEAST_WORDS) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs (start, length, period) by start and period, and the words left by
    dropping those that stand in a run after its first period, joined by one space."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    split = [(t or "").encode().split() for t in texts]  # bytes split at exactly space and \x09-\x0D
    size = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if len(size) else size
    ids = np.empty(int((size + 1).sum()), np.int32)
    for k, w in enumerate(split):
        ids[starts[k] : starts[k] + size[k]] = np.fromiter(map(number.__getitem__, w), np.int32, len(w))
        ids[starts[k] + size[k]] = -1 - k
    runs = find_runs(ids, starts, least)
    order = np.lexsort((runs.period, runs.start))
    start, end, period = runs.start[order], runs.end[order], runs.period[order]
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, end, -1)
    dropped = np.cumsum(step)[:-1] > 0
    of = np.searchsorted(starts, start, "right") - 1
    cuts = np.searchsorted(of, np.arange(len(split) + 1))
    out = []
    for k, w in enumerate(split):
        mine = slice(cuts[k], cuts[k + 1])
        if cuts[k] < cuts[k + 1]:
            w = [x for x, gone in zip(w, dropped[starts[k] : starts[k] + size[k]].tolist(), strict=True) if not gone]
        out.append((list(zip((start[mine] - starts[k]).tolist(), (end[mine] - start[mine]).tolist(), period[mine].tolist(), strict=True)), b" ".join(w)))
    return out


def periodic_runs(docs: DataFrame, keep: Sequence[str], text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The columns ``keep`` of every row, its runs and its text without their repetitions.

    ``runs``: (start, length, period) in words, by start and period; ``collapsed``: the words that no
    run holds after its first period, joined by one space.  Words are split at ASCII white space.

    Null and empty texts have no runs and an empty text; texts are read whole, many short ones or one
    long one at a time; null ids and repeated rows pass through; an empty table gives no rows; other
    columns, whatever their names, are not read; ``keep`` may not hold runs or collapsed.
    """
    kept = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in keep])
    text = fresh("text", kept)
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(SHAPE)])
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            got = annotate(batch.column(batch.num_columns - 1).to_pylist(), least)
            found = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs, _ in got], pa.list_(run))
            left = pa.array([c for _, c in got], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found, left], schema.names)

    return docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in keep], F.col(text_col).alias(text)).mapInArrow(search, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text of a tenth of the documents with a periodic end: of n words those from a on repeat the
    p words at a, where h is the id's crc32, g = h div 10, a = g mod n and p follows from g.

    Null texts and ids leave the text as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    often = F.ceil((n - a) / F.greatest(p, F.lit(1))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, often)), F.lit(1), (n - a).cast("int"))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)
