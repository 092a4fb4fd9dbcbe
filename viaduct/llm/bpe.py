"""Byte-level BPE over whole texts with a memory-mapped minimal transducer of frequent words.

A *word* here is what the pre-tokenizer can never merge across: a run of non-space characters with
one optional space before it, or white space on its own.  Frequent words of the corpus are compiled
into a minimal acyclic automaton whose transitions carry additive outputs; the sum along a path
numbers the word, and the number addresses its ids.  Workers memory-map the automaton.  Words that
it does not hold are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.common import bounded, cut_lineage

# Unicode White_Space, which differs from Python's \s by the separators 1C to 1F.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
_ODD_SPACE = re.compile("[" + _WS[_WS.index("\x85") :] + "]")
_ASCII_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CUT = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")
# Fixed value: the pre-tokenizer's pattern.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_CHARS = 1 << 20
MEMO_WORDS = 300_000
LEXICON_WORDS = 65_536


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + k): b for k, b in enumerate(rest)}


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut only where encoding cannot notice."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Encoder:
    """Encodes texts to packed little-endian uint32 ids, and decodes them.

    With a lexicon, all words of a block of texts walk the transducer together and only those that it
    lacks are merged; without one, every text is merged.
    """

    def __init__(self, spec: bytes, lexicon: bytes | None = None):
        import tiktoken

        parsed = json.loads(spec)
        to_byte = _byte_of_char()
        added = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in parsed["model"]["vocab"].items() if t not in added}
        self._merge = tiktoken.Encoding("viaduct", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special = {k: np.array([v], "<u4") for k, v in added.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        token = [b""] * (1 + max([*ranks.values(), *added.values()]))
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            token[i] = t
        self._token_size = np.fromiter(map(len, token), np.int64, len(token))
        self._token_start = np.cumsum(self._token_size) - self._token_size
        self._token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self._newline = ranks[b"\n"]
        self._lexicon = Transducer.mapped(lexicon) if lexicon else None

    def merge(self, text: str) -> np.ndarray:
        return np.asarray(self._merge.encode_to_numpy(text), "<u4")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a null text counts as empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        block: list[tuple[int, bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self._parts(text or ""):
                if part in self._special:
                    block, size = self._flush(block, out)
                    out[k].append(self._special[part].tobytes())
                    continue
                for piece in slices(part):
                    if self._lexicon is None or _ODD_SPACE.search(piece):
                        block, size = self._flush(block, out)
                        out[k].append(self.merge(piece).tobytes())
                        continue
                    block.append((k, piece.encode()))
                    size += len(block[-1][1])
                    if size > SLICE_CHARS:
                        block, size = self._flush(block, out)
        self._flush(block, out)
        return [b"".join(x) for x in out]

    def _flush(self, block: list[tuple[int, bytes]], out: list[list[bytes]]) -> tuple[list, int]:
        if block:
            ids, ends = self._by_lexicon([x for _, x in block])
            start = 0
            for (k, _), end in zip(block, ends, strict=True):
                out[k].append(ids[start:end].tobytes())
                start = end
        return [], 0

    def _by_lexicon(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of all pieces in a row, and where those of each piece end."""
        joined = b"".join(pieces)
        if not joined:
            return np.zeros(0, "<u4"), [0] * len(pieces)
        flat = np.frombuffer(joined, np.uint8)
        stops = np.cumsum([len(x) for x in pieces])
        first = word_starts(flat, stops)
        size = np.diff(np.append(first, len(flat)))
        number = self._lexicon.walk(flat, first, size)
        missed = np.flatnonzero(number < 0)
        merged, sizes = self._merged([joined[a : a + n] for a, n in zip(first[missed].tolist(), size[missed].tolist(), strict=True)])
        base = self._lexicon.starts
        count = (base[number + 1] - base[number]).astype(np.int64)
        source = base[number].astype(np.int64)
        count[missed] = sizes
        source[missed] = len(self._lexicon.ids) + np.cumsum(sizes) - sizes
        end = np.cumsum(count)
        at = np.repeat(source - (end - count), count) + np.arange(end[-1])
        ids = np.concatenate([self._lexicon.ids, merged])[at]
        return ids, np.append(0, end)[np.searchsorted(first, stops)].tolist()

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merges words that the lexicon lacks: their ids in a row, and how many each has.

        A line break between words is a token of its own, and no other word holds one, so one call
        serves them all; words of white space are merged singly.
        """
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        blank = [w.isspace() for w in words]
        ids = self.merge(b"\n".join([b"." if x else w for w, x in zip(words, blank, strict=True)]).decode())
        ends = np.append(np.flatnonzero(ids == self._newline), len(ids))
        sizes = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self._newline]
        if any(blank):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k in np.flatnonzero(blank):
                parts[k] = self.merge(words[k].decode())
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, sizes

    def _parts(self, text: str) -> list[str]:
        if self._split is None or not any(s in text for s in self._special):
            return [text]
        return [p for p in self._split.split(text) if p]

    def decode(self, packed: bytes) -> str:
        out = []
        for at in range(0, len(packed), 4 * SLICE_CHARS):
            ids = np.frombuffer(packed[at : at + 4 * SLICE_CHARS], "<u4")
            size = self._token_size[ids]
            end = np.cumsum(size)
            out.append(self._token_bytes[np.repeat(self._token_start[ids] - (end - size), size) + np.arange(end[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def word_starts(flat: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where words begin in UTF-8 texts laid end to end (``stops``: where each text ends).

    White space must be ASCII.  A run of it before a word is one piece without its last character;
    that character begins the word if it is a space and is a piece of its own otherwise.
    """
    space = _ASCII_SPACE[flat]
    begins = np.zeros(len(flat) + 1, bool)
    begins[0] = True
    begins[stops] = True
    begins = begins[:-1]
    after = np.append(~space[1:], False)  # a word follows
    after[stops[stops > 0] - 1] = False
    behind = np.append(False, space[:-1])
    plain = np.append(False, flat[:-1] == 32)
    return np.flatnonzero(begins | space & (~behind | after) | ~space & behind & ~plain)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(spec: bytes, lexicon: bytes | None = None) -> Encoder:
    """One encoder for each worker process."""
    key = (hashlib.sha256(spec).digest(), hashlib.sha256(lexicon or b"").digest())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, lexicon)
    return _ENCODERS[key]


# ---------------------------------------------------------------- transducer


class Transducer:
    """A minimal acyclic automaton in flat arrays: an open-addressed table of (state, byte) arcs.

    Arc values are (target, output); the outputs along an accepting path add up to the word's number.
    """

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys, values, final, starts, ids):
        self.keys, self.values, self.final, self.starts, self.ids = keys, values, final, starts, ids
        self.shift = np.uint64(64 - int(len(keys)).bit_length() + 1)

    @staticmethod
    def build(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
        """Compiles (word, packed ids) pairs; equal suffixes share states (words are added in order)."""
        entries = sorted(dict(entries).items())
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child) that may still change
        free: list[int] = []

        def settle(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                shape = (final[child], tuple(arcs[child].items()))
                same = register.setdefault(shape, child)
                if same != child:
                    arcs[parent][byte] = same
                    arcs[child], final[child] = {}, False
                    free.append(child)

        last = b""
        for word, _ in entries:
            shared = len(os.path.commonprefix([word, last]))
            settle(shared)
            state = path[-1][2] if path else 0
            for byte in word[shared:]:
                if free:
                    child = free.pop()
                else:
                    child = len(arcs)
                    arcs.append({})
                    final.append(False)
                arcs[state][byte] = child
                path.append((state, byte, child))
                state = child
            final[state] = True
            last = word
        settle(0)

        below: dict[int, int] = {}
        order, stack = [], [0]
        seen = {0}
        while stack:
            s = stack.pop()
            order.append(s)
            for t in arcs[s].values():
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        pending = list(order)
        while pending:  # children before parents
            s = pending.pop()
            if s in below:
                continue
            missing = [t for t in arcs[s].values() if t not in below]
            if missing:
                pending += [s, *missing]
            else:
                below[s] = final[s] + sum(below[t] for t in arcs[s].values())
        n = sum(len(arcs[s]) for s in order)
        size = 1 << max(4, int(2 * n + 1).bit_length())
        keys, values = np.full(size, -1, "<i8"), np.zeros(size, "<i8")
        shift = 64 - size.bit_length() + 1
        for s in order:
            number = int(final[s])
            for byte, t in arcs[s].items():
                key = s << 8 | byte
                slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> shift
                while keys[slot] >= 0:
                    slot = (slot + 1) & (size - 1)
                keys[slot], values[slot] = key, t << 32 | number
                number += below[t]
        starts = np.cumsum([0, *(len(ids) // 4 for _, ids in entries)]).astype("<i4")
        arrays = [keys, values, np.array(final, "u1"), starts, np.frombuffer(b"".join(i for _, i in entries), "<u4")]
        head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
        body = b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)
        return head + b" " * (-(len(head) + 1) % 8) + b"\n" + body

    @classmethod
    def mapped(cls, image: bytes) -> Transducer:
        """Memory-maps the image from a file of this machine's own, which has no name once it is mapped."""
        with tempfile.NamedTemporaryFile() as f:
            f.write(image)
            f.flush()
            return cls(*cls._arrays(image, f.name))

    @staticmethod
    def _arrays(image: bytes, path: str) -> list[np.ndarray]:
        at = image.index(b"\n") + 1
        arrays = []
        for kind, n in json.loads(image[:at]):
            arrays.append(np.memmap(path, kind, "r", at, (n,)).view(np.ndarray) if n else np.zeros(0, kind))
            at += arrays[-1].nbytes + -arrays[-1].nbytes % 8
        return arrays

    def walk(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word flat[first : first + size], or -1; words advance together by bytes."""
        out = np.full(len(first), -1, np.int64)
        for a in range(0, len(first), 1 << 15):
            self._walk(flat, first[a : a + (1 << 15)], size[a : a + (1 << 15)], out[a : a + (1 << 15)])
        return out

    def _walk(self, flat, first, size, out) -> None:
        mask = len(self.keys) - 1
        word = np.arange(len(first))
        here, left = first.copy(), size.copy()
        state, number = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        while len(word):
            key = state << 8 | flat[here]
            slot = ((key.astype(np.uint64) * self._MIX) >> self.shift).astype(np.int64)
            got = self.keys[slot]
            wrong = np.flatnonzero((got != key) & (got >= 0))
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & mask
                got[wrong] = self.keys[slot[wrong]]
                wrong = wrong[(got[wrong] != key[wrong]) & (got[wrong] >= 0)]
            hit = np.flatnonzero(got == key)
            value = self.values[slot[hit]]
            word, here, left = word[hit], here[hit] + 1, left[hit] - 1
            state, number = value >> 32, number[hit] + (value & 0xFFFFFFFF)
            done = left == 0
            if done.any():
                good = done & (self.final[state] > 0)
                out[word[good]] = number[good]
                keep = np.flatnonzero(~done)
                word, here, left, state, number = word[keep], here[keep], left[keep], state[keep], number[keep]


# ---------------------------------------------------------------- operators


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): occurrences of every word over all documents.  Null texts have no words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in bounded(batches):
            for text in batch.column(0).to_pylist():
                for part in slices(text or ""):
                    seen.update(_WORD.findall(part))
                if len(seen) > MEMO_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, spec: bytes, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The transducer of the most frequent words of all documents: as many whole steps of frequency as
    ``words`` has room for.

    Words that occur once are left out.  The driver gets a sum for each step and at most ``words`` words.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    counted = cut_lineage(word_counts(docs, text_col).where((F.col("n") > 1) & (F.length("word") <= 64)).withColumn("step", step))
    least, room = None, words
    for held, n in sorted(counted.groupBy("step").count().collect(), reverse=True):
        if n > room:
            break
        least, room = held, room - n
    frequent = [] if least is None else [r.word for r in counted.where(F.col("step") >= least).select("word").collect()]
    enc = Encoder(spec)
    return Transducer.build((w.encode(), enc.merge(w).tobytes()) for w in frequent)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """Encodes each whole text and decodes its ids again.

    Returns id_col, ``ids`` (binary, little-endian uint32) and ``decoded`` (string), one row per input
    row.  Null text: empty; null ids and repeated rows pass through; a very long text is encoded whole,
    in slices cut where encoding cannot notice; an empty table gives no rows; extra columns of the
    input are ignored.
    """
    return _with_ids(docs, tokenizer_path, id_col, text_col, words, digests=False)


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """As :func:`encode_decode`, with digests instead of ids and text: n_tokens, ids_sha256, decoded_sha256."""
    return _with_ids(docs, tokenizer_path, id_col, text_col, words, digests=True)


def _with_ids(docs: DataFrame, path: str, id_col: str, text_col: str, words: int, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    with open(path, "rb") as f:
        spec = f.read()
    held = spark.sparkContext.broadcast((spec, build_lexicon(docs, spec, text_col, words)))  # a vocabulary file and at most `words` entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*held.value)
        for batch in bounded(batches):
            packed = enc.encode(batch.column(1).to_pylist())
            decoded = map(enc.decode, packed)
            if digests:
                rest = {
                    "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed],
                    "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
                }
            else:
                rest = {"ids": pa.array(packed, pa.binary()), "decoded": pa.array(list(decoded), pa.string())}
            yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | rest)

    kind = docs.schema[id_col].dataType.simpleString()
    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {shape}")
    return out.withColumnRenamed("id", id_col)
