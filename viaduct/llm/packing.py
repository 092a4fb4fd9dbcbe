"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.bpe import encoder
from viaduct.llm.common import bounded

END = b"\0\0\0\0"  # id 0 closes every document


class Packer:
    """Fills one sequence at a time from a pool of examples.

    An example is a run of tokens of which those from ``prompt`` on bear loss.  The next one into the
    open sequence is the example that fits and whose demand vector (tokens, segments, loss), scaled
    by the limits, has the largest dot product with what the sequence has left.  If none fits, the
    best example is cut to fill the sequence and its rest returns to the pool.  So only a limit
    other than tokens, or the end of the input, leaves a sequence short.
    """

    def __init__(self, tokens: int, segments: int, loss: int):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limit = np.array([tokens, segments, loss], np.int64)

    def fill(self, size: np.ndarray, prompt: np.ndarray, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Yields sequences as lists of (example, start, length).

        Unless ``last``, stops when the pool cannot fill a sequence; :attr:`left` then holds what is
        left as (example, start, length).
        """
        start = np.zeros(len(size), np.int64)
        size, prompt = size.astype(np.int64), prompt.astype(np.int64)
        tokens, _, loss_limit = self.limit.tolist()
        for k in np.flatnonzero(size >= tokens).tolist():  # long examples fill sequences alone
            while size[k] - start[k] >= tokens:
                n = self._cut(int(start[k]), int(size[k]), int(prompt[k]), tokens, loss_limit)
                yield [(k, int(start[k]), n)]
                start[k] += n
        pool = np.flatnonzero(size > start)
        need = np.empty((len(pool), 3), np.float64)
        need[:, 0] = size[pool] - start[pool]
        need[:, 1] = 1
        need[:, 2] = size[pool] - np.maximum(start[pool], np.minimum(prompt[pool], size[pool]))
        total = need[:, 0].sum()
        live = np.ones(len(pool), bool)
        scaled = need / self.limit
        alive = len(pool)
        while alive and (last or total >= 2 * tokens):
            room = self.limit.astype(np.float64)
            sequence: list[tuple[int, int, int]] = []
            while alive and room.min() > 0:
                worth = scaled @ (room / self.limit)
                worth[~live | (need > room).any(axis=1)] = -1
                best = int(worth.argmax())
                if worth[best] < 0:  # nothing fits: cut the best of the rest
                    worth = np.where(live, scaled @ (room / self.limit), -1)
                    best = int(worth.argmax())
                k = int(pool[best])
                n = self._cut(int(start[k]), int(size[k]), int(prompt[k]), int(room[0]), int(room[2]))
                if not n:
                    break
                before = need[best].copy()
                sequence.append((k, int(start[k]), n))
                start[k] += n
                need[best, 0] -= n
                need[best, 2] = size[k] - max(start[k], min(prompt[k], size[k]))
                room -= [n, 1, before[2] - need[best, 2]]
                total -= n
                if need[best, 0] == 0:
                    live[best] = False
                    alive -= 1
                else:
                    scaled[best] = need[best] / self.limit
            yield sequence
            if alive and alive < len(pool) // 2:
                pool, need, scaled = pool[live], need[live], scaled[live]
                live = np.ones(len(pool), bool)
        self.left = [(int(k), int(start[k]), int(size[k] - start[k])) for k in pool[live]]

    @staticmethod
    def _free(start: int, n: int, prompt: int) -> int:
        return min(max(prompt - start, 0), n)

    def _cut(self, start: int, size: int, prompt: int, room: int, loss_room: int) -> int:
        """The most tokens from ``start`` on that both rooms take."""
        n = min(size - start, room)
        free = self._free(start, n, prompt)
        return min(n, free + loss_room)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_tokens_col: str | None = None,
    max_tokens: int = 1024,
    max_segments: int = 1024,
    max_loss_tokens: int | None = None,
) -> DataFrame:
    """Packs all documents into sequences; returns a row for each piece of a document.

    Columns: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A document is its
    ids and a closing id 0.  ``prompt_tokens_col`` names how many leading tokens bear no loss (null
    or absent: none), ``max_loss_tokens`` limits the others in a sequence (default: max_tokens) and
    ``max_segments`` the pieces; at its default it binds only where every piece is one token.

    Every task packs its own partition as it streams through, so there is no shuffle and memory holds
    one Arrow batch.  What a partition's end or another limit leaves below max_tokens is cut into sequences whose
    lengths are powers of two, which need no padding.  A sequence id is the partition's number
    times 2**33 plus a counter, so a task that runs again gives the same rows.

    Null text: empty, one piece of the closing id.  Null ids pass through; repeated rows are packed
    as rows of their own; a very long text is encoded whole and fills sequences of its own before its
    rest joins the others; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())  # a vocabulary file
    limits = (max_tokens, max_segments, max_loss_tokens or max_tokens)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(held.value), Packer(*limits)
        base, number = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []  # (id, packed ids, tokens before them, prompt, all tokens)
        kind = None

        def emit(sequences: Iterator[list[tuple[int, int, int]]], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows: list[tuple] = []
            for sequence in sequences:
                offset = 0
                for k, start, n in sequence:
                    key, ids, before, _, total = parts[k]
                    rows.append((key, before + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, base + number, offset))
                    offset += n
                number += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in bounded(batches):
            kind = batch.schema.field(0).type
            ids = batch.column(0).to_pylist()
            prompts = batch.column(2).to_pylist()
            for key, packed, p in zip(ids, enc.encode(batch.column(1).to_pylist()), prompts, strict=True):
                packed += END
                waiting.append((key, packed, 0, max(p or 0, 0), len(packed) // 4))
            filled = packer.fill(*_shape(waiting), False)
            yield from emit((piece for sequence in filled for piece in _powers(sequence, limits[0])), waiting)
            waiting = _rest(waiting, packer.left)
        sequences = []
        if waiting:
            for sequence in packer.fill(*_shape(waiting), True):
                sequences += _powers(sequence, limits[0])
            yield from emit(iter(sequences), waiting)

    prompt = F.col(prompt_tokens_col).cast("long") if prompt_tokens_col else F.lit(0).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), prompt.alias("prompt"))
    shape = ", ".join(f"{n} long" for n in names[1:])
    return out.mapInArrow(run, f"id {kind}, {shape}").withColumnRenamed("id", id_col)


def _shape(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(ids) // 4 for _, ids, *_ in parts], np.int64)
    return size, np.array([min(p, n) for (_, _, _, p, _), n in zip(parts, size.tolist(), strict=True)], np.int64)


def _rest(parts: list[tuple], left: list[tuple[int, int, int]]) -> list[tuple]:
    out = []
    for k, start, n in left:
        key, ids, before, prompt, total = parts[k]
        out.append((key, ids[4 * start : 4 * (start + n)], before + start, max(prompt - start, 0), total))
    return out


def _powers(sequence: list[tuple[int, int, int]], limit: int) -> list[list[tuple[int, int, int]]]:
    """Cuts a short sequence where its length, in binary, says so."""
    total = sum(n for _, _, n in sequence)
    if total == limit or total & (total - 1) == 0:
        return [sequence]
    out, parts = [], list(reversed(sequence))
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        piece = []
        while room:
            k, start, n = parts.pop()
            take = min(n, room)
            piece.append((k, start, take))
            room -= take
            if take < n:
                parts.append((k, start + take, n - take))
        if piece:
            out.append(piece)
    return out
