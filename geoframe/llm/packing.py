"""Vector bin packing of examples into training sequences.

Each example has a vector: tokens, one segment, loss-bearing tokens. A sequence has a limit for each. The open
sequence takes, again and again, the example with the largest dot product of its vector with what the sequence has
left (both as fractions of the limits) among those that fit; documents may also be cut, so what is left of a sequence
is filled by the head of one more, if that is long enough. A task packs its own rows in windows, so nothing is shuffled.

Edge cases: a null or empty text is its end id; an example longer than a sequence is cut (documents) or refused with
an error (examples that must stay whole); rows that share an id are packed each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm.text import small_batches, text_batches
from geoframe.llm.tokens import Ids, with_end

#: Production limits of a sequence: loss-bearing tokens; and the shortest head that a cut leaves.
LOSS, SHORTEST = 2044, 16
#: Tokens that a task holds before it packs them, and bytes of text that it encodes at once.
WINDOW, SLICE = 1 << 20, 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Shelf:
    """Examples not placed yet, by their vector (tokens, loss-bearing tokens); equal vectors are as good as each other."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, float)
        self.held: dict[tuple[int, int], list] = defaultdict(list)
        self.vectors = np.zeros((0, 2), np.int64)
        self.stale = False

    def put(self, tokens: int, loss: int, item) -> None:
        self.stale |= not self.held[tokens, loss]
        self.held[tokens, loss].append(item)

    def best(self, left: list[int], cut: bool) -> tuple[int, int] | None:
        """The vector with the largest dot product with what is left; with cut, even if it doesn't fit."""
        if self.stale:
            self.vectors, self.stale = np.array([v for v, items in self.held.items() if items], np.int64).reshape(-1, 2), False
        room = np.array(left) / self.limits
        score = self.vectors @ (room[[0, 2]] / self.limits[[0, 2]]) + room[1] / self.limits[1]
        if not cut:
            score[(self.vectors[:, 0] > left[0]) | (self.vectors[:, 1] > left[2])] = -1
        if not len(score) or score.max() < 0:
            return None
        return tuple(self.vectors[int(score.argmax())].tolist())

    def take(self, vector: tuple[int, int]):
        item = self.held[vector].pop()
        if not self.held[vector]:
            del self.held[vector]
            self.stale = True
        return item


def pack_rows(shelf: Shelf, limits: tuple[int, int, int], cut, last: bool):
    """Lists of placed items, one list a sequence; unless last, the shelf keeps less than a few sequences of tokens.

    cut(item, tokens left, loss left) gives (head, tail) with their vectors, or None.
    """
    waiting = sum(max(v[0], 1) * len(items) for v, items in shelf.held.items())
    while shelf.held and (last or waiting > 8 * limits[0]):
        left, row = list(limits), []
        while left[1] > 0 and shelf.held:
            vector = shelf.best(left, False)
            if vector is not None:
                item = shelf.take(vector)
            else:
                vector = cut and left[0] > 0 and shelf.best(left, True)
                parts = vector and cut(item := shelf.take(vector), left[0], left[2])
                if not parts:
                    if vector:
                        shelf.put(*vector, item)
                    break
                (vector, item), (rest, tail) = parts
                shelf.put(*rest, tail)
            row.append(item)
            left = [left[0] - vector[0], left[1] - 1, left[2] - vector[1]]
            waiting -= max(vector[0], 1)
        yield row


def sequence_ids():
    """Numbers that no other task of the job gives out."""
    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 36
    while True:
        yield at
        at += 1


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, segments: int | None = None, loss: int = LOSS, shortest: int = SHORTEST) -> DataFrame:
    """Pack the texts of docs (doc_id, text), cut where it helps, into sequences of at most length tokens.

    A document's first id has nothing before it to be predicted from, so it bears no loss; all others do. No cut leaves
    less than shortest ids before it (unless a limit or the document is less). Without a number of segments a sequence takes
    as many pieces as it has room for, so short documents fill it, too. Returns one row per piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.
    """
    limits = (length, segments or length, min(loss, length))

    def vector(start: int, end: int) -> tuple[int, int]:
        return end - start, end - start - (start == 0)

    def cut(item, tokens: int, loss_left: int):
        doc, start, end = item
        size = min(tokens, loss_left + (start == 0))
        if not (shortest if tokens < length else 1) <= size < end - start:
            return None
        at = start + size
        return (vector(start, at), (doc, start, at)), (vector(at, end), (doc, at, end))

    def rows(batches):
        encoder, shelf, numbers, held = Ids.of(tokenizer), Shelf(limits), sequence_ids(), 0

        def packed(last):
            out = []
            for row in pack_rows(shelf, limits, cut, last):
                number, offset = next(numbers), 0
                for (name, raw), start, end in row:
                    out.append((name, start, end - start, zlib.crc32(raw[4 * start : 4 * end]), len(raw) // 4, number, offset, end - start - (start == 0)))
                    offset += end - start
            fields = [pa.field(x.split()[0], pa.int64()) for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * len(fields), schema=pa.schema(fields))

        for batch, data, offsets in text_batches(batches, limit=SLICE, lower=encoder.lowers):
            ids, bounds = with_end(*encoder.encode(data, offsets), end_id)
            raw, bounds = ids.astype("<u4").tobytes(), bounds.tolist()
            for name, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:]):
                doc, at, n = (name, raw[4 * a : 4 * b]), 0, b - a
                while n - at > length:  # whole sequences first; their rest is placed with the others
                    size = min(length, limits[2] + (at == 0))
                    shelf.put(*vector(at, at + size), (doc, at, at + size))
                    at += size
                shelf.put(*vector(at, n), (doc, at, n))
            held += len(ids)
            if held >= WINDOW:
                yield packed(False)
                held = 0
        yield packed(True)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, PIECES)


def pack_examples(examples: DataFrame, length: int = 2048, segments: int = 64, loss: int = 2048) -> DataFrame:
    """Pack whole examples (id, tokens, loss_tokens), as instruction data needs: none is cut.

    Returns id, tokens, loss_tokens, sequence_id, offset. Null and negative counts are 0; an example beyond a limit is an
    error; an example without tokens is placed like any other and takes a segment.
    """
    limits = (length, segments, loss)

    def rows(batches):
        shelf, numbers, held = Shelf(limits), sequence_ids(), 0

        def packed(last):
            out = []
            for row in pack_rows(shelf, limits, None, last):
                number, offset = next(numbers), 0
                for name, tokens, bearing in row:
                    out.append((name, tokens, bearing, number, offset))
                    offset += tokens
            fields = [("id", pa.int64()), ("tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 5, schema=pa.schema(fields))

        for batch in batches:
            for name, tokens, bearing in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if tokens > length or bearing > loss:
                    raise ValueError(f"example {name} exceeds a limit: {tokens} tokens, {bearing} loss-bearing")
                shelf.put(max(tokens, 0), max(bearing, 0), (name, max(tokens, 0), max(bearing, 0)))
                held += max(tokens, 1)
            if held >= WINDOW:
                yield packed(False)
                held = 0
        yield packed(True)

    whole = examples.select(F.col("id").cast("long"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.col("loss_tokens"), F.lit(0)).cast("long").alias("loss_tokens"))
    return whole.mapInArrow(rows, "id long, tokens long, loss_tokens long, sequence_id long, offset long")
