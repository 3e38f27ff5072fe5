"""Helpers shared by the text operators: words of a batch as numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are no letters: all ASCII but A-Z and a-z; bytes of longer characters count as letters.
NO_LETTERS = np.zeros(256, bool)
NO_LETTERS[:128] = True
NO_LETTERS[65:91] = NO_LETTERS[97:123] = False
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Of the polynomial word hashes; odd, so they have inverses modulo 2**64.
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to hand Python a few megabytes of rows at a time, whatever the length of the texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def held_out(column: str, modulus: int, remainder: int):
    """crc32(column as text) mod modulus = remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text of code points up to U+07FF, in DuckDB SQL, which has no such function.

    Each byte is followed by seven zeros: each of the eight takes one bit from the sum.
    """
    point = "ord(c)"
    raw = f"case when {point} < 128 then [{point}] else [192 | ({point} >> 6), 128 | ({point} & 63)] end"
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: flatten(list_transform({raw}, lambda x: [x, 0, 0, 0, 0, 0, 0, 0]))))"
    folded = f"list_reduce(list_prepend(4294967295::bigint, {steps}::bigint[]), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384))"
    return f"xor({folded}, 4294967295)"


#: What a worker process remembers from task to task: calls that let it go.
REMEMBERED: list[Callable[[], None]] = []


def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, after what the same worker process remembers of other operators is let go: in a pipeline it serves stage after
    stage, and what is remembered for one would take memory from the next."""
    for forget in REMEMBERED:
        forget()
    if REMEMBERED:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # give it back to the system, where the C library can
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    return batches


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20, lower: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about limit bytes of text (a longer text alone): rows, bytes (A-Z lowered if asked), offsets; null is empty."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = text.fill_null("")
        wide = pa.types.is_large_string(text.type)
        if batch.num_rows == 0:
            continue
        _, ends, data = text.buffers()
        ends = np.frombuffer(ends, np.int64 if wide else np.int32)[text.offset : text.offset + batch.num_rows + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            part = data[ends[at] : ends[to]]
            yield batch.slice(at, to - at), LOWER[part] if lower else part, ends[at : to + 1] - ends[at]
            at = to


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the first of its words (one entry more than texts)."""
    return runs_of(~separators[data], offsets)


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of True within a text, and for each text the first of its runs (one entry more than texts)."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class SpanHash:
    """64-bit hashes of any spans of a byte array, from one running sum over it."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        if len(self.powers.get(base, ((),))[0]) <= len(data):
            steps = np.full(max(len(data), 1 << 21) + 1, np.uint64(base))
            steps[0] = 1
            back = np.full(len(steps), np.uint64(pow(base, -1, 2**64)))
            back[0] = 1
            self.powers[base] = np.cumprod(steps), np.cumprod(back)
        powers, self.inverses = self.powers[base]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverses[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread what the bits of h tell over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i; 0 where that is empty."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[: bounds[-1]], bounds[some], axis=0, dtype=np.float64)
    return out
