"""Token-id files of directly addressable codes.

A block holds the ids of some consecutive documents. Ids are split into chunks of `bits` bits. Level 0 has the
lowest chunk of every id and a continuation bitmap that marks ids with more chunks; level 1 has the next chunk of
those ids and its own bitmap, and so on. A rank directory counts the marks before every 512 ids, so the place of an
id in the next level is one lookup and one short count: any id is read without decoding its neighbours.

A file is a Parquet table of such blocks in document order; `write_token_files` makes it, `read_documents` and
`token_at` read it. Edge cases: a null or empty text has only the end id; a null doc_id sorts first; rows that share a
doc_id follow each other; an empty table gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.llm.text import small_batches, text_batches
from geoframe.llm.tokens import Ids, with_end

MAGIC = b"DAC1"
EVERY = 512
#: Ids after which a block ends (a longer document has a longer block).
BLOCK_IDS = 1 << 16
#: first_token: ids of the shard (what one task writes) before the block.
BLOCKS = "shard long, block int, n_docs int, first_token long, n_tokens long, payload binary"


def pack(ids: np.ndarray, doc_ids: list, bounds: np.ndarray, bits: int = 8) -> bytes:
    """One block: ids of documents doc_ids, each from bounds[i] to bounds[i+1]."""
    kind = np.uint8 if bits <= 8 else np.uint16
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(bits)
        marks = more > 0
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(marks, np.arange(0, max(len(marks), 1), EVERY), dtype=np.uint32) if len(marks) else [])]).astype("<u4")
        levels.append((rest & np.uint32((1 << bits) - 1)).astype(kind).tobytes() + np.packbits(marks, bitorder="little").tobytes() + ranks.tobytes())
        levels[-1] = struct.pack("<Q", len(rest)) + levels[-1]
        if not marks.any():
            break
        rest = more[marks]
    known = np.array([d is not None for d in doc_ids])
    head = struct.pack("<4sBBII", MAGIC, bits, len(levels), len(doc_ids), len(ids))
    return head + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.astype(np.uint8).tobytes() + bounds.astype("<u4").tobytes() + b"".join(levels)


class Block:
    """A block's parts, as views of its bytes."""

    def __init__(self, payload: bytes):
        magic, self.bits, n_levels, n, self.n_tokens = struct.unpack_from("<4sBBII", payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = 14
        self.doc_ids = np.frombuffer(payload, "<i8", n, at)
        self.known = np.frombuffer(payload, np.uint8, n, at + 8 * n)
        self.bounds = np.frombuffer(payload, "<u4", n + 1, at + 9 * n)
        at += 13 * n + 4
        kind = np.dtype(np.uint8 if self.bits <= 8 else "<u2")
        self.levels = []
        for _ in range(n_levels):
            (m,) = struct.unpack_from("<Q", payload, at)
            chunks = np.frombuffer(payload, kind, m, at + 8)
            at += 8 + m * kind.itemsize
            marks = np.frombuffer(payload, np.uint8, -(-m // 8), at)
            at += len(marks)
            ranks = np.frombuffer(payload, "<u4", -(-m // EVERY) + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, marks, ranks))

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one chunk of each level that it has."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, marks, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (k * self.bits)
            if not marks[i >> 3] >> (i & 7) & 1:
                break
            begin = i // EVERY * EVERY
            ahead = np.unpackbits(marks[begin >> 3 : (i >> 3) + 1], bitorder="little")[: i - begin]
            i = int(ranks[i // EVERY]) + int(ahead.sum())
        return value

    def all(self) -> np.ndarray:
        """All ids."""
        out, at = np.zeros(self.n_tokens, np.uint32), np.arange(self.n_tokens)
        for k, (chunks, marks, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(k * self.bits)
            at = at[np.unpackbits(marks, count=len(chunks), bitorder="little").astype(bool)]
        return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, bits: int = 8) -> None:
    """Encode docs (doc_id, text) and write their ids, in ascending doc_id order, to the token files at path.

    One shuffle orders the texts by ranges of doc_id (and a hash of the text, so that one id's rows are no hot key); each task
    then encodes its range and writes its blocks. A shard is what one task writes.
    """

    def blocks(batches):
        encoder, shard, number, written = Ids.of(tokenizer), TaskContext.get().partitionId(), 0, 0
        held, held_ids, held_bounds = [], [], [0]

        def made():
            nonlocal number, written
            row = {"shard": [shard], "block": [number], "n_docs": [len(held)], "first_token": [written], "n_tokens": [held_bounds[-1]], "payload": [pack(np.concatenate(held_ids), held, np.array(held_bounds), bits)]}
            number, written = number + 1, written + held_bounds[-1]
            held.clear(), held_ids.clear(), held_bounds.__setitem__(slice(None), [0])
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int64()), ("block", pa.int32()), ("n_docs", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        for rows, data, offsets in text_batches(batches, lower=encoder.lowers):
            ids, bounds = with_end(*encoder.encode(data, offsets), end_id)
            names = rows.column(0).to_pylist()
            at = 0
            while at < len(names):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_IDS - held_bounds[-1], "right")) - 1)
                held += names[at:to]
                held_ids.append(ids[bounds[at] : bounds[to]])
                held_bounds += (bounds[at + 1 : to + 1] - bounds[at] + held_bounds[-1]).tolist()
                if held_bounds[-1] >= BLOCK_IDS or to < len(names):
                    yield made()
                at = to
        if held:
            yield made()

    own = small_batches(docs).select(F.col("doc_id").cast("long"), "text").withColumn("place", F.xxhash64("text"))
    ordered = own.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """For each shard (a task's range of rows) the count of ids before it. As many rows as write tasks."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(path)
    # One row per write task, so small enough to send to all.
    placed = blocks.select("shard", "first_token", "payload").join(F.broadcast(shard_starts(blocks)), "shard").select("payload", (F.col("shard_start") + F.col("first_token")).alias("start"))

    def documents(batches):
        for batch in batches:
            for payload, start in zip(batch.column(0), batch.column(1).to_pylist()):
                block = Block(payload.as_py())
                raw, bounds = block.all().astype("<u4").tobytes(), block.bounds.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=block.known == 0), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """The id at each global position (column position) of the token files; null beyond the end."""
    blocks = spark.read.parquet(path)
    first = F.col("shard_start") + F.col("first_token")
    places = blocks.join(F.broadcast(shard_starts(blocks)), "shard").select("shard", "block", first.alias("lo"), (first + F.col("n_tokens")).alias("hi"))
    # A directory of stretches of BLOCK_IDS positions, so that it is an equal join: a block of usual size is in one or two.
    stretch = lambda c: F.floor(F.col(c) / BLOCK_IDS) if isinstance(c, str) else F.floor(c / BLOCK_IDS)
    directory = places.withColumn("stretch", F.explode(F.sequence(stretch("lo"), stretch(F.col("hi") - 1))))
    wanted = positions.select("position").distinct().withColumn("stretch", stretch("position"))
    near = wanted.join(directory, "stretch").where("position >= lo and position < hi").drop("stretch")
    found = near.join(blocks.select("shard", "block", "payload"), ["shard", "block"])

    def ids(batches):
        for batch in batches:
            position, offset, payload = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(position, pa.int64()), pa.array([Block(p)[o] for p, o in zip(payload, offset)], pa.int64())], ["position", "token_id"])

    got = found.select(F.col("position").cast("long"), (F.col("position") - F.col("lo")).alias("offset"), "payload").mapInArrow(ids, "position long, token_id long")
    return positions.join(got, "position", "left")
