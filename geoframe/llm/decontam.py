"""Benchmark decontamination by pigeonhole edit matching.

An item of m bytes may have k = floor(rate * m) errors. It is cut into k + 1 pieces; a passage within k errors of it
holds at least one piece unchanged. Every place of every text is looked up among the pieces. A hit is first verified on
the largest run of pieces around it, among those from halving the item again and again, that fits a machine word: a run
of L pieces may have L - 1 errors, and by the same argument one of the hits of a true passage passes at every level.
What is left is verified over the whole item. Both use Myers' bit-parallel distance, the first over all hits at once.

Texts are compared as bytes, A-Z lowered and each white space byte as a space. Edge cases: a null or empty text holds
nothing; a null or empty item, or one of white space alone, is nowhere; items with the same text are each reported; repeated rows are each searched;
of several places of an item in a text the best, then the first, is reported; other columns are ignored. Items are sent
to the tasks in blocks of bounded size, each searched against all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm.text import LOWER, SPACES, SpanHash, fresh, small_batches, text_batches

RATE = 0.1
#: Least lengths of the groups of pieces.
LENGTHS = np.array([1, 2, 3, 4, 5, 7, 9])
#: Bytes of items sent to the tasks at once.
BLOCK_BYTES = 16 << 20
HITS = "doc_id long, item_id long, distance int, budget int, start long, end long"

PLAIN = LOWER.copy()
PLAIN[SPACES] = 32


@dataclass
class Pieces:
    """All pieces of the items, by the group of lengths that they are in, then by the hash of their first bytes.

    groups: for each, how many first bytes are hashed, and from where to where its pieces are. Pieces of about equal lengths
    are a group, so short ones don't make the others' hashes short.
    """

    groups: list[tuple[int, int, int]]
    item: np.ndarray
    at: np.ndarray
    size: np.ndarray
    node_at: np.ndarray
    node_size: np.ndarray
    node_budget: np.ndarray
    hashes: np.ndarray
    likely: list[np.ndarray]
    items: list[bytes]
    budgets: list[int]
    item_ids: list


def cut_items(texts: list[str | None], item_ids: list, rate: float) -> Pieces:
    items = [PLAIN[np.frombuffer((t or "").encode(), np.uint8)].tobytes() for t in texts]
    budgets = [int(rate * len(t)) for t in items]
    rows = []
    for n, (text, k) in enumerate(zip(items, budgets)):
        if not text.strip():
            continue
        cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
        for i in range(k + 1):
            a, b = 0, k + 1
            while cuts[b] - cuts[a] > 64 and b - a > 1:
                middle = (a + b) // 2
                a, b = (a, middle) if i < middle else (middle, b)
            rows.append((n, cuts[i], cuts[i + 1] - cuts[i], cuts[a], min(cuts[b] - cuts[a], 64), b - a - 1))
    table = np.array(rows, np.int64).reshape(-1, 6)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in items])]).astype(np.int64)
    begin = offsets[table[:, 0]] + table[:, 1]
    kind = np.searchsorted(LENGTHS, table[:, 2], "right")
    shortest = np.full(len(LENGTHS) + 1, 1 << 30)
    np.minimum.at(shortest, kind, table[:, 2])
    own = shortest[kind]
    hashes = SpanHash(np.frombuffer(b"".join(items), np.uint8))(begin, begin + own) if len(table) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    groups, likely = [], []
    for size in np.unique(own).tolist():
        at = np.flatnonzero(own == size)
        groups.append((size, int(at[0]), int(at[-1]) + 1))
        likely.append(np.zeros(1 << 20, bool))
        likely[-1][hashes[at] >> np.uint64(44)] = True
    return Pieces(groups, *table[order].T, hashes, likely, items, budgets, item_ids)


def piece_hits(pieces: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, place and text of every exact hit; of items that may have no error, the first one in each text."""
    span = SpanHash(data)
    found = [group_hits(pieces, n, span, data, offsets) for n in range(len(pieces.groups))]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def group_hits(pieces: Pieces, group: int, span: SpanHash, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    common, begin, end = pieces.groups[group]
    places = np.arange(max(0, len(data) - common + 1))
    hashes = span(places, places + common)
    places = np.flatnonzero(pieces.likely[group][hashes >> np.uint64(44)])
    low, high = (begin + np.searchsorted(pieces.hashes[begin:end], hashes[places], side) for side in ("left", "right"))
    many = high - low
    place = np.repeat(places, many)
    piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    text = np.searchsorted(offsets, place, "right") - 1
    inside = place + pieces.size[piece] <= offsets[text + 1]
    piece, place, text = piece[inside], place[inside], text[inside]
    # An item that may have no error is one piece, and its first place is enough. Short ones are everywhere in a text, so where
    # the hash is of the whole piece the others go before the comparison.
    exact = np.array(pieces.budgets, np.int64)[pieces.item[piece]] == 0
    piece, place, text = firsts(len(pieces.item), piece, place, text, exact & (pieces.size[piece] == common))
    raw = data.tobytes()
    same = np.fromiter((raw[p : p + s] == pieces.items[i][a : a + s] for p, s, i, a in zip(place.tolist(), pieces.size[piece].tolist(), pieces.item[piece].tolist(), pieces.at[piece].tolist())), bool, len(piece))
    piece, place, text = piece[same], place[same], text[same]
    return firsts(len(pieces.item), piece, place, text, np.array(pieces.budgets, np.int64)[pieces.item[piece]] == 0)


def firsts(n: int, piece: np.ndarray, place: np.ndarray, text: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hits without those marked once that are not the first of their piece (of n) in their text."""
    some = np.flatnonzero(once)
    _, first = np.unique(text[some] * n + piece[some], return_index=True)
    kept = ~once
    kept[some[first]] = True
    return piece[kept], place[kept], text[kept]


def near_hits(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, piece: np.ndarray, place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which hits have their run of pieces within its budget: Myers' recurrence over all of them, 64 bits each."""
    items = np.frombuffer(b"".join(pieces.items), np.uint8)
    item_at = np.concatenate([[0], np.cumsum([len(t) for t in pieces.items])])
    nodes, node = np.unique(np.stack([pieces.item[piece], pieces.node_at[piece], pieces.node_size[piece]], 1), axis=0, return_inverse=True)
    node = node.ravel()
    marks = np.zeros((len(nodes), 256), np.uint64)  # positions of each byte in each run
    for n, (i, a, size) in enumerate(nodes.tolist()):
        run = items[item_at[i] + a : item_at[i] + a + size]
        np.bitwise_or.at(marks[n], run, np.uint64(1) << np.arange(size, dtype=np.uint64))
    size, budget = pieces.node_size[piece], pieces.node_budget[piece]
    begin = np.maximum(place - (pieces.at[piece] - pieces.node_at[piece]) - budget, offsets[text])
    end = np.minimum(place - (pieces.at[piece] - pieces.node_at[piece]) + size + budget, offsets[text + 1])
    one, top = np.uint64(1), (size - 1).astype(np.uint64)
    plus, minus = np.full(len(piece), ~np.uint64(0)), np.zeros(len(piece), np.uint64)
    score, best = size.copy(), size.copy()
    for step in range(int((end - begin).max(initial=0))):
        at = begin + step
        live = at < end
        eq = marks[node, data[np.minimum(at, len(data) - 1)]]
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        hp, hn = minus | ~(d0 | plus), plus & d0
        score = np.where(live, score + (hp >> top & one).astype(np.int64) - (hn >> top & one).astype(np.int64), score)
        best = np.minimum(best, score)
        hp, hn = hp << one, hn << one
        plus, minus = hn | ~(d0 | hp), hp & d0
    return best <= budget


#: Before any start that an item can have: one that lacks its first bytes starts before its text, and may before the slice.
NEVER = -(1 << 62)


def best_end(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of pattern to a substring of text, and the first place where such a substring ends."""
    marks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        marks[c] = marks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, len(pattern) - 1
    plus, minus, score, best, where = full, 0, len(pattern), len(pattern), 0
    for j, c in enumerate(text):
        eq = marks.get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | ~(d0 | plus) & full, plus & d0
        score += (hp >> top & 1) - (hn >> top & 1)
        if score < best:
            best, where = score, j + 1
        plus, minus = (hn << 1 | ~(d0 | hp << 1)) & full, (hp << 1) & d0
    return best, where


def matches(pieces: Pieces, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end) of the best passage for each text and item; places count bytes in data."""
    piece, place, text = piece_hits(pieces, data, offsets)
    near = np.zeros(len(piece), bool)
    for at in range(0, len(piece), 50_000):
        part = slice(at, at + 50_000)
        near[part] = near_hits(pieces, data, offsets, piece[part], place[part], text[part])
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    tried: dict[tuple[int, int], int] = {}
    raw, ends = data.tobytes(), offsets.tolist()
    item, begin = pieces.item[piece[near]], place[near] - pieces.at[piece[near]]
    for t, i, at in sorted(zip(text[near].tolist(), item.tolist(), begin.tolist())):
        k, pattern = pieces.budgets[i], pieces.items[i]
        if at <= tried.get((t, i), NEVER) or found.get((t, i), (1,))[0] == 0:
            continue
        low, high = max(at - k, ends[t]), min(at + len(pattern) + 2 * k, ends[t + 1])
        distance, end = best_end(pattern, raw[low:high])
        tried[t, i] = at + k // 2 if distance <= k else at
        if distance <= k and distance < found.get((t, i), (k + 1,))[0]:
            _, back = best_end(pattern[::-1], raw[low : low + end][::-1])
            found[t, i] = distance, low + end - back, low + end
    return [(t, i, *x) for (t, i), x in found.items()]


def item_blocks(items: DataFrame, rate: float) -> Iterator[Pieces]:
    """The items (item_id, text), cut, in as many blocks as their size asks for, one after the other."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        rows = items.select(F.col("item_id").cast("long"), "text").where(block == b).where("text <> ''").toArrow()
        if rows.num_rows:
            rows = rows.sort_by([("item_id", "ascending"), ("text", "ascending")])
            yield cut_items(rows["text"].to_pylist(), rows["item_id"].to_pylist(), rate)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document (doc_id, text) and item that it holds: doc_id, item_id, distance, budget, start, end (code points)."""

    def search(block):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def rows(batches):
            pieces = sent.value
            for batch, data, offsets in text_batches(batches):
                hits = matches(pieces, PLAIN[data], offsets)
                names, characters = batch.column(0).to_pylist(), np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).tolist()
                out = [(names[t], pieces.item_ids[i], d, pieces.budgets[i], characters[a] - characters[offsets[t]], characters[b] - characters[offsets[t]]) for t, i, d, a, b in hits]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["doc_id", "item_id", "distance", "budget", "start", "end"])

        return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, HITS)

    found = [search(b) for b in item_blocks(items, rate)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], HITS)


def without_items(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, with their own columns, that hold no item."""
    for block in item_blocks(items, rate):

        def rows(batches, sent=docs.sparkSession.sparkContext.broadcast(block)):
            for batch, data, offsets in text_batches(fresh(batches)):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in matches(sent.value, PLAIN[data], offsets)]] = False
                yield batch.filter(pa.array(clean))

        docs = small_batches(docs).mapInArrow(lambda batches, f=rows: f(batches), docs.schema)
    return docs
