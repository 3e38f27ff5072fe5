"""Spelling variants: words that one edit turns into each other, found by asymmetric chunks.

A word is cut into two disjoint chunks, its halves. One edit (a code point inserted, deleted or replaced) leaves one of them
as it is, at most one place further on. So each word gives its chunks, and also the positional grams that a chunk of a word
one edit away could be: of the same length or one shorter, at the places that one edit leaves. Many words share a half,
so the half that holds the edit is cut in two again, and the piece of it that stays is part of what must agree. Chunks and
grams meet in an equal join; the edit distance is checked there. Of a pair the shorter word (of two of one length the
lesser) gives chunks and the longer one grams, so a pair meets in one way.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lowered. Edge cases: a null text has no words; a
null id counts as an empty one where slips are planted; rows that repeat count again; an empty table gives no rows; a word
near no other has no form, and is its own root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm.text import crc32_sql, runs_of, small_batches, text_batches
from geoframe.plans.storage import stored_large

#: A slip is made in one of so many runs of a document.
SLIPS = 97
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Of a run of more bytes the checksum is taken alone, of shorter ones all together.
LONG = 256


def crc_table() -> np.ndarray:
    """What a byte does to a CRC-32, for all 256 bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of data, each going on from what it has begun with (zlib.crc32's second argument)."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    ascending = sizes[order][::-1]
    c = begun[order] ^ np.uint32(0xFFFFFFFF)
    at, long = starts[order], int((sizes > LONG).sum())
    for j in range(int(ascending[-1 - long]) if long < len(sizes) else 0):
        more = slice(long, len(sizes) - int(np.searchsorted(ascending, j, "right")))
        c[more] = CRC[(c[more] ^ data[at[more] + j]) & 255] ^ (c[more] >> np.uint32(8))
    out = np.empty(len(sizes), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(begun[i]))
    return out


def word_counts(batches: Iterator[pa.RecordBatch], slips: int = SLIPS, least_length: int = LEAST_LENGTH) -> Iterator[pa.RecordBatch]:
    """word and n of each slice of texts: runs of letters with their slips made, of least_length code points at least.

    The letters of all runs stand in one byte array; what is dropped from a run is masked out, so what is left is the data
    of an array of strings.
    """
    for rows, data, offsets in text_batches(batches):
        ids = ["" if i is None else str(i) for i in rows.column(0).to_pylist()]
        # U+00C0 to U+00FF are the bytes C3 80 to C3 BF; C3 begins nothing else.
        wide = data == 0xC3
        letter = wide | ((data >= 97) & (data <= 122))
        letter[1:] |= wide[:-1]
        starts, ends, first = runs_of(letter, offsets)
        if not len(starts):
            continue
        begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        h = checksums(data, starts, ends, np.repeat(begun, np.diff(first))).astype(np.int64)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.searchsorted(heads, starts)
        length = np.searchsorted(heads, ends) - at
        slip = h % slips == 0
        lost = heads[at[slip] + h[slip] % length[slip]]
        lost = np.concatenate([lost, lost[wide[lost]] + 1])
        keep = length - slip >= least_length
        edges = np.zeros(len(data) + 1, np.int8)
        edges[starts[keep]] += 1
        edges[ends[keep]] -= 1
        kept = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
        kept[lost] = False
        upto = np.concatenate([[0], np.cumsum(kept)])
        bounds = np.concatenate([upto[starts[keep]], upto[-1:]])
        words = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[kept]))
        counts = words.value_counts()
        yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], ["word", "n"])


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, how often it occurs, of the words that are long and frequent enough."""
    some = small_batches(docs).select("doc_id", "text").mapInArrow(lambda b: word_counts(b, least_length=least_length), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def kept_and_lost(length: Column, longer: int) -> list[Column]:
    """For a word of so many code points (plus longer): in which quarter the edit is supposed, what is kept without it, and it."""
    half = F.floor(length / 2).cast("int")
    bounds = [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((length - half) / 2).cast("int"), length]
    word, rows = F.col("word"), []
    for quarter in range(4):
        start, end = bounds[quarter], bounds[quarter + 1] + longer
        kept = F.concat(F.substring(word, F.lit(1), start), F.lit("|"), F.substring(word, end + 1, length + longer))
        rows.append(F.struct(length.alias("of"), F.lit(quarter).alias("quarter"), kept.alias("kept"), F.substring(word, start + 1, end - start).alias("lost")))
    return rows


def chunks(words: DataFrame) -> DataFrame:
    """Each word's half that an edit leaves, with the piece of the other half that it leaves too: four rows a word."""
    return words.select("word", "n", F.inline(F.array(*kept_and_lost(F.length("word"), 0))))


def grams(words: DataFrame) -> DataFrame:
    """The positional grams of each word that can be what chunks() gives for a word of its length or one less, one edit away.

    After a replacement what follows the edit is at its own place, after an insertion one further on.
    """
    size = F.length("word")
    return words.select("word", "n", F.inline(F.array(*kept_and_lost(size, 0), *kept_and_lost(size - 1, 1))))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs a, b of words (with na, nb, their counts) that exactly one edit turns into each other, each once."""
    a = chunks(words).withColumnsRenamed({"word": "a", "n": "na", "lost": "in_a"})
    b = grams(words).withColumnsRenamed({"word": "b", "n": "nb", "lost": "in_b"})
    ordered = (F.length("b") > F.col("of")) | (F.col("a") < F.col("b"))
    # What is kept is the same in both, so the words are as far apart as what is not. Rows are four and eight times the words,
    # which Spark doesn't see in their file.
    found = a.join(b.hint("merge"), ["of", "quarter", "kept"]).where(ordered & (F.levenshtein("in_a", "in_b", 1) == 1))
    # An insertion between two quarters is found in both.
    return found.select("a", "na", "b", "nb").distinct()


def with_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words (word, n) with n_near, the number of near words, and form, form_n: the most frequent of them (of equals the least in
    code-point order), if it occurs at least times as often."""
    pairs = stored_large(near_pairs(words), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).unionAll(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    joined = words.join(best.hint("merge"), "word", "left")
    keep = -F.col("best.m") >= times * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(keep, F.col("best.near")).alias("form"), F.when(keep, -F.col("best.m")).alias("form_n"))


def with_roots(formed: DataFrame, times: int = TIMES) -> DataFrame:
    """formed (word, n, form, ..) with root, the last word that forms lead to; the word itself if it has none.

    Along forms n grows times-fold, which bounds their number; each round doubles the distance that pointers reach.
    """
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    most, least = formed.agg(F.max("n"), F.min("n")).first()
    steps = math.log(most / least, times) + 1 if most else 1
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        links = stored_large(links, "form-links")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(links.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame) -> DataFrame:
    """Per word of docs word, form, root, n, n_near, form_n."""
    words = stored_large(counted(docs), "words")
    return with_roots(stored_large(with_forms(words), "forms")).select("word", "form", "root", "n", "n_near", "form_n")


def oracle() -> str:
    """The rows of grouped() as DuckDB SQL over documents. Near words are found by what they are without one code point."""
    return f"""with recursive runs as (
      select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
    each as (select doc_id, run, count(*) as n from runs group by all),
    summed as (select run, n, {crc32_sql("coalesce(cast(doc_id as varchar), '') || ':' || run")} as h from each),
    slipped as (select n, case when h % {SLIPS} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from summed),
    words as (select word, cast(sum(n) as bigint) as n from slipped where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
    less as (select word, n, p, substr(word, 1, p) || substr(word, p + 2) as rest from (select word, n, unnest(range(length(word))) as p from words)),
    near as (
      select a.word, b.word as near, b.n as m from less a join less b using (p, rest) where a.word <> b.word
      union select a.word, b.word, b.n from less a join words b on a.rest = b.word
      union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
    best as (select word, count(*) as n_near, max(m) as most from near group by word),
    firsts as (select word, n_near, most, min(near) as near from best join near using (word) where m = most group by all),
    forms as (
      select word, n, coalesce(n_near, 0) as n_near, case when most >= {TIMES} * n then near end as form, case when most >= {TIMES} * n then most end as form_n
      from words left join firsts using (word)),
    roots as (
      select word, coalesce(form, word) as root, 1 as step from forms
      union all select r.word, f.form, step + 1 from roots r join forms f on f.word = r.root where f.form is not null)
    select word, form, root, n, n_near, form_n from forms join (select word, arg_max(root, step) as root from roots group by word) using (word)"""
