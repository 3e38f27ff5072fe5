"""SimHash near-duplicates by BK-trees.

A document's fingerprint has a bit set if over half of its shingles' hashes have it. Two fingerprints that differ in at
most `radius` bits agree in one of radius + 1 blocks of bits, so all links are found inside shards, one for each block
and value of its first bits; so many bits are used that a shard has about NODES distinct fingerprints. A shard's
fingerprints go into a BK-tree, whose children are keyed by their Hamming distance to the parent; a search starts at the
root and follows only edges whose distance is within the radius of its own. Shards and their trees stay where their
fingerprints are shuffled to: sending all trees to all tasks would broadcast data that grows with the corpus. A shard of
more than SHARD_MOST fingerprints is split again by blocks of the bits that are still free. Of the links in a shard only
a spanning forest of the shortest is handed on, never all pairs.

`classes` links fingerprints. `one_of_each` drops near copies: several independent fingerprints of two-word shingles give
candidates, and two texts are linked only if the Jaccard similarity of their sets of five-word shingles is LEAST or more.

Edge cases: a null or empty text has no shingle and fingerprint zero, linked like any other; fewer words than a shingle
are one shingle; texts without words are all alike; repeated rows share a fingerprint; a null doc_id never names a class
unless it is all there is; an empty table gives no rows; other columns, whatever their names, are kept (one_of_each) or
ignored (classes).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm.text import LOWER, SpanHash, mixed, small_batches, text_batches, words_of
from geoframe.operators.graph import connected_components
from geoframe.plans.storage import stored

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Distinct fingerprints that a shard is meant to have, and beyond which it is split.
NODES, SHARD_MOST = 1024, 16_384
#: Entries of the searches under way in a task at once, and links held before they are cut down to a forest.
FRONTIER, HELD = 1 << 18, 1 << 19
#: Of near copies: independent fingerprints, their radius, words of their shingles, words of the shingles that are compared, and the similarity of a link.
TABLES, WIDE, PAIR, FIVE, LEAST = 6, 5, 2, 5, 0.8
FULL = (1 << 64) - 1


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of lowered texts again, with one space after each; where each begins (one entry more); first word of each text."""
    starts, ends, firsts = words_of(data, offsets)
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    plain = np.full(at[-1], 32, np.uint8)
    letters = np.arange(sizes.sum())
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    plain[letters + np.repeat(np.arange(len(sizes)), sizes)] = data[letters + np.repeat(starts - before, sizes)]
    return plain, at, firsts


def shingle_spans(at: np.ndarray, firsts: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes where each shingle starts and ends, and for each text the first of its shingles (one entry more than texts)."""
    words = np.diff(firsts)
    shingles = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    first = np.arange(bounds[-1]) + np.repeat(firsts[:-1] - bounds[:-1], shingles)
    last = np.minimum(first + shingle, np.repeat(firsts[1:], shingles))
    return at[first], at[last] - 1, bounds


#: For each byte its bits, the highest first, as eight counters of a byte each.
COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: the bits that over half of its hashes have."""
    out, many = np.zeros(len(bounds) - 1, np.uint64), np.diff(bounds)
    some = np.flatnonzero(many)
    if len(some):
        # Counted over runs of at most 255 hashes first, so that a byte is enough.
        runs = -(-many[some] // 255)
        firsts = np.concatenate([[0], np.cumsum(runs)])
        begin = np.repeat(bounds[some], runs) + 255 * (np.arange(firsts[-1]) - np.repeat(firsts[:-1], runs))
        counts = np.add.reduceat(COUNTERS[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)], begin, axis=0).view(np.uint8)
        counts = np.add.reduceat(counts.astype(np.int64), firsts[:-1], axis=0)
        out[some] = np.packbits(2 * counts > many[some, None], axis=1).view(">u8").ravel()
    return out


def of_texts(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of lowered texts from the XXH64 of all their shingles, repeats included."""
    plain, at, firsts = plain_words(data, offsets)
    start, end, bounds = shingle_spans(at, firsts, shingle)
    raw, digest = plain.tobytes(), xxhash.xxh64_intdigest
    return majority(np.array([digest(raw[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())], np.uint64), bounds)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as ascending 40-bit hashes, and the first of each text (one entry more than texts)."""
    plain, at, firsts = plain_words(data, offsets)
    start, end, bounds = shingle_spans(at, firsts, shingle)
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    keys = np.sort(text << np.uint64(40) | SpanHash(plain)(start, end) >> np.uint64(24))
    keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
    return keys & np.uint64((1 << 40) - 1), np.searchsorted(keys >> np.uint64(40), np.arange(len(bounds), dtype=np.uint64))


def near_copy_prints(data: np.ndarray, offsets: np.ndarray, tables: int = TABLES) -> list[np.ndarray]:
    """Independent fingerprints of lowered texts from their distinct two-word shingles."""
    hashes, bounds = shingle_sets(data, offsets, PAIR)
    return [majority(mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * m + 1)), bounds) for m in range(tables)]


def with_prints(docs: DataFrame, keep: list[str], prints, names: list[str]) -> DataFrame:
    """The columns keep of docs and the arrays that prints(data, offsets) gives for each row's text, as longs."""
    fields = [docs.schema[c] for c in keep]

    def rows(batches):
        for batch, data, offsets in text_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(f.view(np.int64)) for f in prints(data, offsets))], [*(f.name for f in fields), *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return small_batches(docs).select(*keep, "text").mapInArrow(rows, f"{schema}, {', '.join(n + ' long' for n in names)}")


class BKTrees:
    """One BK-tree for each group of values (groups are consecutive): the first value of a group is its root, and what has
    the same distance to a node makes up one child of it. Nodes are numbered level by level."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        roots = np.flatnonzero(np.diff(group, prepend=-1))
        self.values, self.root = values, np.cumsum(np.diff(group, prepend=-1) != 0) - 1
        entries, keys, held, owner, base = [], [], np.arange(len(values)), self.root, 0
        while len(held):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            entries.append(held[first])
            rest = np.ones(len(held), bool)
            rest[first] = False
            held, owner = held[rest], np.cumsum(~rest)[rest] - 1
            distance = np.bitwise_count(values[held] ^ values[entries[-1][owner]]).astype(np.int64)
            key = (base + owner) * 65 + distance
            order = np.argsort(key, kind="stable")
            held, key = held[order], key[order]
            new = np.diff(key, prepend=-1) != 0
            keys.append(key[new])
            base, owner = base + len(entries[-1]), np.cumsum(new) - 1
        self.entry = np.concatenate(entries) if entries else np.zeros(0, np.int64)
        # below[node * 65 + d]: the first child, of this or a later node, at a distance of d or more.
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=len(self.entry) * 65 + 1))]) + len(roots)

    def pairs(self, radius: int):
        """(a, b, distance), entry a before b, of all within the radius in one group, some at a time; and how many nodes were visited."""
        todo, visited = [(np.arange(len(self.values)), self.root)], 0
        while todo:
            query, node = todo.pop()
            if len(node) > FRONTIER and len(node) > 1:
                half = len(node) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            visited += len(node)
            entry = self.entry[node]
            distance = np.bitwise_count(self.values[query] ^ self.values[entry]).astype(np.int64)
            near = (distance <= radius) & (entry < query)
            if near.any():
                yield entry[near], query[near], distance[near], 0
            low, high = self.below[node * 65 + np.maximum(distance - radius, 0)], self.below[node * 65 + np.minimum(distance + radius, 64) + 1]
            many = high - low
            if many.any():
                todo.append((np.repeat(query, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)))
        yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), visited


def shortest_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of edges that make up a spanning forest of least weight, by Boruvka's rounds."""
    order = np.argsort(weight, kind="stable")
    a, b, label, kept = a[order], b[order], np.arange(n), []
    place = np.arange(len(a))
    while len(place):
        la, lb = label[a[place]], label[b[place]]
        apart = la != lb
        place, la, lb = place[apart], la[apart], lb[apart]
        if not len(place):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, la, place)
        np.minimum.at(best, lb, place)
        chosen = np.unique(best[best < len(a)])
        kept.append(chosen)
        # Join what the chosen edges connect: each label to the least that it reaches.
        la, lb, to = label[a[chosen]], label[b[chosen]], np.arange(n)
        while True:
            least = np.minimum(to[la], to[lb])
            if (least == to[la]).all() and (least == to[lb]).all():
                break
            np.minimum.at(to, la, least)
            np.minimum.at(to, lb, least)
            to = to[to]
        label = to[label]
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


def forest_of(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (a, b: places in values) that hold all that is linked in each group together; nodes visited."""
    held, n, visited = [np.zeros((3, 0), np.int64)], 0, 0

    def cut():
        all_links = np.concatenate(held, 1)
        return [all_links[:, shortest_forest(len(values), *all_links)]]

    for *links, seen in BKTrees(values, group).pairs(radius):
        held.append(np.stack(links))
        n, visited = n + len(links[0]), visited + seen
        if n > HELD:
            held, n = cut(), 0
    (a, b, _), = cut()
    return a, b, visited


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_bits(free: int, blocks: int, bits: int) -> list[int]:
    """For each of so many blocks of the free bits, (at most) its first so many bits; nothing at all for no bits."""
    if not bits:
        return [0]
    places = [i for i in range(64) if free >> i & 1]
    cuts = [round(i * len(places) / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in places[a : min(z, a + bits)]) for a, z in zip(cuts, cuts[1:]) if z > a]


def bits_for(size: int) -> int:
    """Bits that make about NODES a shard of so many fingerprints."""
    return max(0, -(-size // NODES) - 1).bit_length()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (table, src, dst) between fingerprints that hold all of their groups together.

    distinct has each fingerprint once: table (which kind it is of; only those of one kind are linked) and fp.
    """
    size = distinct.groupBy("table").count().agg(F.max("count")).first()[0] or 0
    # Of the shards of a mask, all bits that aren't in it are free.
    made = [(m, FULL & ~m) for m in first_bits(FULL, radius + 1, bits_for(size))]
    rows, found = distinct.select("table", "fp", F.explode(F.array(*[F.lit(signed(m)) for m, _ in made])).alias("mask")), []
    value, key = F.col("fp").bitwiseAND(F.col("mask")), ["table", "mask", "value"]
    while True:
        hot = stored(rows.groupBy("table", "mask", value.alias("value")).count().where(F.col("count") > SHARD_MOST), "hot-shards")
        # At most as many as there are masks; each has at least radius + 1 free bits, or it could not be as large.
        largest = {r.mask: r.most for r in hot.groupBy("mask").agg(F.max("count").alias("most")).collect()}
        if not largest:
            found.append(tree_links(rows, radius))
            break
        valued = rows.withColumn("value", value)
        found.append(tree_links(valued.join(hot, key, "left_anti"), radius))
        nexts = {m: [(m | n, free & ~n) for n in first_bits(free, radius + 1, bits_for(largest[signed(m)]))] for m, free in made if signed(m) in largest}
        again = distinct.sparkSession.createDataFrame([(signed(m), [signed(n) for n, _ in some]) for m, some in nexts.items()], "mask long, again array<long>")
        split = valued.join(hot, key, "left_semi").join(again, "mask")
        rows = stored(split.select("table", "fp", F.explode("again").alias("mask")).distinct(), "shards")
        made = list({m: (m, free) for some in nexts.values() for m, free in some}.values())
    return reduce(DataFrame.union, found).distinct()


def tree_links(shards: DataFrame, radius: int) -> DataFrame:
    """Links (table, src, dst) inside each shard (table, mask, and the bits of fp in mask): a task has whole shards, some at a time."""

    def linked(parts: list[tuple[np.ndarray, ...]]):
        table, mask, fp = (np.concatenate(x) for x in zip(*parts))
        a, b, _ = forest_of(fp.view(np.uint64), np.concatenate([[0], np.cumsum(new_shard(table, mask, fp))]), radius)
        return pa.RecordBatch.from_arrays([pa.array(table[a]), pa.array(fp[a]), pa.array(fp[b])], ["table", "src", "dst"])

    def new_shard(table, mask, fp) -> np.ndarray:
        return (table[1:] != table[:-1]) | (mask[1:] != mask[:-1]) | ((fp[1:] ^ fp[:-1]) & mask[1:] != 0)

    def rows(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = tuple(batch.column(i).to_numpy() for i in range(3))
            if held and new_shard(*(np.concatenate([h[-1:], p[:1]]) for h, p in zip(held[-1], part)))[0] and sum(len(h[0]) for h in held) > SHARD_MOST:
                yield linked(held)
                held = []
            cut = np.flatnonzero(new_shard(*part)) + 1
            if len(cut) and sum(len(h[0]) for h in held) + cut[-1] > SHARD_MOST:
                yield linked([*held, tuple(p[: cut[-1]] for p in part)])
                held, part = [], tuple(p[cut[-1] :] for p in part)
            held.append(part)
        if held:
            yield linked(held)

    value = F.col("fp").bitwiseAND(F.col("mask"))
    ordered = shards.select("table", "mask", "fp").repartition("table", "mask", value).sortWithinPartitions("table", "mask", value, "fp")
    return ordered.mapInArrow(rows, "table int, src long, dst long")


def fingerprint_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each distinct fp of prints (doc_id, fp): component_id, the smallest doc_id of what it is linked to."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    found = links(distinct.select(F.lit(0).alias("table"), "fp"), radius).select("src", "dst")
    labels = connected_components(found)
    rooted = stored(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("root")), "rooted")
    smallest = stored(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "classes")
    return stored(rooted.join(smallest, "root").select("fp", "component_id"), "class-of")


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(with_prints(docs.select("doc_id", "text"), ["doc_id"], lambda data, offsets: [of_texts(data, offsets)], ["fp"]), "prints")
    named = prints.join(fingerprint_classes(prints, radius), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def digest(text: str) -> Column:
    """Which text a row has: its MD5, that of an empty text for null."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def alike(pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (src, dst, src_text, dst_text) whose texts' sets of five-word shingles have at least that Jaccard similarity."""

    def rows(batches):
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                raw = [x.as_py().encode() for x in (a, b)]
                data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
                sets, bounds = shingle_sets(data, np.array([0, len(raw[0]), len(data)]), FIVE)
                n, m = np.diff(bounds).tolist()
                both = len(np.intersect1d(sets[: bounds[1]], sets[bounds[1] :], assume_unique=True))
                kept[i] = both >= least * (n + m - both)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(kept)) for i in (0, 1)], ["src", "dst"])

    return small_batches(pairs).select("src", "dst", "src_text", "dst_text").mapInArrow(rows, "src binary, dst binary")


def copy_links(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (src, dst: digests) that hold the near copies among the texts of prints (t, doc_id: one that has it, f0, f1, ..) together.

    In each table of fingerprints, texts of the same one are linked to the first of them, and the trees link the first of
    each. What is linked that way is a candidate; of a group of candidates each text is compared with the group's first,
    and then those links that have not been settled by that.
    """
    names = [f"f{m}" for m in range(TABLES)]
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("table"), F.col(n).alias("fp")) for m, n in enumerate(names)]))
    by_table = prints.select("t", kinds.alias("k")).select("t", "k.table", "k.fp")
    first = stored(by_table.groupBy("table", "fp").agg(F.min("t").alias("name"), F.count("*").alias("n")), "first-of-prints")
    shared = by_table.join(first.where("n > 1"), ["table", "fp"]).where("t <> name").select(F.col("name").alias("src"), F.col("t").alias("dst"))
    ends = [first.select("table", F.col("fp").alias(k), F.col("name").alias(f"{k}_name")) for k in ("src", "dst")]
    near = links(first.select("table", "fp"), WIDE).join(ends[0], ["table", "src"]).join(ends[1], ["table", "dst"]).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
    candidates = stored(near.union(shared).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "candidates")
    groups = connected_components(candidates).select(F.col("node").alias("t"), F.col("component").alias("first"))
    # Joined by doc_id, too, so that the copies of one text are no hot key. The merge hints keep one plan for all sizes: what
    # they are put on grows with the corpus.
    owned = groups.join(prints.select(F.col("t").alias("__t"), F.col("doc_id").alias("__id")), F.col("t") == F.col("__t")).drop("t")
    known = docs.select("doc_id", digest("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    known = known.join(owned.hint("merge"), (F.col("t") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    texts = stored(known.groupBy("t").agg(F.first("first").alias("first"), F.first("text").alias("text")), "texts-of-candidates")
    firsts = texts.where("t = first").select(F.col("t").alias("src"), F.col("text").alias("src_text"))
    members = texts.where("t <> first").select(F.col("first").alias("src"), F.col("t").alias("dst"), F.col("text").alias("dst_text"))
    like_first = stored(alike(members.join(firsts.hint("merge"), "src")), "like-the-first")
    settled = stored(groups.join(like_first.select(F.col("dst").alias("t"), F.lit(True).alias("like")), "t", "left").select("t", (F.col("like").isNotNull() | (F.col("t") == F.col("first"))).alias("like"), "first"), "settled")
    ends = [settled.select(F.col("t").alias(k), F.col("like").alias(f"{k}_like"), F.col("first").alias(f"{k}_first")) for k in ("src", "dst")]
    # A link to the group's first has been compared, whatever came of it.
    left = stored(candidates.join(ends[0], "src").join(ends[1], "dst").where("not (src_like and dst_like) and src <> src_first and dst <> dst_first").select("src", "dst"), "links-left")
    sides = [texts.select(F.col("t").alias(k), F.col("text").alias(f"{k}_text")) for k in ("src", "dst")]
    return like_first.union(alike(left.join(sides[0], "src").join(sides[1], "dst")))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, of which one stays for each class of near copies: that with the smallest doc_id."""
    # Names that no column has, whatever its case.
    t, id_, t_, stays = (unused(docs, name) for name in ("__text", "__row_id", "__row_text", "__row_stays"))
    own = docs.withColumn(t, digest("text"))
    prints = stored(with_prints(own.select("doc_id", F.col(t).alias("t"), "text"), ["doc_id", "t"], near_copy_prints, [f"f{m}" for m in range(TABLES)]), "prints")
    # Null ids last.
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    texts = stored(prints.groupBy("t").agg(F.min(named).alias("best"), *[F.first(f"f{m}").alias(f"f{m}") for m in range(TABLES)]), "texts")
    labels = connected_components(copy_links(texts.withColumn("doc_id", F.col("best.doc_id")).drop("best"), docs))
    rooted = texts.join(labels.withColumnRenamed("node", "t"), "t", "left").select("best", F.coalesce("component", "t").alias("root"))
    chosen = stored(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.t"), "chosen")
    rows = prints.groupBy("doc_id", "t").count()
    one = chosen.select(F.col("doc_id").alias(id_), F.col("t").alias(t_))
    marked = rows.join(one, (F.col("t") == F.col(t_)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    marked = marked.select(F.col("doc_id").alias(id_), F.col("t").alias(t_), F.col(t_).isNotNull().alias(stays), "count")
    marked = stored(marked.where(~F.col(stays) | (F.col("count") > 1)).select(id_, t_, stays), "rows-that-go-or-repeat")
    repeating = stored(marked.where(stays).drop(stays), "rows-that-repeat")
    same = (F.col(t) == F.col(t_)) & F.col("doc_id").eqNullSafe(F.col(id_))
    once = own.join(marked.drop(stays).hint("merge"), same, "left_anti")
    repeated = own.join(repeating, same, "left_semi").dropDuplicates(["doc_id", t])
    return once.unionByName(repeated).drop(t)
