"""Merkle manifest of a dataset: leaves per source, trees over them, a tree over the sources, and a proof for every leaf.

H is the lowercase hex sha256 of its inputs, one after the other, digests as hex text. A leaf is H of the fields of a row, each
`-` if null, else its length in bytes, a colon and the value. In a source leaves follow each other by doc_id; each FAN
consecutive nodes become their H until one node is left, the source's subroot. Subroots, by source, become the root likewise.

Proofs come by pointer jumping. Each node holds the segment of its path towards the root that it knows, the siblings and
its place among them level by level, and the node where that segment ends. A self-join appends the segment of that node, so
each round doubles the distance, until all segments end at the root. Leaves are nobody's ancestors: they stay with their run
and take up the segment of their parent, once that is whole.

Edge cases: null fields are fields; null ids come first, rows that share an id follow each other by their leaf, repeated
rows are leaves of their own; the null source comes first; a lone leaf is its subroot, a lone subroot the root, and a leaf
without siblings has the H of nothing as its proof; a row without an id is not tampered with; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm.text import crc32_sql
from geoframe.operators.splits import numbered
from geoframe.plans.storage import stored

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of a level in a segment: a byte for the place in the run and its size, then a digest or zeros for each place but its own.
DIGEST = 32
LEVEL = 1 + (FAN - 1) * DIGEST


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and tampered: the leaf of a row whose text lost its line feeds, as every second one does."""
    lost = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    head = F.concat(*[field(F.col(c)) for c in FIELDS[:-1]])
    own = docs.select("doc_id", "source", lost.alias("lost"), head.alias("head"), "text")
    whole = hashed(F.col("head"), field(F.col("text")))
    cut = hashed(F.col("head"), field(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return own.select("doc_id", "source", whole.alias("leaf"), F.when(F.col("lost"), cut).alias("tampered"))


def indexed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with tree (the number of the source), place in it and n, the source's rows; and trees: tree, source, n."""
    placed = stored(numbered(rows, "source", "doc_id", "leaf", name="at"), "leaves")
    sums = placed.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    trees = stored(numbered(sums, "source", name="tree"), "trees")
    # Rows of one source follow each other, so the place in a source is the place among all rows less that of its first.
    own = trees.select(F.col("source").alias("__source"), "tree", "first", "n")
    joined = placed.join(own, F.col("source").eqNullSafe(F.col("__source")))
    return joined.withColumn("place", F.col("at") - F.col("first")).drop("__source", "first", "at"), trees


def runs(nodes: DataFrame, *more: str) -> DataFrame:
    """Runs of FAN consecutive nodes (tree, place, digest, n: nodes of the tree's level, ..): kids in order, and their parent's
    tree, place, digest and n."""
    kids = F.sort_array(F.collect_list(F.struct("place", "digest", *more)))
    grouped = nodes.groupBy("tree", "n", F.floor(F.col("place") / FAN).alias("up")).agg(kids.alias("kids"))
    text = F.array_join(F.transform("kids", lambda k: F.lower(F.hex(k["digest"]))), "")
    return grouped.select("tree", F.col("up").alias("place"), F.unhex(hashed(text)).alias("digest"), F.ceil(F.col("n") / FAN).alias("n"), "kids")


def grown(bottom: DataFrame, most: int, *more: str) -> list[DataFrame]:
    """Runs of all levels above bottom, which has most nodes a tree: level by level, until one node is left of each tree.

    A tree that has come to one node is done, so a run of one is always the last of several.
    """
    levels, nodes = [], bottom
    while most > 1:
        levels.append(stored(runs(nodes.where("n > 1"), *more if not levels else ()), "runs"))
        nodes = levels[-1].drop("kids")
        most = -(-most // FAN)
    return levels


def tops(bottom: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The last node of each tree: tree, height, digest."""
    found = bottom.where("n = 1").select("tree", F.lit(0).alias("height"), "digest")
    for height, level in enumerate(levels, 1):
        found = found.unionAll(level.where("n = 1").select("tree", F.lit(height), "digest"))
    return found


def siblings(kids: Column, own: Column) -> Column:
    """The level of a segment that the kid at own (from 0) of a run has: a byte for own and the run's size, the others' digests."""
    code = F.unhex(F.lpad(F.hex(own * (FAN + 1) + F.size(kids)), 2, "0"))
    other = lambda i: F.when(own == i, F.lit(b"")).otherwise(F.coalesce(F.get(kids, F.lit(i))["digest"], F.lit(bytes(DIGEST))))
    # With room for the digests of a full run all levels are of one length; room that isn't needed comes last.
    present = [other(i) for i in range(FAN)]
    return F.concat(code, *present)


def steps(level: DataFrame, kid: str, up_tree: int | None, up_height: int) -> DataFrame:
    """A row for each kid of the level's runs: its node (kid gives tree, height, place), segment, and the parent's node."""
    rows = level.select("tree", "place", "kids", F.posexplode("kids").alias("own", "kid"))
    parent = F.struct((F.col("tree") if up_tree is None else F.lit(up_tree)).cast("long").alias("tree"), F.lit(up_height).alias("height"), F.col("place").cast("long").alias("place"))
    return rows.select(F.expr(kid).alias("node"), siblings(F.col("kids"), F.col("own")).alias("segment"), parent.alias("up"))


def node(tree: str, height: str, place: str) -> str:
    return f"named_struct('tree', cast({tree} as bigint), 'height', cast({height} as int), 'place', cast({place} as bigint))"


#: The tree over the sources.
OVER = -1


def whole_segments(links: DataFrame, rounds: int) -> DataFrame:
    """links (node, segment, up; up is null where that is the root) with segments up to the root: node, segment.

    Each round joins the nodes that aren't there yet with the nodes their segments end at. What has arrived isn't moved again.
    """
    arrived, active = links.where("up is null"), links.where("up is not null")
    for _ in range(rounds):
        all_ = arrived.unionByName(active).select(F.col("node").alias("up"), F.col("segment").alias("further"), F.col("up").alias("then"))
        moved = active.join(all_, "up").select("node", F.concat("segment", "further").alias("segment"), F.col("then").alias("up"))
        moved = stored(moved, "segments")
        arrived, active = arrived.unionByName(moved.where("up is null")), moved.where("up is not null")
    return arrived.select("node", "segment")


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of docs doc_id, source, leaf, tampered (null if it isn't), subroot, root, and proof: the levels from the leaf to
    the root, LEVEL bytes each."""
    rows, trees = indexed(leaves(docs))
    most, n_trees = trees.agg(F.max("n"), F.count("*")).first()
    rows = stored(rows.withColumn("digest", F.unhex("leaf")), "placed")
    payload = ("doc_id", "source", "leaf", "tampered")
    levels = grown(rows, most or 0, *payload)
    subroots = stored(tops(rows, levels), "subroots")
    sources = subroots.select(F.lit(OVER).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(n_trees).cast("long").alias("n"), "height")
    over = grown(sources, n_trees, "height")
    top = tops(sources.select("tree", "digest", "n"), over).first() if n_trees else None
    # The root is a source's own subroot if there is no other source.
    root = F.expr(node(str(OVER), str(len(over)), "0")) if n_trees > 1 else F.expr(node("0", str(len(levels)), "0"))

    parts = [steps(level, node("tree", str(h), "kid.place"), None, h + 1) for h, level in enumerate(levels) if h]
    parts += [steps(level, node("kid.place", "kid.height", "0") if h == 0 else node(str(OVER), str(h), "kid.place"), OVER, h + 1) for h, level in enumerate(over)]
    segments = None
    if parts:
        links = parts[0]
        for part in parts[1:]:
            links = links.unionByName(part)
        links = stored(links.withColumn("up", F.when(F.col("up") != root, F.col("up"))), "links")
        segments = whole_segments(links, max(len(levels) + len(over) - 1, 1).bit_length())

    def proven(df: DataFrame, at: str) -> DataFrame:
        """df with beyond, the segment of the node at, up to the root; empty if that is the root."""
        if segments is None:
            return df.withColumn("beyond", F.lit(b""))
        own = segments.withColumnsRenamed({"node": "__node", "segment": "beyond"})
        return df.withColumn("__at", F.expr(at)).join(own, F.col("__at") == F.col("__node"), "left").withColumn("beyond", F.coalesce("beyond", F.lit(b""))).drop("__at", "__node")

    named = subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    lone = proven(rows.where("n = 1"), node("tree", "0", "0")).join(named, "tree").select(*payload, "subroot", F.col("beyond").alias("proof"))
    done = lone
    if levels:
        in_runs = proven(levels[0].select("tree", "place", "kids"), node("tree", "1", "place")).join(named, "tree")
        each = in_runs.select("subroot", "beyond", "kids", F.posexplode("kids").alias("own", "kid"))
        done = each.select(*[F.col(f"kid.{c}") for c in payload], "subroot", F.concat(siblings(F.col("kids"), F.col("own")), "beyond").alias("proof")).unionByName(lone)
    return done.select(*payload, "subroot", F.lit(bytes(top.digest).hex() if top else None).alias("root"), "proof")


def levels_of(proof: Column) -> Column:
    """The levels of a proof: where they begin, the leaf's place in the run, and the run's size."""
    numbers = F.expr(f"sequence(0, length(proof) div {LEVEL} - 1)")
    some = F.when(F.length(proof) > 0, numbers).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        code = F.conv(F.hex(F.substring(proof, i * LEVEL + 1, F.lit(1))), 16, 10).cast("int")
        return F.struct((i * LEVEL + 2).alias("begin"), F.floor(code / (FAN + 1)).cast("int").alias("own"), (code % (FAN + 1)).alias("n"))

    return F.transform(some, at)


def digests(proof: Column, begin: Column, n: Column) -> Column:
    return F.lower(F.hex(F.substring(proof, begin, n * DIGEST)))


def siblings_text(proof: Column) -> Column:
    """All siblings, level by level, left to right, as hex text."""
    return F.array_join(F.transform(levels_of(proof), lambda v: digests(proof, v["begin"], v["n"] - 1)), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""

    def up(digest: Column, v: Column) -> Column:
        left = digests(proof, v["begin"], v["own"])
        right = digests(proof, v["begin"] + v["own"] * DIGEST, v["n"] - 1 - v["own"])
        return hashed(left, digest, right)

    return F.aggregate(levels_of(proof), leaf, up)


def verified(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and whether what rows hold now, tampered or not, gives the root with their proof."""
    whole = manifest(docs)
    now = F.coalesce("tampered", "leaf")
    done = whole.withColumn("folded_root", folded(now, F.col("proof")))
    proof = hashed(siblings_text(F.col("proof"))).alias("proof_sha256")
    return done.select("doc_id", "source", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle() -> str:
    """The rows of verified() as DuckDB SQL over documents."""
    plain = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
    head = " || ".join(plain(c) for c in FIELDS[:-1])
    tree = lambda name, base: f"""{name} as (
      {base}
      union all select tree, height + 1, place // {FAN}, sha256(string_agg(digest, '' order by place)), (n + {FAN - 1}) // {FAN}
      from {name} where n > 1 group by tree, height, place // {FAN}, n)"""  # noqa: E731
    return f"""with recursive leaves as (
      select doc_id, source, sha256({head} || {plain("text")}) as leaf,
        case when doc_id is not null and {crc32_sql("cast(doc_id as varchar)")} % 2 = 0 then sha256({head} || {plain("replace(text, chr(10), '')")}) end as tampered from documents),
    placed as (
      select *, row_number() over () as r, dense_rank() over (order by source nulls first) - 1 as tree,
        row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as n from leaves),
    {tree("trees", "select tree, 0 as height, place, leaf as digest, n from placed")},
    subroots as (select tree, height, digest from trees where n = 1),
    {tree("over_", "select -1::bigint as tree, 0 as height, tree as place, digest, count(*) over () as n from subroots")},
    nodes as (select * from trees union all select * from over_),
    steps as (
      select tree, height, place, coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as lefts,
        coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as rights
      from nodes where n > 1 window run as (partition by tree, height, place // {FAN} order by place)),
    paths as (
      select r, tree, 0 as height, place, cast('' as varchar) as proof, coalesce(tampered, leaf) as folded, 0 as level from placed
      union all select r, case when lefts is null then -1 else p.tree end, case when lefts is null then 0 else p.height + 1 end,
        case when lefts is null then p.tree else p.place // {FAN} end, proof || coalesce(lefts || rights, ''),
        case when lefts is null then folded else sha256(lefts || folded || rights) end, level + 1
      from paths p left join steps s on s.tree = p.tree and s.height = p.height and s.place = p.place where p.tree >= 0 or lefts is not null),
    whole as (select r, arg_max(proof, level) as proof, arg_max(folded, level) as folded_root from paths group by r),
    root as (select digest as root from over_ where n = 1)
    select doc_id, source, leaf, digest as subroot, root, sha256(proof) as proof_sha256, folded_root, folded_root = root as verified
    from placed join whole using (r) join subroots using (tree), root"""
