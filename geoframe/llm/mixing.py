"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

The sources, in code-point order with null last, have weights that repeat; they share a budget of words. A source's target
stops at TIMES times its size, and what it leaves is shared among the others by weight. The documents of a source queue in
a shuffled order, up to TIMES times over. A document's virtual finish time is the words of its source up to its end,
divided by the source's target: all sources are served at once, each at its own rate. Sorted by that time over all
sources, the queue is the mix; it ends where the budget is spent, within a document if need be.

A size is the number of runs of bytes that are no white space (space, \\t to \\r); a null text has none. Edge cases: rows
are shuffled by a hash of id and text, so repeated rows follow each other and each is served as one of its own; null ids and
null sources are values like any other; a document or source without words takes none (target 0); a source may be one
document, which then is cut; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.plans.storage import stored

WEIGHTS, TIMES = (5, 2, 1), 3
#: Rows that a bucket of a running total has on average.
BUCKET = 4096
SPACES = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Runs of characters that are no white space, counted; null has none. No array of words is made."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t-\r]+", "x"), SPACES, "")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Per row doc_id, source, size and place, 32 hex digits: rows in the order of place are shuffled."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    place = F.md5(F.concat(name, F.lit(" "), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place.alias("place"))


def weighed(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with their weight, by the place in code-point order, null last, and their number.

    A row per source comes together in one task, nothing of their documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(w) for w in weights])
    return sources.withColumn("queue", place).withColumn("weight", F.get(turn, F.col("queue") % len(weights)))


def targets(sources: DataFrame, budget: int, times: int = TIMES) -> DataFrame:
    """sources (source, source_size, weight) with their target: least(times * source_size, level * weight), where the level
    spends the budget (all of it if the limits allow).

    What sources take is a concave function of the level with a kink at each limit; Newton's method finds the level after
    few rounds, each a sum over the sources.
    """
    limit, level = times * F.col("source_size"), 0.0
    while True:
        open_ = limit >= F.lit(level) * F.col("weight")
        spent, share = sources.agg(F.sum(F.when(~open_, limit).otherwise(0)), F.sum(F.when(open_, F.col("weight")).otherwise(0))).first()
        higher = (budget - spent) / share if share else level
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def before(df: DataFrame, keys: list[str], bucket: str, order: list, weight: str, name: str) -> DataFrame:
    """df with the sum of weight over the rows before its own, by keys, where buckets follow each other and rows are in the
    order inside them: sums of buckets first, so that no task has all rows of a key."""
    rows = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.select(*keys, bucket, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before")), "offsets")
    inside = df.withColumn("__inside", F.coalesce(F.sum(weight).over(rows), F.lit(0)))
    return inside.join(offsets, [*keys, bucket]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES, budget: int | None = None) -> tuple[DataFrame, int]:
    """Rows of docs without their texts, with source_size, target and begin, the words of the source before its own in the
    shuffled order; and the budget, which is all words unless given."""
    rows = stored(sized(docs), "sizes")
    sums = stored(weighed(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights), "sources")
    total, n = sums.agg(F.sum("source_size"), F.sum("n")).first()
    budget = (total or 0) if budget is None else budget
    aims = stored(targets(sums, budget, times), "targets").select(F.col("source").alias("__source"), "queue", "source_size", "target")
    joined = rows.join(aims, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # place is uniform, so its first digits deal the rows evenly, whatever their source.
    buckets = (n or 0) // BUCKET + 1
    dealt = joined.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)))
    return stored(before(dealt, ["queue"], "bucket", ["place", "size"], "size", "begin"), "queued"), budget


def mixed(rows: DataFrame, budget: int, times: int = TIMES) -> DataFrame:
    """The mix over rows that queued() gave: one row per document and time that it is served, with begin_words and words (how many
    it gives), finish (its virtual time) and first_at, the words of the mix before it. In the order of first_at it is the mix."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    served = rows.where("size > 0").withColumn("turn", turn).withColumn("start", F.col("turn") * F.col("source_size") + F.col("begin"))
    # A queue's service ends at its target: all targets together are the budget, so by then it is spent.
    share = F.ceil("target")
    cut = served.where(F.col("start") < share).withColumn("words", F.least("size", share - F.col("start")))
    timed = cut.withColumn("finish", (F.col("start") + F.col("words")) / F.col("target"))
    # In any stretch of virtual time sources are served the same words, so equal stretches are equal ranges of the sort.
    stretches = rows.count() // BUCKET + 1
    ranged = timed.withColumn("stretch", F.least(F.floor(F.col("finish") * stretches), F.lit(stretches)))
    ordered = before(ranged, [], "stretch", ["finish", "queue", "start"], "words", "first_at")
    return ordered.where(F.col("first_at") < budget).withColumn("words", F.least("words", budget - F.col("first_at")))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES, budget: int | None = None) -> DataFrame:
    """Per row of docs doc_id, source, size, source_size, target, taken (its words in the mix, repeats counted) and first_at (words
    of the mix before it; null if it is not in it)."""
    rows, budget = queued(docs, weights, times, budget)
    columns = ["doc_id", "source", "size", "source_size", "target"]
    mix = mixed(rows, budget, times)
    # begin tells rows of a source with words apart, repeated ones too.
    some = mix.groupBy("queue", "begin", *columns).agg(F.sum("words").alias("taken"), F.min("first_at").alias("first_at"))
    none = rows.where((F.col("size") == 0) | (F.col("begin") >= F.ceil("target"))).select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_at"))
    return some.select(*columns, "taken", "first_at").unionByName(none)


def oracle() -> str:
    """The rows of taken() as DuckDB SQL over documents."""
    size = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
    return f"""with sized as (
      select doc_id, source, cast({size} as bigint) as size, md5(coalesce(cast(doc_id as varchar), '-') || ' ' || md5(coalesce(text, ''))) as place from documents),
    sources as (
      select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as queue from sized group by source),
    weighed as (
      select *, cast({TIMES} * source_size as double) as lim, case queue % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end as weight from sources),
    -- the level if the sources with smaller limits for their weight are full; of these the right one is the largest
    levels as (
      select ((select sum(size) from sized) - coalesce(sum(lim) over earlier, 0)) / (sum(weight) over rest) as level
      from weighed window earlier as (order by lim / weight, queue rows between unbounded preceding and 1 preceding), rest as (order by lim / weight, queue rows between current row and unbounded following)),
    aims as (
      select source, queue, source_size, least(lim, weight * (select max(level) from levels)) as target from weighed),
    queued as (
      select doc_id, source, size, source_size, target, queue,
        coalesce(sum(size) over (partition by queue order by place, size rows between unbounded preceding and 1 preceding), 0) as begin, row_number() over () as r
      from sized join aims using (source)),
    timed as (
      select *, turn * source_size + begin as start, least(size, ceil(target) - (turn * source_size + begin)) as words
      from queued, range({TIMES}) t(turn) where size > 0 and turn * source_size + begin < ceil(target)),
    ordered as (
      select r, words, coalesce(sum(words) over (order by (start + words) / target, queue, start rows between unbounded preceding and 1 preceding), 0) as first_at from timed),
    mix as (
      select r, sum(least(words, (select sum(size) from sized) - first_at)) as taken, min(first_at) as first_at
      from ordered where first_at < (select sum(size) from sized) group by r)
    select doc_id, source, size, cast(source_size as bigint) as source_size, target, cast(coalesce(taken, 0) as bigint) as taken, cast(mix.first_at as bigint) as first_at
    from queued left join mix using (r)"""
