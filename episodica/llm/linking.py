"""Components of the similar pairs among the members of buckets, without making all pairs of a bucket.

1. Every member of a bucket is compared with the bucket's smallest id, its leader. A bucket of true near copies then is
   one star, and further pairs of it could tell nothing new.
2. What is left are pairs of a bucket whose members lie in different components. For a link, a member must share at least
   the asked percentage of its own set with a single member of another component, so as much of its set must occur
   in other components at all. Members that fail this (heavily edited copies: their edits are theirs alone) have no
   link left to find; once they are set aside, others fail too, until nothing changes. This loses no link. Before the last
   step the same is asked of the elements that occur in partners of each size.
3. Those that remain meet a second leader of their bucket, drawn by a hash, which joins the fragments of large groups.
4. What is left is compared pair by pair, inside the tasks that hold the buckets (``compare``), or in a join whose condition
   tells most pairs apart (``meet``), so that only the few that may be links leave it.

Steps 2 and 4 in tasks need the sets' elements as rows, which pays for long texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.base import stage

Step = Callable[[DataFrame], DataFrame]
Compare = Callable[[DataFrame, DataFrame], DataFrame]


def shared_members(members: DataFrame) -> DataFrame:
    """Members (bucket, id) of the buckets that hold more than one id, with the smallest id of each."""
    shared = members.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("_last"))
    return members.join(shared.where("leader < _last").drop("_last"), "bucket").distinct()


def contested(shared: DataFrame, components: DataFrame) -> DataFrame:
    """(bucket, id, c): members of the buckets that hold more than one component."""
    named = shared.join(components, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("bucket").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low != _high")
    return named.join(mixed.select("bucket"), "bucket")


def foreign_rows(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(id, c, n, h): elements that occur in several components. ``rows``: (id, n, h)."""
    own = rows.join(named, "id")
    seen = own.groupBy("h").agg(F.min("c").alias("_low"), F.max("c").alias("_high"))
    return own.join(seen.where("_low != _high").select("h"), "h")


def still_open(rows: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(id, c): those of the named ids that may have a link into another component."""
    before = None
    while True:
        alive = foreign_rows(rows, named).groupBy("id", "c", "n").agg(F.count("*").alias("k"))
        named = stage(alive.where(100 * F.col("k") >= percent * F.col("n")).select("id", "c"))
        now = named.count()
        if not now or (before and now > 0.95 * before):  # further rounds would cost more than they spare
            return named
        before = now


def open_by_size(rows: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """As ``still_open``, by the partner's size too: sets of n and m elements need (n + m) * percent / (100 + percent) in common.

    Partners are taken by classes of size in steps of a fiftieth; the smallest size of a class gives its bound.
    """
    before = None
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.02)))
    reach = F.log(F.lit(100.0 / percent)) / F.log(F.lit(1.02))
    while True:
        own = stage(rows.join(named, "id").withColumn("w", size))
        seen = own.groupBy("h", "w").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("m"))
        least = seen.groupBy("w").agg(F.min("m").alias("m"))
        seen = seen.drop("m").join(F.broadcast(least), "w")  # one row per class of size: at most 50 * ln(longest set)
        met = own.alias("x").join(seen.alias("y"), F.expr("x.h = y.h and (y.low != x.c or y.high != x.c)"))
        met = met.where(F.abs(F.col("x.w") - F.col("y.w")) <= reach + 1)
        alive = met.groupBy("id", "c", "n", "y.w", "m").agg(F.count("*").alias("k"))
        alive = alive.where((100 + percent) * F.col("k") >= percent * (F.col("n") + F.col("m")))
        named = stage(alive.select("id", "c").distinct())
        now = named.count()
        if not now or now == before:
            return named
        before = now


def linked(
    shared: DataFrame,
    similar: Step,
    components: Step,
    percent: int,
    elements: Step | None = None,
    compare: Compare | None = None,
    meet: Step | None = None,
) -> DataFrame:
    """(id, component) of all ids with a similar partner in a bucket.

    ``shared``: a stored table (bucket, id, leader). ``similar`` keeps the pairs (a, b) that are links; ``elements`` gives
    (id, n, h) for a table of ids: the size of each set and a row per element. ``compare`` does the last step: it gets the
    rows of the ids left and their buckets (bucket, id, c) and gives links that join all similar ids. Without these two, no
    member is set aside, and ``meet`` gives the pairs (a, b) of different c in a bucket that may be links.
    """
    pairs = shared.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = stage(similar(pairs))
    found = components(links)
    rest = contested(shared, found)
    named = stage(rest.select("id", "c").distinct())
    if not named.take(1):
        return found
    if elements:
        rows = stage(elements(named.select("id")))
        rest = rest.join(still_open(rows, named, percent).select("id"), "id", "left_semi")
    rest = stage(rest)
    lead = rest.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id").alias("x"), "id", "c")).alias("l"))
    pairs = rest.join(lead, "bucket").where("c != l.c").select(F.col("id").alias("b"), F.col("l.id").alias("a"))
    links = stage(links.union(similar(pairs.select("a", "b").distinct())))
    found = components(links)
    rest = contested(rest.select("bucket", "id"), found)
    if elements:
        named = open_by_size(rows, still_open(rows, rest.select("id", "c").distinct(), percent), percent)
        rest = rest.drop("c").join(named, "id")
        more = compare(rows.join(named.select("id"), "id", "left_semi"), rest)
    else:
        more = similar(meet(stage(rest)).distinct())
    more = stage(more)
    return components(links.union(more)) if more.take(1) else found
