"""Exact deduplication that splits off heavy hitters, in DataFrame functions alone.

Texts are equal when they are identical after every run of blanks (U+0020, U+0009 to U+000D) became one space; a null counts
as an empty text. Of equal texts the row with the smallest doc_id stays, a null doc_id only where the group has no other.

1. Each text is read once: a stage table holds a row's doc_id, a row number and the SHA-256 digest of its normalised text.
2. A Misra-Gries summary (Spark's ``approx_top_k``, a frequent-items sketch whose counters are decremented together) is
   built in the tasks and merged. It holds every digest with more than one in ``2 * parts`` of all rows, ``parts`` being the
   shuffle's number of partitions. A digest it missed would cost time, never a result.
3. Candidates are verified: their rows are counted exactly, combined in the tasks. The winners, fewer than ``2 * parts``
   digests of fixed size, are broadcast, and their rows get their answer where they lie, without a shuffle.
4. The remaining digests are shuffled as usual. None of them holds more rows than half a partition's share.

Defined results: a repeated row (doc_id and text equal) stays once. An empty table gives an empty one. Only doc_id and text
are read by ``mark``; ``deduplicate`` carries all columns under any names, packed into one, and returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.base import hashed_parts, stage

#: Counters for each digest that may be heavy: the summary's error is then below half the share that makes a digest heavy.
COUNTERS_EACH, MOST_COUNTERS = 16, 1_000_000


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "), 256)


def candidates(named: DataFrame, most: int) -> DataFrame:
    """The digests of ``named`` that the Misra-Gries summary holds as frequent, ``most`` at the utmost."""
    counters = min(max(COUNTERS_EACH * most, 1024), MOST_COUNTERS)
    top = named.agg(F.expr(f"approx_top_k(digest, {min(most, counters)}, {counters})").alias("top"))
    return top.select(F.explode("top.item").alias("digest"))


def winners(named: DataFrame, parts: int) -> DataFrame:
    """(digest, first, n): the digests that hold more than one in ``2 * parts`` of all rows, verified, fewer than ``2 * parts``.

    ``first`` is the row that stays.
    """
    found = named.join(F.broadcast(candidates(named, 2 * parts)), "digest")
    exact = found.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    rows = named.agg(F.count("*").alias("rows")).scalar()
    return stage(exact.where(F.col("n") * (2 * parts) > rows))


def _named(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """The stage table: ``place`` orders the rows of a group, its number tells repeated rows apart."""
    number = F.monotonically_increasing_id()
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), number.alias("row"))
    return stage(docs.select(place.alias("place"), digest(F.col("text")).alias("digest"), *carried))


def _answered(named: DataFrame) -> DataFrame:
    """The stage table with ``first`` and ``n`` of each row's group."""
    heavy = winners(named, hashed_parts(named.sparkSession))
    tagged = named.join(F.broadcast(heavy), "digest", "left")
    group = Window.partitionBy("digest")
    light = tagged.where("n is null").drop("first", "n")
    light = light.withColumn("first", F.min("place").over(group)).withColumn("n", F.count("*").over(group))
    return tagged.where("n is not null").select(*light.columns).union(light)


def mark(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 of the normalised text."""
    return _answered(_named(docs, [])).select(
        F.col("place.id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place.row") == F.col("first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    whole = F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("whole")
    kept = _answered(_named(docs, [whole])).where("place.row = first.row")
    return kept.select(*[F.col(f"whole.c{k}").alias(c) for k, c in enumerate(docs.columns)])
