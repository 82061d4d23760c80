"""Fuzzy line deduplication by MinHash over character shingles, in DataFrame functions alone.

A text's lines end at line feeds. Lines are compared trimmed and in lower case. A line's set holds its distinct runs of
``SHINGLE`` characters; two lines are linked if the Jaccard similarity of their sets is ``PERCENT`` hundredths or more. Lines
shorter than ``MIN_CHARS`` have too few shingles for that and are linked with equal lines only; empty lines are left alone. Of
each component only the first line (by doc_id, place, then text) stays.

1. Equal lines are one node, named by a 64-bit hash, so copies meet nowhere but in a count. The texts of the nodes are
   shuffled once, into buckets of that name; signatures, parities and the choice of lines that share a band follow there.
2. Signatures: ``BANDS`` x ``ROWS`` minima of the hashes of all of a line's shingles, each under its own xor mask (which orders the
   hashes anew). Each distinct line is signed once. A pair of similarity 0.8 shares none of the 8 bands of 3 rows with
   probability 0.003.
3. Pairs that share a band (see ``linking``) and at least ``LEAST_EQUAL`` of all minima are verified on the full sets of the hashes
   of all shingles. A pair of similarity 0.8 has fewer equal minima with probability 7e-6. Before any set of a pair is built,
   parities tell most others apart: each line that shares a band has a map of ``64 * WORDS`` bits, a bit being the parity of the
   shingles that fall on it. Bits that differ between two lines are no more than the shingles that only one of them has, so
   a pair with too many of them is no link; this loses none. Pairs of a bucket's members are told apart by them inside
   the join that makes them, before their minima.
4. Components come from union-find over tables.

Null texts have no lines. Equal doc_ids with equal texts are one document. Rows without doc_id come
first in the order. Columns other than doc_id and text are carried by ``clean`` and not read otherwise.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.base import bucketed, hashed_parts, stage
from episodica.llm.components import union_find
from episodica.llm.linking import linked

SHINGLE, MIN_CHARS, PERCENT, BANDS, ROWS, LEAST_EQUAL, WORDS = 8, 16, 80, 8, 3, 10, 16
#: Shingles of a line that are signed together, which spares three of four updates of the minima, and turned over together.
STEP, TURNED = 4, 8


def text_key() -> Column:
    return F.xxhash64("text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, place, line as compared): every line of every text."""
    lines = docs.where("text is not null").select(
        "doc_id", text_key().alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line")
    )
    return lines.withColumn("line", F.lower(F.trim("line")))


def compared(lines: DataFrame) -> DataFrame:
    return lines.where("line != ''").withColumn("id", F.xxhash64("line"))


def shingles(lines: DataFrame, size: int = SHINGLE, step: int = 1) -> DataFrame:
    """(id, h0, h1, ...) from (id, line): the hashes of ``step`` shingles of a line a row; its last one fills the last row.

    Two bytes hold a character, so a shingle is cut in constant time.
    """
    wide = lines.select("id", F.encode("line", "UTF-16BE").alias("u"))
    last = F.greatest(F.lit(1), F.octet_length("u") - 2 * size + 1)
    cells = wide.select("id", "u", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(2 * step))).alias("at"))
    starts = [F.col("at")] + [F.least(F.col("at") + 2 * j, F.col("last")) for j in range(1, step)]
    return cells.select("id", *[F.xxhash64(F.substr("u", at, F.lit(2 * size))).alias(f"h{j}") for j, at in enumerate(starts)])


def signatures(lines: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(id, m0, m1, ...) from (id, line), the upper halves of the minima."""
    draw = random.Random(1)
    masks = [draw.getrandbits(64) - (1 << 63) for _ in range(bands * rows)]
    least = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(STEP)])) for m in masks]
    return shingles(lines, size, STEP).groupBy("id").agg(*[F.shiftright(m, 32).cast("int").alias(f"m{k}") for k, m in enumerate(least)])


def bands_of(signed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(bucket, id): a line's buckets, one a band."""
    return signed.select(F.explode(F.array(*[_bucket(b, rows) for b in range(bands)])).alias("bucket"), "id")


def _bucket(band: int, rows: int) -> Column:
    return F.xxhash64(F.lit(band), *[f"m{band * rows + r}" for r in range(rows)])


def first_shared(bands: int) -> Column:
    """The bucket of the first band in which the buckets x0, x1, ... and y0, y1, ... agree."""
    return F.coalesce(*[F.when(F.col(f"x{b}") == F.col(f"y{b}"), F.col(f"x{b}")) for b in range(bands)])


def shared_lines(members: DataFrame) -> DataFrame:
    """Members (bucket, id) of the buckets that hold more than one id, with the smallest id of each.

    Each line is in a bucket once, so rows of three numbers are dealt once; a bucket that is large is sorted on disk.
    """
    within = Window.partitionBy("bucket")
    ends = members.select("*", F.min("id").over(within).alias("leader"), F.max("id").over(within).alias("_last"))
    return ends.where("leader < _last").drop("_last")


def alike(n: int, least: int) -> Column:
    """Whether the signatures m0, m1, ... and k0, k1, ... agree in enough places."""
    return reduce(add, [(F.col(f"m{k}") == F.col(f"k{k}")).cast("int") for k in range(n)]) >= least


def shingle_hashes(line: Column, size: int = SHINGLE) -> Column:
    """The hashes of a line's shingles.

    The encoded line is the outer lambda's variable: read as a column of the row, its bytes would be copied for every shingle.
    """
    def hashed(u: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(u) - 2 * size + 1), F.lit(2))
        return F.transform(starts, lambda at: F.xxhash64(F.substr(u, at, F.lit(2 * size))))

    return F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), hashed), F.lit(0))


def parities(lines: DataFrame, words: int = WORDS, size: int = SHINGLE) -> DataFrame:
    """(id, n, w0, w1, ...): the size of a line's set, and a map of bits whose parities its shingles turn over."""
    # The generator makes Spark build a set once; inlined it would be built for every place of the second one.
    sets = lines.select("id", F.explode(F.array(F.array_distinct(shingle_hashes(F.col("line"), size)))).alias("s"))
    cells = sets.select("id", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(TURNED))).alias("from"))
    cells = cells.select("id", F.size("s").alias("n"), *[F.get("s", F.col("from") + j).alias(f"h{j}") for j in range(TURNED)])
    at = [F.pmod(F.shiftright(f"h{j}", 6), F.lit(words)).cast("int").alias(f"at{j}") for j in range(TURNED)]
    bit = [F.expr(f"shiftleft(1L, cast(h{j} & 63 as int))").alias(f"bit{j}") for j in range(TURNED)]
    bits = cells.select("id", "n", *at, *bit)
    zero = F.lit(0).cast("long")

    def turned(k: int) -> Column:
        here = [F.when(F.col(f"at{j}") == k, F.col(f"bit{j}")).otherwise(zero) for j in range(TURNED)]
        return F.bit_xor(reduce(lambda x, y: x.bitwiseXOR(y), here)).alias(f"w{k}")

    return bits.groupBy("id").agg(F.max("n").alias("n"), *[turned(k) for k in range(words)])


def near_enough(words: int, percent: int) -> Column:
    """Whether the sets of n, w0, ... and l, v0, ... can be similar enough: no more shingles than these bits tell are apart."""
    apart = reduce(add, [F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(words)])
    return (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("l"))


def _similar(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (a, b, n, l) whose full sets, of n and l shingles, are similar enough. Lines travel as text, a tenth of their sets."""
    a = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    b = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    # Dealt by number: a few short pairs would else be drawn into one task, and their sets are what takes the time.
    both = pairs.join(a, "a").repartition(hashed_parts(pairs.sparkSession), "b").join(b, "b")
    shared = F.size(F.array_intersect(shingle_hashes(F.col("line_a"), size), shingle_hashes(F.col("line_b"), size)))
    # The same as 100 * shared >= percent * union.
    return both.where((100 + percent) * shared >= percent * (F.col("n") + F.col("l"))).select("a", "b")


def _components(
    lines: DataFrame, put: Callable[[DataFrame, str], DataFrame], percent: int, bands: int, rows: int, size: int, least_equal: int
) -> DataFrame:
    """(id, component) of the lines that are linked with others."""
    # Equal lines meet within tasks first. The lines' texts are dealt once, by id; what follows finds them in its buckets.
    distinct = put(lines.groupBy("id").agg(F.first("line").alias("line")), "id")
    signed = put(signatures(distinct, bands, rows, size), "id")
    shared = stage(shared_lines(bands_of(signed, bands, rows)))
    mine = shared.select("id").distinct().hint("shuffle_hash")  # the smaller side, so no line is sorted
    texts = put(distinct.join(mine, "id", "left_semi"), "id")
    n = bands * rows
    first = put(signed.join(parities(texts, WORDS, size).hint("shuffle_hash"), "id"), "id")
    other = {"id": "b", "n": "l"} | {f"m{k}": f"k{k}" for k in range(n)} | {f"w{k}": f"v{k}" for k in range(WORDS)}
    second = first.withColumnsRenamed(other)
    sides = ["n", *[f"w{k}" for k in range(WORDS)]]
    near_by = alike(n, least_equal) & near_enough(WORDS, percent)

    def similar(pairs: DataFrame) -> DataFrame:
        near = pairs.join(first.withColumnRenamed("id", "a"), "a").join(second, "b").where(near_by)
        return _similar(near.select("a", "b", "n", "l"), texts, percent, size)

    def meet(rest: DataFrame) -> DataFrame:
        """Members of a bucket in different components that may be links, told apart by their parities within the join.

        A pair is taken from the first bucket it shares; that one is among the rest, as any that holds two components is.
        ``similar`` asks for the minima: with them the join's code would be too long for Java to compile.
        """
        one = rest.join(first.select("id", *sides, *[_bucket(b, rows).alias(f"x{b}") for b in range(bands)]), "id")
        two = one.withColumnsRenamed({"id": "b", "c": "d"} | {c: other[c] for c in sides} | {f"x{b}": f"y{b}" for b in range(bands)})
        one = one.withColumnRenamed("id", "a")
        once = (F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & (F.col("bucket") == first_shared(bands))
        return one.join(two.withColumnRenamed("bucket", "_b"), F.col("bucket") == F.col("_b")).where(once & near_enough(WORDS, percent)).select("a", "b")

    return linked(shared, similar, union_find, percent, meet=meet)


def removed_lines(
    docs: DataFrame,
    percent: int = PERCENT,
    min_chars: int = MIN_CHARS,
    bands: int = BANDS,
    rows: int = ROWS,
    size: int = SHINGLE,
    least_equal: int = LEAST_EQUAL,
) -> DataFrame:
    """(doc_id, key, places): the lines of each document that are near copies of an earlier one."""
    lines = compared(lines_of(docs))
    named = stage(lines.select("doc_id", "key", "place", "id"))
    with bucketed(docs.sparkSession) as put:
        components = _components(lines.where(F.length("line") >= min_chars), put, percent, bands, rows, size, least_equal)
    seen = named.join(components, "id", "left")
    seen = seen.select("doc_id", "key", "place", F.coalesce("component", "id").alias("component"))
    order = F.struct("doc_id", "place", "key")
    leading = seen.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    gone = seen.join(leading.where("n > 1"), "component")
    gone = gone.where(~order.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("place")).alias("places"))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and the places of the removed lines, comma-joined."""
    counted = docs.select(
        "doc_id", text_key().alias("key"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines")
    )
    counted = counted.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    out = _with_places(counted, counted["key"], removed_lines(docs, **options))
    return out.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("_places", ","), F.lit("")).alias("removed_lines"),
    )


def _with_places(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows, and beside them the places of their removed lines (null where none went)."""
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("places").alias("_places"))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["_doc"]) & (key == gone["_key"]), "left")


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents without their removed lines; a document all of whose text went is left out."""
    gone = removed_lines(docs, **options)
    joined = _with_places(docs, F.xxhash64(docs["text"]), gone)
    places, old, whole = F.col("_places"), docs["text"], F.col("_whole")
    # Through the generator a text is split once; inlined into the lambda it would be split for every line.
    joined = joined.select("*", F.explode(F.array(F.when(places.isNotNull(), F.split(old, "\n", -1)))).alias("_whole"))
    left = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), places)  # a hash set: linear in the lines
    kept = F.transform(left, lambda place: F.get(whole, place))
    text = F.when(places.isNull(), old).otherwise(F.array_join(kept, "\n"))
    return joined.where(places.isNull() | (F.trim(text) != "")).select(*[text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])
