"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all windows of the training texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``n`` consecutive words of an item; an item
of fewer words is one window. Every window of a document is hashed (Rabin-Karp) and looked up; a hit is verified
word by word. A document word inside any occurrence is hit.

The windows are numbered by Spark. They are broadcast in blocks of at most ``block`` windows: a usual benchmark is one block; a
larger one takes several scans, whose hits are put together per document.

Null texts and items without words have no windows. Rows are told apart by (doc_id, hash of the text); repeated rows
all get the same result. Items without an id count as text that must not be trained on, but appear in no list. Other columns
are carried by ``clean`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.base import byte_slices, stage
from episodica.llm.words import ALNUM_LOWER, Powers, cut

WINDOW = 13
BLOCK = 500_000
HITS = "doc_id long, row long, n_words long, spans array<array<long>>, items array<long>"


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """All windows of the items: hash, number of words, the words joined by spaces, ids of the items that hold it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(1)):
                words = cut(data, offsets, ALNUM_LOWER, powers)
                names = batch.column(0)[low:high].to_pylist()
                rows = []
                for k, count in enumerate(words.counts()):
                    size = min(n, int(count))
                    for at in range(words.first[k], words.first[k + 1] - size + 1) if size else ():
                        rows.append((names[k], size, words.text(at, at + size, ALNUM_LOWER).decode()))
                columns = list(zip(*rows)) if rows else [[]] * 3
                kinds = [pa.int64(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "size", "words"]
                )

    found = items.select("item_id", "text").mapInArrow(scan, "item_id long, size int, words string")
    return found.groupBy("size", "words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def needles(rows: list[tuple[int, str, list[int]]]) -> dict[int, tuple[np.ndarray, list[bytes], list[list[int]]]]:
    """A block of windows in memory: by length, sorted hashes with the words and the items of each."""
    powers, by_size = Powers(), {}
    for size in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == size]
        texts = [r[1].encode() for r in own]
        offsets = np.cumsum([0, *map(len, texts)])
        hashes = cut(np.frombuffer(b"".join(texts), np.uint8), offsets, ALNUM_LOWER, powers).whole(np.arange(len(own)))
        order = np.argsort(hashes, kind="stable")
        by_size[size] = hashes[order], [texts[k] for k in order], [own[k][2] for k in order]
    return by_size


def _scan(docs: DataFrame, block) -> DataFrame:
    """Per row: number of words, spans (first word, word after the last; merged) hit and items found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, by_size = Powers(), block.value
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(2)):
                words = cut(data, offsets, ALNUM_LOWER, powers)
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[int]] = {}
                for size, (hashes, texts, owners) in by_size.items():
                    if not len(words.hashes):
                        continue
                    at, bounds = words.inside(size)
                    own = words.runs(size)[at]
                    first = np.searchsorted(hashes, own)
                    hit = np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == own)
                    rows = np.searchsorted(bounds, hit, side="right") - 1
                    for h, row in zip(hit.tolist(), rows.tolist()):
                        begin, k = int(at[h]), int(first[h])
                        text = words.text(begin, begin + size, ALNUM_LOWER)
                        while k < len(hashes) and hashes[k] == own[h]:
                            if texts[k] == text:
                                begin -= int(words.first[row])
                                spans.setdefault(row, []).append((begin, begin + size))
                                items.setdefault(row, set()).update(owners[k])
                                break
                            k += 1
                n = high - low
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high],
                        batch.column(1)[low:high],
                        pa.array(words.counts(), pa.int64()),
                        pa.array([merged(spans.get(k, [])) for k in range(n)], pa.list_(pa.list_(pa.int64()))),
                        pa.array([sorted(items.get(k, ())) for k in range(n)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "row", "n_words", "spans", "items"],
                )

    return docs.select("doc_id", row_key().alias("row"), "text").mapInArrow(scan, HITS)


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(docs: DataFrame, items: DataFrame, n: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, row, n_words, spans, items."""
    spark = docs.sparkSession
    found = stage(windows(items, n))
    blocks = max(1, -(-found.count() // block))
    part = F.pmod(F.xxhash64("words"), F.lit(blocks))
    scans = []
    for b in range(blocks):  # each holds about ``block`` windows
        rows = [(r["size"], r["words"], r["items"]) for r in found.where(part == b).toLocalIterator()]
        scans.append(_scan(docs, spark.sparkContext.broadcast(needles(rows))))
    if blocks == 1:
        return scans[0]
    joined = reduce(DataFrame.unionByName, scans).groupBy("doc_id", "row", "n_words")
    joined = joined.agg(
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    copies = docs.groupBy(row_key().alias("row")).agg(F.count("*").alias("copies"))
    joined = joined.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return joined.select("doc_id", "row", "n_words", F.udf(merged, "array<array<long>>")("spans").alias("spans"), "items")


def report(docs: DataFrame, items: DataFrame, n: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per row: n_words, n_hit, n_items, items_sha256 and whether at least a twentieth of the words is hit."""
    found = hits(docs, items, n, block)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, 1) - F.get(s, 0))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "row",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, n: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    The verdicts are joined by row key alone, so they carry no text; Spark splits a skewed key of the document side.
    """
    bad = report(docs, items, n, block).where("contaminated").select(F.col("row").alias("_row")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == bad["_row"], "left_anti")
