"""Exact substring deduplication over windows of ``n`` words (Rabin-Karp).

Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window that covers it also starts in a document of a smaller doc_id. Windows
are judged on the input, and removed windows merge into maximal intervals.

Every window of every document is hashed. Sending 16 bytes per window through a shuffle would move more than the text,
so windows that can't repeat stay behind, without loss:

1. Each window is represented by the smallest hash among its runs of ``GRAM`` words. Equal windows have equal
   representatives, and neighbours mostly share theirs (one in about 20 words is kept). Counted in Spark, representatives that
   occur in one text only are put aside; so are texts that copy a whole smaller document.
2. Hashes of the windows whose representative repeats are counted: the smallest doc_id that holds each.
3. Each document's repeated windows are gathered (no more than it has words) and cut out.

A null text has no words. Equal texts share one key, the hash of the text; repeated rows (equal doc_id and text) keep the
same words, as only a smaller doc_id counts. Rows without doc_id keep all words and remove none. Texts of any length are
read whole; other columns are not read by ``verdicts``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.base import byte_slices, list_column, stage
from episodica.llm.words import SPACED, Powers, Words, cut

WINDOW, GRAM = 50, 12


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row, by doubling."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def representatives(words: Words, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all windows, where each text's windows begin among them, and the representative of each."""
    at, bounds = words.inside(n)
    if not len(at):
        return at, bounds, np.zeros(0, dtype=np.uint64)
    return at, bounds, sliding_min(words.runs(gram), n - gram + 1)[at]


def _anchors(docs: DataFrame, n: int, gram: int) -> DataFrame:
    """(key, h): the representatives of each text, neighbours that agree once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(1)):
                words = cut(data, offsets, SPACED, powers)
                _, bounds, own = representatives(words, n, gram)
                first = np.ones(len(own), dtype=bool)
                first[1:] = own[1:] != own[:-1]
                first[bounds[:-1][bounds[:-1] < len(own)]] = True
                keys = np.repeat(batch.column(0)[low:high].to_numpy(), np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first], pa.int64()), pa.array(own[first].view(np.int64))], ["key", "h"]
                )

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(scan, "key long, h long")


def _judge(rows: DataFrame, n: int, gram: int) -> DataFrame:
    """Numbers of words; the result of copies and of texts without repeats; windows in question of the others."""
    schema = "key long, doc_id long, n_words long, n_removed long, kept_sha256 string, text string, windows array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column("text")):
                words = cut(data, offsets, SPACED, powers)
                part = batch.slice(low, high - low)
                copies = part.column("is_copy").to_numpy(zero_copy_only=False).astype(bool)
                at, bounds, own = representatives(words, n, gram)
                lists = part.column("hs")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                open_rows = np.flatnonzero((sizes > 0) & ~copies & (np.diff(bounds) > 0))
                runs = words.runs(n) if len(open_rows) else None
                windows, ends = [], np.zeros(high - low + 1, dtype=np.int64)
                for k in open_rows:
                    mine = slice(bounds[k], bounds[k + 1])
                    hs = lists[int(k)].values.to_numpy().view(np.uint64)
                    found = np.unique(runs[at[mine]][np.isin(own[mine], hs)])
                    windows.append(found.view(np.int64))
                    ends[k + 1] = len(found)
                counts = words.counts()
                gone = np.where(copies & (counts >= n), counts, 0)
                asked = ends[1:] > 0
                shas = [
                    None if asked[k] else hashlib.sha256(words.text(a + g, b, SPACED)).hexdigest()
                    for k, (a, b, g) in enumerate(zip(words.first[:-1], words.first[1:], gone))
                ]
                text = part.column("text").take(pa.array(np.arange(high - low), mask=~asked))
                values = np.concatenate(windows) if windows else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(shas, pa.string()),
                        text,
                        list_column(values, np.cumsum(ends), pa.int64()),
                    ],
                    ["key", "doc_id", "n_words", "n_removed", "kept_sha256", "text", "windows"],
                )

    return rows.select("key", "doc_id", "is_copy", "hs", "text").mapInArrow(scan, schema)


def intervals(positions: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Windows at the given places, in ascending order, merged into maximal intervals of words."""
    if not len(positions):
        return []
    breaks = np.flatnonzero(np.diff(positions) > n)
    low = positions[np.concatenate([[0], breaks + 1])]
    high = positions[np.concatenate([breaks, [len(positions) - 1]])] + n
    return list(zip(low.tolist(), high.tolist()))


def _cut_out(rows: DataFrame, n: int) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column("text")):
                words = cut(data, offsets, SPACED, powers)
                at, bounds = words.inside(n)
                runs, part, out = words.runs(n), batch.slice(low, high - low), []
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    a, b, spans = int(words.first[k]), int(words.first[k + 1]), []
                    gone = part.column("gone")[k]
                    if gone.is_valid:
                        mine = at[bounds[k] : bounds[k + 1]]
                        hit = np.isin(runs[mine], gone.values.to_numpy().view(np.uint64))
                        spans = intervals(mine[hit], n)
                    edges = [a, *(x for s in spans for x in s), b]
                    kept = b" ".join(words.text(x, y, SPACED) for x, y in zip(edges[::2], edges[1::2]) if x < y)
                    removed = sum(y - x for x, y in spans)
                    spans = [(x - a, y - a) for x, y in spans]
                    out.append((doc_id, b - a, removed, hashlib.sha256(kept).hexdigest(), spans))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(scan, schema)


def verdicts(docs: DataFrame, n: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and the removed spans (first word, word after the last)."""
    key = F.xxhash64("text").alias("key")
    anchors = _anchors(docs, n, gram)
    texts = anchors.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    repeated = anchors.join(texts.select("h"), "h").groupBy("key").agg(F.collect_set("h").alias("hs"))
    owners = docs.where(F.col("text").isNotNull()).groupBy(key).agg(F.min("doc_id").alias("owner"))
    info = owners.join(repeated, "key", "left")
    rows = docs.select(key, "doc_id", "text").join(info, "key", "left")
    rows = rows.withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False)))
    judged = stage(_judge(rows, n, gram))
    asked = judged.where("size(windows) > 0")
    windows = asked.where("doc_id is not null").select("key", "doc_id", F.explode("windows").alias("window"))
    first = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = first.where("first < last").drop("last")
    gone = windows.join(first, "window").where("doc_id > first").groupBy("key", "doc_id")
    gone = gone.agg(F.collect_set("window").alias("gone"))
    cut_out = _cut_out(asked.select("key", "doc_id", "text").join(gone, ["key", "doc_id"], "left"), n)
    whole = F.when(F.col("n_removed") > 0, F.array(F.array(F.lit(0).cast("long"), F.col("n_words"))))
    done = judged.where("size(windows) = 0").select(
        "doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce(whole, F.array().cast("array<array<long>>")).alias("spans")
    )
    return done.unionByName(cut_out)
