"""Packing by power-of-two decomposition: no sequence crosses two documents, none holds padding.

A document of n ids (its end id included) is cut into pieces whose lengths are the powers of two of n, with as many
pieces of the longest length as fit. Pieces of equal length form a bucket; every piece is a sequence of its own, so a batch
drawn from a bucket is a full rectangle. Sequences are numbered bucket by bucket, the shortest first, by (doc_id, hash
of the document, start) within a bucket.

Null texts count as empty: they hold the end id alone. Repeated rows are packed as often as they occur, texts of any length
are cut further, an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.base import give_back_memory, stage, worker_cache
from episodica.llm.encoding import Encoder, little

PIECES = "doc_id long, part int, start long, length long, doc_tokens long, ids binary"


def powers(n: int, longest: int) -> list[int]:
    """Lengths of a document's pieces in their order: the longest ones first."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def cut(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 4096, parts: int = 256) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32 bits)."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("encoders")
        encoder = kept.get(tokenizer) or kept.setdefault(tokenizer, Encoder(tokenizer))
        end = little([end_id])
        for batch in batches:
            names, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high, ids, bounds in encoder.rows(batch.column(2)):
                rows = []
                for k, a, b in zip(range(low, high), bounds.tolist(), bounds[1:].tolist()):
                    whole, start = ids[a:b].astype("<u4").tobytes() + end, 0
                    n = b - a + 1
                    for length in powers(n, longest):
                        rows.append((names[k], parts[k], start, length, n, whole[4 * start : 4 * (start + length)]))
                        start += length
                yield _batch(rows)
        give_back_memory()

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")
    return docs.select("doc_id", part, "text").mapInArrow(pieces, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 6
    names = ["doc_id", "part", "start", "length", "doc_tokens", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def number(pieces: DataFrame) -> DataFrame:
    """Adds sequence_id (gapless from 0) and offset (0). ``pieces`` must be a stored table: it is read twice.

    Ranks come from windows over (length, part): counts of all parts (13 lengths x parts rows) give where each begins.
    """
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("length", "part")) - F.col("_n")
    counts = counts.select("length", "part", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "doc_tokens")) - 1
    ranked = pieces.withColumn("_rank", rank).join(counts, ["length", "part"])
    ranked = ranked.withColumn("sequence_id", F.col("_before") + F.col("_rank"))
    return ranked.withColumn("offset", F.lit(0).cast("long")).drop("part", "_rank", "_before")


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 4096, keep_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids unless left out."""
    pieces = cut(docs, tokenizer, end_id, longest).withColumn("ids_crc32", F.crc32("ids"))
    packed = number(stage(pieces if keep_ids else pieces.drop("ids")))
    return packed.select(
        *"doc_id start length ids_crc32 doc_tokens sequence_id offset".split(), *(["ids"] if keep_ids else [])
    )
