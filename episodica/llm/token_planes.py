"""A file format for token ids: fixed-size blocks cut into byte or bit planes, each plane compressed with zstandard.

A chunk holds the ids of whole documents in a row. Its ids are cut into blocks of ``BLOCK`` ids; a block becomes 4
byte planes (the lowest bytes of all its ids, then the next ones ...) or 32 bit planes, and every plane is compressed
by itself: the high planes are almost all zeros and vanish.

    magic 4 bytes | plane kind 1 | level-free header: ids u64, blocks u32 | per block and plane: compressed length u32 | planes

The lengths are the chunk's index, so a reader can open one block of one plane. Chunks are rows of a Parquet table
(payload, documents and their numbers of ids), written by Spark's commit protocol: a lost executor or a second
attempt leaves no half-written chunk, on any file system.

``write`` orders documents by (doc_id, hash of the text) with nulls first; ``read`` gives each document's ids and where
they start among the ids of all documents. Null texts count as empty, repeated rows are written as often as they
occur, a text of any length is one document. Other columns of the input are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.base import hashed_parts, shared_root, worker_cache
from episodica.llm.encoding import Encoder, little

MAGIC = b"EPP1"
BLOCK = 1 << 14
CHUNK_IDS = 1 << 18
PLANES = {"byte": 4, "bit": 32}
CHUNKS = "part int, chunk int, doc_ids array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray, planes: str = "byte", level: int = 1) -> bytes:
    """The payload of a chunk."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    blocks = -(-len(ids) // BLOCK)
    index, body = [], []
    for b in range(blocks):
        block = np.ascontiguousarray(ids[b * BLOCK : (b + 1) * BLOCK], dtype="<u4")
        rows = block.view(np.uint8).reshape(-1, 4).T
        if planes == "bit":
            rows = np.packbits(np.unpackbits(rows[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1), axis=2)
            rows = rows.reshape(32, -1)
        for plane in rows:
            out = press.compress(plane.tobytes())
            index.append(len(out))
            body.append(out)
    head = MAGIC + struct.pack("<BQI", PLANES[planes], len(ids), blocks)
    return head + np.array(index, dtype="<u4").tobytes() + b"".join(body)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a chunk."""
    import zstandard

    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of token planes")
    n_planes, n, blocks = struct.unpack_from("<BQI", payload, 4)
    at = 4 + struct.calcsize("<BQI")
    index = np.frombuffer(payload, "<u4", blocks * n_planes, at).astype(np.int64)
    ends = at + 4 * len(index) + np.cumsum(index)
    press, out = zstandard.ZstdDecompressor(), np.empty(n, dtype="<u4")
    for b in range(blocks):
        size = min(BLOCK, n - b * BLOCK)
        planes = [
            np.frombuffer(press.decompress(payload[ends[k] - index[k] : ends[k]]), np.uint8)
            for k in range(b * n_planes, (b + 1) * n_planes)
        ]
        rows = np.stack(planes)
        if n_planes == 32:
            bits = np.unpackbits(rows, axis=1, count=size).reshape(4, 8, size)
            rows = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(4, size)
        out[b * BLOCK : b * BLOCK + size] = np.ascontiguousarray(rows.T).view("<u4").ravel()
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, planes: str = "byte") -> None:
    """Encode every text, close it with ``end_id`` and write all ids in ascending order of doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("encoders")
        encoder = kept.get(tokenizer) or kept.setdefault(tokenizer, Encoder(tokenizer))
        part, end, chunk = TaskContext.get().partitionId(), little([end_id]), 0
        names, lengths, held, size = [], [], [], 0

        def full() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(held), "<u4"), planes)
            columns = [[part], [chunk], [list(names)], [list(lengths)], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "chunk", "doc_ids", "lengths", "payload"]
            )

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, high, ids, bounds in encoder.rows(batch.column(1)):
                raw = ids.astype("<u4").tobytes()
                for k, a, b in zip(range(low, high), bounds.tolist(), bounds[1:].tolist()):
                    names.append(doc_ids[k])
                    lengths.append(b - a + 1)
                    held.append(raw[4 * a : 4 * b] + end)
                    size += b - a + 1
                    if size >= CHUNK_IDS:
                        yield full()
                        chunk += 1
                        names, lengths, held, size = [], [], [], 0
        if names:
            yield full()

    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    ordered = rows.repartitionByRange(2 * hashed_parts(spark), "doc_id", F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"))
    chunks = ordered.select("doc_id", "text").mapInArrow(encode, CHUNKS)
    chunks.write.option("compression", "uncompressed").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32 bits)."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    # One row per chunk: the ids before each part, and before each chunk of a part.
    sizes = chunks.select("part", "chunk", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n")
    starts = sizes.withColumn("within", within).join(before_part, "part")
    starts = starts.select("part", "chunk", (F.col("base") + F.col("within")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, names, lengths = (batch.column(c)[k].as_py() for c in ("start", "doc_ids", "lengths"))
                ids = unpack(batch.column("payload")[k].as_py())
                ends = np.cumsum(np.array(lengths, dtype=np.int64))
                if ends[-1] != len(ids):
                    raise ValueError("a chunk's documents and ids differ")
                raw = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(start + ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(raw, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    whole = chunks.join(starts, ["part", "chunk"]).select("start", "doc_ids", "lengths", "payload")
    return whole.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, planes: str = "byte") -> DataFrame:
    """Write the documents' ids into the shared folder and read them back."""
    import uuid

    path = f"{shared_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id, planes)
    return read(docs.sparkSession, path)
