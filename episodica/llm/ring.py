"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points on a ring of 2**63 places; the arc before a point belongs to its shard. A key
goes to the arc its hash lies in. A shard takes no more than its bound; keys beyond it go on clockwise to the next arc
whose shard has room, so balance is guaranteed while most keys stay where plain hashing puts them.

The keys meet the ring in the order of the arcs. Only the number of keys per arc decides who fills up, so the walk
is done on one count per arc (shards x virtual nodes numbers, whatever the size of the table). The rows then find
their place by their rank within their arc. Ranks come from windows over (arc, part), a part being a hash of the whole
row, so one key that holds a third of all rows is still numbered by many tasks.

Rows are never dropped: a null key hashes like any other, repeated rows get places of their own, an empty table gives
an empty table. Columns of the input may have any names but those added (``shard``, ``slot``), which replace them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 63


def points(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all virtual nodes in ring order and the shard of each."""
    place = np.array(
        [
            int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % RING
            for s in range(shards)
            for v in range(virtual_nodes)
        ],
        dtype=np.int64,
    )
    order = np.argsort(place, kind="stable")
    return place[order], np.repeat(np.arange(shards), virtual_nodes)[order]


def bounds(rows: int, shards: int, load_factor: float) -> np.ndarray:
    """How many rows each shard takes at most. A factor of 1 gives counts at most one apart."""
    if load_factor <= 1:
        return rows // shards + (np.arange(shards) < rows % shards)
    return np.full(shards, int(np.ceil(load_factor * rows / shards)))


def walk(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank after the last, shard, first slot): where each arc's keys end up."""
    room, taken, out = room.copy(), np.zeros(len(room), dtype=np.int64), []
    for arc in np.flatnonzero(counts):
        rank, at = 0, arc
        while rank < counts[arc]:
            shard = owner[at]
            n = min(room[shard], counts[arc] - rank)
            if n:
                out.append((int(arc), int(rank), int(rank + n), int(shard), int(taken[shard])))
                taken[shard] += n
                room[shard] -= n
                rank += n
            at = (at + 1) % len(owner)
    return out


def assign(
    df: DataFrame, key: str, shards: int, virtual_nodes: int = 128, load_factor: float = 1.25, parts: int = 64
) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 within a shard) to every row."""
    spark = df.sparkSession
    place, owner = points(shards, virtual_nodes)

    @F.pandas_udf("int")
    def arc_of(hashed: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(place, hashed.to_numpy()) % len(place))

    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    rows = df.drop("shard", "slot").withColumn("_row", row)
    rows = rows.withColumn("_arc", arc_of(F.xxhash64(F.col(f"`{key}`")).bitwiseAND(F.lit(RING - 1))))
    rows = rows.withColumn("_part", F.pmod("_row", F.lit(parts)).cast("int"))
    counts = rows.groupBy("_arc", "_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_arc").orderBy("_part")) - F.col("_n"))
    totals = np.zeros(len(place), dtype=np.int64)
    for arc, n in counts.groupBy("_arc").agg(F.sum("_n")).collect():  # at most shards x virtual_nodes rows
        totals[arc] = n
    pieces = walk(totals, owner, bounds(int(totals.sum()), shards, load_factor))
    # At most one piece per arc and one more per shard that fills up: bounded by the two parameters.
    plan = spark.createDataFrame(pieces, "_arc int, _from long, _to long, shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("_arc", "_part").orderBy("_row")) - 1
    ranked = rows.withColumn("_rank", rank).join(counts.drop("_n"), ["_arc", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(
        F.broadcast(plan), (ranked["_arc"] == plan["_arc"]) & ranked["_rank"].between(plan["_from"], plan["_to"] - 1)
    )
    return placed.select(
        *[ranked[f"`{c}`"] for c in df.columns if c not in ("shard", "slot")],
        "shard",
        (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """Per document: size (UTF-8 bytes of the text, none for null, and 8) and the text's crc32 (0 for null)."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
