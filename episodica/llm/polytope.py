"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

One hash flips signs and applies the Hadamard transform three times, and names the axis (with its sign) the vector then
lies nearest to. A bucket of one table is the label, the vector's length and ``hashes`` such names. Each vector lives in one
bucket of every table and visits ``probes`` more: those where the names it was least sure of are replaced by the runners-up.

Candidates are the pairs (resident, resident) and (resident, visitor) of a bucket. They are verified by cosine in double
precision inside the task that holds the bucket. A bucket of many vectors is cut into blocks, and each pair of
blocks is a group of its own, so no task ever holds more than two blocks. A pair found several times counts in the first
place its two vectors share; what leaves a task are sums and one edge per vector, never pairs.

Equal vectors of one label are one node with a count. Vectors that are null, zero, hold null or non-finite components, or
have no label link with nothing. A null vec_id never names a component. Only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.base import hashed_parts, list_column, sorted_groups, stage
from episodica.llm.components import star_components

TABLES, HASHES, PROBES, BLOCK, COSINE = 12, 3, 3, 1024, 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x


def names(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket names of each row: (rows, tables, 1 + probes), the home first."""
    if probes >= 1 << hashes:
        raise ValueError("a table has fewer places than probes")
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng(width)
    out = np.empty((len(x), tables, 1 + probes), dtype=np.int64)
    every = np.arange(len(x))
    for t in range(tables):
        best, second, doubt = [], [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            first = size.argmax(axis=1)
            top = size[every, first]
            size[every, first] = -1
            next_ = size.argmax(axis=1)
            best.append(2 * first + (y[every, first] < 0))
            second.append(2 * next_ + (y[every, next_] < 0))
            doubt.append((top - np.maximum(size[every, next_], 0)) / np.maximum(top, 1e-300))
        best, second, doubt = np.array(best), np.array(second), np.array(doubt)
        weight = (2 * width) ** np.arange(hashes)[:, None]
        # Sets of names to replace, ordered by the doubt they need; the empty set is the home.
        masks = np.array([[m >> k & 1 for k in range(hashes)] for m in range(1 << hashes)], dtype=float)
        order = np.argsort(masks @ doubt, axis=0, kind="stable")
        for p in range(1 + probes):
            swap = masks[order[p]].T.astype(bool)
            out[:, t, p] = (np.where(swap, second, best) * weight).sum(axis=0)
    return out


def _nodes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors of a label, with their number and smallest vec_id."""
    wide = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound & F.exists(wide, lambda v: v != 0)
    return vectors.withColumn("node", F.when(usable, F.xxhash64("label", "embedding")))


def _placed(nodes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    schema = "node long, copies long, label long, vector array<double>, places array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
            flat = np.asarray(lists.values)[int(lists.offsets[0].as_py()) :] if len(lists) else None
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.stack([flat[starts[r] : starts[r] + size] for r in rows])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                places = names(x, tables, hashes, probes).reshape(len(rows), -1)
                part = batch.take(pa.array(rows))
                ends = lambda n: np.arange(len(rows) + 1) * n
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        part.column("copies"),
                        part.column("label"),
                        list_column(x.ravel(), ends(int(size)), pa.float64()),
                        list_column(places.ravel(), ends(places.shape[1]), pa.int64()),
                    ],
                    ["node", "copies", "label", "vector", "places"],
                )

    return nodes.select("node", "copies", "label", "vector").mapInArrow(scan, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of places (pairs, tables, 1 + probes): table * 3 + kind of the first place both share.

    Kind 0: the same home; 1: the first's home is visited by the second; 2: the other way round.
    """
    same = a[:, :, 0] == b[:, :, 0]
    left = (b[:, :, 1:] == a[:, :, :1]).any(axis=2)
    right = (a[:, :, 1:] == b[:, :, :1]).any(axis=2)
    return np.stack([same, left, right], axis=2).reshape(len(a), -1).argmax(axis=1)


def _compare(rows: DataFrame, tables: int, probes: int, cosine: float) -> DataFrame:
    """Per block pair and vector: links counted here and the smallest node of its local component."""
    keys = ["bucket", "i", "j"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            if group.num_rows < 2:
                continue
            n, home = group.num_rows, group.column("home").to_numpy()
            node, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
            x, places = _matrix(group.column("vector")), _matrix(group.column("places")).reshape(n, tables, -1)
            table, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
            near = np.triu(x @ x.T >= cosine, 1)
            if i != j:
                near &= block[:, None] != block[None, :]
            near &= home[:, None] | home[None, :]
            a, b = np.nonzero(near)
            keep = node[a] != node[b]
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            swap = node[a] > node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            kind = np.where(home[a] & home[b], 0, np.where(home[a], 1, 2))
            own = np.zeros(len(a), dtype=bool)
            for low in range(0, len(a), 1 << 14):
                part = slice(low, low + (1 << 14))
                own[part] = first_shared(places[a[part]], places[b[part]]) == 3 * table + kind[part]
            links = np.bincount(a[own], copies[b[own]], n) + np.bincount(b[own], copies[a[own]], n)
            root = node.copy()
            while True:  # smallest node within reach, over links found here
                before = root.copy()
                np.minimum.at(root, a, before[b])
                np.minimum.at(root, b, before[a])
                if (root == before).all():
                    break
            touched = np.unique(np.concatenate([a, b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[touched]), pa.array(links[touched].astype(np.int64)), pa.array(root[touched])],
                ["node", "links", "root"],
            )

    return rows.mapInArrow(scan, "node long, links long, root long")


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable by links, itself included) and kept."""
    marked = _nodes(vectors)
    wide = F.transform("embedding", lambda v: v.cast("double"))
    nodes = marked.where("node is not null").groupBy("node", F.xxhash64("label").alias("label"))
    nodes = nodes.agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.any_value(wide).alias("vector"))
    nodes = stage(nodes)
    placed = stage(_placed(nodes, tables, hashes, probes))
    stays = placed.select("node", "label", F.size("vector").alias("size"), F.posexplode("places").alias("p", "place"))
    t = F.floor(F.col("p") / (1 + probes)).cast("int")
    home = F.pmod("p", F.lit(1 + probes)) == 0
    stays = stays.select("node", t.alias("t"), home.alias("home"), F.xxhash64("label", "size", t, "place").alias("bucket"))
    sizes = stays.groupBy("bucket").agg(F.count("*").alias("n"), F.max("home").alias("lived"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    sizes = sizes.where("n > 1 and lived").select("bucket", blocks.alias("blocks"))
    cells = stays.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        *["bucket", "node", "t", "home", "block"],
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
    )
    rows = cells.join(placed.select("node", "copies", "vector", "places"), "node")
    rows = rows.repartition(2 * hashed_parts(vectors.sparkSession), "bucket", "i", "j")
    found = stage(_compare(rows.sortWithinPartitions("bucket", "i", "j"), tables, probes, cosine))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = star_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "copies", "first").join(links, "node", "left")
    known = known.join(components.withColumnRenamed("id", "node"), "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    names_ = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(names_, "component").select("node", "copies", "links", "component_id")
    out = marked.select("vec_id", "node").join(known, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        n_links.alias("n_links"),
        component.alias("component_id"),
        (component.isNull() | component.eqNullSafe(F.col("vec_id"))).alias("kept"),
    )
