"""MinHash near-duplicate detection: universal hash minima, bands, signature check, exact check, star components.

A text's words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; its set holds the distinct runs of ``WORDS`` words, or the whole
sequence where there are fewer. Texts are linked if 100 * intersection >= ``percent`` * union of their sets.

* Equal sets are one node: copies meet nowhere but in a count.
* ``bands`` x ``rows`` minima under hash functions (a * x + b) mod 2**64, upper 32 bits, a odd. With 24 bands of 6 rows a pair
  of similarity 0.85 shares no band with probability 1e-5.
* Pairs of a band (see ``linking``) are thinned by set sizes and by the share of equal signature bytes; the bound lies 6
  standard deviations below what a link at the threshold shows.
* What remains is confirmed on the full sets of both texts.

Null texts and texts without words have an empty set and no link. Equal doc_ids with different texts are nodes of their
own, equal rows one; a row without doc_id can be linked, but never names a component. ``groups`` marks rows by doc_id alone:
all rows of a component's smallest doc_id are kept, and a component without doc_ids whole. ``deduplicate`` leaves one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.base import byte_slices, hashed_parts, list_column, sorted_groups, stage
from episodica.llm.components import star_components
from episodica.llm.linking import linked, shared_members
from episodica.llm.words import SPACED_LOWER, Powers, Words, cut, mix

WORDS, BANDS, ROWS, PERCENT = 5, 24, 6, 85
FIRST = "min(struct(doc_id is null as absent, doc_id, key))"
SIGNED = "doc_id long, key long, node long, n_shingles long, bands array<long>, signature binary"


def shingle_sets(words: Words, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    at, bounds = words.inside(size)
    runs = words.runs(size)
    runs = runs[at] if len(at) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((words.counts() > 0) & (np.diff(bounds) == 0))
    sets = [np.unique(runs[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    for k, h in zip(short, words.whole(short)):
        sets[k] = np.array([h ^ np.uint64(words.counts()[k])], dtype=np.uint64)
    return sets


def hash_functions(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signature: for each hash function the smallest value over the set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(shingles), 512):  # keeps the products in the processor's cache
        part = shingles[None, low : low + 512] * a[:, None]
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out >> np.uint64(32)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = WORDS) -> DataFrame:
    """Per row: the node (hash of the whole set; null for an empty one), the set's size, bands and signature bytes."""
    a, b = hash_functions(bands * rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        band = np.repeat(np.arange(bands, dtype=np.uint64), rows)
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(2)):
                sets = shingle_sets(cut(data, offsets, SPACED_LOWER, powers), size)
                nodes, keys, ends, signatures = [], [], [0], []
                for s in sets:
                    if not len(s):
                        nodes.append(None)
                        signatures.append(None)
                        ends.append(ends[-1])
                        continue
                    nodes.append(int(node_of(s)))
                    m = minima(s, a, b)
                    spread = mix(m + (band << np.uint64(32)))
                    order = np.tile(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1), bands)
                    keys.append(mix((spread * order).reshape(bands, rows).sum(axis=1, dtype=np.uint64)))
                    signatures.append((m & np.uint64(255)).astype(np.uint8).tobytes())
                    ends.append(ends[-1] + bands)
                values = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high],
                        batch.column(1)[low:high],
                        pa.array(nodes, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        list_column(values, np.array(ends), pa.int64()),
                        pa.array(signatures, pa.binary()),
                    ],
                    ["doc_id", "key", "node", "n_shingles", "bands", "signature"],
                )

    return docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(scan, SIGNED)


def text_key() -> Column:
    return F.xxhash64("text")


def node_of(shingles: np.ndarray) -> np.int64:
    """One 64-bit number for a whole set, from the sum of its spread members and its size."""
    total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return mix(np.array([total ^ np.uint64(len(shingles))]))[:1].view(np.int64)[0]


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int, signed: int) -> DataFrame:
    """Pairs whose set sizes and signatures allow a link."""
    share = percent / 100
    least = int(signed * (share - 6 * (share * (1 - share) / signed) ** 0.5))

    @F.pandas_udf("boolean")
    def close(x, y):
        import pandas as pd

        left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, signed) for s in (x, y))
        return pd.Series((left == right).sum(axis=1) >= least)

    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    sized = pairs.join(b, "b").join(a, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.where(close("sa", "sb")).select("a", "b")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kept, held = Powers(), {}, 0

        def shingles(node: int, text: str) -> np.ndarray:
            nonlocal held
            if node not in kept:
                raw = text.encode()
                words = cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACED_LOWER, powers)
                if held > 1 << 22:
                    kept.clear()
                    held = 0
                kept[node] = shingle_sets(words, size)[0]
                held += len(kept[node])
            return kept[node]

        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                a, b, text_a, text_b = (batch.column(c)[k].as_py() for c in range(4))
                x, y = shingles(a, text_a), shingles(b, text_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(scan, "a long, b long")


def _elements(texts: DataFrame, size: int) -> DataFrame:
    """(id, n, h): a row per shingle of each node's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low, high, data, offsets in byte_slices(batch.column(1)):
                sets = shingle_sets(cut(data, offsets, SPACED_LOWER, powers), size)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                ids = batch.column(0)[low:high].to_numpy()
                columns = np.repeat(ids, sizes), np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n", "h"])

    return texts.select("node", "text").mapInArrow(scan, "id long, n long, h long")


def _compare(rows: DataFrame, members: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) among members of a bucket that lie in different components, as one edge per member and bucket.

    A large bucket is cut into blocks and each pair of blocks is a group, so a task holds two blocks of sets at most. The
    shared elements of all pairs of a group are one matrix product; pairs never leave the task.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["bucket", "i", "j"]):
            ids, c = (group.column(k).to_numpy() for k in ("id", "c"))
            if len(ids) < 2 or (c == c[0]).all():
                continue
            sets = group.column("s").combine_chunks()
            sizes = np.diff(np.asarray(sets.offsets))
            elements, at = np.unique(np.asarray(sets.flatten()), return_inverse=True)
            both = np.zeros((len(ids), len(ids)), dtype=np.float32)
            owner = np.repeat(np.arange(len(ids)), sizes)
            for low in range(0, len(elements), 4096):
                mine = (at >= low) & (at < low + 4096)
                x = np.zeros((len(ids), 4096), dtype=np.float32)
                x[owner[mine], at[mine] - low] = 1
                both += x @ x.T
            near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
            a, b = np.nonzero(np.triu(near & (c[:, None] != c[None, :]), 1))
            root = ids.copy()
            while len(a):  # smallest id within reach, over links found here
                before = root.copy()
                np.minimum.at(root, a, before[b])
                np.minimum.at(root, b, before[a])
                if (root == before).all():
                    break
            yield pa.RecordBatch.from_arrays([pa.array(ids[root != ids]), pa.array(root[root != ids])], ["a", "b"])

    sets = rows.groupBy("id").agg(F.collect_list("h").alias("s"))
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cells = members.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("bucket", "id", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    whole = cells.join(sets, "id").repartition(2 * hashed_parts(rows.sparkSession), "bucket", "i", "j")
    return whole.sortWithinPartitions("bucket", "i", "j").mapInArrow(scan, "a long, b long").distinct()


def _components(
    docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, size: int = WORDS
) -> DataFrame:
    """Per row: doc_id, key (of the text), node, n_shingles and the first (doc_id, key) of the component."""
    signed = stage(sign(docs, bands, rows, size))
    nodes = stage(
        signed.where("node is not null")
        .groupBy("node")
        .agg(
            F.expr(FIRST).alias("first"),
            F.max("n_shingles").alias("n_shingles"),
            F.any_value("signature").alias("signature"),
        ).select("node", "first.doc_id", "first.key", "n_shingles", "signature")
    )
    members = signed.where("node is not null").select(F.explode("bands").alias("bucket"), F.col("node").alias("id"))
    shared = stage(shared_members(members))
    wanted = shared.select(F.col("id").alias("node")).distinct().join(nodes.select("node", "doc_id", "key"), "node")
    same = (docs["doc_id"].eqNullSafe(wanted["doc_id"])) & (F.xxhash64(docs["text"]) == wanted["key"])
    texts = stage(docs.join(wanted, same).select(wanted["node"], docs["text"]).dropDuplicates(["node"]))

    def similar(pairs: DataFrame) -> DataFrame:
        return _confirm(stage(_plausible(pairs, nodes, percent, bands * rows)), texts, percent, size)

    def elements(ids: DataFrame) -> DataFrame:
        return _elements(texts.join(ids.withColumnRenamed("id", "node"), "node", "left_semi"), size)

    def compare(rows: DataFrame, members: DataFrame) -> DataFrame:
        return _compare(rows, members, percent)

    found = linked(shared, similar, star_components, percent, elements, compare)
    named = nodes.join(found.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("node", "doc_id", "key", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.expr(FIRST).alias("first"))
    named = named.join(names, "component").select("node", "first")
    return signed.select("doc_id", "key", "node", "n_shingles").join(named, "node", "left")


def groups(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, key (of the text), n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    out = _components(docs, **options).select("doc_id", "key", "n_shingles", component.alias("component_id"))
    kept = F.col("component_id").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.withColumn("kept", kept)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of each group with all its columns, that of the smallest doc_id (none last), then of the smallest key.

    Rows that repeat doc_id and text are reduced to one only where they stay; Spark combines them within tasks first.
    """
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    rows = _components(docs, **options).where("node is not null")
    rows = rows.groupBy("doc_id", "key").agg(F.bool_or(first).alias("_first"), F.count("*").alias("_n"))
    rows = rows.where("not _first or _n > 1").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_first")
    rows = stage(rows)
    same = docs["doc_id"].eqNullSafe(rows["_doc"]) & (F.xxhash64(docs["text"]) == rows["_key"])
    repeated = docs.join(rows.where("_first"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(rows, same, "left_anti").unionByName(repeated)
