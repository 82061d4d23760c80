"""Exact deduplication against plain Python: hot groups, repeated rows, missing ids, clashing names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from episodica.llm import heavy_dedup

SCHEMA = "doc_id long, text string, digest string, place int, first string, n long, whole string, kept boolean"
ROWS = [(k, "the same  text" if k % 3 else "the same\ttext") for k in range(400)]
ROWS += [(1000 + k, f"text number {k // 2}") for k in range(300)]
ROWS += [(2000, None), (2001, ""), (2002, " "), (2003, "\n \t\r\x0b\x0c "), (2004, "a b"), (2005, "a b"), (2006, "x" * 300_000)]
ROWS += [(2006, "x" * 300_000), (2006, "x" * 300_000), (None, "the same text"), (None, "alone"), (None, "alone"), (2007, " lead"), (2008, "lead")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "d", k, "f", 1, "w", False) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_mark_equals_plain_python(docs):
    found = heavy_dedup.mark(docs).collect()
    groups = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in brute(ROWS).items()}
    assert len(found) == len(ROWS)
    assert sorted((r.doc_id is None, r.doc_id) for r in found) == sorted((i is None, i) for i, _ in ROWS)
    for r in found:
        assert (r.keep_id, r.group_size) == groups[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.text_sha256 for r in found if r.kept) == sorted(groups)


def test_deduplicate_keeps_rows_whole(docs):
    kept = heavy_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    rows = {tuple(r) for r in docs.collect()}
    found = [tuple(r) for r in kept.collect()]
    assert len(found) == len(brute(ROWS)) and set(found) <= rows


def test_winners_are_exact_and_few(spark, docs):
    named = heavy_dedup._named(docs, [])
    found = heavy_dedup.winners(named, 4).collect()
    counts = {r.digest: r["count"] for r in named.groupBy("digest").count().collect()}
    assert {r.digest: r.n for r in found} == {d: n for d, n in counts.items() if 8 * n > len(ROWS)}
    assert len(found) == 1 and found[0].first.id == 0
    # With so many partitions that half a share is less than a row, every digest may be a winner; the answer is the same.
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        assert heavy_dedup.winners(named, 600).count() > 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_heavy_rows_are_not_shuffled(docs):
    df = heavy_dedup.mark(docs)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_and_one_row(spark, docs):
    assert heavy_dedup.mark(docs.limit(0)).count() == 0
    assert heavy_dedup.deduplicate(docs.limit(0)).count() == 0
    one = heavy_dedup.mark(docs.where("doc_id = 2004")).first()
    assert (one.doc_id, one.keep_id, one.group_size, one.kept) == (2004, 2004, 1, True)
    nothing = docs.where("text is null").withColumn("text", F.lit(None).cast("string"))
    assert heavy_dedup.mark(nothing).first().text_sha256 == hashlib.sha256(b"").hexdigest()
