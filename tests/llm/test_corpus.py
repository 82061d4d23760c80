"""Corpus operators against brute force, exact round trips and held-out accuracy, odd rows included."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from episodica.llm import (
    components,
    decontaminate,
    language_crf,
    line_dedup,
    minhash,
    packing,
    pii,
    polytope,
    ring,
    substring_dedup,
    token_planes,
)
from episodica.llm.base import bucketed
from episodica.llm.encoding import Encoder
from episodica.llm.queries import QUERIES, word_bpe

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, node int"
rng = random.Random(3)
WORDS = ["".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
BASE = " ".join(rng.choice(WORDS) for _ in range(120))
ODD = [
    (1, BASE), (2, BASE), (3, None), (4, ""), (5, "  \n\n "), (None, BASE + " tail of it"), (6, BASE.replace(" ", "  ", 3)),
    (7, "one two"), (8, "One TWO"), (9, "x" * 50_000), (10, " ".join(rng.choice(WORDS) for _ in range(3000))), (10, "same id"),
    (11, "Ünï çödé 中文 line\nsecond line of the text here\n" + BASE[:200]), (12, BASE + " one more"), (12, BASE + " one more"),
    (13, "123 456 !!"), (14, "<|endoftext|> mid \t tab nbsp İx"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "clash", 1, 2) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def ids_of(text, end):
    tokenizer = Tokenizer.from_file(word_bpe())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    encoder = Encoder(word_bpe())
    assert encoder.by_word
    for _, text in ODD:
        assert encoder.encode(text) == np.array(ids_of(text, 0)[:-1], "<u4").tobytes()


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 16384, 40001])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (token_planes.unpack(token_planes.pack(ids, planes)) == ids).all()


def test_token_file_holds_all_documents_in_order(docs, empty):
    back = token_planes.round_trip(docs, word_bpe(), 1)
    found = [(r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids)), r.start) for r in back.collect()]
    assert sorted(x[:3] for x in found if x[0]) == sorted((i, len(ids_of(t, 1)), crc(ids_of(t, 1))) for i, t in ODD if i)
    start = 0
    for doc_id, n, _, at in sorted(found, key=lambda x: x[3]):
        assert at == start
        start += n
    order = [x[0] or 0 for x in sorted(found, key=lambda x: x[3])]
    assert order == sorted(order)
    assert token_planes.round_trip(empty, word_bpe(), 1).count() == 0


def test_packing_covers_every_id_once(docs, empty):
    packed = packing.pack(docs, word_bpe(), 2).collect()
    assert sorted(r.sequence_id for r in packed) == list(range(len(packed)))
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 for r in packed)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in packed)
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed if r.doc_id)
    want = []
    for i, text in ODD:
        ids, at = ids_of(text, 2), 0
        for n in packing.powers(len(ids), 4096):
            want.append((i, at, n, crc(ids[at : at + n]), len(ids)))
            at += n
        assert at == len(ids)
    assert got == sorted(w for w in want if w[0])
    assert packing.pack(empty, word_bpe(), 2).count() == 0


def test_ring_is_even_stable_and_equal_to_a_sequential_walk(spark, docs, empty):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("k"), "id")
    placed = ring.assign(rows, "k", 7, load_factor=1.0).collect()
    by_shard = {}
    for r in placed:
        by_shard.setdefault(r.shard, []).append(r.slot)
    sizes = sorted(map(len, by_shard.values()))
    assert sum(sizes) == 5000 and sizes[-1] - sizes[0] <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert ring.assign(empty, "doc_id", 4).count() == 0 and ring.assign(docs, "doc_id", 4).count() == len(ODD)
    keys = spark.range(20000).withColumnRenamed("id", "k")
    old = {r.k: r.shard for r in ring.assign(keys, "k", 10).collect()}
    new = {r.k: r.shard for r in ring.assign(keys, "k", 11).collect()}
    loads = np.bincount(list(old.values()))
    assert loads.max() <= np.ceil(1.25 * 2000)
    assert sum(old[k] != new[k] for k in old) < 0.3 * len(old)


def test_walk_equals_one_key_at_a_time():
    _, owner = ring.points(4, 5)
    counts = np.random.default_rng(1).integers(0, 30, 20)
    room = ring.bounds(int(counts.sum()), 4, 1.0)
    left, want = room.copy(), []
    for arc, n in enumerate(counts):
        for rank in range(n):
            at = arc
            while not left[owner[at]]:
                at = (at + 1) % 20
            left[owner[at]] -= 1
            want.append((arc, rank, owner[at]))
    got = [(a, r, s) for a, lo, hi, s, _ in ring.walk(counts, owner, room) for r in range(lo, hi)]
    assert sorted(got) == sorted(want)


def test_substring_dedup_equals_brute_force(docs, empty):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in ODD]
    owner = {}
    for i, words in texts:
        for k in range(len(words) - 49 if i is not None else 0):
            w = tuple(words[k : k + 50])
            owner[w] = min(owner.get(w, i), i)
    want = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - 49 if i is not None else 0):
            if owner[tuple(words[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = as_rows(substring_dedup.verdicts(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(want, key=repr)
    assert substring_dedup.verdicts(empty).count() == 0


def test_minhash_groups(spark, docs, empty):
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.groups(docs).collect()}
    for doc_id in (2, 6, 12):
        assert [v for (d, _), v in found.items() if d == doc_id] == [(1, False)]
    assert found[8, 1] == (7, False) and found[4, 0] == (4, True) and found[3, 0] == (3, True)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 7, 9, 10, 10, 11, 13, 14]
    assert minhash.groups(empty).count() == 0


def test_minhash_leaves_one_row_of_each_group(spark):
    other = " ".join(rng.choice(WORDS) for _ in range(120))
    third = " ".join(rng.choice(WORDS) for _ in range(120))
    rows = [(1, BASE)] * 30 + [(2, BASE + " tail"), (None, BASE)]  # the smallest row, repeated
    rows += [(3, other), (3, other + " tail"), (3, other + " tail"), (4, other)]  # equal ids, different texts
    rows += [(None, third), (None, third), (None, third + " tail")]  # no ids at all
    rows += [(5, None), (5, None), (6, "alone"), (7, ""), (7, "")]  # empty sets are no copies
    table = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(5)
    kept = minhash.deduplicate(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5, 5, 6, 7, 7]


def test_line_signatures_see_every_shingle(spark):
    """Pairs that differ within the only shingle that follows a sign: the first one."""
    draw = random.Random(4)
    rows = []
    for k in range(60):
        tail = "".join(draw.choice("abcdefghij_|=~") for _ in range(80))
        rows += [(2 * k, f"x{tail}"), (2 * k + 1, f"y{tail}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    removed = as_rows(line_dedup.report(table).where("n_removed > 0"), "doc_id")
    assert removed == sorted([(k,) for k in range(1, 120, 2)], key=repr)


def test_equal_lines_at_equal_places_keep_one(spark):
    line = "a line of some length that three texts without a name begin with"
    rows = [(None, f"{line}\n{k} and what follows it in text {k * 7919}") for k in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(line in r.text for r in line_dedup.clean(table).collect()) == 1


def test_pipeline_drops_near_copies_from_four_fifths_on(spark):
    words = [f"w{k}" for k in range(204)]
    rows = []
    for doc_id, edits in ((1, []), (2, [20, 60, 100, 140]), (3, [20, 60, 100, 140, 180])):
        w = [f"{x}e{doc_id}" if k in edits else x for k, x in enumerate(words)]
        rows.append((doc_id, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(200)} for _, t in rows]
    share = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert 0.80 <= share[1] < 0.85 and share[2] < 0.80
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash.deduplicate(table).count() == 3
    assert as_rows(corpus_pipeline.near_duplicates(spark, table, SF_DIR), "doc_id") == [(1,), (3,)]


def test_many_edited_copies_keep_all_links(spark):
    """A large group of edited copies of one text, where most pairs are below the threshold."""
    draw, words = random.Random(1), BASE.split()
    texts = []
    for _ in range(150):
        w = list(words)
        for _ in range(draw.randint(0, 6)):
            w[draw.randrange(len(w))] = draw.choice(WORDS)
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert as_rows(minhash.groups(table), "doc_id", "component_id") == sorted(enumerate(parent), key=repr)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(160, 159), (7, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    want = [(k, 0) for k in range(41)] + [(k, 100) for k in range(100, 161)]
    for method in (components.star_components, components.union_find):
        assert sorted(map(tuple, method(table).collect())) == want
        assert method(table.where("false")).count() == 0


def test_line_dedup(spark, docs, empty):
    line = "This is quite a long line about nothing in particular, said again and again"
    rows = [(2, f"{line}\nshort\nunlike anything else in here"), (1, f"{line}!\nshort"), (5, line.upper()), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_rows(line_dedup.report(table), "doc_id", "n_lines", "n_removed", "removed_lines")
    assert got == [(1, 2, 0, ""), (2, 3, 2, "0,1"), (5, 1, 1, "0"), (None, 0, 0, "")]
    clean = line_dedup.clean(table).collect()
    assert {r.doc_id: r.text for r in clean} == {2: "unlike anything else in here", 1: f"{line}!\nshort", None: None}
    assert line_dedup.clean(docs).columns == docs.columns
    assert line_dedup.report(empty).count() == 0


def test_short_lines_are_equal_or_left(spark):
    rows = [(1, "Yes\n\nno\n\n"), (2, " yes \nyess\n\nfifteen letters"), (3, "fifteen letterz\nFIFTEEN LETTERS\n"), (4, "no\nno\nno"), (5, "\n\n")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_rows(line_dedup.report(table), "doc_id", "n_lines", "removed_lines")
    assert got == [(1, 5, ""), (2, 4, "0"), (3, 3, "1"), (4, 3, "0,1,2"), (5, 3, "")]
    assert {r.doc_id: r.text for r in line_dedup.clean(table).collect()} == {
        1: "Yes\n\nno\n\n", 2: "yess\n\nfifteen letters", 3: "fifteen letterz\n", 5: "\n\n"
    }


def test_parities_tell_pairs_apart_and_lose_no_link(spark):
    """Copies of a line, each with edits of its own, just above and just below the threshold."""
    draw, base = random.Random(6), "".join(random.Random(5).choice("abcdefghijklmnop ") for _ in range(300))
    lines = [base]
    for k in range(80):
        text = list(base)
        for at in draw.sample(range(4, 296), 1 + k % 7):
            text[at] = draw.choice("QRSTUVWXYZ").lower() + str(k)
        lines.append("".join(text))
    table = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    maps = {r.id: r for r in line_dedup.parities(table).collect()}
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in lines]
    assert [maps[k].n for k in range(len(sets))] == [len(s) for s in sets]
    first = line_dedup.parities(table)
    second = first.withColumnsRenamed({"id": "b", "n": "l"} | {f"w{k}": f"v{k}" for k in range(line_dedup.WORDS)})
    left = first.join(second, F.col("id") < F.col("b")).where(line_dedup.near_enough(line_dedup.WORDS, 80))
    got = {(r.id, r.b) for r in left.select("id", "b").collect()}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(sets)) for a in range(b)}
    assert {p for p, s in share.items() if s >= 0.8} <= got
    assert not {p for p, s in share.items() if s < 0.7} & got


def test_lines_in_buckets_are_dealt_once(spark):
    """What needs the lines by id takes them from their buckets, without a shuffle, and leaves no name behind."""
    lines = spark.createDataFrame([(k, f"line {k} of some few that are not very long") for k in range(50)], "id long, line string")
    with bucketed(spark) as put:
        table = put(lines, "id")
        names = {x.name for x in spark.catalog.listTables()}
        some = table.where("id < 20").select("id").repartition(4, "id").hint("shuffle_hash")
        for step in (line_dedup.signatures(table), line_dedup.parities(table), table.join(some, "id", "left_semi")):
            plan = step._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")
            assert step.count() in (20, 50)
    assert len(names - {x.name for x in spark.catalog.listTables()}) == 1


def test_members_meet_once_and_only_where_they_may_be_links(spark, monkeypatch):
    """A large group of edited copies of one line: few of its pairs leave the join, each of them once."""
    draw, base = random.Random(3), " ".join(random.Random(2).choices(WORDS, k=30))
    lines = []
    for k in range(150):
        text = list(base)
        for at in draw.sample(range(len(text)), 4):
            text[at] = chr(0x4E00 + 4 * k + len(lines) % 3)
        lines.append("".join(text))
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in lines]
    close = sum(len(x & y) >= 0.7 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    met, exact = [], line_dedup._similar

    def seen(pairs, *args):
        met.append([tuple(r) for r in pairs.select("a", "b").collect()])
        return exact(pairs, *args)

    monkeypatch.setattr(line_dedup, "_similar", seen)
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    line_dedup.report(table).count()
    pairs = [p for step in met for p in step]
    assert all(len(set(step)) == len(step) for step in met)
    assert len(pairs) <= close + 20 < len(lines) * (len(lines) - 1) / 8


def test_code_of_the_join_of_members_is_compiled(spark, monkeypatch):
    """Java does not compile methods of more than 8,000 bytes; a join that is interpreted takes microseconds for every pair."""
    sizes, link = [], line_dedup.linked
    explain = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString

    def seen(shared, *args, meet, **options):
        settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
        before = {k: spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = meet(shared.select("bucket", "id", F.col("id").alias("c")))._jdf.queryExecution()
        sizes.extend(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", explain(plan, "codegen")))
        for k, v in before.items():
            spark.conf.set(k, v)
        return link(shared, *args, meet=meet, **options)

    monkeypatch.setattr(line_dedup, "linked", seen)
    table = spark.createDataFrame([(k, BASE + " " + str(k)) for k in range(3)], "doc_id long, text string")
    assert line_dedup.report(table).where("n_removed > 0").count() == 2
    assert 0 < max(sizes) < 8000


def test_sets_of_long_lines_are_linear(spark):
    """Two lines of 400,000 letters: a set is built from one copy of the line, not from one for every shingle."""
    line = "".join(random.Random(8).choices("abcdefghijklmnopqrstuvwxyz ", k=400_000))
    texts = spark.createDataFrame([(1, line), (2, line[:-9])], "id long, line string")
    pairs = spark.createDataFrame([(1, 2, len(line) - 7, len(line) - 16)], "a long, b long, n int, l int")
    began = time.monotonic()
    assert line_dedup._similar(pairs, texts, 80, 8).count() == 1
    assert time.monotonic() - began < 25


def test_clean_is_linear_in_the_lines_of_a_text(spark):
    """Of 60,000 lines in one text, each written twice, half go."""
    text = "\n".join(f"line {k % 30_000}" for k in range(60_000))
    clean = line_dedup.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == "\n".join(f"line {k}" for k in range(30_000))


def test_decontaminate(spark, docs, empty):
    items = [(1, BASE), (2, "one two"), (3, None), (4, "!!"), (None, "second line of the text here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 20):  # one scan, and several whose hits are put together
        found = {(r.doc_id, r.n_words): r for r in decontaminate.report(docs, bench, block=block).collect()}
        assert found[1, 120].n_hit == 120 and found[1, 120].contaminated
        assert found[8, 2].n_hit == 2 and found[8, 2].items_sha256 == hashlib.sha256(b"2").hexdigest()
        assert found[3, 0].n_hit == 0 and not found[3, 0].contaminated
        assert not found[10, 3000].contaminated
        assert decontaminate.report(docs, bench, block=block).count() == len(ODD)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and {1, 2, 8}.isdisjoint({r.doc_id for r in clean.collect()})
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_polytope_equals_all_pairs(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(60, 32))
    x = np.concatenate([base, base[:20] + 0.05 * draw.normal(size=(20, 32)), base[:5]]).astype(np.float32)
    rows = [(k, int(k % 2 == 9), [float(v) for v in v_]) for k, v_ in enumerate(x)]
    rows += [(200, None, rows[0][2]), (201, 0, None), (202, 0, [0.0] * 32), (203, 0, [float("nan")] * 32), (204, 0, [])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in polytope.near_duplicates(table, block=16).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.98
    assert [got[k][0] for k in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert all(got[k] == (0, k) for k in range(200, 205)) and got[60][1] == 0
    assert polytope.near_duplicates(table.where("false")).count() == 0


def test_pii_base_spans():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    text = "a@b.c@d.e x@y z@@q.r first.last@mail5.example.com.é 1.2.3.4.5.6.7.8 300.1.1.1 +1 (988) 555-2485 or 4111 1111 1111 1111"
    spans = pii.base_spans(text)
    assert [(a, b) for a, k, b in spans if k == 0] == [m.span() for m in email.finditer(text)]
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    assert [(a, b) for a, k, b in spans if k == 1] == [m.span() for m in plain.finditer(text) if "300" not in m.group()]
    assert [text[a:b] for a, k, b in spans if k > 1] == ["+1 (988) 555-2485", "4111 1111 1111 1111"]
    for long_text in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000):
        pii.base_spans(long_text)


def test_pii_adds_spans_and_keeps_base(spark, docs, empty):
    rows = [(k, f"write to user{k}@mail.example.com or call +1 (555) 010-{1000 + k} now") for k in range(40)]
    rows += [(100, "mail me: jane (at) site (dot) org, phone (555) 010-9999"), (101, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.detect(table).collect()}
    assert found[0].n_email == 1 and found[0].n_phone == 1 and found[0].spans.count(":") == 4
    assert found[101].spans == "" and found[100].n_email == 0
    assert found[101].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.detect(docs).count() == len(ODD) and pii.detect(empty).count() == 0


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(0)
    emission, transition = draw.normal(size=(7, 3)), draw.normal(size=(3, 3))
    got, _ = forward = language_crf.forward_backward(emission, np.array([4, 3]), transition)
    assert len(forward) == 2
    for low, n in ((0, 4), (4, 3)):
        total = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            score = sum(emission[low + t, y] for t, y in enumerate(path))
            score += sum(transition[a, b] for a, b in zip(path, path[1:]))
            for t, y in enumerate(path):
                total[t, y] += np.exp(score)
        assert np.allclose(got[low : low + n], total / total.sum(axis=1, keepdims=True))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not here")
def test_language_held_out_accuracy_and_odd_texts(spark, docs, empty):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language_crf.train(table)
    found = language_crf.predict(table, model).where(language_crf.held_out(F.col("doc_id")))
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_crf.predict(docs, model).collect()}
    assert odd[3] == odd[4] == odd[5] == odd[13] == ("und", 0.0)
    signs = spark.createDataFrame(enumerate(["½ ²", "① Ⅳ", "_ ٣", "ª", "中", "e\u0301"]), "doc_id long, text string")
    named = {r.doc_id: r.lang_pred != "und" for r in language_crf.predict(signs, model).collect()}
    assert named == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True}
    assert language_crf.predict(docs, model).columns == [*docs.columns, "lang_pred", "score"]
    assert language_crf.predict(empty, language_crf.train(empty)).count() == 0
    assert language_crf.predict(docs, language_crf.train(empty)).where("lang_pred <> 'und'").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not here")
def test_queries_return_a_row_per_document(spark):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name in ("op2_ring_shards", "op3_token_planes", "op4_language_crf", "op7_weak_pii"):
        assert QUERIES[name](spark, SF_DIR).count() == n


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not here")
def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, kept, SF_DIR)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < after.count() <= kept.count()
        if name == "near_duplicates":
            assert minhash.groups(after).where("not kept").count() == 0
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR)
    assert packed.select("doc_id").distinct().count() == kept.count()
    total = sum(len(ids_of(r.text, 2)) for r in kept.collect())
    assert packed.agg(F.sum("length")).first()[0] == total
