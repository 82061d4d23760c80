"""``run`` of the corpus pipeline against its stages in plain Python; the language verdicts come from the model."""

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from episodica.llm import packing
from episodica.llm.queries import word_bpe

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not here")


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def similar_groups(sets, percent):
    """Components of the sets whose Jaccard similarity reaches the percentage; names must be comparable."""
    holders, groups = defaultdict(list), Groups()
    for name, s in sets.items():
        for x in s:
            holders[x].append(name)
    for name, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for other in holders[x]:
                if other < name:
                    common[other] += 1
        for other, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[other]) - k):
                groups.link(other, name)
    return groups


def without_near_lines(docs):
    lines = {(i, k): line.strip(" ").lower() for i, t in docs.items() for k, line in enumerate((t or "").split("\n"))}
    sets = {line: {line[k : k + 8] for k in range(len(line) - 7)} for line in set(lines.values()) if len(line) >= 16}
    groups, seen, out = similar_groups(sets, 80), set(), {}
    for i, t in sorted(docs.items()):
        kept = []
        for k, line in enumerate((t or "").split("\n")):
            name = groups.find(lines[i, k])
            if lines[i, k] == "" or name not in seen:
                kept.append(line)
            seen.add(name)
        text = "\n".join(kept)
        if text == (t or "") or text.strip(" "):
            out[i] = t if t is None else text
    return out


def without_near_copies(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    groups = similar_groups(sets, 80)
    return {i: t for i, t in docs.items() if groups.find(i) == i}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def without_benchmark(docs, items):
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[k : k + min(13, len(w))]) for k in range(len(w) - min(13, len(w)) + 1)} if w else set()
    lengths = {len(w) for w in windows}
    out = {}
    for i, t in docs.items():
        w, hit = words(t), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out[i] = t
    return out


def test_run_equals_its_stages_in_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("n_chars < 6000 or doc_id % 5 = 0")
    # The words of a document under other lines, a text without letters, one without text.
    words_of = docs.where("lang = 'en' and n_chars between 600 and 1500").orderBy("doc_id").first().text.split()
    wrapped = "\n".join(" ".join(words_of[k : k + 4]) for k in range(0, len(words_of), 4))
    more = [(900_001, wrapped, "en", "s", len(wrapped)), (900_002, "1 2 3", "en", "s", 5), (900_003, None, None, None, None)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = {r.doc_id: r.text for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    sizes = [docs.count(), len(now)]
    items = [r.text for r in bench.collect()]
    for step in (without_near_lines, without_near_copies, lambda d: without_benchmark(d, items)):
        now = step(now)
        sizes.append(len(now))
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 5
    library, want = Tokenizer.from_file(word_bpe()), []
    for i, t in now.items():
        ids, start = [*library.encode(t or "", add_special_tokens=False).ids, corpus_pipeline.END_ID], 0
        for n in packing.powers(len(ids), 4096):
            want.append((i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)))
            start += n
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(want)
    assert sorted(r.sequence_id for r in found) == list(range(len(want)))


def test_stages_carry_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40).drop("n_chars")
    docs = docs.withColumn("score", F.lit(-7.0)).withColumn("lang_pred", F.lit("mine")).withColumn("c0", F.lit(1))
    for step in (corpus_pipeline.language, corpus_pipeline.lines):
        kept = step(spark, docs, SF_DIR)
        assert kept.columns == docs.columns
        assert {(r.score, r.lang_pred, r.c0) for r in kept.collect()} == {(-7.0, "mine", 1)}
    empty = docs.limit(0)
    assert [step(spark, empty, SF_DIR).count() for _, step in corpus_pipeline.STAGES] == [0] * 5
