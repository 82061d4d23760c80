"""The encoder of many texts at once against the library, whole tables and odd words."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from episodica.llm import encoding
from episodica.llm.queries import word_bpe

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    None, "", "  \n", "a", "<|endoftext|> x<|startoftext|>y", "a<|b", "İx ǅ 中文 é\tb c it's don't I'LL we'Re x'y 'd''s .'s 'sure",
    "x" * 50_000, " lead\n\ntrail ", "½ ² ① é é é́ ÀÉÞß×÷ a×b", "they've'll 's's 't1'm2 ''' 'r 're", "1234 a1b2 3.14!? --",
    "\x00 \x7f a\x1cb", "'", "'v", "don’t",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe())


def check(column, library):
    encoder = encoding.Encoder(word_bpe())
    assert not encoder.whole_texts
    seen = 0
    for low, high, ids, bounds in encoder.rows(column):
        assert low == seen
        seen = high
        for k in range(low, high):
            want = library.encode(column[k].as_py() or "", add_special_tokens=False).ids
            assert ids[bounds[k - low] : bounds[k - low + 1]].tolist() == want
    assert seen == len(column)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 40])
def test_odd_texts(library, monkeypatch, slice_bytes):
    monkeypatch.setattr(encoding, "SLICE_BYTES", slice_bytes)
    check(pa.array(ODD), library)


def test_random_texts(library):
    draw = random.Random(2)
    signs = list("aBcstrevmldÉé'’<|>.,-1290×ß÷µ½\t \n中́")
    check(pa.array(["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(3000)]), library)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not here")
def test_whole_table(library, monkeypatch):
    monkeypatch.setattr(encoding, "WORDS_KEPT", 50)
    monkeypatch.setattr(encoding, "PIECES_KEPT", 100)
    check(pq.read_table(f"{SF_DIR}/documents.parquet")["text"].combine_chunks(), library)


def test_memory_is_bounded():
    kept = encoding.Kept({}, 10)
    for k in range(1000):
        assert kept.all([str(k), "often"], str.encode) == [str(k).encode(), b"often"]
    assert len(kept.halves["new"]) + len(kept.halves["old"]) <= 20
