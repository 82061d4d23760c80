"""Spelling variants against brute force: counting, pivotal prefixes, near pairs, forms and roots."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from episodica.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, a string, form string"
rng = random.Random(5)


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


def brute(rows, damage=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if distance_one(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "a", "f") for i, t in rows], SCHEMA).repartition(3)


def found_in(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


LETTERS = "abcéÉßÿØ"


def misspelt(word):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(LETTERS) + word[k:], word[:k] + rng.choice(LETTERS) + word[k + 1 :]])


BASE = ["".join(rng.choice("abceéstÀ") for _ in range(rng.randint(4, 9))) for _ in range(120)]
TOKENS = [w for k, w in enumerate(BASE) for _ in range(3 + 40 // (k + 1))] + [misspelt(w) for w in BASE for _ in range(6)] * 3
rng.shuffle(TOKENS)
ROWS = [(k, " ".join(TOKENS[k * 50 : k * 50 + 50])) for k in range(len(TOKENS) // 50 + 1)]
ODD = [
    (None, "Straße STRASSE strasse, straße;straße÷x×"), (None, None), (7000, ""), (7001, "中文 word中words 123"),
    (7002, "Words WORDS words wörds"), (7002, "Words WORDS words wörds"), (7003, "x" * 9_000 + " " + "x" * 9_001),
    (7004, "x" * 9_000 + " " + "x" * 9_001), (7005, "x" * 9_000 + "\n" + "x" * 9_001 + "Ā" + "tail×end tail×end tail×end"),
]


@pytest.mark.parametrize("damage", [97, 3, 0])
def test_variants_equal_brute_force(spark, damage):
    got = found_in(spelling.variants(docs_of(spark, ROWS + ODD), damage=damage))
    assert got == brute(ROWS + ODD, damage)
    assert any(r[1] for r in got)


def test_hot_word_and_repeated_rows(spark):
    rows = [(1, "common " * 3000 + "comon comon comon")] * 4 + [(2, "common comons comons comons")]
    assert found_in(spelling.variants(docs_of(spark, rows))) == brute(rows)


def test_empty(spark):
    for rows in ([(1, None)], [(1, "a few short")]):
        assert spelling.variants(docs_of(spark, rows)).count() == 0
    assert spelling.variants(docs_of(spark, ROWS).limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        spelling.variants(docs_of(spark, ROWS), min_chars=3)


def test_near_pairs_of_all_words_over_two_letters(spark):
    """Every word of 4 to 7 letters over a and b: repeated bigrams and ties everywhere."""
    words = ["".join(w) for n in range(4, 8) for w in itertools.product("ab", repeat=n)]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(table).collect())
    assert got == sorted((a, b) for a, b in itertools.combinations(sorted(words), 2) if distance_one(a, b))


def test_near_pairs_of_one_letter_each(spark):
    """Every letter there is in the place of one of ``word``'s."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    words = sorted(f"wo{c}rd" for c in letters)
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(table).collect())
    assert got == list(itertools.combinations(words, 2))


def test_pivots_are_the_cheapest_disjoint_pair():
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 7)))
        costs = [rng.randint(1, 9) for _ in places]
        cost = dict(zip(places, costs))
        got = spelling.pivots(places, costs)
        every = [p for p in itertools.combinations(places, 2) if p[1] - p[0] >= 2]
        assert got in every and sum(cost[p] for p in got) == min(sum(cost[x] for x in p) for p in every)


def test_long_text_is_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE_BYTES", 50)
    counter = spelling.RunCounter(5, 0)
    import numpy as np

    text = " ".join(rng.choice(["words", "Éclair", "longer", "中文中", "a" * 70]) for _ in range(200))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    total = Counter()
    for part, offsets in spelling._pieces(data, np.array([0, len(data)]), counter.letter):
        for row in counter.count(part, offsets, ["1"]).to_pylist():
            total[row["values"]] += row["counts"]
    assert total == Counter(w for w in re.findall("[a-zÀ-ÿ]+", text) if len(w) >= 5)
