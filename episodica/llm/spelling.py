"""Groups of spelling variants: words one edit apart, each led to the near word that is written most often.

Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased. With ``damage`` = m, a run loses
one code point where m divides the CRC-32 of ``<doc_id>:<run>`` (planted misspellings; 0 leaves all runs as they are). Words
of at least ``min_chars`` code points and ``min_count`` occurrences are compared. Two are near if exactly one code point is
inserted, deleted or replaced. A word's form is its near word of most occurrences (the smaller one in a tie) where that has
at least ``lead`` times its own; its root is the word at the end of the chain of forms.

1. Counting: tasks count the words of a slice of text, Spark adds up. A word that fills a third of the corpus is a row a slice.
2. Pivotal grams. Bigrams are ordered by their frequency over all words, rare ones first. A word's prefix are its three first
   bigrams in that order (and further places of the third); one edit changes two bigrams at most. Its pivots are two
   disjoint bigrams of the prefix, the rarest pair by dynamic programming; one edit leaves one of them whole. So of two near
   words the one whose prefix ends earlier (or as early) has a pivot among the other's prefix.
3. Position limits: the edit lies before or behind that pivot, so both words are equal from the pivot's start on, or up to
   its end; and of the other side, cut in halves, one half is equal too. Pivots and prefixes meet on these equal parts (at
   least half of the letters), their places and the other word's length, all of them join keys; no pair of words is made
   for a shared bigram alone.
4. Candidates whose letters differ in number by more than an edit explains are left out; the rest is verified by edit
   distance.

Nothing is capped: long words have long prefixes, found in time proportional to their length. Null texts have no words, a null
doc_id counts as an empty one, repeated rows count as often as they occur, an empty table gives an empty result. Columns other
than doc_id and text are not read. Bigrams number at most 90 * 90 (the letters after lower-casing), so their order is the only
table that reaches the driver and all tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.base import byte_slices, runs, stage, strings

MIN_CHARS, MIN_COUNT, LEAD, DAMAGE = 5, 3, 2, 97
GRAM, EDITS = 2, 1
SLICE_BYTES, LONG_RUN = 1 << 21, 64


# --- words of texts -----------------------------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    """The table of the reflected CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


class RunCounter:
    """Counts the damaged runs of slices of text. A run's bytes are A-Z, a-z, or C3 and the byte behind it."""

    def __init__(self, min_chars: int, damage: int):
        self.min_chars, self.damage = min_chars, damage
        self.letter = np.zeros(256, dtype=bool)
        self.letter[[*range(65, 91), *range(97, 123), 0xC3]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.table = _crc_table()

    def count(self, data: np.ndarray, offsets: np.ndarray, names: list[str]) -> pa.StructArray:
        """(values, counts) of the words of the texts between the offsets; ``names`` are the texts' doc_ids."""
        inside = self.letter[data]
        inside[1:] |= data[:-1] == 0xC3
        starts, ends = runs(inside, offsets)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        n_chars = chars[ends] - chars[starts]
        long = n_chars >= self.min_chars
        starts, ends, n_chars = starts[long], ends[long], n_chars[long]
        data = self.lower[data]
        if not self.damage:
            return pc.value_counts(strings(data, starts, ends))
        crc = self._crc(data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, names)
        hit = crc % self.damage == 0
        changed = []
        for a, b, at in zip(starts[hit].tolist(), ends[hit].tolist(), (crc[hit] % n_chars[hit]).tolist()):
            run = data[a:b].tobytes().decode()
            if len(run) > self.min_chars:
                changed.append(run[:at] + run[at + 1 :])
        whole = strings(data, starts[~hit], ends[~hit])
        return pc.value_counts(pa.concat_arrays([whole, pa.array(changed, pa.large_string())]))

    def _crc(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, names: list[str]) -> np.ndarray:
        begun = np.array([zlib.crc32(f"{name}:".encode()) for name in names], dtype=np.uint32)
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        first, state = starts[order], ~begun[rows[order]]
        size = size[order]
        alone = int(np.searchsorted(-size, -LONG_RUN))  # runs longer than that go one by one
        top = int(size[alone]) if alone < len(size) else 0
        ends_at = np.searchsorted(-size, -np.arange(top), side="left")  # how many runs are longer than k bytes
        for k in range(top):
            some = slice(alone, int(ends_at[k]))
            now = state[some]
            state[some] = self.table[(now ^ data[first[some] + k]) & 0xFF] ^ (now >> np.uint32(8))
        out = np.empty(len(size), dtype=np.int64)
        state = ~state
        for k in range(alone):
            at = order[k]
            state[k] = zlib.crc32(data[starts[at] : ends[at]].tobytes(), int(begun[rows[at]]))
        out[order] = state
        return out


def _pieces(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A slice of several texts as it is; one long text in pieces that end between words."""
    if len(offsets) > 2 or len(data) <= SLICE_BYTES:
        yield data, offsets
        return
    stops = np.flatnonzero(~letter[data] & (data < 0x80))
    low = 0
    while low < len(data):
        k = int(np.searchsorted(stops, low + SLICE_BYTES))
        high = int(stops[k]) if k < len(stops) else len(data)
        yield data[low:high], np.array([0, high - low])
        low = high


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = RunCounter(min_chars, damage)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for low, high, data, offsets in byte_slices(batch.column("text"), SLICE_BYTES):
                for part, ends in _pieces(data, offsets, counter.letter):
                    found = counter.count(part, ends, names[low:high])
                    yield pa.RecordBatch.from_arrays(
                        [found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"]
                    )

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    counts = named.where("text is not null").mapInArrow(scan, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- pivotal grams ------------------------------------------------------------------------------------------------------


def pivots(places: list[int], costs: list[int], gram: int = GRAM, count: int = EDITS + 1) -> tuple[int, ...]:
    """``count`` disjoint grams of least total cost, by dynamic programming over ascending places."""
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * count]
    for place, cost in zip(places, costs):
        free = best[bisect_right(places, place - gram)]
        row = list(best[-1])
        for k in range(1, count + 1):
            if free[k - 1] and (row[k] is None or free[k - 1][0] + cost < row[k][0]):
                row[k] = (free[k - 1][0] + cost, free[k - 1][1] + (place,))
        best.append(row)
    return best[-1][count][1]


_PRIME, _STEP = (1 << 61) - 1, 0x1F3D5B79A2C4E68


def parts(word: str) -> tuple[list[int], list[int]]:
    """Hashes of word[:i] and of word[i:] for every i."""
    left, right = [0], [0]
    for c in word:
        left.append((left[-1] * _STEP + ord(c)) % _PRIME)
    for c in reversed(word):
        right.append((right[-1] * _STEP + ord(c)) % _PRIME)
    return left, right[::-1]


def _held(n: int, place: int, left: list[int], right: list[int]) -> list[tuple[int, int, int, int]]:
    """What a word of ``n`` letters is found by at a gram of its prefix: a side's number, its length, two equal parts.

    The side of the gram where the edit lies is halved; the edit spares one half.
    """
    half = place // 2
    behind = place + GRAM + (n - place - GRAM) // 2
    return [(0, n, left[half], right[place]), (1, n, 0, right[half]), (2, n, left[behind], 0), (3, n, left[place + GRAM], right[behind])]


def _sought(n: int, one: int, two: int, left: list[int], right: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """What words one edit away are found by, for pivots at ``one`` and ``two``.

    The edit lies before both, from the first on but before the second, in the second, or behind both; each case has
    a pivot that stays whole (its side before or behind the edit). Letters are replaced or left out at places ``low`` to
    ``high``, inserted before places ``low_in`` to ``high_in``.
    """
    end = two + GRAM
    cases = [
        (one, True, 0, one - 1, 0, one),
        (two, True, one, two - 1, one + 1, two),
        (one, False, two, end - 1, two + 1, end - 1),
        (two, False, end, n - 1, end, n),
    ]
    for place, before, *letters, low_in, high_in in cases:
        for more in (-1, 0, 1):
            low, high = (low_in, high_in) if more > 0 else letters
            if low > high:
                continue
            m = n + more
            if before:
                half = (place + more) // 2
                if high >= half:
                    yield 0, m, left[half], right[place]
                if low < half:
                    yield 1, m, 0, right[half - more]
            else:
                half = place + GRAM + (m - place - GRAM) // 2
                if high >= half:
                    yield 2, m, left[half], 0
                if low < half:
                    yield 3, m, left[place + GRAM], right[half - more]


def _named(keys) -> list[int]:
    """One number for each key; equal ones for equal keys and, rarely, by chance."""
    return [hash(key) for key in keys]


def gram_keys(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """Where the prefix ends in the order, the keys under which the word's pivots search, and those of its prefix."""
    ranked = sorted((order[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = ranked[GRAM * EDITS][0][0]
    prefix = sorted((i, rank[1]) for rank, i in ranked if rank[0] <= last)
    places = [i for i, _ in prefix]
    left, right = parts(word)
    n = len(word)
    one, two = pivots(places, [cost for _, cost in prefix])
    held = {key for place in places for key in _held(n, place, left, right)}
    return last, _named(set(_sought(n, one, two, left, right))), _named(held)


def odd_letters(word: str) -> int:
    """A bit for each of 31 classes of letters that occurs an odd number of times. An edit turns two bits at most.

    The sign of a 32-bit number stays free: Spark counts it many times.
    """
    bits = 0
    for c in word:
        bits ^= 1 << ord(c) % 31
    return bits


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Of each bigram its rank, rare ones first, and its frequency over all words."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda i: F.substr("word", i, F.lit(GRAM)))
    counts = words.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()
    return {g: (rank, n) for rank, (n, g) in enumerate(sorted((r["n"], r["g"]) for r in counts))}


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words one edit apart once. ``words``: (word, n), stored, distinct words of 4 or more letters."""
    order = gram_order(words)
    schema = "word string, n long, id long, last int, odd int, searching array<long>, held array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_keys(w, order) for w in batch.column("word").to_pylist()]
            last = pa.array([f[0] for f in found], pa.int32())
            odd = pa.array([odd_letters(w) for w in batch.column("word").to_pylist()], pa.int32())
            keys = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, last, odd, *keys], ["word", "n", "id", "last", "odd", "searching", "held"])

    numbered = words.select("word", "n", F.monotonically_increasing_id().alias("id"))
    # Stored, so that a number stays with its word. A word with very many keys travels as a number only.
    placed = stage(numbered.mapInArrow(scan, schema))
    pivot = placed.select(F.explode("searching").alias("key"), F.col("id").alias("a"), F.col("last").alias("end_a"), F.col("odd").alias("odd_a"))
    prefix = placed.select(F.explode("held").alias("key"), F.col("id").alias("b"), F.col("last").alias("end_b"), F.col("odd").alias("odd_b"))
    met = pivot.join(prefix, "key").where("end_a <= end_b and a != b")
    met = met.where(F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2 * EDITS)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = placed.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("na"))
    second = placed.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("nb"))
    near = met.join(first, "a").join(second, "b").where(F.levenshtein("word_a", "word_b", EDITS) == 1)
    return near.select(F.col("word_a").alias("a"), "na", F.col("word_b").alias("b"), "nb")


# --- forms and roots ----------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form. Each round doubles the steps; an n at least doubles with every step."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").take(1):
            return now.select("word", "root")
        now = now.drop("moved")


def variants(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, lead: int = LEAD, damage: int = DAMAGE
) -> DataFrame:
    """Per word: word, form, root, n, n_near (number of near words), form_n."""
    if min_chars < GRAM * (EDITS + 1):
        raise ValueError("words must be long enough for two disjoint bigrams and one more")
    words = stage(count_words(docs, min_chars, min_count, damage))
    pairs = stage(near_pairs(words))
    both = pairs.select("a", "b", "nb").union(pairs.select("b", "a", "na"))
    near = both.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("k"), "b")).alias("best")
    )
    led = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.b").alias("b"), (-F.col("best.k")).alias("nb")
    )
    leads = F.col("nb") >= lead * F.col("n")
    led = stage(led.select("word", "n", "n_near", F.when(leads, F.col("b")).alias("form"), F.when(leads, F.col("nb")).alias("form_n")))
    roots = _roots(led.where("form is not null"))
    out = led.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
