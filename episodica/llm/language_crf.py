"""Language identification by a linear-chain conditional random field over words.

A text's words are its runs of letters (ASCII letters, lower-cased, and everything beyond ASCII). A word shows affixes of up to 4
bytes, n-grams of 2 to 4 bytes and its entry in the lexicon (the word itself), all hashed into one weight table; transitions
between labels are learned with them. Chains are lines, so neighbouring words of code-switched text share their evidence
and a change of language costs what the training text says. Forward-backward gives every word's posterior; a document's
language is the label of the largest sum, its score the mean posterior of that label.

The model is fitted on a bounded sample: at most ``per_label`` rows for each label in the order of a hash, ``row_words`` words
of each. Their lines are cut and mixed into chains that switch languages. Prediction reads all words of all texts.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if no row carries a label. Repeated rows get
equal results. Columns other than text are carried, under any names but ``lang_pred`` and ``score``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.llm.base import byte_slices, free_worker_caches, give_back_memory
from episodica.llm.words import Alphabet, Powers, Words, cut, mix

LETTERS = Alphabet([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], lower=True)
UNKNOWN = "und"
BITS, PER_LABEL, ROW_WORDS, STEPS, RATE, RIDGE = 16, 150, 800, 60, 0.15, 1e-5
GRAMS, AFFIXES = (2, 3, 4), (1, 2, 3, 4)


def features(words: Words, chosen: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of the chosen words, one after another, and where each word's begin."""
    starts, sizes = words.starts[chosen], words.ends[chosen] - words.starts[chosen]
    framed = sizes + 2  # a mark before and after
    first = np.concatenate([[0], np.cumsum(framed)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], framed) - 1
    size = np.repeat(sizes, framed)
    real = (at >= 0) & (at < size)
    source = np.repeat(starts, framed) + np.clip(at, 0, np.maximum(size - 1, 0))
    value = np.where(real, LETTERS.value[words.data[source]], np.where(at < 0, np.uint64(0x51ED270B), np.uint64(0x7F4A7C15)))
    left = np.repeat(first[1:], framed) - np.arange(first[-1])  # signs from here to the word's closing mark
    owner, rows = [], []
    own = np.repeat(np.arange(len(chosen)), framed)
    for n in sorted({*GRAMS, *AFFIXES}):
        gram = np.zeros(first[-1], dtype=np.uint64)
        for k in range(n):
            shifted = value[k:] * np.uint64(2 * k * k + 6 * k + 3)
            gram[: len(shifted)] += shifted
        if n in GRAMS:
            keep = left >= n
            rows.append(_row(gram[keep], n, bits))
            owner.append(own[keep])
        if n in AFFIXES:
            fits = sizes >= n
            for mark, place in ((10 + n, first[:-1] + 1), (20 + n, first[1:] - 1 - n)):
                rows.append(_row(gram[place[fits]], mark, bits))
                owner.append(np.flatnonzero(fits))
    rows.append(_row(words.hashes[chosen], 30, bits))
    owner.append(np.arange(len(chosen)))
    owner, rows = np.concatenate(owner), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.searchsorted(owner[order], np.arange(len(chosen)))


def _row(hashed: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return (mix(hashed + np.uint64(kind * 0x9E3779B1)) >> np.uint64(64 - bits)).astype(np.int64)


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and lengths of the chains, the longest first."""
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    return first[order], lengths[order]


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every word's label, and the expected number of each transition.

    All chains advance together, one word a step; those that ended leave the front of the arrays.
    """
    first, sizes = chains(lengths)
    weight = np.exp(emission - emission.max(axis=1, keepdims=True))
    step = np.exp(transition - transition.max())
    forward, posterior = np.empty_like(weight), np.empty_like(weight)
    moves = np.zeros_like(step)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than each step
    state = None
    for t in range(longest):
        at = first[: alive[t]] + t
        state = weight[at] if t == 0 else (state[: alive[t]] @ step) * weight[at]
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    back = None
    for t in range(longest - 1, -1, -1):
        at = first[: alive[t]] + t
        now = np.ones((len(at), len(step)))
        if back is not None and len(back):
            ahead = weight[at[: len(back)] + 1] * back
            now[: len(back)] = ahead @ step.T
            now[: len(back)] /= now[: len(back)].sum(axis=1, keepdims=True)
            pair = forward[at[: len(back)]]
            scale = 1 / np.einsum("si,ij,sj->s", pair, step, ahead)
            moves += (pair * scale[:, None]).T @ ahead * step
        both = forward[at] * now
        posterior[at] = both / both.sum(axis=1, keepdims=True)
        back = now
    return posterior, moves


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transition: np.ndarray


def _sequences(words: Words, data: np.ndarray) -> np.ndarray:
    """Lengths of the chains: words of one line of one text."""
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, words.starts) if len(words.starts) else np.zeros(0, int)
    text = np.searchsorted(words.first, np.arange(len(words.starts)), side="right")
    change = np.flatnonzero((np.diff(line) != 0) | (np.diff(text) != 0)) + 1
    return np.diff(np.concatenate([[0], change, [len(words.starts)]])) if len(words.starts) else np.zeros(0, int)


def fit(rows: list[tuple[str, str]], bits: int = BITS, row_words: int = ROW_WORDS, steps: int = STEPS) -> Model:
    """Maximise the likelihood of the labelled words, by Adam over all chains at once.

    A row with more than ``row_words`` words gives chains drawn from all over its text, until they hold that many.
    """
    labels = sorted({lang for lang, _ in rows})
    raw = [text.encode() for _, text in rows]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = cut(data, np.cumsum([0, *map(len, raw)]), LETTERS, Powers())
    rng = np.random.default_rng(5)
    pieces = []
    for k, (lang, _) in enumerate(rows):
        at, end = int(words.first[k]), int(words.first[k + 1])
        chains, left = [], row_words
        while at < end:
            n = min(int(rng.integers(4, 40)), end - at)
            chains.append((at, n, labels.index(lang)))
            at += n
        if sum(n for _, n, _ in chains) > row_words:  # chains from all over a long text
            rng.shuffle(chains)
        for chain in chains:
            if left > 0:
                pieces.append(tuple(int(x) for x in chain))
                left -= chain[1]
    weights, transition = np.zeros((1 << bits, len(labels))), np.zeros((len(labels), len(labels)))
    if not pieces:
        return Model(labels, weights, transition)
    rng.shuffle(pieces)
    order = np.concatenate([np.arange(a, a + n) for a, n, _ in pieces])
    truth = np.repeat([y for _, _, y in pieces], [n for _, n, _ in pieces])
    lengths = np.array([sum(n for _, n, _ in pieces[k : k + 4]) for k in range(0, len(pieces), 4)])
    _, chosen, inverse = np.unique(words.hashes[order], return_index=True, return_inverse=True)
    table, begin = features(words, order[chosen], bits)
    owner = np.repeat(np.arange(len(chosen)), np.diff(np.concatenate([begin, [len(table)]])))
    ends = np.cumsum(lengths) - 1
    inner = np.setdiff1d(np.arange(len(truth) - 1), ends)
    seen = np.zeros_like(transition)
    np.add.at(seen, (truth[inner], truth[inner + 1]), 1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, transition)]
    for t in range(1, steps + 1):
        emission = np.add.reduceat(weights[table], begin, axis=0)[inverse]
        posterior, moves = forward_backward(emission, lengths, transition)
        miss = -posterior
        miss[np.arange(len(truth)), truth] += 1
        by_word = np.stack([np.bincount(inverse, miss[:, y], len(chosen)) for y in range(len(labels))], axis=1)
        by_row = [np.bincount(table, by_word[owner, y], 1 << bits) for y in range(len(labels))]
        slopes = (np.stack(by_row, axis=1) / len(truth) - RIDGE * weights, (seen - moves) / len(truth) - RIDGE * transition)
        for value, slope, (m, v) in zip((weights, transition), slopes, moments):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(labels, weights, transition)


def sample(docs: DataFrame, per_label: int = PER_LABEL) -> list[tuple[str, str]]:
    """Labelled rows: about ``per_label`` of each label by a hash, never more than twice as many rows in all."""
    labelled = docs.where("lang is not null and text is not null").withColumn("_h", F.xxhash64("doc_id", "text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.2 * per_label / n))])
    drawn = (F.pmod("_h", F.lit(1 << 30)) / (1 << 30)) < share[F.col("lang")]
    rows = labelled.where(drawn).orderBy(F.pmod("_h", F.lit((1 << 30) - 35)), "_h").select("lang", "text")
    out, used = [], dict.fromkeys(counts, 0)
    for lang, text in rows.limit(2 * per_label * len(counts)).collect():
        used[lang] += 1
        if used[lang] <= per_label:
            out.append((lang, text))
    return out


def lettered(text: str) -> bool:
    """Whether a text holds a letter (Unicode category L); numbers such as "½" or "Ⅳ" are none."""
    return any(map(str.isalpha, text))


def _score(batch: pa.RecordBatch, at: int, model: Model, powers: Powers) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for low, high, data, offsets in byte_slices(batch.column(at)):
        words = cut(data, offsets, LETTERS, powers)
        total = np.zeros((high - low, len(model.labels)))
        if len(words.starts) and model.labels:
            _, chosen, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            table, begin = features(words, chosen, int(np.log2(len(model.weights))))
            emission = np.add.reduceat(model.weights[table], begin, axis=0)[inverse]
            posterior, _ = forward_backward(emission, _sequences(words, data), model.transition)
            sums = np.concatenate([np.zeros((1, len(model.labels))), np.cumsum(posterior, axis=0)])
            total = sums[words.first[1:]] - sums[words.first[:-1]]
        counts = words.counts()
        plain = np.zeros(256, dtype=bool)
        plain[65:91] = plain[97:123] = True
        letters = np.concatenate([[0], np.cumsum(plain[data])])
        for k in range(high - low):
            some = letters[offsets[k + 1]] > letters[offsets[k]] or bool(
                counts[k] and lettered(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
            )
            if not some or not model.labels:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(total[k].argmax())
            names.append(model.labels[best])
            scores.append(float(min(1.0, max(0.0, total[k][best] / counts[k]))))
    return names, scores


def predict(docs: DataFrame, model: Model, carried: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to every row, beside the columns named (all of them by default)."""
    kept = docs.drop("lang_pred", "score")
    columns = kept.columns
    carried = columns if carried is None else carried
    places = [columns.index(c) for c in carried]
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transition))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_caches()
        own, powers = Model(*shared.value), Powers()
        for batch in batches:
            names, scores = _score(batch, columns.index("text"), own, powers)
            more = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in places), *more], [*carried, "lang_pred", "score"])
        del own, powers
        give_back_memory()

    fields = [kept.schema.fields[c] for c in places]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(scan, schema)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by crc32 of the id as text, that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    """The model of the rows that are not held out."""
    return fit(sample(docs.where(~held_out(F.col("doc_id"))), per_label))
