"""Token ids of whole texts by a tokenizers file, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import array
import json
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from episodica.llm.base import byte_slices, runs, strings, worker_cache

WORDS_KEPT, PIECES_KEPT = 50_000, 150_000
SLICE_BYTES = 1 << 20
#: The parts of a tokenizer file under which every word between spaces is encoded by itself.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}
]


def little(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """``encode(text)`` gives the bytes of the ids ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    If the file's normaliser and splitter never look beyond white space, a word between blanks always gets the same
    ids. Words seen are then kept (a bounded number, for as long as the worker lives). Other files, and words with
    letters beyond Latin-1 or with a special token, go through the library as they are.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        normalizer, steps = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            normalizer.get("normalizers") == NORMALIZERS
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0].get("pattern") == {"Regex": SPLITTER}
            and spec.get("post_processor") is None
        )
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.splitter = regex.compile(SPLITTER)
        self.latin = regex.compile(r"[!-~\u00a1-\u00ff]*")
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.words = Kept(worker_cache(f"words {path}"), WORDS_KEPT)
        self.pieces = Kept(worker_cache(f"pieces {path}"), PIECES_KEPT)
        self.whole_texts = not self.by_word or any(" " in x or "\n" in x for x in self.special)
        self.inside = np.ones(256, dtype=bool)
        self.inside[[0x20, 0x0A]] = False
        self.classes = _Classes([x.encode()[:2] for x in self.special])

    def plain(self, text: str) -> bytes:
        return little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return little([t.id for t in self.model.tokenize(letters)])

    def word(self, word: str) -> bytes:
        if not self.latin.fullmatch(word) or any(x in word for x in self.special):
            return self.plain(word)
        return b"".join(self.pieces.all(self.splitter.findall(word.lower()), self.piece))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.whole_texts:
            return self.plain(text)
        return b"".join(self.words.all(text.replace("\n", " ").split(" "), self.word))

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The ids of many texts at once: (first row, row after the last, ids, where each row's ids begin and the end).

        Each distinct word of a slice is looked up once, the ids of all words are gathered from that.
        """
        for low, high, data, offsets in byte_slices(column, SLICE_BYTES):
            if self.whole_texts:
                texts = [self.plain(data[a:b].tobytes().decode()) if a < b else b"" for a, b in zip(offsets, offsets[1:])]
                yield low, high, numbers(b"".join(texts)), np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts])])
            elif high - low == 1 and len(data) > 2 * SLICE_BYTES:
                found = [self._gather(part, np.array([0, len(part)]))[0] for part in self._pieces(data)]
                ids = np.concatenate(found)
                yield low, high, ids, np.array([0, len(ids)])
            else:
                yield low, high, *self._gather(data, offsets)

    def _pieces(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """One long text, cut at blanks."""
        blanks = np.flatnonzero(~self.inside[data])
        low = 0
        while low < len(data):
            k = int(np.searchsorted(blanks, low + SLICE_BYTES))
            high = int(blanks[k]) if k < len(blanks) else len(data)
            yield data[low:high]
            low = high

    def _gather(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = runs(self.inside[data], offsets)
        lower, pieces, others = self.classes.pieces(data, *words)
        at, size, flat = [], [], []
        for source, (starts, ends), kept, make in ((lower, pieces, self.pieces, self.piece), (data, others, self.words, self.word)):
            distinct = strings(source, starts, ends).dictionary_encode()
            found = kept.all(distinct.dictionary.to_pylist(), make)
            n = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            which = distinct.indices.to_numpy()
            at.append((np.cumsum(n) - n)[which] + sum(map(len, flat)))
            size.append(n[which])
            flat.append(numbers(b"".join(found)))
        starts = np.concatenate([pieces[0], others[0]])
        order = np.argsort(starts, kind="stable")
        first, n = np.concatenate(at)[order], np.concatenate(size)[order]
        bounds = np.concatenate([[0], np.cumsum(n)])
        ids = np.concatenate(flat)[np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], n)]
        return ids, bounds[np.searchsorted(starts[order], offsets)]


class _Classes:
    """The splitter on the bytes of words of printable ASCII and Latin-1 letters; all other words stay whole."""

    def __init__(self, special: list[bytes]):
        self.special = special
        self.kind = np.full(256, 2, dtype=np.uint8)  # 0 letters, 1 digits, 2 others
        self.kind[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = 0
        self.kind[48:58] = 1
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.odd = np.ones(256, dtype=bool)
        self.odd[0x21:0x7F] = False

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
        """(lower-cased bytes, starts and ends of the pieces, starts and ends of the words left whole)."""
        n = len(data)
        latin = np.zeros(n, dtype=bool)  # second bytes of U+00C0 to U+00FF but for the two signs among them
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        odd = self.odd[data] & ~latin
        odd[:-1] &= ~((data[:-1] == 0xC3) & latin[1:])
        for sign in self.special:
            if len(sign) > 1:
                odd[:-1] |= (data[:-1] == sign[0]) & (data[1:] == sign[1])
            else:
                odd |= data == sign[0]
        odds = np.concatenate([[0], np.cumsum(odd)])
        plain = odds[starts] == odds[ends]
        others = starts[~plain], ends[~plain]
        starts, ends = starts[plain], ends[plain]
        lower = self.lower[data]
        lower[latin & (data <= 0x9E)] += 32
        kind = self.kind[data]
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:n], dtype=np.int8) > 0
        begins = np.zeros(n + 3, dtype=bool)
        begins[1:n] = kind[1:] != kind[:-1]
        begins[:n] |= kind == 1
        begins[starts] = True
        begins[:n] &= inside
        # 's 't 'm 'd 're 've 'll, where no other sign stands before the apostrophe
        quotes = np.flatnonzero((data == 0x27) & begins[:n])
        if len(quotes):
            end = ends[np.searchsorted(starts, quotes, side="right") - 1]
            padded = np.concatenate([lower, np.zeros(3, dtype=np.uint8)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)) & (quotes + 1 < end)
            pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            pair &= (quotes + 2 < end) & ~short
            for which, length in ((short, 2), (pair, 3)):
                at = quotes[which]
                begins[at + 1] = False
                begins[at + length] |= at + length < end[which]
        first = np.flatnonzero(begins[:n])
        last = ends[np.searchsorted(starts, first, side="right") - 1] if len(first) else first
        return lower, (first, np.minimum(np.append(first[1:], n), last)), others


class Kept:
    """A bounded memory: what was not asked for while ``limit`` others came is forgotten."""

    def __init__(self, halves: dict, limit: int):
        self.halves, self.limit = halves, limit
        halves.setdefault("new", {})
        halves.setdefault("old", {})

    def all(self, keys: list[str], make: Callable[[str], bytes]) -> list[bytes]:
        new, old = self.halves["new"], self.halves["old"]
        found = list(map(new.get, keys))
        for k, value in enumerate(found):
            if value is None:
                key = keys[k]
                value = new.get(key)
                if value is None:
                    value = old.get(key)
                    if value is None:
                        value = make(key)
                    if len(new) >= self.limit:
                        self.halves["old"], self.halves["new"] = old, new = new, {}
                    new[key] = value
                found[k] = value
        return found


def numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u4")
