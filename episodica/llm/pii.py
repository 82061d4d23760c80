"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a trained classifier decides.

Kinds: email, ip, card, phone. The base spans are those of fixed patterns (see ``base_spans``); they are always reported. Looser
patterns propose further spans: addresses spelled with "at" and "dot", eight-group ip addresses, card-like groups that fail
the check sum, phone numbers without a plus sign.

1. On every candidate, base or proposed, five labelers vote yes, no or nothing: the strict pattern, the kind's check (Luhn, ranges,
   numbers of digits), a gazetteer (endings of domains, calling codes, issuer prefixes), words around, and the borders.
2. Spark counts vote patterns by kind over all documents (4 x 3**5 at most). EM over these counts (Dawid and Skene) estimates
   each labeler's reliability and each pattern's probability.
3. A logistic span classifier is trained on the shape of the spans, weighted by these probabilities. It may use at most
   ``PATTERNS`` distinct (kind, votes, shape) rows, the most frequent ones; each carries its count.
4. Proposed spans the classifier accepts are added, unless they overlap a base span of their kind.

Null texts hold nothing. Texts of any length are read whole, every pattern in time linear in the text. Repeated rows get equal
results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.base import stage

KINDS = ("email", "ip", "card", "phone")
PATTERNS, LABELERS = 20_000, 5

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins where a run of digits does: a run whose start fails fails everywhere.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z0-9-]{1,63})+"
)
IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
LOCAL_PHONE = re.compile(r"(?<![0-9+)-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")

#: Endings of domains, calling codes and issuer prefixes in common use, and words beside such data.
ENDINGS = "com org net edu gov mil int info io co de fr es it uk us eu ca au ch at nl be pl ru jp cn in br mx".split()
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91".split()
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 6011 65 35 36 38 62".split()
CUES = {
    "email": "mail email e-mail contact write correo courriel".split(),
    "ip": "ip host server address adresse".split(),
    "card": "card visa mastercard amex credit karte carte tarjeta".split(),
    "phone": "phone tel telephone call mobile fax telefon telefono".split(),
}
AGAINST = "version order invoice id isbn issn page vol serial v".split()


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@...``: the part before the sign is the whole run that ends there."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end): the matches of the fixed patterns, those that fail their check dropped."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        number = digits(m.group())
        if 14 <= len(number) <= 19 and luhn(number):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def proposed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the looser patterns that touch no base span."""
    out = []
    if "dot" in text:
        out += [(m.start(), 0, m.end()) for m in SPELLED.finditer(text)]
    if text.count(":") >= 7:
        out += [(m.start(), 1, m.end()) for m in IP6.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19]
    out += [(m.start(), 3, m.end()) for m in LOCAL_PHONE.finditer(text)]
    taken, free, k = sorted((a, b) for a, _, b in base), [], 0
    reach = 0
    for a, kind, b in sorted(out):
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            free.append((a, kind, b))
    return free


def votes(text: str, span: tuple[int, int, int], strict: bool) -> str:
    """One sign per labeler: + yes, - no, 0 nothing to say."""
    a, kind, b = span
    own, number = text[a:b], digits(text[a:b])
    name = KINDS[kind]
    if name == "email":
        tail = re.split(r"[^A-Za-z0-9-]+", own.strip(" )]"))[-1].lower()
        sound, listed = "@" in own and ".." not in own, tail in ENDINGS
    elif name == "ip":
        parts = own.split(".") if "." in own else own.split(":")
        sound, listed = len(parts) in (4, 8), ":" in own or 1 <= int(parts[0][-3:]) <= 223
    elif name == "card":
        sound, listed = luhn(number), any(number.startswith(x) for x in ISSUERS)
    else:
        sound, listed = 10 <= len(number) <= 15, own[0] == "+" and any(number.startswith(x) for x in CODES)
    around = re.findall(r"[a-z-]+", text[max(0, a - 40) : a].lower())[-5:]
    cue = "+" if any(w in CUES[name] for w in around) else "-" if any(w in AGAINST for w in around[-1:]) else "0"
    glued = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    return ("+" if strict else "-") + ("+" if sound else "-") + ("+" if listed else "0") + cue + ("-" if glued else "+")


def shape(text: str, span: tuple[int, int, int]) -> list[int]:
    """Numbers of the features a span shows; the kind's number of features is ``SHAPES``."""
    a, _, b = span
    own = text[a:b]
    n = len(digits(own))
    out = [min(n, 20), 21 + min(len(own) // 4, 9)]
    out += [31 + k for k, c in enumerate(" -.()+:@") if c in own]
    out.append(39 + (0 if a == 0 else 1 if text[a - 1].isspace() else 2))
    out.append(42 + (0 if b == len(text) else 1 if text[b].isspace() else 2 if not text[b].isalnum() else 3))
    return out


SHAPES = 46
FOUND = "doc_id long, spans array<struct<begin:long,kind:int,finish:long,strict:boolean,votes:string,shape:string>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Per row all candidates with votes and shape."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct(
                [("begin", pa.int64()), ("kind", pa.int32()), ("finish", pa.int64())]
                + [("strict", pa.bool_()), ("votes", pa.string()), ("shape", pa.string())]
            )
        )
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text, found = value.as_py() or "", []
                base = base_spans(text)
                for strict, spans in ((True, base), (False, proposed_spans(text, base))):
                    for s in spans:
                        marks = ",".join(map(str, shape(text, s)))
                        found.append((s[0], s[1], s[2], strict, votes(text, s, strict), marks))
                names = ("begin", "kind", "finish", "strict", "votes", "shape")
                rows.append([dict(zip(names, f)) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, FOUND)


def reliabilities(patterns: dict[tuple[int, str], int], rounds: int = 50) -> dict[tuple[int, str], float]:
    """EM over vote patterns: the probability that a span with this kind and these votes is personal data."""
    out = {}
    for kind in {k for k, _ in patterns}:
        own = [(v, n) for (k, v), n in sorted(patterns.items()) if k == kind]
        cast = np.array([["-0+".index(c) for c in v] for v, _ in own])
        n = np.array([x for _, x in own], dtype=float)
        sure = ((cast == 2).sum(axis=1) + 0.5) / ((cast != 1).sum(axis=1) + 1)
        for _ in range(rounds):
            prior = (n @ sure + 1) / (n.sum() + 2)
            odds = np.full(len(own), np.log(prior / (1 - prior)))
            for j in range(LABELERS):
                yes = np.bincount(cast[:, j], n * sure, 3) + [0.5, 1.0, 1.5]
                no = np.bincount(cast[:, j], n * (1 - sure), 3) + [1.5, 1.0, 0.5]
                odds += np.log(yes / yes.sum())[cast[:, j]] - np.log(no / no.sum())[cast[:, j]]
            sure = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out |= {(kind, v): float(p) for (v, _), p in zip(own, sure)}
    return out


def train(rows: list[tuple[int, str, str, int]], sure: dict[tuple[int, str], float], steps: int = 300) -> np.ndarray:
    """Weights of the span classifier, by gradient steps on (kind, votes, shape, count) rows."""
    x = np.zeros((len(rows), len(KINDS) * SHAPES + len(KINDS)))
    for r, (kind, _, marks, _) in enumerate(rows):
        x[r, _columns(kind, marks)] = 1
    n = np.array([r[3] for r in rows], dtype=float)
    y = np.array([sure[r[0], r[1]] for r in rows])
    weight, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    n = np.log1p(n) / max(np.log1p(n).sum(), 1)  # so that a few frequent shapes don't drown the others
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ weight))
        speed = 0.9 * speed + x.T @ (n * (y - p)) - 1e-4 * weight
        weight += speed
    return weight


def _columns(kind: int, marks: str) -> list[int]:
    return [kind * SHAPES + int(m) for m in marks.split(",")] + [len(KINDS) * SHAPES + kind]


def detect(docs: DataFrame, patterns: int = PATTERNS) -> DataFrame:
    """Per row: doc_id, numbers of base spans by kind, base_sha256 and all spans (kind:start:end by start, then kind)."""
    found = stage(candidates(docs))
    each = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.shape", "s.strict")
    counted = {(r[0], r[1]): r[2] for r in each.groupBy("kind", "votes").agg(F.count("*")).collect()}
    sure = reliabilities(counted)
    shapes = each.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n"))
    shapes = shapes.orderBy(F.desc("n"), "kind", "votes", "shape").limit(patterns)
    weight = train([tuple(r) for r in shapes.collect()], sure)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted: dict[tuple[int, str], bool] = {}
        for batch in batches:
            counts, shas, texts = [], [], []
            for spans in batch.column(1).to_pylist():
                base = [s for s in spans if s["strict"]]
                more = []
                for s in spans:
                    key = s["kind"], s["shape"]
                    if not s["strict"]:
                        if key not in accepted:
                            accepted[key] = bool(weight[_columns(*key)].sum() > 0)
                        if accepted[key]:
                            more.append(s)
                counts.append([sum(s["kind"] == k for s in base) for k in range(len(KINDS))])
                shas.append(hashlib.sha256(listed(base).encode()).hexdigest())
                texts.append(listed(base + more))
            numbers = np.array(counts, dtype=np.int64).reshape(-1, len(KINDS))
            columns = [pa.array(numbers[:, k]) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(shas), pa.array(texts)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return found.mapInArrow(judge, schema)


def listed(spans: list[dict]) -> str:
    ordered = sorted(spans, key=lambda s: (s["begin"], s["kind"]))
    return ",".join(f"{KINDS[s['kind']]}:{s['begin']}:{s['finish']}" for s in ordered)
