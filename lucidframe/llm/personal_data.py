"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

A text's words are tagged sentence by sentence.  A word's features are its shape (runs of capitals, small letters and
digits written once, other characters as they are), the ends of the shape and a length class, each for the word and
its two neighbours.  The field is trained on a small labelled table by gradient ascent of its likelihood; decoding is
Viterbi over many sentences at once in numpy.  Words of equal shape and length class share their scores, so a worker
keeps one row of scores for each class that it has met.

Sentences made of plain words alone are not decoded where a bound of the trained scores proves that their best path
tags nothing; if the bound does not hold, they are decoded like any other.

Spans of the fixed patterns always stay; a span of the field is added where it overlaps none of them and where its
digits are what its kind asks for (a card's pass Luhn, an address's parts are at most 255, a phone has 9 to 15).
Patterns, decoding and the merging of spans take time in proportion to the text, digit runs of any length included.
Defined results: a null or empty text has no spans.  Repeated rows are searched one by one.  ``find_personal`` reads no other
column; ``redact`` carries all of them.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidframe.llm.hashing import HashTable, run_hashes
from lucidframe.llm.text import bounded_batches, narrow, slices, table

#: Order of kinds in listings; the last one is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Patterns of the base kinds.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")  # nothing follows the group, so nothing need be given back
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Runs of digits joined by single dots, as long as they go: never tried again from a later digit.
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Tokens decoded at once.
BATCH = 1 << 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def ip_places(text: str) -> list[tuple[int, int]]:
    """What IP matches, leftmost and without overlaps, in one pass: every match is four neighbouring runs of digits."""
    out = []
    for m in DOTTED.finditer(text):
        runs = m[0].split(".")
        if len(runs) >= 4:
            at = m.start()
            for k in range(0, len(runs) - 3, 4):
                size = sum(map(len, runs[k : k + 4])) + 3
                out.append((at, at + size))
                at += size + 1
    return out


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def is_card(text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(re.sub("[^0-9]", "", text)) <= 15


#: What the text of a span of a kind must be.
CHECKS = {"email": lambda t: "@" in t, "ip": is_ip, "card": is_card, "phone": is_phone, "secret": bool}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        free = 0  # each @ with what stands before it, so that long texts without one cost nothing
        at = text.find("@")
        while at >= 0:
            start = at
            while start > free and re.match(r"[A-Za-z0-9._%+-]", text[start - 1]):
                start -= 1
            if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                free = m.end()
            at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", a, b) for a, b in ip_places(text) if is_ip(text[a:b])]
        out += [("card", *m.span()) for m in CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if is_phone(m[0])]
    return out


def training_table(n: int = 300, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table: invented sentences with addresses, numbers and secrets, and (kind, start, end) of them.

    Cards pass Luhn; numbers as long that fail it are among the plain words.
    """
    r = random.Random(seed)

    def sixteen(valid: bool) -> str:
        head = "".join(str(r.randint(0, 9)) for _ in range(15))
        right = next(c for c in "0123456789" if luhn(head + c))
        return head + (right if valid else str((int(right) + r.randint(1, 9)) % 10))

    word = lambda: "".join(r.choice(("th", "er", "an", "ing", "la", "de", "ver", "ion", "su", "é", "ñ", "ü")) for _ in range(r.choice((1, 1, 2, 2, 3, 4, 6, 9))))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    plain = (lambda: str(r.randint(0, 9999)), lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 23)}:{r.randint(10, 59)}", lambda: f"v{r.randint(1, 9)}", lambda: f"{r.randint(1, 99)}%", lambda: f"${r.randint(1, 999)}", lambda: word().upper() + "!!", lambda: word() + r.choice(("***", "&&&", "###", "$$$", "%%%")), lambda: "|", lambda: word().upper(), lambda: word().capitalize(), lambda: (word() + word()).upper(), lambda: (word() + word()).capitalize(), lambda: word() + "." + r.choice(("***", "!!", "%%%")), lambda: sixteen(False), lambda: " ".join(re.findall("....", sixteen(False))))
    made = {
        "email": (lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com".replace("é", "e").replace("ñ", "n").replace("ü", "u"), lambda: f"info@{r.choice('abc')}x.org"),
        "ip": (lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),),
        "card": (lambda: sixteen(True),),
        "phone": (lambda: f"+{r.randint(1, 99)} ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", lambda: f"+{r.randint(1, 99)} {r.randint(100, 999)} 555 {r.randint(1000, 9999)}"),
        "secret": (lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"{r.choice(('password', 'secret', 'api_key'))}={hexa(r.randint(16, 32))}", lambda: f'token = "{hexa(40)}"'),
    }
    rows = []
    for i in range(n):
        text, spans = "", []
        for j in range(r.randint(4, 14)):
            if text:
                text += " "
            kind = r.choice(KINDS) if r.random() < 0.13 else None
            piece = r.choice(made[kind])() if kind else r.choice(plain)() if r.random() < 0.3 else word() + r.choice(("", "", "", ","))
            if j == 0 and not kind:
                piece = piece.capitalize()
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        rows.append((text + r.choice((".", "", "!")), spans))
    return rows


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:], _SHAPE[0x30:0x3A] = ord("A"), ord("a"), ord("a"), ord("9")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = re.compile(r"[Aa]{1,3}[.,;:!?|]?|[|]")
_LENGTHS = np.array([1, 2, 4, 8, 14, 18])
#: Added to the length class of a word that is a number of 13 to 19 digits that passes Luhn.
_LUHN = 8


def word_classes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]], bytes]:
    """Starts and ends of words, a key of shape and length class for each, where the shapes stand, and the shapes."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    shape = _SHAPE[data]
    run = np.isin(shape, (ord("A"), ord("a"), ord("9")))
    keep = ~space
    keep[1:] &= ~(run[1:] & (shape[1:] == shape[:-1]))
    before = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
    a, b = before[starts], before[ends]
    short = shape[keep]
    length = np.searchsorted(_LENGTHS, ends - starts, side="left").astype(np.uint64)
    digits = np.concatenate(([0], np.cumsum(shape == ord("9"), dtype=np.int64)))
    many = digits[ends] - digits[starts]
    for w in np.flatnonzero((many >= 13) & (many <= 19)).tolist():
        number = raw[starts[w] : ends[w]].strip(b".,;:!?|")
        if number.isdigit() and luhn(number.decode()):
            length[w] += np.uint64(_LUHN)
    keys = run_hashes(short, a, b) ^ (length * np.uint64(0x9E3779B97F4A7C15)) if len(starts) else np.zeros(0, np.uint64)
    return starts, ends, keys, np.column_stack((a, b, length.astype(np.int64))), short.tobytes()


def class_features(shape: str, length: int) -> list[str]:
    valid, length = length & _LUHN, length & ~_LUHN
    return [f"l:{valid}:{shape.strip('.,;:!?|')[:2]}:{length}", f"s:{shape[:12]}", f"p:{shape[:2]}", f"e:{shape[-2:]}", f"n:{length}", f"9:{shape.count('9') > 0}:{min(3, shape.count('9'))}", f"x:{shape.strip('.,;:!?|')[:8]}:{length}", f"@:{'@' in shape}", f"k:{''.join(sorted(set(shape)))[:6]}"]


class Field:
    """Weights of features at the word and its neighbours, and of steps between tags."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.features, self.weights, self.steps = features, weights, steps  # weights: offset (-1, 0, 1), feature, tag
        self.slack = 2 * max(0.0, float((steps[1:].max() if len(steps) else 0) - steps[0, 0]), float(steps.max() - steps[0, 0]))
        plain = [(s + e, n) for s in ("a", "A", "Aa", "aA", "AaA", "aAa") for e in ("", *".,;:!?|") for n in range(len(_LENGTHS) + 1)] + [("|", 0)]
        rows = np.stack([self.row(s, n) for s, n in plain])
        lead = rows[:, :, :1] - rows  # how far O is ahead of each tag, by offset
        total = lead[:, 1] + lead[:, 0].min(0) + lead[:, 2].min(0)
        # a neighbour that is missing adds nothing
        least = lead[:, 1] + np.minimum(lead[:, 0].min(0), 0) + np.minimum(lead[:, 2].min(0), 0)
        self.plain = {p for p, t, m in zip(plain, total, least) if min(t[1:].min(), m[1:].min()) >= self.slack}

    def row(self, shape: str, length: int) -> np.ndarray:
        """Scores of a class for the word after it, itself, and the word before it."""
        known = [self.features[f] for f in class_features(shape, length) if f in self.features]
        return self.weights[:, known].sum(1)


def sentences(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, line_ends: np.ndarray) -> np.ndarray:
    """The first word of every sentence: after a word that ends in . ! or ?, and after a line end."""
    if not len(starts):
        return np.zeros(0, np.int64)
    last = data[ends - 1]
    closes = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    opens = np.concatenate(([True], closes[:-1]))
    opens[np.minimum(np.searchsorted(starts, line_ends), len(starts) - 1)] = True
    return np.flatnonzero(opens)


def viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best tags of all sequences at once; ``scores`` has a row for each word, sequences start at ``first``."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    tags = np.zeros(len(scores), np.int8)
    back = np.zeros((len(scores), scores.shape[1]), np.int8)
    best = scores[first].copy()
    ended = np.zeros(len(first), np.int64)
    n = len(first)
    for t in range(int(size[0]) if len(size) else 0):
        if t:
            n = int(np.searchsorted(-size, -t, side="left"))
            paths = best[:n, :, None] + steps
            at = first[:n] + t
            back[at] = paths.argmax(1)
            best[:n] = paths.max(1) + scores[at]
    ended = best.argmax(1)
    for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        n = int(np.searchsorted(-size, -t, side="left")) if t else len(first)
        at = first[:n] + t
        tags[at] = ended[:n]
        ended[:n] = back[at, ended[:n]]
    return tags


def _batch(rows: Sequence[tuple[str, list[tuple[str, int, int]]]], k: int = len(TAGS)) -> tuple[list[list[list[str]]], list[list[int]]]:
    features, gold = [], []
    for text, spans in rows:
        raw = text.encode()
        starts, ends, _, places, shapes = word_classes(raw)
        points = [len(raw[:s].decode()) for s in starts.tolist()]
        features.append([class_features(shapes[a:b].decode(), n) for a, b, n in places.tolist()])
        tags = []
        for p in points:
            inside = next(((kind, a) for kind, a, b in spans if a <= p < b), None)
            tags.append(0 if inside is None else 1 + 2 * KINDS.index(inside[0]) + (p != inside[1]))
        gold.append(tags)
    return features, gold


def train_field(rows: Sequence[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.3, penalty: float = 1e-3) -> Field:
    """Gradient ascent (Adagrad) of the penalised likelihood, all sentences in one batch."""
    features, gold = _batch([(t, s) for t, s in rows if t.strip()])
    names = {f: i for i, f in enumerate(sorted({f for s in features for w in s for f in w}))}
    k, n, longest = len(TAGS), len(features), max((len(s) for s in features), default=0)
    weights, steps = np.zeros((3, len(names), k)), np.zeros((k, k))
    if not longest:
        return Field(names, weights, steps)
    mask = np.zeros((n, longest))
    y = np.zeros((n, longest), int)
    where: list[list[tuple[int, int, int]]] = [[], [], []]
    for i, (s, g) in enumerate(zip(features, gold)):
        mask[i, : len(s)] = 1
        y[i, : len(s)] = g
        for t in range(len(s)):
            for o in (-1, 0, 1):  # a word's features count for the word after it, itself, and the one before it
                if 0 <= t - o < len(s):
                    where[o + 1] += [(i, t, names[f]) for f in s[t - o]]
    cells = [np.array(w) if w else np.zeros((0, 3), int) for w in where]
    given = [np.zeros((n * longest, len(names)), np.float32) for _ in cells]  # the labelled table is small
    for g, c in zip(given, cells):
        g[c[:, 0] * longest + c[:, 1], c[:, 2]] = 1
    gold_one = np.eye(k)[y] * mask[:, :, None]
    gold_steps = np.zeros((k, k))
    np.add.at(gold_steps, (y[:, :-1].ravel(), y[:, 1:].ravel()), (mask[:, 1:]).ravel())
    sums = [np.zeros_like(weights), np.zeros_like(steps)]
    lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    for _ in range(rounds):
        e = sum(given[o] @ weights[o].astype(np.float32) for o in range(3)).astype(float).reshape(n, longest, k)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None] > 0, e[:, t] + lse(alpha[:, t - 1, :, None] + steps, 1), alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, lse(steps + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pairs = np.exp(alpha[:, :-1, :, None] + steps + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        rest = (gold_one - p).reshape(-1, k)
        grads = [-penalty * n * weights, gold_steps - pairs.sum((0, 1)) - penalty * n * steps]
        for o in range(3):
            grads[0][o] += given[o].T @ rest.astype(np.float32)
        for w, g, s in zip((weights, steps), grads, sums):
            s += g * g
            w += rate * g / (np.sqrt(s) + 1e-8)
    return Field(names, weights, steps)


class Tagger:
    """Scores by class, and decoding of whole texts."""

    def __init__(self, field: Field, kept: int = 200_000):
        self.field, self.kept = field, kept
        self.reset()

    def reset(self) -> None:
        self.table = HashTable(self.kept)
        self.rows = np.zeros((1024, 3, len(TAGS)), np.float32)
        self.plain = np.zeros(1024, bool)

    def classes(self, keys: np.ndarray, places: np.ndarray, shapes: bytes) -> np.ndarray:
        found = self.table.find(keys)
        if (lost := np.flatnonzero(found < 0)).size:
            new, at = np.unique(keys[lost], return_index=True)
            if self.table.size + len(new) > self.kept:
                self.kept = max(self.kept, len(keys))
                self.reset()
                lost = np.arange(len(keys))
                new, at = np.unique(keys, return_index=True)
            numbers = self.table.add(new)
            while self.table.size > len(self.plain):
                self.rows, self.plain = np.concatenate((self.rows, np.zeros_like(self.rows))), np.concatenate((self.plain, np.zeros_like(self.plain)))
            for i, (a, b, n) in zip(numbers.tolist(), places[lost[at]].tolist()):
                shape = shapes[a:b].decode()
                self.rows[i] = self.field.row(shape, n)
                self.plain[i] = (shape, n) in self.field.plain
            found = self.table.find(keys)
        return found

    def spans(self, texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in bytes of each text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        raw = b"\n".join(t or b"" for t in texts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        starts, ends, keys, places, shapes = word_classes(raw)
        if not len(starts):
            return out
        known = self.classes(keys, places, shapes)
        first = sentences(starts, ends, data, np.flatnonzero(data == 0x0A))
        size = np.diff(np.append(first, len(starts)))
        odd = np.concatenate(([0], np.cumsum(~self.plain[known])))
        todo = odd[first + size] > odd[first]
        first, size = first[todo], size[todo]
        if not len(first):
            return out
        begins = np.concatenate(([0], np.cumsum([len(t or b"") + 1 for t in texts])))
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // BATCH, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)]):
            f, n = first[a:b], size[a:b]
            at = np.arange(n.sum()) + np.repeat(f - (np.cumsum(n) - n), n)
            begin = np.cumsum(n) - n
            c = known[at]
            scores = self.rows[c, 1].copy()
            inner = np.ones(len(at), bool)
            inner[begin] = False
            after = np.flatnonzero(inner)
            scores[after] += self.rows[c[after - 1], 2]
            scores[after - 1] += self.rows[c[after], 0]
            tags = viterbi(scores, begin, n, self.field.steps.astype(np.float32))
            i = 0
            hits = np.flatnonzero(tags)
            while i < len(hits):
                w = hits[i]
                kind = (tags[w] - 1) // 2
                j = i
                while j + 1 < len(hits) and hits[j + 1] == hits[j] + 1 and inner[hits[j + 1]] and tags[hits[j + 1]] == 2 + 2 * kind:
                    j += 1
                s, e = int(starts[at[w]]), int(ends[at[hits[j]]])
                while e > s + 1 and raw[e - 1] in b".,;:!?":
                    e -= 1
                d = int(np.searchsorted(begins, s, side="right")) - 1
                out[d].append((KINDS[kind], s - int(begins[d]), e - int(begins[d])))
                i = j + 1
        return out


def all_spans(texts: list[bytes | None], tagger: Tagger) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Of each text the base spans and all spans, in code points, in the order of kinds and starts."""
    out = []
    for text, tagged in zip(texts, tagger.spans(texts)):
        if not text:
            out.append(([], []))
            continue
        plain = text.decode()
        base = base_spans(plain)
        added = []
        if tagged:
            data = np.frombuffer(text, np.uint8)
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            order = sorted((a, b) for _, a, b in base)
            starts, reach = [a for a, _ in order], list(accumulate((b for _, b in order), max))
            for kind, a, b in tagged:
                p, q = int(points[a]), int(points[b])
                before = bisect_left(starts, q)
                if not (before and reach[before - 1] > p) and CHECKS[kind](plain[p:q]):
                    added.append((kind, p, q))
        rank = lambda s: (KINDS.index(s[0]), s[1])
        out.append((sorted(base, key=rank), sorted(base + added, key=rank)))
    return out


_taggers: dict[int, Tagger] = {}


def tagger_of(broadcast) -> Tagger:
    """The worker's tagger of this trained field."""
    if broadcast.value.stamp not in _taggers:
        _taggers.clear()
        _taggers[broadcast.value.stamp] = Tagger(broadcast.value)
    return _taggers[broadcast.value.stamp]


def load_field(spark: SparkSession, rows=None):
    field = train_field(rows if rows is not None else training_table())
    field.stamp = hash(field.weights.tobytes())
    return spark.sparkContext.broadcast(field)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled=None) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (kind, first, last)."""
    field = load_field(df.sparkSession, labelled)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger_of(field)
        for ids, texts in slices(batches):
            found = all_spans(texts, own)
            lists = [pa.array([[{"kind": k, "first": a, "last": b} for k, a, b in f[i]] for f in found], _SPAN) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,first:long,last:long>>"
    return narrow(df, id_col, text_col).mapInArrow(scan, f"doc_id long, base {kind}, spans {kind}")


def redact_text(text: bytes, spans: list[tuple[str, int, int]]) -> bytes:
    plain, out, at = text.decode(), [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if b <= at:
            continue
        out += [plain[at : max(a, at)], f"[{kind.upper()}]"] if a >= at else []
        at = b
    return "".join([*out, plain[at:]]).encode()


def redact(df: DataFrame, text_col: str = "text", labelled=None) -> DataFrame:
    """All rows and columns of ``df``, every span of the texts replaced by its kind in brackets."""
    field = load_field(df.sparkSession, labelled)
    at = df.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger_of(field)
        for batch in batches:
            kind = batch.schema.field(at).type
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(at)], ["doc_id", "text"])
            done: list[bytes | None] = []
            for _, texts in slices(iter([pair])):
                for text, (_, spans) in zip(texts, all_spans(texts, own)):
                    # overlapping spans of different kinds are one gap
                    done.append(redact_text(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary()).cast(kind) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return bounded_batches(df).mapInArrow(scan, df.schema)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
