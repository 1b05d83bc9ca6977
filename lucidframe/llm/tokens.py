"""Exact token ids of whole texts by word_bpe_49k.json, many words at once.

The tokenizer drops white space and never joins characters across it.  Within a white-space chunk of plain Latin
characters its pre-tokens are runs of letters, single digits and runs of marks, so these are cut in whole-array steps;
a chunk with anything else - apostrophes, special tokens, other scripts - is one unit and goes through the whole
tokenizer, normalizer and all.  Units repeat: each worker keeps the ids of those it has met in a bounded table that is
keyed by 64-bit hashes, and only new ones reach the tokenizer, many in one call.
"""

from __future__ import annotations

import json
import os

import numpy as np

from lucidframe.llm.hashing import HashTable, run_hashes

#: Units that a worker keeps; the table starts anew beyond.
KEPT_UNITS = 1_000_000
WORD_BPE = "word_bpe_49k.json"

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
#: Classes of bytes.  0xC3 leads the letters from U+00C0 to U+00FF, whose second bytes are classed as letters too.
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASSES[0x21:0x7F] = MARK
CLASSES[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = LETTER
CLASSES[0x30:0x3A] = DIGIT
CLASSES[[ord("'"), ord("<")]] = OTHER
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cut_units(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the units in them: starts, ends, and whether a unit is a whole chunk of other characters."""
    data = np.frombuffer(raw, np.uint8)
    kind = CLASSES[data]
    lower = LOWER[data]
    if (lead := np.flatnonzero(data == 0xC3)).size:
        after = lead + 1
        second = data[after]
        upper = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        lower[after[upper]] += 32
        kind[after[(second == 0x97) | (second == 0xB7)]] = OTHER
    space = kind == SPACE
    if (odd := np.flatnonzero(kind == OTHER)).size:
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        hit = np.unique(np.searchsorted(first, odd, side="right") - 1)
        step = np.zeros(len(data) + 1, np.int8)
        step[first[hit]] += 1
        step[last[hit]] -= 1
        whole = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        kind[whole] = OTHER
        lower[whole] = data[whole]
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= kind == DIGIT
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))
    unit = kind[starts]
    keep = unit != SPACE
    return lower, starts[keep], ends[keep], unit[keep] == OTHER


class Encoder:
    """Token ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str | None = None, kept: int = KEPT_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        file = path or default_path()
        self.whole = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.letters, self.kept = byte_letters(), kept
        self.reset()

    def reset(self) -> None:
        self.table = HashTable(self.kept)
        self.first, self.count = np.zeros(self.kept, np.int64), np.zeros(self.kept, np.int64)
        self.flat, self.used = np.zeros(1 << 20, "<u4"), 0

    def store(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[numbers] = counts
        self.first[numbers] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def learn(self, lower: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> None:
        raw = lower.tobytes()
        plain = np.flatnonzero(~other)
        for a in range(0, len(plain), 20_000):
            some = plain[a : a + 20_000]
            units = [raw[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist())]
            e = self.merger.encode(" ".join(u.decode() if u.isascii() else u.decode("latin-1").translate(self.letters) for u in units), add_special_tokens=False)
            counts = np.bincount(np.array(e.word_ids, np.int64), minlength=len(units))
            self.store(self.table.add(keys[some]), np.array(e.ids, "<u4"), counts)
        rest = np.flatnonzero(other)
        for a in range(0, len(rest), 4096):
            some = rest[a : a + 4096]
            got = [e.ids for e in self.whole.encode_batch_fast([raw[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist())], add_special_tokens=False)]
            self.store(self.table.add(keys[some]), np.array([i for ids in got for i in ids], "<u4"), np.array([len(ids) for ids in got], np.int64))

    def units(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all units and their numbers in the table."""
        lower, starts, ends, other = cut_units(raw)
        if not len(starts):
            return starts, np.zeros(0, np.int32)
        keys = run_hashes(lower, starts, ends) ^ other.astype(np.uint64)
        found = self.table.find(keys)
        if (lost := np.flatnonzero(found < 0)).size:
            new, at = np.unique(keys[lost], return_index=True)
            if self.table.size + len(new) > self.kept:
                self.kept = max(self.kept, len(keys))
                self.reset()
                new, at = np.unique(keys, return_index=True)
                lost = np.arange(len(keys))
            at = lost[at]
            self.learn(lower, new, starts[at], ends[at], other[at])
            found = self.table.find(keys)
        return starts, found

    def encode_many(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text."""
        raw = b"\n".join(t or b"" for t in texts) + b"\n"
        starts, found = self.units(raw)
        counts = self.count[found]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        at = np.arange(total) + np.repeat(self.first[found] - (stops - counts), counts)
        ids = self.flat[at]
        bounds = np.cumsum([len(t or b"") + 1 for t in texts])
        ends = np.concatenate(([0], stops))[np.searchsorted(starts, bounds)]
        return np.split(ids, ends[:-1])

    def counts(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text, the starts of its units, in bytes, and their numbers of tokens."""
        raw = b"\n".join(t or b"" for t in texts) + b"\n"
        starts, found = self.units(raw)
        counts, sizes = self.count[found], np.array([len(t or b"") + 1 for t in texts])
        bounds = np.cumsum(sizes)
        cuts = np.searchsorted(starts, bounds)[:-1]
        return [(s - b, c) for s, c, b in zip(np.split(starts, cuts), np.split(counts, cuts), (bounds - sizes).tolist())]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; workers serve many tasks, so its table stays."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
