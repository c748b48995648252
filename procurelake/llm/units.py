"""Token ids of texts by distinct units, in arrays: a bounded hash table of what the tokenizers library has given."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

TABLE = 1 << 21
LONG = 64
_TANGLED = re.compile(r"\s (?:\s|\Z)|  ").search
_BASE = 0x9E3779B97F4A7C15
_SPACE = 0x20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & ((1 << 64) - 1)), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _after_letter(data: np.ndarray) -> np.ndarray:
    """Whether a byte is ASCII punctuation behind a letter; 0xC3 leads the Latin-1 letters, x and division sign left out."""
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    found = _MARK[data]
    found[1:] &= letter[:-1]
    found[:1] = False
    return found


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def _before_blank(data: np.ndarray, spaces: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Those of the places of spaces that a blank, perhaps of two or three bytes, or the end of a text follows."""
    padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
    one, two = padded[spaces + 1], padded[spaces + 2]
    found = _BLANK[one] | ((one == 0xC2) & ((two == 0x85) | (two == 0xA0))) | ((one == 0xE1) & (two == 0x9A))
    found |= ((one == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((one == 0xE3) & (two == 0x80))
    last = np.zeros(len(data) + 1, dtype=bool)
    last[ends] = True
    return spaces[found | last[spaces + 1]]


class UnitEncoder:
    """Ids as the library gives them for whole texts, each followed by ``end_id``.

    The library cuts a text into pieces before it merges; no piece goes on after a space that follows something
    else, and a run of blanks is cut before its last one. So a text falls into units, each a space
    with what follows up to the next, that are encoded by themselves. Neither does a piece go on from a letter to
    punctuation, so units end there too, where bytes alone tell (ASCII and Latin-1 letters). Units of up to ``LONG`` bytes are known by a 64-bit hash
    and their length; each is given to the library once while the table holds it, which is emptied when half full.
    A text in which a space stands among blanks, or ends the text after a blank, or that holds the
    string of an added token, goes to the library whole.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tool.get_added_tokens_decoder().values()]
        self.end_id = end_id
        self._powers = _powers(_BASE, 1 << 16), _powers(pow(_BASE, -1, 1 << 64), 1 << 16)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(TABLE, dtype=np.uint64)
        self.starts = np.zeros(TABLE, dtype=np.int32)
        self.sizes = np.zeros(TABLE, dtype=np.int32)
        self.count = 0
        self.pool = np.array([self.end_id], dtype=np.int32)
        self.used = 1

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        found = [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or that of the empty slot where it belongs."""
        slots = (hashes & np.uint64(TABLE - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            key = self.keys[slots[left]]
            left = left[(key != hashes[left]) & (key != 0)]
            slots[left] = (slots[left] + 1) & (TABLE - 1)
        return slots

    def _add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), dtype=np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.count += len(hashes)
        left = np.arange(len(hashes))
        while len(left):  # of hashes that meet in an empty slot one stays, the others look on
            slots = self._find(hashes[left])
            self.keys[slots] = hashes[left]
            own = self.keys[slots] == hashes[left]
            self.starts[slots[own]], self.sizes[slots[own]] = starts[left[own]], sizes[left[own]]
            left = left[~own]

    def _hashes(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self._powers[0]):
            n = 2 * len(data)
            self._powers = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        ahead, back = self._powers
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ahead[: len(data)], out=sums[1:])
        h = (sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h[h == 0] = 1
        return h

    def _short_units(self, joined: bytes, first: np.ndarray, last: np.ndarray, hashes: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool that begins with the end id, and where in it the ids of each unit are, zero for units that are not short.

        The table takes at most a quarter of its slots from a slice of the units, so a text with more distinct units than
        the table has slots is encoded as well; the ids of a slice are copied before the table may be emptied.
        """
        starts, sizes = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        pools, used = [self.pool[:1]], 1
        step = max(TABLE // 4, 1)
        for begin in range(0, len(short), step):
            part = short[begin : begin + step]
            names, at = np.unique(hashes[part], return_index=True)
            if self.count + len(names) > TABLE // 2:
                self._clear()
            fresh = self.keys[self._find(names)] == 0
            where = part[at[fresh]]
            if len(where):
                self._add(names[fresh], *self._library([joined[a:b].decode() for a, b in zip(first[where], last[where])]))
            slots = self._find(hashes[part])
            starts[part], sizes[part] = self.starts[slots], self.sizes[slots]
            if len(short) <= step:
                return self.pool[: self.used], starts, sizes
            n = sizes[part]
            shift = np.cumsum(n) - n
            pools.append(self.pool[np.repeat(starts[part] - shift, n) + np.arange(int(n.sum()))])
            starts[part] = used + shift
            used += len(pools[-1])
        return np.concatenate(pools), starts, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` one after the other, each with the end id, and how many each has."""
        encoded = [text.encode("utf-8") for text in texts]
        joined = b"".join(encoded)
        data = np.frombuffer(joined, dtype=np.uint8)
        ends = np.cumsum([len(x) for x in encoded], dtype=np.int64)
        origin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        spaces = data == _SPACE
        tangled = np.array([any(token in text for token in self.added) for text in texts])
        for at in np.unique(np.searchsorted(ends, _before_blank(data, np.flatnonzero(spaces), ends), "right")):
            tangled[at] |= bool(_TANGLED(texts[at]))
        begins = spaces | _after_letter(data)
        begins[origin[origin < len(data)]] = True
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(data))
        owner = np.searchsorted(ends, first, "right")
        plain = ~tangled[owner]
        first, last, owner = first[plain], last[plain], owner[plain]
        hashes = self._hashes(data, first, last)
        short = last - first <= LONG
        held, starts, sizes = self._short_units(joined, first, last, hashes, np.flatnonzero(short))
        # long units and tangled texts: their own ids, after the pool
        wide, whole = np.flatnonzero(~short), np.flatnonzero(tangled)
        own, counts = self._library([*(joined[first[i] : last[i]].decode() for i in wide), *(texts[i] for i in whole)])
        pool = np.concatenate([held, own])
        places = len(held) + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)[: len(counts)]
        starts[wide], sizes[wide] = places[: len(wide)], counts[: len(wide)]
        # rows in the order of the texts; each text ends with the end id, which is the pool's first
        count = len(texts)
        if len(whole):
            at = np.searchsorted(owner, whole)
            owner = np.insert(owner, at, whole)
            starts, sizes = np.insert(starts, at, places[len(wide) :]), np.insert(sizes, at, counts[len(wide) :])
        at = np.searchsorted(owner, np.arange(count), "right")
        owner = np.insert(owner, at, np.arange(count))
        starts, sizes = np.insert(starts, at, 0), np.insert(sizes, at, 1)
        shift = np.cumsum(sizes) - sizes
        ids = pool[np.repeat(starts - shift, sizes) + np.arange(int(sizes.sum()))]
        return ids, np.bincount(owner, weights=sizes, minlength=count).astype(np.int64)


def groups(texts: list[str], points: int = 1 << 19) -> Iterator[list[str]]:
    """Runs of texts of bounded size; a longer text is a run of its own."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > points:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield group
