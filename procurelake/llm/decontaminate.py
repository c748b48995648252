"""Benchmark items in documents, within an edit budget: q-gram lemma in diagonal bands, then banded alignment.

Documents and items are compared in lower case with blanks as one space. A region that is an item of m characters with
at most e edits shares m - q + 1 - e q of its q-grams with it, all on diagonals (place in the document less
place in the item) that differ by at most e. So hits of the items' q-grams are counted in overlapping bands of diagonals,
bands that reach the bound are regions to look at, and an alignment along the band decides. An item so short that the bound
would say nothing has shorter q-grams, down to single characters, so items of any length are found.

Items go out in blocks of at most ``BLOCK_CHARS`` characters, whatever the benchmark's size; each block is one pass over the
documents, which are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.llm.units import groups

Q = 8
EDIT_RATE = 0.1
BLOCK_CHARS = 4_000_000
_FILTER = 1 << 22
_GAP = np.uint32(0xFFFFFFFF)
LINKS = "doc_id long, item_id long, start long, end long, edits int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _qgrams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` code points from each place on, as if blanks of nothing followed the end."""
    base = 0x9E3779B97F4A7C15
    out = np.zeros(len(points), dtype=np.uint64)
    power = np.concatenate([points.astype(np.uint64) + np.uint64(1), np.zeros(q, dtype=np.uint64)])
    size, done = 1, 0
    while q:  # by the binary digits of q
        if q & 1:
            scale = np.uint64(pow(base, size, 1 << 64))
            out = out * scale + power[done : done + len(points)]
            done += size
        q >>= 1
        if q:
            scale = np.uint64(pow(base, size, 1 << 64))
            power = power * scale + np.concatenate([power[size:], np.zeros(size, dtype=np.uint64)])
            size *= 2
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def aligned(item: np.ndarray, region: np.ndarray, shift: int, reach: int, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits of ``item`` against any part of ``region``, with that part's start and end, or None beyond the budget.

    Cell (i, d) stands for i characters of the item against the region up to ``i + d + shift``; only ``d`` from 0 to ``reach`` are kept.
    """
    width, far = reach + 1, budget + 1
    offsets = np.arange(width)
    cost = np.where((offsets + shift >= 0) & (offsets + shift <= len(region)), 0, far)
    start = np.clip(offsets + shift, 0, len(region))
    for i in range(1, len(item) + 1):
        ends = i + offsets + shift
        inside = (ends >= 1) & (ends <= len(region))
        same = inside & (region[np.clip(ends - 1, 0, max(0, len(region) - 1))] == item[i - 1]) if len(region) else np.zeros(width, dtype=bool)
        match = np.where(inside, cost + ~same, far)
        skip = np.append(cost[1:], far) + 1  # a character of the item is missing
        take = skip < match
        best = np.where(take, np.minimum(skip, far), np.minimum(match, far))
        begin = np.where(take, np.append(start[1:], 0), start)
        best = np.where((ends >= 0) & (ends <= len(region)), best, far)
        # a character of the region is extra: from the left, one edit each
        keyed = (best - offsets) * (width + 1) + offsets
        least = np.minimum.accumulate(keyed)
        origin = least % (width + 1)
        cost = np.minimum(np.where((ends >= 0) & (ends <= len(region)), best[origin] + offsets - origin, far), far)
        start = begin[origin]
        if cost.min() > budget:
            return None
    at = int(cost.argmin())
    return int(cost[at]), int(start[at]), len(item) + at + shift


def _place(region: np.ndarray, item: np.ndarray) -> int:
    """Where ``item`` stands unchanged in ``region`` first, or -1."""
    data, part = region.tobytes(), item.tobytes()
    at = data.find(part)
    while at % 4 and at >= 0:
        at = data.find(part, at + 1)
    return at // 4 if at >= 0 else -1


class Items:
    """A block of items with their q-grams, sorted by hash; items of one size of q-grams together."""

    def __init__(self, rows: list[tuple[int, str]], q: int, rate: float) -> None:
        kept = sorted({(item, text) for item, raw in rows if (text := normal(raw))}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        self.names = [item for item, _ in kept]
        self.points = [_points(text) for _, text in kept]
        self.sizes = np.array([len(p) for p in self.points], dtype=np.int64)
        self.budgets = (self.sizes * rate).astype(np.int64)
        # the longest q-grams of which the lemma asks for one at least
        own = np.clip(self.sizes // (self.budgets + 1), 1, q)
        self.bounds = self.sizes - own + 1 - self.budgets * own
        self.grams = [_Grams(int(size), np.flatnonzero(own == size), self.points) for size in np.unique(own)]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each normal text its items: index, start, end (in the normal text) and edits; the best region of each."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        joined = np.concatenate([part for text in texts for part in (_points(text), np.full(1, _GAP, dtype=np.uint32))])
        ends = np.cumsum([len(text) + 1 for text in texts]) - 1
        origin = np.concatenate([[0], ends[:-1] + 1])
        for grams in self.grams:
            self._find(grams, joined, origin, ends, out)
        return [[(name, a, b, edits) for name, (edits, a, b) in sorted(found.items())] for found in out]

    def _find(self, grams: _Grams, joined: np.ndarray, origin: np.ndarray, ends: np.ndarray, out: list[dict]) -> None:
        item, place, diagonal = grams.hits(joined)
        if not len(item):
            return
        # bands of twice the drift, in steps of the drift: any drift lies within one of them
        step = self.budgets[item] + 1
        band = np.floor_divide(diagonal, step)
        rows = np.concatenate([np.stack([item, band, place]), np.stack([item, band - 1, place])], axis=1)
        order = np.lexsort((rows[2], rows[1], rows[0]))
        rows = rows[:, order]
        new = np.concatenate([[True], (np.diff(rows, axis=1) != 0).any(axis=0)])  # a q-gram of the item counts once
        rows = rows[:, new]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:2], axis=1) != 0).any(axis=0)]))
        counts = np.diff(np.append(edge, rows.shape[1]))
        names, bands = rows[0, edge], rows[1, edge]
        full = counts >= self.bounds[names]
        names, bands = names[full], bands[full]
        # without edits the first place is the best one, so later ones are looked at only if it fails
        text = np.searchsorted(ends, np.maximum(bands * (self.budgets[names] + 1), 0), "left")
        strict = self.budgets[names] == 0
        later = strict & np.concatenate([[False], (np.diff(names) == 0) & (np.diff(text) == 0)])
        for name, number in zip(names[~later].tolist(), bands[~later].tolist()):
            self._check(name, number, joined, origin, ends, out)
        for name, number, at in zip(names[later].tolist(), bands[later].tolist(), text[later].tolist()):
            if at < len(out) and name not in out[at]:
                self._check(name, number, joined, origin, ends, out)

    def _check(self, name: int, band: int, joined: np.ndarray, origin: np.ndarray, ends: np.ndarray, out: list[dict]) -> None:
        budget, size = int(self.budgets[name]), int(self.sizes[name])
        first = band * (budget + 1)
        # the texts that the region touches; the bound was reached in one of them or in none
        for text in range(int(np.searchsorted(ends, max(0, first), "left")), len(ends)):
            if origin[text] > first + 2 * (budget + 1) + size + budget:
                break
            begin = max(int(origin[text]), first - budget)
            region = joined[begin : min(int(ends[text]), first + 2 * (budget + 1) + size + budget)]
            shift = first - begin - budget
            exact = _place(region, self.points[name])
            found = (0, exact, exact + size) if exact >= 0 else aligned(self.points[name], region, shift, 2 * (budget + 1) + 2 * budget, budget)
            if found:
                row = (found[0], found[1] + begin - int(origin[text]), found[2] + begin - int(origin[text]))
                if name not in out[text] or row < out[text][name]:
                    out[text][name] = row


class _Grams:
    """q-grams of some items with their places, sorted by hash."""

    def __init__(self, q: int, numbers: np.ndarray, points: list[np.ndarray]) -> None:
        self.q = q
        hashes = [_qgrams(points[n], q)[: len(points[n]) - q + 1] for n in numbers]
        every = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.item = np.repeat(numbers, [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(len(h)) for h in hashes)])[order]
        self.table = np.zeros(_FILTER, dtype=bool)
        self.table[(self.hashes & np.uint64(_FILTER - 1)).astype(np.int64)] = True

    def hits(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in it and diagonal of each q-gram of the texts that an item has."""
        grams = _qgrams(joined, self.q)
        at = np.flatnonzero(self.table[(grams & np.uint64(_FILTER - 1)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        times = high - low
        at, low, times = at[times > 0], low[times > 0], times[times > 0]
        index = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        place = self.place[index]
        return self.item[index], place, np.repeat(at, times) - place


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, dealt by hash; a block that comes out too large is split further on."""
    slim = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    total = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-int(total) // limit))
    for number in range(count):
        mine = slim if count == 1 else slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number)
        block, size = [], 0
        for row in mine.toLocalIterator():
            if block and size + len(row["text"]) > limit:
                yield block
                block, size = [], 0
            block.append((row["item_id"], row["text"]))
            size += len(row["text"])
        if block:
            yield block


def _sent(docs: DataFrame, benchmark: DataFrame, q: int, rate: float, limit: int):
    for block in blocks(benchmark, limit):
        yield docs.sparkSession.sparkContext.broadcast(Items(block, q, rate))


def _hits(items: Items, texts) -> Iterator[list[tuple[int, int, int, int]]]:
    for group in groups([normal(text) for text in texts], 1 << 20):
        yield from items.find(group)


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: items of ``benchmark`` (``item_id``, ``text``) that ``docs`` (``doc_id``, ``text``) hold.

    One row per row of ``docs`` and item, with the region of fewest edits, the first of equals, as places in the
    text in lower case with single spaces. At most ``rate`` of the item's characters may be edited, so items of fewer than ten are
    found as they are. An item without characters is in nothing; null and empty texts hold nothing; texts of any length are searched
    whole, each in one piece; repeated rows give repeated links, repeated items (equal id and text) one; null ids stay null; an empty table gives an empty table.
    """

    def search(sent):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                hits = list(_hits(items, batch.column("text").to_pylist()))
                rows = [(items.names[name], a, b, edits) for found in hits for name, a, b, edits in found]
                docs = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(hits)), [len(found) for found in hits])))
                columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([docs, *columns], names=["doc_id", "item_id", "start", "end", "edits"])

        return work

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = [slim.mapInArrow(search(sent), LINKS) for sent in _sent(docs, benchmark, q, rate, limit)]
    if not found:
        return docs.sparkSession.createDataFrame([], LINKS)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item; cases as in ``leaks``."""

    def search(sent):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in _hits(sent.value, batch.column("text").to_pylist())], pa.bool_()))

        return work

    for sent in _sent(docs, benchmark, q, rate, limit):
        docs = docs.mapInArrow(search(sent), docs.schema)
    return docs
