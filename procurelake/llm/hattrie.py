"""Counting of word sequences in a HAT-trie: a shallow trie over word ids whose leaves are hash containers that burst.

At the root, words share hash containers. A container that outgrows ``BURST`` bursts: shared by several first words, it
becomes one container for each of them; filled by one first word, it becomes a node of its own, with one container for each
second word. The trie's size is bounded: at ``LIMIT`` sequences whole subtrees of first words, the largest
ones first, leave it in runs until half is free; sorting by words and merging the runs is left to the caller.

Words are known by ids of a task's own dictionary, which is bounded as well: when it is full, everything is spilled and
the ids begin anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BURST = 4096
LIMIT = 1 << 20
SHARED = 256
RUN = 1 << 17
BITS = 21  # of a word id
WORDS = 900_000  # a slice of text may add as many again
_LOW = (1 << BITS) - 1


class HatTrie:
    """Counts of sequences of ``size`` word ids. A sequence is its first id and a packed number of the others."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.shift = BITS * (size - 2)  # to the second id of the packed others
        self.whole = BITS * (size - 1)  # to the first id of a packed sequence
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self.shared: list[dict[int, int]] = [{} for _ in range(SHARED)]
        self.burst = [False] * SHARED
        self.pure: dict[int, dict] = {}  # by first word: a container, or a node of containers by second word
        self.nodes: set[int] = set()

    def add(self, firsts: np.ndarray, others: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct sequences in ascending order of their first ids."""
        if not len(firsts):
            return
        heads, starts = np.unique(firsts, return_index=True)
        ends = np.append(starts[1:], len(firsts)).tolist()
        rest, n = others.tolist(), counts.tolist()
        for head, a, b in zip(heads.tolist(), starts.tolist(), ends):
            bucket = head & (SHARED - 1)
            if not self.burst[bucket]:
                self._into_shared(bucket, head, rest[a:b], n[a:b])
            elif head in self.nodes:
                self._into_node(self.pure[head], rest[a:b], n[a:b])
            else:
                self._into_pure(head, rest[a:b], n[a:b])

    def _put(self, table: dict[int, int], keys: list[int], counts: list[int]) -> None:
        before, get = len(table), table.get
        for key, n in zip(keys, counts):
            table[key] = get(key, 0) + n
        self.count += len(table) - before

    def _into_shared(self, bucket: int, head: int, rest: list[int], counts: list[int]) -> None:
        table, base = self.shared[bucket], head << self.whole
        self._put(table, [base | key for key in rest], counts)
        if len(table) > BURST:
            self.shared[bucket], self.burst[bucket] = {}, True
            low = (1 << self.whole) - 1
            for key, n in table.items():
                self.pure.setdefault(key >> self.whole, {})[key & low] = n
            for first in {key >> self.whole for key in table}:
                self._grow(first)

    def _into_pure(self, head: int, rest: list[int], counts: list[int]) -> None:
        self._put(self.pure.setdefault(head, {}), rest, counts)
        self._grow(head)

    def _grow(self, head: int) -> None:
        """A container of one first word that is too large becomes a node by second word."""
        table = self.pure[head]
        if self.size < 3 or len(table) <= BURST:
            return
        node: dict[int, dict[int, int]] = {}
        for key, n in table.items():
            node.setdefault(key >> self.shift, {})[key] = n
        self.pure[head] = node
        self.nodes.add(head)

    def _into_node(self, node: dict[int, dict[int, int]], rest: list[int], counts: list[int]) -> None:
        for key, n in zip(rest, counts):
            table = node.setdefault(key >> self.shift, {})
            if key in table:
                table[key] += n
            else:
                table[key] = n
                self.count += 1

    def _size(self, head: int) -> int:
        return sum(map(len, self.pure[head].values())) if head in self.nodes else len(self.pure[head])

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of (sequences, counts) of whole subtrees, until at most ``keep`` sequences stay; a sequence is a row of ids."""
        heads: list[int] = []
        times: list[int] = []  # how many sequences of the run each head begins
        keys: list[int] = []
        counts: list[int] = []

        def run() -> tuple[np.ndarray, np.ndarray]:
            others = np.array(keys, dtype=np.int64)
            ids = [np.repeat(np.array(heads, dtype=np.int64), times), *((others >> (BITS * at)) & _LOW for at in range(self.size - 2, -1, -1))]
            return np.stack(ids, axis=1), np.array(counts, dtype=np.int64)

        order = sorted(self.pure, key=self._size, reverse=True) if keep else list(self.pure)
        for head in order:
            if self.count <= keep:
                break
            before, subtree = len(keys), self.pure.pop(head)
            for table in subtree.values() if head in self.nodes else (subtree,):
                keys += table
                counts += table.values()
            heads.append(head)
            times.append(len(keys) - before)
            self.count -= times[-1]
            self.nodes.discard(head)
            if len(keys) >= RUN:
                yield run()
                heads, times, keys, counts = [], [], [], []
        low = (1 << self.whole) - 1
        for bucket in sorted(range(SHARED), key=lambda b: len(self.shared[b]), reverse=True):
            table = self.shared[bucket]
            if self.count <= keep or not table:
                break
            heads += [key >> self.whole for key in table]
            times += [1] * len(table)
            keys += [key & low for key in table]
            counts += table.values()
            self.count -= len(table)
            self.shared[bucket] = {}
        if keys:
            yield run()
        if not self.count:
            self._clear()


def windows(ids: np.ndarray, pairs: np.ndarray, sizes: tuple[int, ...], seen: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct windows of ``ids`` by size, as ``size, firsts, others, counts``, in ascending order.

    ``pairs`` tells which neighbours may stand in one window. The first ``seen`` places were passed before, so windows
    within them don't count. Windows get a rank by the prefixes they share, size by size, which keeps keys within 64 bits.
    """
    rank, valid = ids.astype(np.int64), np.ones(len(ids), dtype=bool)
    for size in range(2, max(sizes) + 1):
        if len(ids) < size:
            return
        rank, valid = (rank[:-1] << BITS) | ids[size - 1 :], valid[:-1] & pairs[size - 2 :]
        at = np.flatnonzero(valid)
        _, first, back = np.unique(rank[at], return_index=True, return_inverse=True)
        rank = np.zeros(len(rank), dtype=np.int64)
        rank[at] = back
        if size in sizes:
            counts = np.bincount(back[at > seen - size], minlength=len(first))
            starts, counts = at[first[counts > 0]], counts[counts > 0]
            others = np.zeros(len(starts), dtype=np.int64)
            for step in range(1, size):
                others = (others << BITS) | ids[starts + step]
            yield size, ids[starts], others, counts
