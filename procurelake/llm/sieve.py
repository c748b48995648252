"""A filter of bounded size for sequences of words: what it lacks is not in the set, what it holds may be.

Bits are set in blocks of 2^16, each by one task, so the filter is put together without any task that sees the whole set. Its
size follows the set up to ``MOST`` bits (64 MB); beyond that it lets more through, which costs time and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

MOST = 1 << 29
EACH = 16
_BLOCK = 16
_PROBES = 4


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def fold(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a sequence from that of its beginning and its last word's; a sequence begins with 0."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _places(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the bits within a block."""
    mixed = fold(hashes, np.uint64(1))
    for probe in range(_PROBES):
        yield ((mixed >> np.uint64(16 * probe)) & np.uint64((1 << _BLOCK) - 1)).astype(np.int64)


def _blocks(hashes: np.ndarray, shift: int) -> np.ndarray:
    return (hashes >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(hashes), dtype=np.int64)


class Sieve:
    def __init__(self, bits: bytes, shift: int) -> None:
        self.bits, self.shift = bits, shift

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.bits, dtype=np.uint8)
        start, found = _blocks(hashes, self.shift) << _BLOCK, np.ones(len(hashes), dtype=bool)
        for place in _places(hashes):
            at = start + place
            found &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _hashed(shift: int):
    def work(batches):
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                h = np.zeros(1, dtype=np.uint64)
                for word in word_hashes(phrase.encode().split(b" "), lang):
                    h = fold(h, word)
                hashes.append(h[0])
            found = np.array(hashes, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_blocks(found, shift), pa.int64()), pa.array(found.view(np.int64))], names=["block", "h"])

    return work


def _filled(batches):
    """Bits of each block; rows come sorted by block."""
    block, bits = None, np.zeros(1 << _BLOCK, dtype=bool)

    def row():
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary())], names=["block", "bits"])

    for batch in batches:
        blocks, hashes = batch.column("block").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
        for number in np.unique(blocks).tolist():
            if number != block:
                if block is not None:
                    yield row()
                block, bits = number, np.zeros(1 << _BLOCK, dtype=bool)
            for place in _places(hashes[blocks == number]):
                bits[place] = True
    if block is not None:
        yield row()


def build(phrases: DataFrame, most: int = MOST) -> Sieve:
    """Filter of the rows of ``lang``, ``phrase``; phrases are words joined by one space."""
    size = min(most, max(1 << _BLOCK, 1 << (EACH * phrases.count()).bit_length()))
    blocks = size >> _BLOCK
    shift = 64 - (blocks.bit_length() - 1)
    hashed = phrases.select("lang", "phrase").mapInArrow(_hashed(shift), "block long, h long")
    made = hashed.repartition("block").sortWithinPartitions("block").mapInArrow(_filled, "block long, bits binary")
    bits = bytearray(size >> 3)
    for block, part in made.toLocalIterator():
        at = block << (_BLOCK - 3)
        bits[at : at + len(part)] = part
    return Sieve(bytes(bits), shift)
