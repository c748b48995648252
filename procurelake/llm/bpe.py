"""Byte-level BPE: encoding by merge ranks, and decoding from ids with their byte offsets.

Pieces come from ``pretokens``; each distinct piece is merged once per cache and then looked up. Merging keeps
the parts of a piece in a linked list and the ranks of neighbours in a heap, so a piece of n bytes without
any break takes n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.llm.pretokens import boundaries

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE = 300_000
GROUP_POINTS = 1 << 22


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank, the leftmost of equals, is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    size = len(piece)
    if size < 48:
        return _merge_short(piece, ranks)
    right = list(range(1, size + 1))  # where the part that starts here ends
    left = list(range(-1, size - 1))
    heap = [(rank, at, at + 2) for at in range(size - 1) if (rank := ranks.get(piece[at : at + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(size)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = right[at]
        if gone[at] or middle >= size or right[middle] != end:
            continue
        right[at] = end
        gone[middle] = 1
        if end < size:
            left[end] = at
            if (rank := ranks.get(piece[at : right[end]])) is not None:
                heapq.heappush(heap, (rank, at, right[end]))
        if (before := left[at]) >= 0 and (rank := ranks.get(piece[before:end])) is not None:
            heapq.heappush(heap, (rank, before, end))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at : right[at]]])
        at = right[at]
    return ids


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[at : at + 1] for at in range(len(piece))]
    get, never = ranks.get, 1 << 60
    pairs = [get(a + b, never) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < never:
        at = pairs.index(low)
        parts[at : at + 2] = [joined := parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = get(joined + parts[at + 1], never)
        if at:
            pairs[at - 1] = get(parts[at - 1] + joined, never)
    return [ranks[part] for part in parts]


class Pieces:
    """Ids of pieces, kept as little-endian 32-bit integers in two generations of bounded size.

    When the young generation is full it becomes the old one, and what is used again moves back,
    so frequent pieces stay. ``make`` gives the ids of a piece that is in neither.
    """

    def __init__(self, make, size: int = CACHE) -> None:
        self.make, self.size = make, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = np.array(self.make(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self.young) >= self.size:
                self.young, self.old = {}, self.young
            self.young[piece] = found
        return found

    def of_text(self, text: str, cuts: np.ndarray) -> bytes:
        at, get, make = cuts.tolist(), self.young.get, self.ids
        pieces = [text[a:b] for a, b in zip(at, at[1:])]
        if len(self.young) + len(pieces) > self.size:  # the generations may change under way
            return b"".join([self.young.get(piece) or make(piece) for piece in pieces])
        return b"".join([get(piece) or make(piece) for piece in pieces])

    def of_texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text. Boundaries are found for groups of bounded size; a longer text is a group of its own."""
        for group in groups(texts):
            for text, cuts in zip(group, boundaries(group)):
                yield self.of_text(text, cuts)


def groups(texts: list[str], points: int = GROUP_POINTS) -> Iterator[list[str]]:
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


class Encoder:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self.pieces = Pieces(lambda piece: merge(piece.encode("utf-8", "surrogatepass"), self.ranks))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        for ids in self.pieces.of_texts(texts):
            yield np.frombuffer(ids, dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset of each token in the decoded text, and its length at the end."""
        return [0, *accumulate(map(len, map(self.token_bytes.__getitem__, ids)))]

    def decode_span(self, ids: list[int], first: int, last: int) -> bytes:
        """Bytes ``first`` to ``last`` of the text, from the tokens that cover them only."""
        at = np.array(self.offsets(ids))
        first, last = max(0, first), min(last, int(at[-1]))
        if first >= last:
            return b""
        a, b = int(np.searchsorted(at, first, "right")) - 1, int(np.searchsorted(at, last, "left"))
        return self.decode(ids[a:b])[first - int(at[a]) : last - int(at[a])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs`` (``doc_id``, ``text``), without special tokens.

    A null or empty text has no ids; equal and repeated rows are encoded alike and all kept; a null
    doc_id stays null; an empty table gives an empty table; further columns are ignored. A long text is encoded whole,
    in one task, in memory that is a multiple of its own size.
    """
    path = path or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            lists = [np.frombuffer(ids, dtype="<i4") for ids in tool.pieces.of_texts(_texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _slim(docs).mapInArrow(work, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, content`` (bytes) and the tokens' byte ``offsets``, from ``doc_id, ids``; null ids decode to nothing."""
    path = path or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            lists = [ids or [] for ids in batch.column("ids").to_pylist()]
            content, offsets = pa.array([*map(tool.decode, lists)], pa.binary()), pa.array([*map(tool.offsets, lists)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), content, offsets], names=["doc_id", "content", "offsets"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, content binary, offsets array<long>")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, and decoded from the ids in the same task.

    The digests are of the decimal ids joined by commas, and of the decoded bytes. Cases as in ``encode``.
    """
    path = path or vocabulary_path()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            counts, listed, decoded = [], [], []
            for ids in tool.encode_batch(_texts(batch)):
                counts.append(len(ids))
                listed.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    return _slim(docs).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [text or "" for text in batch.column("text").to_pylist()]


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
