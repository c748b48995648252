"""Ranked lexical search: term at a time with a limited set of accumulators.

Documents are read once per block of items and become an index of what the block's items ask for: one row per document with its
number of terms and the places and frequencies of the asked terms. Statistics are aggregates over that index. Then each
task inverts its own share of the index, ``DOCS`` documents at a time, and ranks them for every item: terms go from the
rarest to the most frequent; before each, the kth best partial score is compared with all that the remaining terms can
still add, and once that sum is smaller no accumulator is created any more, as a document first met now can't get among the best.
Accumulators that exist are updated exactly to the end. The kth score of the documents a task has ranked already counts from
the start. The best of the tasks are merged by rank, in two steps, so the size of the merge doesn't grow with one item.

Items are dealt into blocks by the number of their terms, so that what is broadcast is bounded; every block is ranked against
all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.session import staged

K = 50
DOCS = 1 << 16
POSTINGS = 1 << 22
BLOCK_TERMS = 1 << 18
SLICE = 1 << 22
_MERGES = 64
_SCALE = 1_000_000_000

#: Letters and digits of ASCII, the capitals as small letters, and all bytes of other characters; the rest parts terms.
_TERMS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_INDEX = "doc_id long, n long, terms array<int>, tfs array<long>"
_INDEX_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_RANKED = "query int, doc_id long, score long, task int"
_RANKED_ARROW = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("task", pa.int32())])


def _slices(data: bytes) -> Iterator[bytes]:
    """``data`` cut between terms into parts of about ``SLICE`` bytes."""
    at = 0
    while len(data) - at > SLICE:
        end = data.find(b" ", at + SLICE)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def terms_of(text: str | bytes | None) -> Counter:
    """Terms of a text, in UTF-8, with their frequencies."""
    data = (text or b"") if isinstance(text, (bytes, type(None))) else text.encode("utf-8", "surrogatepass")
    found: Counter = Counter()
    for part in _slices(data.translate(_TERMS)):
        found.update(part.split())
    return found


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items as ``(item_id, distinct terms)``, dealt by hash into blocks of about ``size`` terms; one block at a time is fetched."""
    texts = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    asked = texts.mapInArrow(_item_terms(items.schema["item_id"].dataType), _item_schema(items))
    asked = staged(asked, "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // size))
    block = F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks))
    for number in range(blocks):
        rows = [(row.item_id, [bytes(t) for t in row.terms]) for row in asked.where(block == number).toLocalIterator()]
        if rows:
            yield rows


def _item_schema(items: DataFrame):
    return T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("terms", T.ArrayType(T.BinaryType()))])


def _item_terms(kind):
    def work(batches):
        for batch in batches:
            found = [sorted(terms_of(text)) for text in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    return work


def _indexer(places):
    """Rows of the index from texts; ``places`` is a broadcast of the numbers of the asked terms."""

    def work(batches):
        asked = places.value
        for batch in batches:
            doc, n, terms, tfs, ends = [], [], [], [], [0]
            texts = batch.column("text").cast(pa.binary())
            for row, text in zip(batch.column("doc_id").to_pylist(), texts):
                counts = terms_of(text.as_py())
                if not counts:
                    continue
                held = sorted((asked[t], counts[t]) for t in counts.keys() & asked.keys())
                doc.append(row)
                n.append(counts.total())
                terms += [t for t, _ in held]
                tfs += [f for _, f in held]
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), *lists], schema=_INDEX_ARROW)

    return work


def _measures(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with ``n`` terms; in Python's integers where 64 bits would not hold the product."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // total for x in n], dtype=np.int64)
    return 50 + 50 * n * documents // total


class Best:
    """The k highest scores so far, equal ones by ascending doc_id, a missing doc_id last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.doc, self.missing, self.score = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def floor(self) -> int:
        """What a score must reach at least."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, doc: np.ndarray, missing: np.ndarray, score: np.ndarray) -> None:
        use = score >= self.floor()
        doc, missing, score = (np.concatenate(x) for x in ((self.doc, doc[use]), (self.missing, missing[use]), (self.score, score[use])))
        order = np.lexsort((doc, missing, -score))[: self.k]
        self.doc, self.missing, self.score = doc[order], missing[order], score[order]


class Shard:
    """A share of the index, inverted: postings and impacts by term, documents as numbers from 0."""

    def __init__(self, doc: np.ndarray, missing: np.ndarray, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, total: int) -> None:
        self.doc, self.missing = doc, missing
        impacts = _SCALE * tfs // (1000 * tfs + 20 * _measures(n, documents, total)[owner])
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts = owner[order], impacts[order]
        names, starts = np.unique(terms[order], return_index=True)
        tops = np.maximum.reduceat(self.impacts, starts) if len(starts) else starts
        ends = np.append(starts[1:], len(terms))
        self.postings = {int(t): (int(a), int(b), int(top)) for t, a, b, top in zip(names, starts, ends, tops)}
        self.scores = np.zeros(len(doc), dtype=np.int64)
        self.known = np.zeros(len(doc), dtype=bool)

    def rank(self, query: list[tuple[int, int]], best: Best) -> None:
        """Adds this share's documents to ``best`` for a query of (term, weight), rarest first."""
        here = [(*self.postings[t], w) for t, w in query if t in self.postings]
        left = [0]
        for *_, top, w in reversed(here):
            left.append(left[-1] + w * top)
        left.reverse()  # what the terms from each on can add
        met = np.zeros(0, dtype=np.int64)
        creating = True
        for at, (a, b, _, w) in enumerate(here):
            docs, gain = self.docs[a:b], w * self.impacts[a:b]
            if creating:
                reach = best.floor()
                if len(met) >= best.k:
                    reach = max(reach, int(np.partition(self.scores[met], len(met) - best.k)[len(met) - best.k]))
                creating = left[at] >= reach
            if creating:
                self.scores[docs] += gain
                fresh = docs[~self.known[docs]]
                self.known[fresh] = True
                met = np.concatenate([met, fresh])
            elif len(met) * 16 < b - a:
                place = np.minimum(np.searchsorted(docs, met), b - a - 1)
                hit = docs[place] == met
                self.scores[met[hit]] += gain[place[hit]]
            else:
                hit = self.known[docs]
                self.scores[docs[hit]] += gain[hit]
        best.add(self.doc[met], self.missing[met], self.scores[met])
        self.scores[met], self.known[met] = 0, False


def _searcher(queries, k: int, documents: int, total: int):
    """Ranks the documents of a task for all queries of a block, a bounded number of documents and postings at a time."""

    def work(batches):
        asked = queries.value
        best = [Best(k) for _ in asked]
        held: list[tuple[np.ndarray, ...]] = []
        size = postings = 0

        def search():
            doc, missing, n, counts, terms, tfs = (np.concatenate(x) for x in zip(*held))
            shard = Shard(doc, missing, n, np.repeat(np.arange(len(doc)), counts), terms, tfs, documents, total)
            for query, found in zip(asked, best):
                shard.rank(query, found)

        for batch in batches:
            ids, lists, tfs = batch.column("doc_id"), batch.column("terms"), batch.column("tfs")
            held.append((
                ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                ids.is_null().to_numpy(zero_copy_only=False),
                batch.column("n").to_numpy(),
                np.diff(lists.offsets.to_numpy()),
                lists.flatten().to_numpy().astype(np.int64),
                tfs.flatten().to_numpy(),
            ))
            size, postings = size + len(batch), postings + len(held[-1][4])
            if size >= DOCS or postings >= POSTINGS:
                search()
                held, size, postings = [], 0, 0
        if held:
            search()
        task = TaskContext.get().partitionId() % _MERGES
        for query, found in enumerate(best):
            if len(found.doc):
                count = len(found.doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(count, query, np.int32)), pa.array(found.doc, mask=found.missing), pa.array(found.score), pa.array(np.full(count, task, np.int32))],
                    schema=_RANKED_ARROW,
                )

    return work


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring rows of ``docs`` (``doc_id``, ``text``) for each row of ``items`` (``item_id``, ``text``).

    Only scores above 0 count; equal ones go by ascending doc_id, a null doc_id last. A null or empty text has no terms: such a
    document is found by nothing and not counted, such an item finds nothing. Repeated rows are documents, and items,
    of their own; rows that share an item_id are ranked apart. Long texts are split into terms a
    slice at a time, and a term may be of any length. Empty tables give an empty table; further columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = items.schema["item_id"].dataType
    parts = []
    for block in _blocks(items, block_terms):
        names = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        index = staged(slim.mapInArrow(_indexer(spark.sparkContext.broadcast(names)), _INDEX), "index")
        documents, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = index.select(F.explode("terms").alias("term")).groupBy("term").count()
        held = {row[0]: row[1] for row in holding.toLocalIterator()}
        weights = {t: weight(documents, n) for t, n in held.items()}
        queries = [sorted(((names[t], weights[names[t]]) for t in terms if names[t] in held), key=lambda x: (held[x[0]], x[0])) for _, terms in block]
        found = index.mapInArrow(_searcher(spark.sparkContext.broadcast(queries), k, documents, total), _RANKED)
        merged = _first(_first(found, ["query", "task"], k).drop("rank"), ["query"], k)
        numbers = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], _named(kind))
        parts.append(merged.join(F.broadcast(numbers), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], _result(kind))
    return reduce(DataFrame.unionByName, parts)


def _named(kind):
    return T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", kind)])


def _result(kind):
    return T.StructType([T.StructField("item_id", kind), *(T.StructField(n, t) for n, t in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())))])
