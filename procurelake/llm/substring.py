"""Removal of word windows that an earlier document has already, with FM-indexes over shards.

Equal windows choose the same anchor: the word run of smallest hash among those inside the window. So the
windows of a document fall into contexts, each one anchor with the words around it, and a window can only
recur in a context of the same anchor. Contexts of one anchor meet in one shard; a shard indexes its
distinct contexts, streams them through backward search, and reports the intervals of starts
whose window is as long as asked for and stands in an earlier document. Anchors that stay within one
document, nearly all of them, never reach a shard, and equal contexts are one with their smallest doc_id.
An anchor with more than ``SHARD`` distinct contexts, which would make a shard too large for a task, has its windows
grouped by hash instead, with minima that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.fmindex import FMIndex
from procurelake.session import staged

WINDOW = 50
ANCHOR = 8
SHARD = 32_768
SHARD_WORDS = 400_000
_PLACES = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 22


def words_of(text: str | None) -> list[bytes]:
    """Words between the ASCII blanks 0x20 and 0x09 to 0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class _Runs:
    """Hashes of any run of words, from prefix sums of a polynomial modulo 2^64 over mixed word hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        self.back = _powers(pow(_BASE, -1, 1 << 64), n + 1)
        np.cumsum(_mixed(hashes) * _powers(_BASE, n + 1)[:n], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[last] - self.sums[first]) * self.back[first])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 15), np.uint64(base), dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= _PIECE:
            _POWERS[base] = known
    return known[:n]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    count = len(values) - width + 1
    rows = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def contexts(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor and context hash of each run of starts that share an anchor, the run's first start and number of starts.

    A text of millions of words is taken in pieces that overlap by a window less one word.
    """
    parts = [np.zeros((4, 0), dtype=np.uint64)]
    for begin in range(0, max(1, len(hashes) - window + 1), _PIECE):
        piece = hashes[begin : begin + _PIECE + window - 1]
        if len(piece) < window:
            continue
        runs = _Runs(piece)
        at = np.arange(len(piece) - anchor + 1)
        marks = runs.of(at, at + anchor)
        lowest = _sliding_min((marks & ~_PLACES) | at.astype(np.uint64), window - anchor + 1) & _PLACES
        first = np.flatnonzero(np.concatenate([[True], lowest[1:] != lowest[:-1]]))
        count = np.diff(np.append(first, len(lowest)))
        # the anchor's place is part of what must agree, so it joins the hash
        place = lowest[first].astype(np.int64)
        content = _mixed(runs.of(first, first + count + window - 1) + (place - first).astype(np.uint64))
        parts.append(np.stack([marks[place], content, (first + begin).astype(np.uint64), count.astype(np.uint64)]))
    return tuple(np.concatenate(parts, axis=1))


_OCCURRENCES = "doc_id long, text_key long, anchor long, context long, first long, starts int"


def _occurrences(window: int, anchor: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, texts = (batch.column(name) for name in ("doc_id", "text_key", "text"))
            ids, marks = docs.to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False)
            found, sizes = [np.zeros((4, 0), dtype=np.uint64)], []
            for text in texts:
                part = contexts(word_hashes(words_of(text.as_py())), window, anchor)
                found.append(np.stack(part))
                sizes.append(len(part[0]))
            anchors, content, first, starts = np.concatenate(found, axis=1)
            arrays = [np.repeat(ids, sizes), np.repeat(marks, sizes), anchors.view(np.int64), content.view(np.int64), first.view(np.int64), starts.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["doc_id", "text_key", "anchor", "context", "first", "starts"])

    return work


@F.pandas_udf(T.BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Texts compressed for a shuffle."""
    tool = zstandard.ZstdCompressor(level=1)
    return texts.map(lambda x: tool.compress((x or "").encode("utf-8", "surrogatepass")))


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _cut_out(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Word hashes of the contexts that are asked for, from the texts."""
    for batch in batches:
        rows = []
        for data, wanted in zip(batch["packed"], batch["wanted"]):
            hashes = word_hashes(_unpacked(data).split())
            for item in wanted:
                words = hashes[item["first"] : item["first"] + item["starts"] + window - 1].tobytes()
                rows.append((item["anchor"], item["context"], item["low"], item["high"], words))
        yield pd.DataFrame(rows, columns=["anchor", "context", "low", "high", "words"])


def _search(window: int):
    """Runs of starts whose window stands in an earlier document, for contexts that come sorted by anchor."""

    def shard(rows: list[tuple]) -> pd.DataFrame:
        words = [np.frombuffer(row[4], dtype=np.uint64) for row in rows]
        names, symbols = np.unique(np.concatenate(words), return_inverse=True)
        texts = np.split(symbols, np.cumsum([len(w) for w in words])[:-1])
        index = FMIndex(texts, len(names), window)
        smallest = index.smallest(np.array([row[2] for row in rows], dtype=np.int64))
        out = []
        for (anchor, context, _, high, _), kinds in zip(rows, index.windows(texts)):
            lows = smallest[kinds[: len(kinds) - window + 1]]
            cuts = np.append(np.flatnonzero(np.diff(lows, prepend=lows[0] - 1)), len(lows))
            out += [(anchor, context, a, b - 1, lows[a]) for a, b in zip(cuts, cuts[1:]) if lows[a] < high]
        return pd.DataFrame(out, columns=["anchor", "context", "start", "end", "low"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch[["anchor", "context", "low", "high", "words"]].itertuples(index=False, name=None):
                if size > SHARD_WORDS and row[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4]) // 8
        if rows:
            yield shard(rows)

    return work


def _by_window(cut: DataFrame, window: int) -> DataFrame:
    """The same runs for anchors of many contexts: smallest doc_id by the windows' hashes."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for anchor, context, low, high, words in batch[["anchor", "context", "low", "high", "words"]].itertuples(index=False, name=None):
                codes = np.frombuffer(words, dtype=np.uint64)
                at = np.arange(len(codes) - window + 1)
                one, two = _Runs(codes).of(at, at + window), _Runs(_mixed(codes + np.uint64(1))).of(at, at + window)
                yield pd.DataFrame({"anchor": anchor, "context": context, "low": low, "high": high, "start": at, "one": one.view(np.int64), "two": two.view(np.int64)})

    rows = cut.mapInPandas(hashes, "anchor long, context long, low long, high long, start long, one long, two long")
    lows = rows.groupBy("one", "two").agg(F.min("low").alias("least"))
    return rows.join(lows, ["one", "two"]).where("least < high").select("anchor", "context", "start", F.col("start").alias("end"), F.col("least").alias("low"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """``doc_id, text_key, start, end``: runs of words covered by windows that a smaller doc_id has too.

    ``docs`` holds ``doc_id``, ``text`` and ``text_key``, which tells texts of one doc_id apart. Runs may overlap.
    """
    anchor = min(anchor, window)
    slim = docs.where("doc_id IS NOT NULL").select("doc_id", "text_key", "text")
    found = staged(slim.mapInArrow(_occurrences(window, anchor), _OCCURRENCES), "contexts")
    place = F.struct("doc_id", "text_key", "first", "starts")
    # both levels combine before their shuffle, so an anchor that stands in every line stays small
    distinct = found.groupBy("anchor", "context").agg(F.min(place).alias("at"), F.max("doc_id").alias("high"))
    shared = distinct.groupBy("anchor").agg(F.min("at.doc_id").alias("a"), F.max("high").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    chosen = staged(distinct.join(shared.select("anchor", "n"), "anchor"), "chosen")

    low = F.col("at.doc_id").alias("low")
    alike = chosen.where("n = 1").select("anchor", "context", F.lit(0).cast("long").alias("start"), (F.col("at.starts") - 1).cast("long").alias("end"), low)
    asked = chosen.where("n > 1").select(
        F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key"),
        F.struct("anchor", "context", low, "high", F.col("at.first").alias("first"), F.col("at.starts").alias("starts"), "n").alias("item"),
    )
    # a document asks for its own contexts only, so a list is bounded by its text
    wanted = asked.groupBy("doc_id", "text_key").agg(F.collect_list("item").alias("wanted"))
    texts = slim.select("doc_id", "text_key", packed("text").alias("packed")).dropDuplicates(["doc_id", "text_key"])
    with_text = texts.join(wanted, ["doc_id", "text_key"])

    def cut(condition: str) -> DataFrame:
        picked = with_text.withColumn("wanted", F.expr(f"filter(wanted, x -> {condition})")).where("size(wanted) > 0")
        return picked.select("packed", "wanted").mapInPandas(lambda batches: _cut_out(batches, window), "anchor long, context long, low long, high long, words binary")

    dealt_cut = cut(f"x.n <= {shard}").repartition("anchor").sortWithinPartitions("anchor")
    searched = dealt_cut.mapInPandas(_search(window), "anchor long, context long, start long, end long, low long")
    runs = alike.unionByName(searched)
    if not chosen.where(F.col("n") > shard).isEmpty():
        runs = runs.unionByName(_by_window(cut(f"x.n > {shard}"), window))
    runs = staged(runs, "runs")
    return (
        found.join(runs, ["anchor", "context"])
        .where("low < doc_id")
        .select("doc_id", "text_key", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end") + window).alias("end"))
    )


def _kept(batches: Iterator[pd.DataFrame], carry: list[str], verbatim: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for data, covered in zip(batch["packed"], batch["covered"]):
            text = _unpacked(data)
            words = text.split()
            count = len(words)
            if covered is not None and len(covered):
                edge = np.zeros(count + 1, dtype=np.int32)
                for run in covered:
                    edge[run["start"]] += 1
                    edge[run["end"]] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:count]) == 0)]
            kept = text if verbatim and len(words) == count else b" ".join(words)
            rows.append((count, count - len(words), kept.decode("utf-8", "surrogatepass")))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
        yield pd.concat([batch[["doc_id", *carry]].reset_index(drop=True), out], axis=1)


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = (), anchor: int = ANCHOR, shard: int = SHARD, verbatim: bool = False) -> DataFrame:
    """``doc_id``, the columns of ``carry``, ``n_words``, ``n_removed`` and ``kept`` of each row of ``docs`` (``doc_id``, ``text``).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. ``kept`` has the other words with one space between, or the
    text as it is where nothing goes and ``verbatim`` is set. Rows with equal doc_id are the same
    document and never remove each other's words; a null doc_id is neither smaller nor larger, so its row is kept
    whole; a null text has no words; a text shorter than a window stays. An empty table gives an empty
    table; columns that are not carried are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    names = [f"_c{i}" for i in range(len(carry))]
    runs = repeated_windows(keyed, window, anchor, shard)
    # the runs of a text are bounded by its own windows
    covered = runs.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("covered"))
    texts = keyed.select("doc_id", "text_key", packed("text").alias("packed"), *names)
    joined = texts.join(covered, ["doc_id", "text_key"], "left").select("doc_id", *names, "packed", "covered")
    fields = [T.StructField("doc_id", T.LongType()), *[keyed.schema[c] for c in names]]
    fields += [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    out = joined.mapInPandas(lambda batches: _kept(batches, names, verbatim), T.StructType(fields))
    return out.select("doc_id", *[F.col(n).alias(c) for n, c in zip(names, carry)], "n_words", "n_removed", "kept")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
