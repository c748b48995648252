"""Phrases of words that stand together more often than their parts, mined from counts of word sequences.

Sequences are counted level by level, as a sequence is never more frequent than what it consists of: first words, then pairs of
words that reach the least count, then longer sequences all of whose pairs reach it. Each task counts in a HAT-trie of bounded size
and passes subtrees on as sorted runs; runs are merged per prefix, the first two words, which splits a frequent
first word over many partitions. What reached the least count on one level is known to the next as a filter of
bounded size, which only saves work: every count is compared with the bound itself after merging.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procurelake.llm import hattrie, sieve
from procurelake.session import staged

LEAST = 30
MOST = 4
TOP = 2000
SHARE = 80
SCALE = 2_000_000
SLICE = 1 << 22
NO_LANG = "und"
_SALTS = 16
_BREAK = b"."
#: A row of a run: the first word or two, by which runs are merged, and the words after them.
_RUN = "lang string, prefix string, rest string, n long"
_RUN_ARROW = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("rest", pa.string()), ("n", pa.int64())])

#: Capitals of ASCII as small letters, what parts pieces as a break, the tab as a space.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x2E if chr(c) in ".,;:!?\n\v\f\r" else 0x20 if c == 9 else c for c in range(256))


def _tokens(texts: list[str]) -> Iterator[list[bytes]]:
    """Words of texts and breaks, in slices of bounded size; texts are parted by breaks."""
    data = b"\n".join([text.encode("utf-8", "surrogatepass") for text in texts]).translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
        end = len(data) if end < 0 else end
        yield data[at:end].replace(_BREAK, b" . ").split()
        at = end


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        texts.setdefault(lang, []).append(text)
    yield from texts.items()


def _count_words(limit: int):
    """The root of the trie alone: words by language, passed on as a sorted run when there are ``limit`` of them."""

    def run(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            words = sorted(found)
            for at in range(0, len(words), hattrie.RUN):
                some = words[at : at + hattrie.RUN]
                texts = pa.array(some, pa.binary()).cast(pa.string())
                n = np.fromiter(map(found.__getitem__, some), np.int64, len(some))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(some)), texts, pa.repeat(pa.scalar(""), len(some)), pa.array(n)], schema=_RUN_ARROW)

    def work(batches):
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, texts in _by_lang(batch):
                found = counts.setdefault(lang, Counter())
                for tokens in _tokens(texts):
                    found.update(tokens)
                    found.pop(_BREAK, None)
                    if sum(map(len, counts.values())) >= limit:
                        yield from run(counts)
                        counts.clear()
                        found = counts.setdefault(lang, Counter())
        yield from run(counts)

    return work


class _Words:
    """Ids of the words of a task that the filter lets through, 0 for all others and for breaks."""

    def __init__(self, known: sieve.Sieve) -> None:
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, dict[bytes, int]] = {}
        self.words, self.langs = [b""], [""]
        self.hashes = np.zeros(1, dtype=np.uint64)
        self.size = 0

    def order(self) -> np.ndarray:
        """Place of each word among all in byte order."""
        place = np.empty(len(self.words), dtype=np.int64)
        place[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        return place

    def number(self, tokens: list[bytes], lang: str) -> np.ndarray:
        ids = self.ids.setdefault(lang, {_BREAK: 0})
        fresh = list(set(tokens) - ids.keys())
        if fresh:
            hashes = sieve.word_hashes(fresh, lang)
            kept = self.known.holds(sieve.fold(np.zeros(len(fresh), dtype=np.uint64), hashes))
            for word, use in zip(fresh, kept.tolist()):
                ids[word] = len(self.words) if use else 0
                if use:
                    self.words.append(word)
                    self.langs.append(lang)
            self.hashes = np.concatenate([self.hashes, hashes[kept]])
            self.size += len(fresh)
        return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))


def _count_sequences(sizes: tuple[int, ...], words, pairs, limit: int):
    """Sequences of the given sizes; ``words`` and ``pairs`` are broadcasts of the filters, the latter may be missing."""

    def work(batches):
        known = _Words(words.value)
        tries = {size: hattrie.HatTrie(size) for size in sizes}

        def rows(keep: int) -> Iterator[pa.RecordBatch]:
            if not any(trie.count for trie in tries.values()):
                return
            place = known.order()
            words, langs = pa.array(known.words, pa.binary()).cast(pa.string()), pa.array(known.langs)
            for trie in tries.values():
                for ids, n in trie.spill(keep // len(tries)):
                    order = np.lexsort(place[ids].T[::-1])
                    ids, n = ids[order], n[order]
                    texts = [words.take(pa.array(column)) for column in ids.T]
                    prefix = pc.binary_join_element_wise(*texts[:2], " ")
                    rest = pc.binary_join_element_wise(*texts[2:], " ") if len(texts) > 2 else pa.repeat(pa.scalar(""), len(n))
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(ids[:, 0])), prefix, rest, pa.array(n)], schema=_RUN_ARROW)

        for batch in batches:
            for lang, texts in _by_lang(batch):
                tail: list[bytes] = []
                for tokens in _tokens(texts):
                    ids = known.number([*tail, *tokens], lang)
                    joined = (ids[:-1] > 0) & (ids[1:] > 0)
                    if pairs is not None:
                        at = np.flatnonzero(joined)
                        first = sieve.fold(np.zeros(len(at), dtype=np.uint64), known.hashes[ids[at]])
                        joined[at] = pairs.value.holds(sieve.fold(first, known.hashes[ids[at + 1]]))
                    for size, firsts, others, counts in hattrie.windows(ids, joined, sizes, len(tail)):
                        tries[size].add(firsts, others, counts)
                    tail = [*tail, *tokens][1 - max(sizes) :]
                    if known.size >= hattrie.WORDS:
                        yield from rows(0)
                        known.clear()
                    elif sum(trie.count for trie in tries.values()) >= limit:
                        yield from rows(limit // 2)
        yield from rows(0)

    return work


def _merged(runs: DataFrame) -> DataFrame:
    """``lang, phrase, size, f``: sums of the runs' counts, merged in partitions by prefix."""
    sums = runs.repartition("lang", "prefix").groupBy("lang", "prefix", "rest").agg(F.sum("n").alias("f"))
    alone = F.col("rest") == ""
    phrase = F.when(alone, F.col("prefix")).otherwise(F.concat_ws(" ", "prefix", "rest"))
    words = lambda c: F.size(F.split(c, " "))
    size = F.when(alone, words("prefix")).otherwise(words("rest") + 2)
    return sums.select("lang", phrase.alias("phrase"), size.alias("size"), "f")


def counts(docs: DataFrame, least: int = LEAST, most: int = MOST, limit: int = hattrie.LIMIT) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all sequences of up to ``most`` words that occur ``least`` times, and ``lang, n``, all words counted."""
    context = docs.sparkSession.sparkContext
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(lang.alias("lang"), text.alias("text"))
    words = staged(_merged(rows.mapInArrow(_count_words(limit), _RUN)), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least)
    known = context.broadcast(sieve.build(often))
    table = often
    if most >= 2:
        runs = rows.mapInArrow(_count_sequences((2,), known, None, limit), _RUN)
        pairs = staged(_merged(runs).where(F.col("f") >= least), "pairs")
        table = table.unionByName(pairs)
    if most >= 3:
        joined = context.broadcast(sieve.build(pairs))
        runs = rows.mapInArrow(_count_sequences(tuple(range(3, most + 1)), known, joined, limit), _RUN)
        table = table.unionByName(staged(_merged(runs).where(F.col("f") >= least), "longer"))
    return table, totals


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("w", start, length), " ")


def _long(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(table: DataFrame, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of all phrases of two words and more, by their lowest-scoring cut."""
    phrases = table.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), _part(F.lit(1), F.col("k")).alias("part"), F.col("k").alias("words")),
        F.struct(F.lit(1).alias("side"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part"), (F.col("size") - F.col("k")).alias("words")),
    )
    asked = cuts.select("lang", "phrase", "size", "a", "k", F.explode(sides).alias("s"))
    # single words are asked for by very many phrases, so these rows are dealt out over copies of the word's row
    salt = F.when(F.col("s.words") == 1, F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int")
    asked = asked.select("lang", "phrase", "size", "a", "k", "s.side", "s.part", salt.alias("salt"))
    copies = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    parts = table.where(F.col("size") < most).select("lang", F.col("phrase").alias("part"), "f", F.explode(copies).alias("salt"))
    found = asked.join(parts, ["lang", "part", "salt"])
    sums = [
        F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{name}{k}")
        for k in range(1, most) for side, name in enumerate("lr")
    ]
    gathered = found.groupBy("lang", "phrase", "size", "a").agg(*sums)

    def cut(k: int) -> Column:
        l, r = F.col(f"l{k}"), F.col(f"r{k}")
        score = F.call_function("div", F.lit(scale).cast("decimal(18,0)") * _long(F.col("a")), _long(l) + _long(r)).cast("long")
        return F.when(F.col("size") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))

    lowest = F.array_min(F.array_compact(F.array(*[cut(k) for k in range(1, most)]))).alias("c")
    return gathered.select("lang", "phrase", "size", "a", lowest).select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")


def independent(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """``rows`` without those that stand, word for word, in a longer row of at least ``share`` percent of their count."""
    words = rows.where("size > 2").select("lang", F.col("a").alias("f"), "size", F.split("phrase", " ").alias("w"))
    lengths = words.select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = lengths.select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    covers = inner.groupBy("lang", _part(F.col("i"), F.col("k")).alias("phrase")).agg(F.max("f").alias("cover"))
    kept = (F.col("cover").isNull()) | (_long(F.col("cover")) * 100 < _long(F.col("a")) * share)
    return rows.join(covers, ["lang", "phrase"], "left").where(kept).drop("cover")


def collocations(
    docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, share: int = SHARE, limit: int = hattrie.LIMIT
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases of ``docs`` (``text``, ``lang``).

    A null text is empty and gives nothing; a null lang is ``und``, together with rows that say so. Repeated rows and
    equal texts count as often as they stand there. Texts are read in slices, a sequence across two slices is counted
    once; a word may be of any length. Equal scores go by count, then by phrase in byte order. An empty table, and one
    in which nothing occurs ``least`` times, gives an empty table. Further columns are ignored.
    """
    table, totals = counts(docs, least, most, limit)
    rows = independent(staged(scored(table, most), "scored"), share)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    whole = first.join(totals, "lang")
    return whole.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
