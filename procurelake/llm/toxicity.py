"""Toxicity by class-conditional Kneser-Ney models of expressions.

An expression (a word between blanks, lower-cased) is spelled out letter by letter by models of toxic
and of ordinary text, in two ways. By spelling: each class has its own counts of the spelling so far (up to ``ORDER`` - 1
letters), and what it discounts goes to backoff counts that both classes share, first of the same spelling, then continuation
counts of ``SHARED`` down to 1 letters; what a class has hardly seen is scored by what is common. By runs: each class has its
own counts of ``OWN`` letters, over shared continuation counts of fewer, which finds expressions in new spellings.
A document's figures, for both ways, are its log-likelihood ratios in the mean per expression, in excess of two
margins, and those of its two strongest expressions; a logistic curve turns them into a score.

Counting is a Spark aggregation over all labelled rows of ``COUNT_FOLDS``; the curve is fitted on at most ``FIT_ROWS``
rows of ``FIT_FOLD``, which the counts have not seen. Spellings seen fewer than ``LEAST`` times are left to the backoff.
Counts are kept in tables of ``SLOTS`` hashed n-grams, which bounds what reaches the driver and is
broadcast, whatever the corpus holds: 14 sets of three tables with 2^18 slots.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.session import staged

ORDER, SHARED = 9, 5
OWN = (3, 4, 5)
LEAST = 2
MARGINS = (1.5, 3.0)
DISCOUNT = 0.75
FLOOR = 1e-3  # spread over letters below the lowest order
SLOTS = 1 << 18
FOLDS, COUNT_FOLDS, FIT_FOLD = 5, (1, 2, 3), 4
FIT_ROWS = 20_000
LEAST_FIT = 5
CACHE = 400_000
COUNT_WORDS = 100_000
RATIO_WORDS = 10_000
TASK_WORDS = 250_000
GROUP_WORDS = 100_000
#: Where too few labelled rows are there to fit a curve.
PLAIN_CURVE = (-6.0, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
FIGURES = tuple(f"{name}_{way}" for way in ("spelling", "runs") for name in ("peak", "second", "over_low", "over_high"))
_FEATURES = "doc_id long, text_key long, " + ", ".join(f"{name} double" for name in FIGURES)
_TOP, _BOTH = ORDER, 2  # the spelling so far; counts of both classes together


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def expressions(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with a mark before and after each, place in the word, and the words' starts."""
    points = np.frombuffer("".join(f"\x02{word}\x03" for word in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return points.astype(np.uint64), np.arange(len(points)) - np.repeat(starts, sizes), starts


def _hashes(points: np.ndarray) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each place, by its size; places too near a word's start are not meant."""
    out = [np.zeros(len(points), dtype=np.uint64)]
    for size in range(1, ORDER + 1):
        before = np.concatenate([[np.uint64(0)], out[-1][:-1]])
        out.append(_mixed(before * np.uint64(0x9E3779B97F4A7C15) + points + np.uint64(size)))
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _places(hashes: list[np.ndarray], place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the n-gram of ``size``, its slot and its context's slot. The largest size means the spelling so far."""
    if size < _TOP:
        return hashes[size], _slot(hashes[size]), np.concatenate([[0], _slot(hashes[size - 1])[:-1]])
    length = np.minimum(place + 1, ORDER)
    table = np.stack(hashes)
    at = np.arange(len(place))
    gram, context = table[length, at], table[length - 1, np.maximum(at - 1, 0)]
    return gram, _slot(gram), _slot(context)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words by class; a batch passes them on whenever they fill up, the sums follow in Spark."""

    def rows(toxic: int) -> pd.DataFrame:
        return pd.DataFrame({"word": [*counts[toxic]], "toxic": toxic, "n": [*counts[toxic].values()]})

    for batch in batches:
        counts = Counter(), Counter()
        for text, mark in zip(batch["text"], batch["toxic"]):
            toxic = int(bool(mark))
            counts[toxic].update(expressions(text))
            if len(counts[toxic]) > COUNT_WORDS:
                yield rows(toxic)
                counts[toxic].clear()
        # no words, no rows: an empty column is no text column to Arrow, so a batch of one class alone would fail
        yield from (rows(toxic) for toxic in (0, 1) if counts[toxic])


def _packed(size: int, toxic, gram: np.ndarray, context: np.ndarray, left) -> np.ndarray:
    """One key of a counted n-gram: 4 bits size, 2 bits class, twice 18 bits slots, 16 bits of what stands before it."""
    key = (np.int64(size) << 58) | (np.asarray(toxic, dtype=np.int64) << 56) | (gram << 36) | (context << 18)
    return key | np.asarray(left, dtype=np.int64)


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-grams of distinct words: spellings so far and runs with the words' counts, shared ones with the letter before them."""
    for batch in batches:
        if not len(batch):
            continue
        points, place, starts = _spelled(list(batch["word"]))
        lengths = np.diff(np.append(starts, len(points)))
        times, toxic = np.repeat(batch["n"].to_numpy(), lengths), np.repeat(batch["toxic"].to_numpy(), lengths)
        hashes = _hashes(points)
        before = _mixed(points + np.uint64(7)) & np.uint64(0xFFFF)
        for size in (*range(1, SHARED + 1), _TOP):
            _, gram, context = _places(hashes, place, size)
            use = (place >= 1) & ((place >= size - 1) | (size == _TOP))
            left = 0 if size == _TOP else np.where(place >= size, before[np.maximum(np.arange(len(points)) - size, 0)], 0)
            keys = [_packed(size, _BOTH, gram, context, left)[use]]
            if size == _TOP or size in OWN:
                keys.append(_packed(size, toxic, gram, context, 0)[use])
            for each in keys:
                names, at = np.unique(each, return_inverse=True)
                yield pd.DataFrame({"key": names, "amount": np.bincount(at, weights=times[use]).astype(np.int64)})


def gather(labelled: DataFrame) -> DataFrame:
    """Tables of the models from ``text, toxic``: ``part`` (0 n-grams, 1 contexts), ``size``, ``toxic``, ``slot``, ``total``, ``kinds``."""
    words = labelled.mapInPandas(_count_words, "word string, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))
    words = staged(words, "words")
    # n-grams repeat over tasks, so a task takes many words
    dealt = words.repartition(max(1, -(-words.count() // TASK_WORDS)))
    single = dealt.mapInPandas(_grams, "key long, amount long").groupBy("key").agg(F.sum("amount").alias("amount"))

    def field(shift: int, bits: int) -> Column:
        return F.shiftright("key", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    single = single.select(field(58, 4).alias("size"), field(56, 2).alias("toxic"), field(36, 18).alias("gram"), field(18, 18).alias("context"), "amount")
    top, types = F.col("size") == _TOP, (F.col("size") < _TOP) & (F.col("toxic") == _BOTH)
    amount = F.when(types, F.lit(1)).otherwise(F.col("amount"))
    often = single.where(~top | (F.col("amount") >= LEAST))
    counted = staged(often.groupBy("size", "toxic", "gram", "context").agg(F.sum(amount).alias("v")), "grams")
    grams = counted.groupBy("size", "toxic", F.col("gram").alias("slot")).agg(F.sum("v").alias("total"), F.lit(0).cast("long").alias("kinds"))
    heads = counted.groupBy("size", "toxic", F.col("context").alias("slot")).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("kinds"))
    return grams.select(F.lit(0).alias("part"), "*").unionByName(heads.select(F.lit(1).alias("part"), "*"))


_TABLES = "size int, toxic int, grams binary, totals binary, kinds binary"


def _dense(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The three tables of one size and class as compressed arrays; a group has at most two rows for each slot."""
    arrays = []
    for part, column in ((0, "total"), (1, "total"), (1, "kinds")):
        some, table = rows[rows["part"] == part], np.zeros(SLOTS, dtype=np.float32)
        table[some["slot"]] = some[column]
        arrays.append(zlib.compress(table.tobytes(), 1))
    return pd.DataFrame([(*key, *arrays)], columns=["size", "toxic", "grams", "totals", "kinds"])


class Models:
    """Both models; tables travel compressed and are unpacked where they are used."""

    def __init__(self, tables: DataFrame) -> None:
        """From what ``gather`` gives, packed by tasks and fetched one after the other."""
        packed = tables.groupBy("size", "toxic").applyInPandas(_dense, _TABLES)
        self.packed = {(row.size_, row.toxic): row[2:] for row in packed.withColumnRenamed("size", "size_").toLocalIterator()}
        self.grams: dict[tuple[int, int], np.ndarray] = {}
        self.heads: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def unpack(self) -> Models:
        for key, tables in self.packed.items():
            if key not in self.grams:
                self.grams[key], *heads = (np.frombuffer(zlib.decompress(bytes(table)), dtype=np.float32) for table in tables)
                self.heads[key] = tuple(heads)
        return self

    def _better(self, key, slots, place, lower: np.ndarray) -> np.ndarray:
        """Interpolates counts above ``lower``, where their context is known."""
        if key not in self.heads:
            return lower
        _, gram, context = slots
        total, kinds = self.heads[key][0][context].astype(np.float64), self.heads[key][1][context]
        known = (total > 0) & ((place >= key[0] - 1) | (key[0] == _TOP))
        own = np.maximum(self.grams[key][gram] - DISCOUNT, 0)
        total = np.where(known, total, 1)
        return np.where(known, own / total + DISCOUNT * kinds / total * lower, lower)

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word, by spelling and by runs."""
        points, place, starts = _spelled(words)
        hashes = _hashes(points)
        slots = {size: _places(hashes, place, size) for size in (*range(1, SHARED + 1), _TOP)}
        common = [np.full(len(points), FLOOR)]
        for size in range(1, SHARED + 1):
            common.append(self._better((size, _BOTH), slots[size], place, common[-1]))
        shared = self._better((_TOP, _BOTH), slots[_TOP], place, common[-1])
        spelling, runs = [], []
        for toxic in (0, 1):
            spelling.append(self._better((_TOP, toxic), slots[_TOP], place, shared))
            chance = common[min(OWN) - 1]
            for size in OWN:
                chance = self._better((size, toxic), slots[size], place, chance)
            runs.append(chance)
        each = [np.where(place > 0, np.log(way[1]) - np.log(way[0]), 0.0) for way in (spelling, runs)]
        return np.add.reduceat(np.stack(each, axis=1), starts, axis=0)


def figures_of(ratios: np.ndarray) -> tuple[float, ...]:
    """The figures of a text from its expressions' ratios, one row each; none: all zero."""
    if not len(ratios):
        return (0.0,) * len(FIGURES)
    out = []
    for way in ratios.T:
        two = np.partition(way, max(0, len(way) - 2))[-2:]
        out += [float(two[-1]), float(two[0]) if len(two) > 1 else 0.0, *(float(np.maximum(way - margin, 0).mean()) for margin in MARGINS)]
    return tuple(out)


def _features(models):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.zeros((0, 2))
        tool = models.value.unpack()
        for batch in batches:
            rows = []
            for group in _runs_of(batch.column("text").to_pylist()):
                fresh = list(set().union(*group).difference(known))
                if fresh and len(known) + len(fresh) > CACHE:
                    known, fresh = {}, list(set().union(*group))
                first = len(known)
                if first + len(fresh) > len(table):
                    table = np.concatenate([table[:first], np.zeros((max(first, len(fresh), 4096), 2))])
                for at in range(0, len(fresh), RATIO_WORDS):
                    part = fresh[at : at + RATIO_WORDS]
                    table[first + at : first + at + len(part)] = tool.ratios(part)
                if fresh:
                    known.update(zip(fresh, range(first, first + len(fresh))))
                rows += [figures_of(table[[*map(known.__getitem__, words)]]) for words in group]
            figures = np.array(rows, dtype=np.float64).reshape(-1, len(FIGURES))
            columns = [batch.column("doc_id"), batch.column("text_key"), *map(pa.array, np.ascontiguousarray(figures.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", *FIGURES])

    return work


def _runs_of(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """Expressions of texts in runs of about ``GROUP_WORDS``; a longer text is a run of its own."""
    group: list[list[str]] = []
    size = 0
    for text in texts:
        words = expressions(text)
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _fit(rows: pd.DataFrame) -> tuple[float, ...]:
    """Intercept and weights of the figures by Newton steps with a small ridge, on figures of unit spread."""
    y = rows["toxic"].to_numpy(dtype=np.float64)
    if min(y.sum(), len(y) - y.sum()) < LEAST_FIT:
        return PLAIN_CURVE
    spread = rows[[*FIGURES]].std().replace(0, 1).fillna(1).to_numpy()
    x = np.column_stack([np.ones(len(y)), rows[[*FIGURES]].to_numpy() / spread])
    weights, ridge = np.zeros(x.shape[1]), np.diag([0.0, *[1.0] * len(FIGURES)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge @ weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(weights)), slope)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, [weights[0], *(weights[1:] / spread)]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (hash of the text), ``held_out``, ``score`` and ``predicted`` of each row of ``docs`` (``doc_id``, ``text``).

    ``labels`` (``doc_id``, ``toxic``) marks some of them; rows whose crc32(doc_id as text) mod 5 is 0 are held out from all
    learning, and only the text makes a score. Null labels are none; of several the largest holds. A null or empty text
    has no expressions and both figures zero, a long one is scored whole; repeated rows score alike; a null doc_id has no label and isn't held out;
    with fewer than ``LEAST_FIT`` rows of a class to fit, a fixed curve stands in; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    taught = slim.where(fold(F.col("doc_id")).isin(*COUNT_FOLDS)).join(marks, "doc_id").select("text", "toxic")
    models = spark.sparkContext.broadcast(Models(staged(gather(taught).coalesce(8), "tables")))
    key = F.xxhash64("text").alias("text_key")
    figures = staged(slim.select("doc_id", key, "text").mapInArrow(_features(models), _FEATURES), "figures")
    sample = figures.where(fold(F.col("doc_id")) == FIT_FOLD).join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(FIT_ROWS)
    base, *weights = _fit(sample.select(*FIGURES, "toxic").toPandas())
    line = F.lit(base)
    for name, weight in zip(FIGURES, weights):
        line = line + F.lit(weight) * F.col(name)
    value = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return figures.select("doc_id", "text_key", held.alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that ``score`` predicts to be toxic; equal rows share their fate."""
    rejected = score(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_key"))
    return docs.join(rejected, same, "left_anti")
