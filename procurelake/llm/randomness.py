"""Secrets in texts: known shapes by pattern, unknown ones by a battery of randomness tests.

Known shapes are assignments to names such as ``token``, access keys and long hexadecimal runs. Beyond them every run of ``LENGTH`` or
more token characters outside those spans is a candidate. Its encoding is the smallest alphabet that has all its characters. Three
tests ask whether it could be drawn at random from that alphabet: chi-squared for uniform use of the alphabet, runs above and below the
alphabet's middle, and serial correlation of neighbours. A candidate that fails one (p below ``ALPHA`` over the number of tests)
is no secret.

A short candidate passes such tests easily, hence the second question: how likely is a text-like string of this length and
encoding to use its alphabet so evenly? Text-like means letters drawn with the shares they have in all documents. Chi-squared grows
with the number of equal pairs of characters, whose mean and variance under those shares are known for each length, so
the question has a p-value. Over all candidates these p-values go through the Benjamini-Hochberg procedure, weighted by the
chance of its length and encoding to be found at all, so that the share of false discoveries stays below ``FALSE`` and lengths at
which nothing can be told take nothing from the others. p-values are rounded up to steps of 1/100 in their decimal logarithm,
so the procedure needs counts of a bounded number of steps, not the sorted values.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.session import staged

LENGTH = 20
ALPHA = 0.001
FALSE = 0.01
#: Lengths from here on count as one for weights; all of them are told with near certainty.
LONGEST = 160
_STEPS = 100  # of a decimal logarithm
_LEAST_LOG = 300

KINDS = ("assign", "access", "hex", "random")
# Patterns and least lengths of the known shapes.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
_NAMES = ("passw", "secret", "token", "key")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, from the smallest alphabet to the largest.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "upper hex": _DIGITS + "ABCDEF",
    "small letters": _SMALL,
    "large letters": _LARGE,
    "base32": _LARGE + "234567",
    "small base36": _DIGITS + _SMALL,
    "large base36": _DIGITS + _LARGE,
    "letters": _LARGE + _SMALL,
    "base62": _LARGE + _SMALL + _DIGITS,
    "base64": _LARGE + _SMALL + _DIGITS + "+/",
    "base64url": _LARGE + _SMALL + _DIGITS + "-_",
    "any": _LARGE + _SMALL + _DIGITS + "+/-_",
}
ENCODINGS = list(ALPHABETS)
_SETS = [frozenset(chars) for chars in ALPHABETS.values()]
_PLACES = []
for _chars in ALPHABETS.values():
    _place = np.zeros(128, dtype=np.int64)
    _place[[ord(c) for c in _chars]] = np.arange(len(_chars))
    _PLACES.append(_place)

_FOUND = "doc_id long, base array<struct<kind:int,start:long,end:long>>, candidates array<struct<start:long,end:long,encoding:int,size:long,pairs:long>>, shares array<long>"


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Known shapes as (kind, start, end), in order, and candidate runs that touch none of them as (start, end)."""
    base, runs = [], [m.span() for m in _RUN.finditer(text)]
    low = text.lower()
    if any(name in low for name in _NAMES):
        base += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    # both other shapes lie within runs, as their characters are token characters and they are at least as long
    for start, end in runs:
        base += [(1, *m.span()) for m in ACCESS.finditer(text, start, end) if m.end() - m.start() >= ACCESS_CHARS]
        base += [(2, *m.span()) for m in HEX.finditer(text, start, end)]
    base.sort(key=lambda x: (x[1], x[0], x[2]))
    free, at, reached = [], 0, 0
    for start, end in runs:
        while at < len(base) and base[at][1] < end:
            reached = max(reached, base[at][2])
            at += 1
        if reached <= start:
            free.append((start, end))
    return base, free


def encoding_of(run: str) -> int:
    used = frozenset(run)
    return next(i for i, chars in enumerate(_SETS) if used <= chars)


def _tail(z: float) -> float:
    """Chance of a normal value above ``z``."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def equal_pairs(counts: np.ndarray) -> int:
    return int((counts * (counts - 1) // 2).sum())


def battery(places: np.ndarray, letters: int) -> tuple[float, float, float]:
    """p-values of the chi-squared, runs and serial-correlation tests of symbols drawn evenly from ``letters``."""
    n = len(places)
    counts = np.bincount(places, minlength=letters)
    chi, free = float((counts.astype(float) ** 2).sum()) * letters / n - n, letters - 1
    even = _tail(((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    upper = places >= letters // 2
    above, below = int(upper.sum()), n - int(upper.sum())
    if above and below:
        runs = 1 + int((upper[1:] != upper[:-1]).sum())
        mean = 1 + 2 * above * below / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        turning = 2 * _tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        turning = 2 * 0.5**n
    centred = places - places.mean()
    power = float((centred**2).sum())
    related = 2 * _tail(abs(float((centred[1:] * centred[:-1]).sum()) / power) * math.sqrt(n)) if power > 0 else 0.0
    return even, turning, related


def looks_random(places: np.ndarray, letters: int, alpha: float = ALPHA) -> bool:
    return min(battery(places, letters)) * 3 >= alpha


def _moments(n: int, shares: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of the number of equal pairs among ``n`` symbols with these shares."""
    two, three = float((shares**2).sum()), float((shares**3).sum())
    pairs = n * (n - 1) / 2
    return pairs * two, math.sqrt(max(pairs * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two), 1e-9))


def ordinary(pairs: int, n: int, shares: np.ndarray) -> float:
    """Chance of at most so many equal pairs in a text-like string."""
    mean, deviation = _moments(n, shares)
    return _tail((mean - pairs - 0.5) / deviation)


def power(n: int, shares: np.ndarray) -> float:
    """Chance that a string drawn evenly has fewer equal pairs than all but one in a thousand of the text-like ones."""
    letters = len(shares)
    mean, deviation = _moments(n, shares)
    own, spread = _moments(n, np.full(letters, 1 / letters))
    bound = mean - 3.09 * deviation  # that point of a normal value
    return _tail((own - bound) / spread)


def alphabet_shares(counts: np.ndarray) -> list[np.ndarray]:
    """Shares of the symbols of each encoding among all characters of its alphabet; none seen: even shares.

    Where an alphabet has letters of one case only, the other case counts as well: text in capitals is text.
    """
    found = []
    for chars in ALPHABETS.values():
        own = counts[[ord(c) for c in chars]].astype(float)
        own += [counts[ord(c.swapcase())] if c.swapcase() not in chars else 0 for c in chars]
        found.append(own / own.sum() if own.sum() else np.full(len(chars), 1 / len(chars)))
    return found


class Rule:
    """Weights by encoding and length, from the numbers of candidates, and the step up to which they are secrets."""

    def __init__(self, counts: np.ndarray, cells: dict[tuple[int, int], int]) -> None:
        self.shares = alphabet_shares(counts)
        raw = {(e, n): power(n, self.shares[e]) for e, n in cells}
        total = sum(cells.values())
        mean = sum(raw[c] * n for c, n in cells.items()) / total if total else 0.0
        self.weights = {c: w / mean if mean > 0 else 1.0 for c, w in raw.items()}
        self.total, self.bound = total, -1

    def step(self, encoding: int, size: int, pairs: int) -> int:
        """Weighted p-value in steps of its logarithm: the higher, the less text-like; -1 where nothing can be told."""
        w = self.weights[encoding, min(size, LONGEST)]
        p = ordinary(pairs, size, self.shares[encoding])
        if w <= 0 or p > w:
            return -1
        return min(_LEAST_LOG * _STEPS, math.floor(-math.log10(max(p / w, 10.0**-_LEAST_LOG)) * _STEPS))

    def close(self, steps: dict[int, int], false: float = FALSE) -> Rule:
        """Benjamini-Hochberg over the numbers of candidates by step: the lowest step that holds the share of false discoveries."""
        beyond, self.bound = 0, _LEAST_LOG * _STEPS + 1
        for step in sorted((s for s in steps if s >= 0), reverse=True):
            beyond += steps[step]
            if 10.0 ** (-step / _STEPS) * self.total <= false * beyond:
                self.bound = step
        return self

    def secret(self, encoding: int, size: int, pairs: int) -> bool:
        return self.step(encoding, size, pairs) >= self.bound


def _finder(alpha: float):
    """Known shapes and candidates that pass the battery, by document; the last row of a batch has its counts of characters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen = [], np.zeros(256, dtype=np.int64)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                seen += np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
                base, free = spans(text)
                candidates = []
                for start, end in free:
                    run = text[start:end]
                    encoding = encoding_of(run)
                    letters = len(_SETS[encoding])
                    places = _PLACES[encoding][np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
                    pairs = equal_pairs(np.bincount(places, minlength=letters))
                    random = looks_random(places, letters, alpha)
                    candidates.append({"start": start, "end": end, "encoding": encoding if random else -1 - encoding, "size": end - start, "pairs": pairs})
                rows.append({"doc_id": doc, "base": [dict(zip(("kind", "start", "end"), b)) for b in base], "candidates": candidates, "shares": None})
            rows.append({"doc_id": None, "base": None, "candidates": None, "shares": seen[:128].tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)

    return work


_FOUND_ARROW = pa.schema([
    ("doc_id", pa.int64()),
    ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
    ("candidates", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("size", pa.int64()), ("pairs", pa.int64())]))),
    ("shares", pa.list_(pa.int64())),
])


def _stepper(rule):
    def work(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("encoding", "size", "pairs")]
            yield pa.RecordBatch.from_arrays([pa.array([rule.value.step(*row) for row in zip(*columns)], pa.int32())], names=["step"])

    return work


def _writer(rule):
    """All spans of each document."""

    def work(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                found = [(b["kind"], b["start"], b["end"]) for b in row["base"]]
                found += [(3, c["start"], c["end"]) for c in row["candidates"] if c["encoding"] >= 0 and rule.value.secret(c["encoding"], c["size"], c["pairs"])]
                found.sort(key=lambda x: (x[1], x[0], x[2]))
                rows.append({"doc_id": row["doc_id"], "spans": [dict(zip(("kind", "start", "end"), f)) for f in found]})
            yield pa.RecordBatch.from_pylist(rows, schema=_SPANS_ARROW)

    return work


_SPANS = "doc_id long, spans array<struct<kind:int,start:long,end:long>>"
_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("spans", _FOUND_ARROW.field("base").type)])


def scan(docs: DataFrame, alpha: float = ALPHA, false: float = FALSE) -> DataFrame:
    """``doc_id, spans`` of each row of ``docs`` (``doc_id``, ``text``): kind (a place in ``KINDS``), start and end in code points.

    A null or empty text has no spans. Repeated rows and equal texts are searched each for itself, and their candidates
    count as often; a null doc_id keeps its row. Texts of any length are searched whole; a run of characters may be
    of any length. With no candidate, or none that can be told from text, only known shapes are returned. An
    empty table gives an empty table; further columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = staged(slim.mapInArrow(_finder(alpha), _FOUND), "secrets")
    shares = found.where("shares IS NOT NULL").select(F.posexplode("shares").alias("c", "n")).groupBy("c").agg(F.sum("n"))
    counts = np.zeros(128, dtype=np.int64)
    for c, n in shares.toLocalIterator():
        counts[c] = n
    rows = found.where("shares IS NULL").select("doc_id", "base", "candidates")
    tested = rows.select(F.explode("candidates").alias("c")).select("c.*")
    encoding = F.when(F.col("encoding") < 0, -1 - F.col("encoding")).otherwise(F.col("encoding"))
    cells = tested.groupBy(encoding.alias("e"), F.least("size", F.lit(LONGEST)).alias("n")).count()
    rule = Rule(counts, {(e, n): number for e, n, number in cells.toLocalIterator()})
    shared = context.broadcast(rule)
    steps = tested.where("encoding >= 0").select("encoding", "size", "pairs").mapInArrow(_stepper(shared), "step int")
    rule.close({step: n for step, n in steps.groupBy("step").count().toLocalIterator()}, false)
    return rows.mapInArrow(_writer(context.broadcast(rule)), _SPANS)


def _joined(spans_: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans_)


def _digest(batches):
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            base = [s for s in row["spans"] if s["kind"] < 3]
            counts = {f"n_{name}": sum(s["kind"] == kind for s in base) for kind, name in enumerate(KINDS[:3])}
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append({"doc_id": row["doc_id"], **counts, "base_sha256": digest, "spans": _joined(row["spans"])})
        yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST_ARROW)


_DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_DIGEST_ARROW = pa.schema([
    ("doc_id", pa.int64()), *((f"n_{name}", pa.int64()) for name in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string()),
])


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` from what ``scan`` gives; spans as ``kind:start:end``, joined by commas."""
    return found.select("doc_id", "spans").mapInArrow(_digest, _DIGEST)
