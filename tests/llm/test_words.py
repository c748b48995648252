"""Secret scans, phrase mining and ranked search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procurelake.llm import collocations, hattrie, randomness, ranked, sieve

# secrets


def plain_base(text):
    found = [(0, *m.span()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


PARTS = ["token", "TOKEN", "toKen", "ſecret", "api_key", "apiKey", "passwd", "password", "=", ": ", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "deadbeefdead", "x", "é", "😀", "\n", "/", "-", "abc.def", "AKIAAKIA", "Zz9"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=20).map("".join))
def test_known_shapes(text):
    base, free = randomness.spans(text)
    assert base == plain_base(text)
    runs = [m.span() for m in re.finditer("[A-Za-z0-9+/_-]+", text) if len(m[0]) >= 20]
    assert free == [(a, b) for a, b in runs if not any(x < b and a < y for _, x, y in base)]


def plain_scan(texts):
    """All spans of all texts, with sorted p-values instead of counted steps."""
    counts = np.zeros(128, dtype=np.int64)
    for text in texts:
        for char in text:
            if ord(char) < 128:
                counts[ord(char)] += 1
    shares = randomness.alphabet_shares(counts)
    tested = []
    for at, text in enumerate(texts):
        for a, b in randomness.spans(text)[1]:
            run = text[a:b]
            encoding = randomness.encoding_of(run)
            alphabet = randomness.ALPHABETS[randomness.ENCODINGS[encoding]]
            places = np.array([alphabet.index(c) for c in run])
            pairs = sum(run[i] == run[j] for i in range(len(run)) for j in range(i))
            w = randomness.power(min(len(run), randomness.LONGEST), shares[encoding])
            good = min(randomness.battery(places, len(alphabet))) * 3 >= randomness.ALPHA
            tested.append([at, a, b, w, randomness.ordinary(pairs, len(run), shares[encoding]), good])
    mean = sum(t[3] for t in tested) / len(tested) if tested else 1
    scaled = []
    for t in tested:
        q = t[4] / (t[3] / mean)
        if t[5] and q <= 1:
            scaled.append((10 ** (-math.floor(-math.log10(max(q, 1e-300)) * 100) / 100), t))
    scaled.sort(key=lambda x: x[0])
    bound = max((q for q, _ in scaled if q * len(tested) <= randomness.FALSE * sum(p <= q for p, _ in scaled)), default=-1)
    found = [plain_base(text) for text in texts]
    for q, (at, a, b, *_) in scaled:
        if q <= bound:
            found[at].append((3, a, b))
    return [sorted(f, key=lambda x: (x[1], x[0], x[2])) for f in found]


def test_secrets(spark):
    rnd = random.Random(8)
    draw = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    some = randomness.ALPHABETS
    texts = [prose(rnd, rnd.randint(0, 300)) for _ in range(80)]
    texts += [f"{prose(rnd, 30)} {draw(some[e], n)} {prose(rnd, 30)}" for e in ("base64", "base62", "base64url", "upper hex") for n in (20, 40, 64, 200)]
    texts += [prose(rnd, 20) + " " + prose(rnd, 12).replace(" ", ""), "ab" * 400, "0123456789" * 9, "-" * 90, some["base62"], "é" * 50 + " token = " + draw(some["hex"], 40)]
    texts += ["", "long " * 100_000 + draw(some["base62"], 60), draw(some["base62"], 300_000)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[90]), (500, None)]
    got = {}
    more = documents(spark, [*rows, *((600 + i, prose(rnd, 60_000)) for i in range(8))])
    for row in randomness.digests(randomness.scan(more)).collect():
        got.setdefault(row.doc_id, []).append(row)
    assert sum(map(len, got.values())) == len(rows) + 8
    want = plain_scan([t or "" for _, t in rows if t is None or len(t) < 200_000])
    small = [r for r in rows if r[1] is None or len(r[1]) < 200_000]
    alone = {r.doc_id: r for r in randomness.digests(randomness.scan(documents(spark, small))).collect()}
    write = lambda spans: ",".join(f"{randomness.KINDS[k]}:{a}:{b}" for k, a, b in spans)
    for (doc, _), spans in zip(small, want):
        assert alone[doc].spans == write(spans)
        base = [s for s in spans if s[0] < 3]
        assert alone[doc].base_sha256 == hashlib.sha256(write(base).encode()).hexdigest()
        assert (alone[doc].n_assign, alone[doc].n_access, alone[doc].n_hex) == tuple(sum(s[0] == k for s in base) for k in range(3))
    planted = [alone[i].spans for i in range(80, 96) if i % 4 != 0]
    assert sum("random" in s for s in planted) >= 11
    assert not any("random" in alone[i].spans for i in [*range(80), 96, 97, 98, 99, 100])
    assert f"random:500000:{500_060}" in got[103][0].spans and got[104][0].spans == "random:0:300000"
    assert randomness.scan(documents(spark, [])).count() == 0
    assert [r.spans for r in randomness.digests(randomness.scan(documents(spark, [(1, "a"), (2, None)]))).collect()] == ["", ""]


# phrases


def plain_phrases(rows, least, top=2000, share=80, most=4):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            score, k = min((scale_of(a, counts[phrase[:k]], counts[phrase[k:]]), k) for k in range(1, len(phrase)))
            inside = any(
                m >= least and 100 * m >= share * a and len(longer) > len(phrase) and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
                for longer, m in counts.items() if m >= least
            )
            if not inside:
                found.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def scale_of(a, left, right):
    return 2_000_000 * a // (left + right)


def text_table(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    return df.select("*", *[F.lit("own").alias(c) for c in ("phrase", "size", "n", "f", "a", "k", "w", "rank", "score", "doc_id", "prefix")])


def phrase_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(120):
        words = [rnd.choice("the of A a in x y zé new york city Red \x00 　k".split(" ")) for _ in range(rnd.randint(0, 80))]
        text = "".join(w + rnd.choice([" ", " ", " ", " ", "  ", "\t", ".", ", ", "\n", "!"]) for w in words)
        rows.append((text, rnd.choice(["en", "en", "fr", None, "und"])))
    return [*rows, (None, "en"), ("", None), *[("new york city of the red", "en")] * 40]


def test_phrases(spark, monkeypatch):
    rows = phrase_rows(1)
    want = plain_phrases(rows, 8)
    assert len(want) > 60
    got = sorted(map(tuple, collocations.collocations(text_table(spark, rows), least=8).collect()))
    assert got == want
    assert sorted(map(tuple, collocations.collocations(text_table(spark, rows), least=8, top=3).collect())) == plain_phrases(rows, 8, top=3)
    assert collocations.collocations(text_table(spark, [])).count() == 0
    assert collocations.collocations(text_table(spark, rows[:2]), least=30_000).count() == 0


def test_phrases_in_small_tables_and_slices(spark):
    """Every run is short: containers burst, subtrees are spilled, dictionaries begin anew, texts are cut."""
    rows = phrase_rows(2)
    texts = [t or "" for t, _ in rows]
    for cut, limit, burst, words in ((7, 10, 2, 5), (64, 200, 8, 12), (1 << 20, 1 << 20, 4096, 1 << 20)):
        old = collocations.SLICE, hattrie.BURST, hattrie.WORDS
        collocations.SLICE, hattrie.BURST, hattrie.WORDS = cut, burst, words
        try:
            total = Counter()
            everything = type("All", (), {"value": type("S", (), {"holds": lambda self, h: np.ones(len(h), dtype=bool)})()})()
            work = collocations._count_sequences((2, 3, 4), everything, None, limit)
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
            for run in work(iter([batch, batch])):
                for lang, prefix, rest, n in zip(*[run.column(c).to_pylist() for c in ("lang", "prefix", "rest", "n")]):
                    assert lang == "en"
                    words_ = f"{prefix} {rest}".strip(" ").split(" ")
                    total[len(words_), " ".join(words_)] += n
            want = Counter()
            for text in texts * 2:
                low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
                for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                    found = re.findall("[^\x20\x09]+", piece)
                    for size in (2, 3, 4):
                        want.update((size, " ".join(found[i : i + size])) for i in range(len(found) - size + 1))
            assert total == want
        finally:
            collocations.SLICE, hattrie.BURST, hattrie.WORDS = old


def test_long_text_phrases(spark):
    text = "one two three four. " * 60_000 + "x" * 300_000
    got = collocations.collocations(text_table(spark, [(text, "en")])).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("one two three four", 60_000, 60_000, 60_000, 240_001, 1_000_000)]


def test_sieve_holds_all(spark):
    rows = [("en" if i % 2 else "fr", f"w{i} x{i}" if i % 3 else f"w{i}") for i in range(5000)]
    made = sieve.build(spark.createDataFrame(rows, "lang string, phrase string"))

    def hashes(lang, phrase):
        h = np.zeros(1, dtype=np.uint64)
        for word in sieve.word_hashes(phrase.encode().split(), lang):
            h = sieve.fold(h, word)
        return h

    assert all(made.holds(hashes(*row))[0] for row in rows)
    assert sum(made.holds(hashes("de", phrase))[0] for _, phrase in rows) < 100
    tight = sieve.build(spark.createDataFrame(rows, "lang string, phrase string"), most=1 << 16)
    assert all(tight.holds(hashes(*row))[0] for row in rows)


# ranked search


def plain_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, Counter(split(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    documents_, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            m = 50 + 50 * c.total() * documents_ // total
            score = sum(math.floor(1000 * math.log((2 * documents_ + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(split(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out += [(item, rank, d, -score) for rank, (score, _, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = [prose(rnd, 1) for _ in range(150)] + ["Été", "漢字", "a1", "😀"]
    words = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choice(vocabulary[: rnd.choice([5, 20, 154])]) for _ in range(n))
    docs = [(i, words(rnd.randint(0, 60))) for i in range(700)]
    docs += [(i, "same Text twice text") for i in range(900, 990)] + [(5, docs[5][1])] * 2 + [(None, docs[7][1]), (None, docs[7][1]), (8000, None), (8001, ""), (8002, "word " * 200_000)]
    items = [(i, words(rnd.randint(1, 30))) for i in range(25)] + [(3, "text same"), (3, "text same"), (None, "word"), (40, None), (41, "nowhere")]
    given_items = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit("own")).withColumn("query", F.lit(1))
    table = documents(spark, docs).repartition(3)
    for k in (50, 5):
        got = sorted(map(tuple, ranked.search(table, given_items, k).collect()), key=str)
        assert got == plain_search(docs, items, k)
    # several blocks of items
    assert sorted(map(tuple, ranked.search(table, given_items, 5, block_terms=40).collect()), key=str) == plain_search(docs, items, 5)
    assert ranked.search(documents(spark, []), given_items).count() == 0
    assert ranked.search(table, given_items.limit(0)).count() == 0


def test_accumulators_stop(monkeypatch):
    """Shares of few documents, one after the other: the kth score so far stops new accumulators, no result changes."""
    rnd = random.Random(6)
    names = np.arange(40)
    rows = [sorted(rnd.sample(range(40), rnd.randint(1, 12))) for _ in range(3000)]
    n = np.array([len(r) * 3 for r in rows])
    tfs = [np.array([rnd.randint(1, 3) for _ in r]) for r in rows]
    df = Counter(t for r in rows for t in r)
    weights = {t: ranked.weight(3000, df[t]) for t in names.tolist()}
    query = sorted(((t, weights[t]) for t in rnd.sample(range(40), 15)), key=lambda x: df[x[0]])
    best, made = ranked.Best(10), 0
    for at in range(0, 3000, 250):
        part = slice(at, at + 250)
        shard = ranked.Shard(
            np.arange(at, at + 250), np.zeros(250, bool), n[part], np.repeat(np.arange(250), [len(r) for r in rows[part]]),
            np.concatenate([np.array(r) for r in rows[part]]), np.concatenate(tfs[part]), 3000, int(n.sum()),
        )
        before = ranked.Best.add
        monkeypatch.setattr(ranked.Best, "add", lambda self, doc, *a: (globals().__setitem__("_made", globals().get("_made", 0) + len(doc)), before(self, doc, *a))[1])
        shard.rank(query, best)
        monkeypatch.setattr(ranked.Best, "add", before)
        assert not shard.scores.any() and not shard.known.any()
    made = globals()["_made"]
    scores = []
    for d, r in enumerate(rows):
        m = 50 + 50 * int(n[d]) * 3000 // int(n.sum())
        scores.append((-sum(w * (10**9 * int(tfs[d][r.index(t)]) // (1000 * int(tfs[d][r.index(t)]) + 20 * m)) for t, w in query if t in r), d))
    assert [(-s, d) for s, d in sorted(scores)[:10]] == list(zip(best.score.tolist(), best.doc.tolist()))
    assert made < sum(s < 0 for s, _ in scores)
    assert ranked._measures(np.array([10**6]), 10**14, 10**15)[0] == 50 + 50 * 10**20 // 10**15
