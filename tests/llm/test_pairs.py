"""SimHash, substring, vector and benchmark operators against plain versions."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procurelake.llm import caps, components, decontaminate, minhash, simcopies, simhash, substring
from procurelake.llm.fmindex import FMIndex

LONG = " ".join(f"w{i}" for i in range(60_000))


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    links += [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(70)]
    forest = Forest()
    for a, b in links:
        if a is not None and b is not None:
            forest.join(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: forest.find(x) for x in list(forest.up)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 2**64 - 1), st.integers(0, 3))
def test_bk_tree_finds_all_within_radius(values, probe, radius):
    tree = simhash.BKTree()
    values += [probe ^ (1 << 5), probe ^ 3, probe]
    for value in values:
        tree.add(value)
    assert sorted(tree.within(probe, radius)) == sorted({v for v in values if (v ^ probe).bit_count() <= radius})


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("shard", [4096, 3])
def test_simhash_groups(spark, shard):
    rnd = random.Random(7)
    base = [prose(rnd, 120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 3].replace("ba", "be", 1) + f" x{i % 5}") for i in range(40)]
    rows += [(200, ""), (201, None), (202, " \n"), (203, "É à  Ａ"), (204, "one two"), (3, base[3]), (None, base[0]), (205, LONG), (206, "A B\x0bC\x1cD e")]
    got = simhash.near_copies(documents(spark, rows), shard=shard).collect()
    marks = [plain_fingerprint(t) for _, t in rows if t is not LONG]
    assert sorted(f"{m:016x}" for m in marks) == sorted(r.fingerprint for r in got if r.doc_id != 205)
    by = defaultdict(set)
    for r in got:
        by[int(r.fingerprint, 16)].add(r.doc_id)
    forest = Forest()
    for a in by:
        for b in by:
            if (a ^ b).bit_count() <= 2:
                forest.join(a, b)
    low = defaultdict(set)
    for mark, ids in by.items():
        low[forest.find(mark)] |= {i for i in ids if i is not None}
    assert all(r.component_id == min(low[forest.find(int(r.fingerprint, 16))]) for r in got)
    kept = simhash.keep_one(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(ids) for ids in low.values())
    assert simhash.near_copies(documents(spark, [])).count() == 0


def test_near_copies_of_the_pipeline_against_all_pairs(spark):
    rnd = random.Random(17)
    rows = [(i, prose(rnd, rnd.randint(40, 300))) for i in range(60)]
    for i in range(60):
        for edits in (1, 2, 3, 5):
            words = rows[i][1].split()
            for at in rnd.sample(range(len(words)), edits):
                words[at] = prose(rnd, 1)
            rows.append((100 * (i + 1) + edits, " ".join(words)))
    rows += [(9000, ""), (9001, None), (9002, "one two"), (9003, "ONE two"), (9004, "one two three"), (3, rows[3][1]), (None, rows[4][1])]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    forest, linked = Forest(), 0
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                forest.join(a, b)
                linked += x != y
    low = defaultdict(list)
    for at, (i, _) in enumerate(rows):
        if i is not None:
            low[forest.find(at)].append(i)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(map(min, low.values()))
    assert linked > 100 and len(want) < 220
    for kept in (corpus_pipeline.drop_near_copies(spark, docs, ""), minhash.keep_one(docs, tile=2)):
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert minhash.keep_one(docs.limit(0)).count() == 0


@settings(max_examples=60)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=6), st.lists(st.integers(-1, 2), max_size=25), st.integers(2, 7))
def test_fm_index_windows(texts, query, window):
    arrays = [np.array(t, dtype=np.int64) for t in texts]
    index = FMIndex(arrays, 3, window)
    smallest = index.smallest(np.arange(len(texts)) + 10)
    want = {}
    for number, text in enumerate(texts):
        for s in range(len(text) - window + 1):
            want.setdefault(tuple(text[s : s + window]), number + 10)
    for text, kinds in zip([*texts, query], index.windows([*arrays, np.array(query, dtype=np.int64)])):
        for s in range(len(text)):
            expected = want.get(tuple(text[s : s + window])) if s + window <= len(text) else None
            assert expected == (smallest[kinds[s]] if kinds[s] >= 0 else None)


def plain_repeats(rows, window):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    low = {}
    for d, words in split:
        if d is not None:
            for s in range(len(words) - window + 1):
                key = tuple(words[s : s + window])
                low[key] = min(low.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        for s in range(len(words) - window + 1):
            if d is not None and low[tuple(words[s : s + window])] < d:
                gone.update(range(s, s + window))
        out.append((d, len(words), len(gone), " ".join(w.decode() for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [32_768, 2])
def test_repeated_windows_go(spark, shard):
    rnd = random.Random(2)
    passages = [prose(rnd, n) for n in (14, 30, 80)]
    rows = []
    for i in range(60):
        parts = [prose(rnd, rnd.randint(0, 30)), rnd.choice(passages), prose(rnd, rnd.randint(0, 12)), rnd.choice(passages)]
        rows.append((i // 2 * 3 if i % 7 else i, "  ".join(parts[: rnd.randint(1, 4)])))
    loop = "a b c " * 40
    rows += [(500, loop), (501, loop + "d"), (502, None), (503, ""), (None, passages[2]), (504, passages[2]), (504, passages[2]), (505, "é x " * 30), (506, "é x " * 30)]
    rows += [(507, LONG), (508, "x y " + LONG)]
    window = 10
    got = substring.remove_repeats(documents(spark, rows), window=window, carry=("lang",), shard=shard)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()], key=str) == plain_repeats(rows, window)
    assert set(got.columns) == {"doc_id", "lang", "n_words", "n_removed", "kept"}
    assert substring.remove_repeats(documents(spark, [])).count() == 0


def test_contexts_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    covered = lambda found: sorted(s for first, count in zip(*map(lambda x: x.astype(int), found[2:])) for s in range(first, first + count))
    monkeypatch.setattr(substring, "_PIECE", 700)
    assert covered(substring.contexts(hashes, 50, 8)) == list(range(5000 - 49))


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 48))
    vectors = [c + rng.standard_normal(48) * s for c in centres for s in (0.05, 0.2, 0.3, 0.35)]
    rows = [(i, [float(x) for x in v], i % 3 if i % 40 else None) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[1][1], 1) for i in range(30)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 48, 1), (2003, [float("nan")] + [1.0] * 47, 1), (2004, [None] + [1.0] * 47, 1)]
    rows += [(2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [1.0], 1), (2008, [float("inf")] * 48, 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("own")).withColumn("links", F.lit(1))
    sound = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    for tile in (1024, 4):
        got = {r.vec_id: r for r in caps.near_vectors(df, tile=tile).collect()}
        assert len(got) == len(rows)
        total = found = 0
        forest = Forest()
        for i, v, lab in sound:
            links = [j for j, w, other in sound if other == lab and len(w) == len(v) and (j != i) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
            assert got[i].n_links <= len(links)
            total, found = total + len(links), found + got[i].n_links
            for j in links:
                if None not in (i, j):
                    forest.join(i, j)
        assert found >= 0.95 * total and total > 900
        same = sum(got[i].component_id == forest.find(i) for i, _, _ in sound if i is not None)
        assert same >= 0.95 * len(sound)
        assert all(got[i].n_links == 0 and got[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2007, 2008))
        assert got[2006].component_id == 2005
    assert caps.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("codes", [32, 448, 3163])
def test_near_vectors_share_filters_at_any_number_of_codes(codes):
    rng = np.random.default_rng(99)
    u, w = rng.standard_normal((2, 300, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= np.sum(u * w, axis=1, keepdims=True) * u
    v = 0.931 * u + np.sqrt(1 - 0.931**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    a, b = (caps.filters_of(x, codes, caps.FILTERS) for x in (u, v))
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b)]) >= 0.97
    assert np.mean([len(x) for x in a]) >= caps.FILTERS


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_against_plain_alignment(spark):
    rnd = random.Random(9)
    items = [(i, prose(rnd, 14)) for i in range(6)] + [(6, None), (7, "short"), (0, prose(rnd, 14))]
    items[8] = (0, items[0][1])
    rows = []
    for i in range(40):
        text = list(rnd.choice(items[:6])[1].upper())
        for _ in range(rnd.randint(0, 9)):
            text[rnd.randrange(len(text))] = rnd.choice(["", "q", "zz"])
        rows.append((i, prose(rnd, rnd.randint(0, 20)) + "\n " + "".join(text) + " " + prose(rnd, rnd.randint(0, 9))))
    rows += [(50, None), (51, ""), (52, items[1][1] + " " + items[2][1]), (52, items[1][1]), (None, items[3][1]), (53, LONG + " " + items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("start", F.lit("own"))
    want = sorted(
        (str(d), k, e) for d, t in rows for k, item in items[:6]
        if (e := distance(decontaminate.normal(item), decontaminate.normal(t)[-4000:])) <= len(decontaminate.normal(item)) // 10
    )
    docs = documents(spark, rows)
    for limit in (4_000_000, 100):
        got = decontaminate.leaks(docs, bench, q=5, limit=limit)
        assert sorted((str(r.doc_id), r.item_id, r.edits) for r in got.collect()) == want
    kept = decontaminate.clean(docs, bench, q=5)
    leaking = {d for d, _, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in rows if str(d) not in leaking)
    assert kept.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_items_of_any_length_against_plain_alignment():
    """Items of 1 to 40 characters, unchanged and with as many edits as their budget allows, spread or together."""
    rnd = random.Random(12)
    letters = "abcdefg "
    text = decontaminate.normal("".join(rnd.choice(letters) for _ in range(300)))
    items, texts = [], [text, "", "b", "zz " * 20]
    for size in range(1, 41):
        item = decontaminate.normal("".join(rnd.choice("hijklmnop ") for _ in range(size)))
        for edits in range(len(item) // 10 + 2):
            changed = list(item)
            for at in rnd.sample(range(len(changed)), min(edits, len(changed))):
                changed[at] = rnd.choice(["z", "", changed[at] + "z"])
            at = rnd.randrange(len(text))
            texts.append(decontaminate.normal(text[:at] + "".join(changed) + text[at:]))
        items.append((size, item))
    items += [(100, "b"), (101, text[50:59]), (102, text[10:33]), (103, "zz zz")]

    def plain(item, whole):
        row = [0] * (len(whole) + 1)
        for i, a in enumerate(item, 1):
            left, row = row, [i]
            for j, b in enumerate(whole, 1):
                row.append(min(left[j - 1] + (a != b), left[j] + 1, row[-1] + 1))
        return min(row)

    found = decontaminate.Items(items, 8, 0.1)
    got = {(t, found.names[name], edits) for t, hits in enumerate(found.find(texts)) for name, _, _, edits in hits}
    want = {(t, n, e) for t, whole in enumerate(texts) for n, item in items if item and (e := plain(item, whole)) <= len(item) // 10}
    assert got == want and len(want) > 100
    for t, hits in enumerate(found.find(texts)):
        for name, a, b, edits in hits:
            if not edits:
                item = dict(items)[found.names[name]]
                assert texts[t][a:b] == item and a == texts[t].find(item)


def test_fingerprints_tell_texts_of_similarity_08_from_others():
    rnd = random.Random(23)
    near, far, last = [], [], None
    for _ in range(150):
        words = prose(rnd, rnd.randint(60, 400)).split()
        edited = list(words)
        for at in rnd.sample(range(len(words)), max(1, len(words) // 50)):
            edited[at] = "edited"
        a, b = (minhash.shingle_set(" ".join(x)) for x in (words, edited))
        marks = [int.from_bytes(simcopies.wide_fingerprint(x).tobytes(), "little") for x in (a, b)]
        if minhash.similar(a, b, 0.8):
            near.append((marks[0] ^ marks[1]).bit_count())
        far.append((marks[0] ^ last).bit_count() if last else 128)
        last = marks[0]
    assert len(near) > 40 and max(near) <= simcopies.RADIUS < min(far) - 20
    assert not simcopies.wide_fingerprint(minhash.shingle_set(None)).any()


@pytest.mark.parametrize("cut", [{}, {"tile": 2}, {"tile_bytes": 4000}])
def test_near_copies_by_simhash(spark, cut, monkeypatch):
    """The stage takes its candidates from fingerprints and BK-trees; MinHash bands are not asked."""
    monkeypatch.setattr(minhash, "keep_one", None)
    rnd = random.Random(29)
    base = [prose(rnd, rnd.randint(60, 200)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[0] + " " + prose(rnd, 1 + i % 3)) for i in range(30)]
    rows += [(200 + i, base[i] + f" end{i}") for i in range(1, 20)] + [(300, ""), (301, None), (302, " \n"), (303, "one two"), (304, "ONE  two"), (None, base[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simcopies.keep_one(docs, **cut) if cut else corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(40), 300, 303]
    assert cut or simcopies.keep_one(docs.limit(0)).count() == 0
