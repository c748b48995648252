"""Chat, tokenizer, archive, page and toxicity operators, and the pipeline."""

import hashlib
import io
import os
import random
import struct
import zipfile
import zlib
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from procurelake.llm import bpe, chat, pages, pretokens, queries, simhash, tokenfile, toxicity, units, warc, zipread
from procurelake.session import scratch_path

AWKWARD = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s>", "<s>", "a<", "[/", ">", "[ROLE]x[/ROLE]y[/TEXT]", "<<SYS>>\\<</SYS>>", "s>", "", None, "\\", "$1\n<</SYS>", "[/INST", "x" * 200_000 + "</s>"]
PIECES = ["'", "s", "t", "re", "'s", " ", " ", "  ", "\n", "\t", "1", "²", "!", "é", "漢", " ", "　", "😀", "\x1c", "\x85", "A", "́", "Ɤ", "<|endoftext|>", ""]


def test_chats_read_back(spark):
    rnd = random.Random(3)
    rows = [(c, rnd.choice([None, 0, 1, 1, 2, 3]), rnd.choice(["user", "assistant", "system", "tool", None, "", "[/ROLE]", "<s>"]), rnd.choice(AWKWARD)) for c in range(60) for _ in range(rnd.randint(1, 6))]
    rows += [(None, 0, "user", "a"), (100, 0, "user", "same"), (100, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit("own").alias(c) for c in ("formatted", "turns", "mask", "_turns")])
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        want = [(role, text) for _, _, role, text in sorted(turns)]
        row = got[c]
        assert [(t.role, t.text) for t in row.turns] == want
        at, loss = 0, ""
        for run in row.mask:
            loss += row.formatted[at : at + run.chars] if run.loss else ""
            at += run.chars
        assert at == len(row.formatted)
        assert row.escaped or loss == "".join(t for r, t in want if r == "assistant")
    assert not got[100].escaped
    digest = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert digest[100].turns_sha256 == hashlib.sha256(b"user\nsame\nuser\nsame\n").hexdigest() and digest[100].loss_chars == 0
    assert chat.format_chats(df.limit(0)).count() == 0
    odd = spark.createDataFrame([("<s>a</s>rest",), ("<s>[INST]</s>",), ("<s>[\\INST]</s>",), ("",)], "formatted string")
    assert [r.turns and [tuple(t) for t in r.turns] for r in chat.parse(odd).collect()] == [None, None, [("assistant", "[INST]")], []]


@pytest.fixture(scope="module")
def library():
    path = bpe.vocabulary_path()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join) | st.text(max_size=20), min_size=1, max_size=5))
def test_pieces_and_ids_are_the_librarys(texts):
    path = bpe.vocabulary_path()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    tool = bpe.encoder(path)
    for text, ids in zip(texts, tool.encode_batch(texts)):
        assert ids == encoding.encode_ordinary(text)
        data = text.encode()
        assert tool.decode(ids) == data
        assert tool.offsets(ids)[-1] == len(data)
        assert tool.decode_span(ids, 1, len(data) - 1) == data[1:-1]


def test_scan_crosses_lanes():
    text = ("ab 'tis it's\n\n  we'll 12ab " * 3000)[:-7]
    starts = pretokens.boundaries([text, "", text])
    import regex

    want = [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)] + [len(text)]
    assert starts[0].tolist() == want == starts[2].tolist() and starts[1].tolist() == [0]


def test_bpe_rows(spark, library):
    rows = [(1, "Hello, it's 2024 — é漢"), (2, None), (3, ""), (1, "again"), (None, "x"), (4, "a" * 60_000), (5, "word " * 30_000)]
    got = bpe.round_trip(documents(spark, rows)).collect()
    want = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    both = bpe.decode(bpe.encode(documents(spark, rows))).collect()
    assert sorted(bytes(r.content).decode() for r in both) == sorted(t or "" for _, t in rows)
    assert bpe.round_trip(documents(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*PIECES, "q" * 70, " a,", "naïve."]), max_size=25).map("".join) | st.text(max_size=20), min_size=1, max_size=5))
def test_units_are_the_librarys(texts):
    tool = Tokenizer.from_file(tokenfile.vocabulary_path())
    ids, sizes = tokenfile.encoder(tokenfile.vocabulary_path(), 0).encode(texts)
    want = [tool.encode(text, add_special_tokens=False).ids + [0] for text in texts]
    assert ids.tolist() == [i for row in want for i in row] and sizes.tolist() == [len(row) for row in want]


def test_unit_table_is_emptied_when_full(monkeypatch):
    monkeypatch.setattr(units, "TABLE", 64)
    small = units.UnitEncoder(tokenfile.vocabulary_path(), 0)
    rnd = random.Random(1)
    for _ in range(20):
        text = prose(rnd, 20)
        assert small.encode([text])[0].tolist() == [*small.tool.encode(text, add_special_tokens=False).ids, 0]


def test_units_beyond_the_table(monkeypatch):
    """A text with more distinct units than the table has slots, alone and among others."""
    monkeypatch.setattr(units, "TABLE", 1024)
    small = units.UnitEncoder(tokenfile.vocabulary_path(), 0)
    texts = [" ".join(f"w{i}" for i in range(5000)), "short", "", " ".join(f"w{i % 700}" for i in range(5000)) + " <|endoftext|>"]
    ids, sizes = small.encode(texts)
    want = [[*small.tool.encode(text, add_special_tokens=False).ids, 0] for text in texts]
    assert ids.tolist() == [i for row in want for i in row] and sizes.tolist() == [len(row) for row in want]


def test_long_text_of_distinct_words():
    text = " ".join(np.base_repr(i * 7919, 36) for i in range(3_000_000))
    tool = tokenfile.encoder(tokenfile.vocabulary_path(), 0)
    ids, sizes = tool.encode([text])
    want = tool.tool.encode(text, add_special_tokens=False).ids
    assert sizes.tolist() == [len(want) + 1] and (ids[:-1] == np.array(want)).all() and ids[-1] == 0


def test_token_files(spark):
    rnd = random.Random(5)
    rows = [(i * 3 % 101, prose(rnd, rnd.randint(0, 60))) for i in range(150)] + [(None, "n"), (7, None), (8, ""), (9, "long " * 30_000), (9, "long " * 30_000)]
    target = f"{scratch_path(spark, 'tokens')}/ids"
    tokenfile.write(documents(spark, rows).repartition(5), target)
    got = tokenfile.digests(spark, target).collect()
    tool, sizes, crc = Tokenizer.from_file(tokenfile.vocabulary_path()), {}, Counter()
    for doc, text in rows:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        crc[(doc, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))] += 1
        sizes[doc] = sizes.get(doc, 0) + len(ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == crc
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    part = tokenfile.read(spark, target, low=20, high=30)
    assert {r.doc_id for r in part.collect()} == {d for d, _ in rows if d is not None and 20 <= d <= 30}
    plan = part.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan
    files = [f for f in spark.read.parquet(target).inputFiles()]
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata.row_group(0).column(0)
    assert meta.has_offset_index and meta.has_column_index
    empty = f"{scratch_path(spark, 'tokens')}/ids"
    tokenfile.write(documents(spark, []), empty)
    assert tokenfile.digests(spark, empty).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(wide, monkeypatch):
    if wide:
        for name in ("ZIP64_LIMIT", "ZIP_FILECOUNT_LIMIT"):
            monkeypatch.setattr(zipfile, name, 2)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as pack:
        for i in range(4):
            with pack.open(zipfile.ZipInfo(f"é{i}.txt"), "w", force_zip64=True) as member:
                member.write(b"PK\x05\x06" * i + b"content" * i)
        pack.writestr("packed.txt", b"x" * 100, zipfile.ZIP_DEFLATED)
        pack.comment = b"PK\x05\x06 a comment"
    found = zipread.members(data, len(data.getvalue()))
    assert [*found] == ["é0.txt", "é1.txt", "é2.txt", "é3.txt", "packed.txt"]
    for i in range(4):
        member = found[f"é{i}.txt"]
        assert zipread.read_range(data, zipread.data_start(data, member), member.size) == b"PK\x05\x06" * i + b"content" * i
    with pytest.raises(zipread.BadPackage):
        zipread.data_start(data, found["packed.txt"])
    with pytest.raises(zipread.BadPackage):
        zipread.members(io.BytesIO(b"nothing"), 7)


def test_archives(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 9}</p>") for i in range(40)] + [(50, None, None), (51, "u\r\nX: y", ""), (52, "u", "ü" * 300_000), (None, "u", "<p>1</p>"), (53, "u", "t"), (53, "u", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("own")).withColumn("kind", F.lit("own"))
    packages = warc.write_archives(df, scratch_path(spark, "warc"), records=7)
    got = warc.read_archives(packages).collect()
    assert len(got) == len(rows) and packages.count() > 3
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page)
    for r in got:
        if r.record_type == "response":
            assert first[bytes(r.payload).decode()] == r.page_id and r.refers_to is None
    assert Counter(r.record_type for r in got) == {"response": len(first), "revisit": len(rows) - len(first)}
    want = Counter((page, len((html or "").encode()), warc.base32_sha1((html or "").encode())) for page, _, html in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    assert all(r.refers_to == first[next(h or "" for p, _, h in rows if p == r.page_id)] for r in got if r.record_type == "revisit")
    all_responses = warc.round_trip(df, least=1 << 30).collect()
    assert {r.record_type for r in all_responses} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_shared_lines_are_longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    i, j = pages.shared_lines(a, b)
    assert len(i) == table[-1][-1] and [a[k] for k in i] == [b[k] for k in j] and i == sorted(set(i)) and j == sorted(set(j))


def test_blocks_of_markup():
    html = """<!doctype html><html><head><title>t</title></head><body><header>site</header><nav><ul><li>menu</ul></nav>
      <div class="cookie-notice">ok?<div>nested</div></div><main><header><h1>Head&amp;line</h1></header><p>One <b>two</b>
      three<br>four<p class=ad>buy<p>five &lt;p&gt;<form>f</form><script>if (a<b) "</p>"</script><!-- no --><section id="comments">c</section>
      <p hidden>h</p><table><tr><td>a<td>b</table></main><footer>foot</footer>"""
    assert pages.blocks(html) == (True, ["Head&line", "One two three four", "five <p>", "a b"])
    assert pages.blocks("a < b<p>c</div>d<script>x") == (False, ["a < b", "c", "d"])
    assert pages.blocks(None) == pages.blocks("") == pages.blocks("<p> </p>") == (False, [])


def test_nearest_pages_are_differenced(spark):
    site = "<p>Welcome to the site</p>{}<p>All rights reserved</p>"
    rows = [(i, f"http://a.example/x/{i}", site.format(f"<p>own text of page {i} " + prose(random.Random(i), 40) + "</p>")) for i in range(30)]
    rows += [(100, "http://b.example/", site.format("<p>alone</p>")), (101, None, "<p>no url</p>"), (102, "http://c.example/1", site.format("<p>copy</p>")), (103, "http://c.example/2", site.format("<p>copy</p>"))]
    rows += [(104, "http://a.example/x/5", "<article><p>Welcome to the site</p></article>"), (None, "http://[bad", None), (105, "http://d.example", "<p>" + "long word " * 50_000), (105, "http://d.example", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("own").alias(c) for c in ("lines", "row", "host", "part")])
    got = pages.main_text(df).collect()
    text = {r.page_id: r.text for r in got if r.page_id != 105}
    assert len(got) == len(rows)
    assert all(text[i].startswith(f"own text of page {i} ") and "\n" not in text[i] for i in range(30))
    assert text[100] == "Welcome to the site\nalone\nAll rights reserved" == text[102].replace("copy", "alone")
    assert text[101] == "no url" and text[104] == "Welcome to the site" and text[None] == ""
    assert sorted(r.n_chars for r in got if r.page_id == 105) == [0, 499_999]
    assert pages.main_text(df.limit(0)).count() == 0


def test_articles_keep_what_only_sounds_like_furniture():
    html = """<div class="site-header">top</div><noscript>enable it</noscript><article><h2 id="related-work">Related work</h2>
      <p class="search-results">Results</p><figure><figcaption>Figure 1</figcaption></figure><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>
      <div class="notice-of-claims">claims</div><noscript>plain</noscript><div class="ad-container-2">buy</div><ul class="related posts">more</ul>
      <div id="comment-list">first!</div><div class="wide sidebar">side</div><header>By me</header></article><div class="footer">end</div>"""
    assert pages.blocks(html) == (True, ["Related work", "Results", "Figure 1", "so x=1", "claims", "plain", "By me"])


def test_marked_pages_are_differenced_before_the_marks_are_asked(spark):
    """Of what neighbours share, lines in a marked article stay, but not those whose class or id casts doubt on them."""
    html = """<div>Site</div><article><h1 id="search-tips">Tips</h1><p>Shared passage</p><p>{}</p><div class="share-this-{}">{}<b>Tell a friend</b></div></article>"""
    rows = [(i, f"http://a.example/x/{i}", html.format(prose(random.Random(i), 30), "article", f"<p>share number {i}</p>")) for i in range(12)]
    rows += [(20, "http://b.example/1", html.format("alone", "article", "")), (21, "http://a.example/x/5a", "<p>Tell a friend</p><p>bare</p>")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Tips\nShared passage\n{prose(random.Random(i), 30)}\nshare number {i}" for i in range(12))
    assert got[20] == "Tips\nShared passage\nalone\nTell a friend" and got[21] == "Tell a friend\nbare"


def test_differencing_against_a_plain_version(spark):
    """Random hosts of pages with shared lines, exact and near copies side by side."""
    rnd = random.Random(21)
    rows = []
    for host in range(6):
        site = [f"site {host} line {k} menu" for k in range(3)]
        made = []
        for n in range(rnd.randint(1, 14)):
            if made and rnd.random() < 0.4:
                lines = list(rnd.choice(made))
                if rnd.random() < 0.5:
                    lines.insert(rnd.randrange(len(lines) + 1), f"added {n}")
            else:
                lines = [*rnd.sample(site, 2), *(prose(rnd, rnd.randint(3, 12)) for _ in range(rnd.randint(0, 4))), rnd.choice(site)]
            made.append(lines)
            rows.append((len(rows), f"http://h{host}.example/{rnd.randint(0, 9)}/{n % 3}", "".join(f"<p>{line}</p>" for line in lines)))
    rows += [(500 + n, "http://copies.example/a", "<p>site menu line</p><p>story one is told here</p>") for n in range(3)]
    rows += [(503, "http://copies.example/b", "<p>site menu line</p><p>another story</p>")]
    want = {}
    for host in {r[1].split("/")[2] for r in rows}:
        same = {}
        for at, (page, url, html) in enumerate(rows):
            if url.split("/")[2] == host:
                same.setdefault(tuple(pages.blocks(html)[1]), []).append(("/" + url.split("/", 3)[3], at))
        order = sorted((min(places), lines) for lines, places in same.items())
        for k, (_, lines) in enumerate(order):
            gone = set()
            for side in (1, -1):
                for far in range(1, pages.REACH + 1):
                    if not 0 <= k + side * far < len(order):
                        break
                    other = order[k + side * far][1]
                    first, second = (lines, other) if side == 1 else (other, lines)
                    i, j = pages.shared_lines([hash(x) for x in first], [hash(x) for x in second])
                    share = max(sum(len(first[x]) for x in i) / max(1, sum(map(len, first))), sum(len(second[x]) for x in j) / max(1, sum(map(len, second))))
                    if not len(i) or share <= pages.COPY_SHARE:
                        gone |= set(i if side == 1 else j)
                        break
            for _, at in same[lines]:
                want[rows[at][0]] = "\n".join(line for x, line in enumerate(lines) if x not in gone)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got == want
    assert got[500] == got[501] == got[502] == "story one is told here" and got[503] == "another story"


def test_differencing_across_stretches_of_the_order(spark):
    """One host longer than a stretch, near copies side by side at each border: each page and side as by comparing it with the nearest pages."""
    rnd = random.Random(4)
    made = []
    for n in range(3 * pages.STRETCH + 10):
        near = n % pages.STRETCH in (1, 2, pages.STRETCH - 1) or rnd.random() < 0.2
        own = [*made[-1], f"added {n}"] if made and near else [f"own {n} a", f"own {n} b"][: rnd.randint(1, 2)] + [f"site line {rnd.randint(0, 2)}"]
        made.append(own)
    rows = [(n, f"http://a.example/{n:04}", "".join(f"<p>{line}</p>" for line in lines)) for n, lines in enumerate(made)]
    want = {}
    for k, lines in enumerate(made):
        gone = set()
        for side in (1, -1):
            for far in range(1, pages.REACH + 1):
                if not 0 <= k + side * far < len(made):
                    break
                a, b = (lines, made[k + side * far])[::side]
                i, j = pages.shared_lines(a, b)
                if max(sum(len(a[x]) for x in i) / len("".join(a)), sum(len(b[x]) for x in j) / len("".join(b))) <= pages.COPY_SHARE:
                    gone |= set(i if side == 1 else j)
                    break
        want[k] = "\n".join(line for x, line in enumerate(lines) if x not in gone)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.main_text(df).collect()} == want


def test_differencing_writes_less_than_the_pages(spark, tmp_path, monkeypatch):
    """What is staged takes less disk than the pages, and the alignment gets each of them about once, not once for each neighbour."""
    rows = [(n, f"http://a.example/{n}", "".join(f"<p>{prose(random.Random(9 * n + k), 60)}</p>" for k in range(9))) for n in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    size, staged = lambda df: sum(os.path.getsize(urlsplit(f).path) for f in df.inputFiles()), pages.staged
    sizes, seen = {}, spark.sparkContext.accumulator(0)

    def measured(df, label, **options):
        out = staged(df, label, **options)
        sizes[label] = size(out)
        return out

    def counted(batches, align=pages._align):
        def passed():
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return align(passed())

    monkeypatch.setattr(pages, "staged", measured)
    monkeypatch.setattr(pages, "_align", counted)
    df = spark.read.parquet(f"{tmp_path}/pages")
    assert pages.main_text(df).count() == len(rows)
    assert sizes["blocks"] + sizes["ordered"] < 0.85 * size(df) and len(rows) <= seen.value <= 1.1 * len(rows)


@pytest.fixture(scope="module")
def marked(spark):
    rnd = random.Random(8)
    bad = ["gruk", "blarz", "snorfel"]
    rows, labels = [], []
    for i in range(900):
        words = prose(rnd, rnd.randint(20, 60)).split()
        if i % 6 == 0:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice(["", "o", "ing", "an"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, marked):
    rows, labels = marked
    more = [(5000, None), (5001, ""), (5002, "ba " * 50_000), (None, "x y"), (5003, rows[0][1]), (5003, rows[0][1])]
    docs, marks = documents(spark, rows + more), spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("own"))
    got = toxicity.score(docs, marks).collect()
    assert len(got) == len(rows + more)
    held = {r.doc_id: r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900}
    assert {*held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(held[i].predicted == toxic for i, toxic in labels if i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (5000, 5001)) and len({r.score for r in got if r.doc_id == 5003}) == 1
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in labels], "doc_id long, toxic int")
    again = {(r.doc_id, r.text_key): r.score for r in toxicity.score(docs, flipped).collect()}
    assert again == {(r.doc_id, r.text_key): r.score for r in got}
    assert {r.predicted for r in toxicity.score(docs, marks.limit(0)).collect()} == {0}
    assert toxicity.score(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize("only", [0, 1])
def test_toxicity_with_batches_of_one_class(spark, only):
    """Where no row of a batch is toxic, or none ordinary, and where a batch has no word at all."""
    rows = [(i, prose(random.Random(i), 12) if i < 40 else None) for i in range(60)]
    docs, marks = documents(spark, rows), spark.createDataFrame([(i, only) for i, _ in rows], "doc_id long, toxic int")
    assert sorted(r.doc_id for r in toxicity.score(docs, marks).collect()) == [i for i, _ in rows]
    corpus = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert toxicity.keep_clean(corpus, marks.where("doc_id > 100")).count() == len(rows)


def test_pipeline_stages(spark, marked, tmp_path):
    rows, labels = marked
    rnd = random.Random(12)
    item = prose(rnd, 40)
    passage = prose(rnd, 70)
    clean = [(i, t) for i, t in rows if i % 6]
    extra = [(2000 + i, prose(rnd, 90)) for i in range(20)]
    planted = [(3000, clean[0][1]), (3001, clean[0][1]), (3002, item + " " + prose(rnd, 30)), (3003, prose(rnd, 60) + " " + passage), (3004, passage + " " + prose(rnd, 60)), (3005, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + extra + planted], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, frames = docs, []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        frames.append(at)
    toxic, single, cut, safe, last = frames
    assert all(frame.columns == docs.columns for frame in frames[:-1])
    rejected = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in toxic.collect()} == {i for i, _ in rows + extra + planted} - rejected and len(rejected) >= 145
    kept = {r.doc_id: r.text for r in single.collect()}
    groups = simhash.near_copies(toxic).collect()
    assert set(kept) == {r.component_id for r in groups} and 3000 not in kept and 3001 not in kept
    after = {r.doc_id: r for r in cut.collect()}
    assert set(after) == set(kept)
    for doc, text in kept.items():
        want = text if doc != 3004 else " ".join(text.split()[70:])
        assert after[doc].text == want and after[doc].n_chars == len(want)
    assert {r.doc_id for r in safe.collect()} == set(after) - {3002}
    assert {r.doc_id: r.decoded_sha256 for r in last.collect()} == {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in after.items() if d != 3002}
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, last.collect()))


def test_queries_are_registered():
    numbers = [name.split("_")[0] for name in queries.QUERIES]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14)) and set(queries.CHECKS) <= set(queries.QUERIES)
