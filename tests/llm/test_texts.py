"""Operators on single texts: languages, quality, media, token files, packing, pages."""

import hashlib
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import html_extract, huffman, langid, media, packing, quality, queries, token_files
from quarry.llm.common import READ_ROWS
from quarry.llm.tokens import PieceEncoder

ODD = [None, "", " ", "\n", "a", "Émile a été là.", "x" * 200_000, "日本語", "12 34 !!", "a\x00b", "😀 😀"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated rows, very long text, clashing names."""
    rows = [(i, t, None if i % 3 else "fr", "k", i) for i, t in enumerate(ODD)] + [(None, "a", None, None, None), (4, "a", "en", "k", 1), (4, "a", "en", "k", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n long")


@pytest.fixture(scope="module")
def truth(spark, sf):
    from tokenizers import Tokenizer

    import public_tokenizers

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    return {d: np.array([*encode.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in docs.items()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab É\n.,!'1<|\t  日#"), max_size=30))
def test_pieces_give_the_whole_encoding(text):
    global _encoder
    _encoder = globals().get("_encoder") or PieceEncoder()
    (got,) = _encoder.encode(pa.array([text]))
    assert got.tolist() == _encoder._whole.encode(text, add_special_tokens=False).ids


def test_full_cache_changes_nothing():
    small, large = PieceEncoder(cache_pieces=3), PieceEncoder()
    texts = pa.array(["one two three four", "five six, seven.", None, "one <|endoftext|> two"])
    assert [x.tolist() for x in small.encode(texts)] == [x.tolist() for x in large.encode(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=600), st.integers(9, 20))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, np.uint16)
    counts = np.bincount(ids, minlength=500) ** 3
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and (lengths > 0).tolist() == (counts > 0).tolist()
    if (counts > 0).sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1
    codes, symbols, steps = huffman.canonical(lengths, limit)
    bits, marks = huffman.encode(ids, codes, lengths)
    again = huffman.decode([bits, bits], [marks, marks], [len(ids)] * 2, symbols, steps, limit)
    assert all(x.tolist() == ids.tolist() for x in again)


def test_package_merge_is_optimal_without_limit():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost


def test_token_files(spark, sf, truth):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_token_files"](spark, sf).collect()}
    at = 0
    for d in sorted(truth):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(truth[d]), crc(truth[d]))
        at += len(truth[d])
    assert len(got) == len(truth)


def test_token_files_of_odd_rows(spark, odd):
    got = token_files.round_trip(odd).orderBy("start").collect()
    assert len(got) == len(ODD) + 3 and got[0]["doc_id"] is None
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1)} == {1}
    assert token_files.round_trip(odd.where("false")).collect() == []


def reader_batches(node):
    """Rows and batches that the Parquet reader of a plan that ran has given."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return reader_batches(node.executedPlan())
    if name.endswith("QueryStage"):
        return reader_batches(node.plan())
    if name == "ColumnarToRow":
        return [node.metrics().apply(x).value() for x in ("numOutputRows", "numInputBatches")]
    children = node.children()
    return reader_batches(children.apply(0)) if children.size() else []


def test_long_texts_are_read_few_rows_at_a_time(spark, tmp_path):
    texts = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words ")), 50).alias("text"))
    texts.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    got = token_files.tokenize(docs).drop("ids")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(300))
    rows, batches = reader_batches(got._jdf.queryExecution().executedPlan())
    assert rows and rows / batches <= READ_ROWS


def check_packing(rows, lengths):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, n in lengths.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at and length > 0
            at += length
        assert at == n
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * total


def test_packing(spark, sf, truth):
    rows = queries.QUERIES["op7_packing"](spark, sf).collect()
    check_packing(rows, {d: len(t) for d, t in truth.items()})
    for r in rows:
        ids = truth[r["doc_id"]]
        assert (r["ids_crc32"], r["doc_tokens"]) == (crc(ids[r["start"] : r["start"] + r["length"]]), len(ids))


def test_packing_of_odd_rows(spark, odd):
    rows = packing.pack(odd.where("doc_id <> 4"), keep_ids=True).collect()
    sizes = {}
    for r in rows:
        sizes[r["doc_id"]] = r["doc_tokens"]
        assert len(r["ids"]) == 2 * r["length"]
    check_packing(rows, sizes)
    assert sum(r["length"] for r in packing.pack(odd.where("doc_id = 4 OR doc_id IS NULL")).collect()) == 8
    assert packing.pack(odd.where("false")).collect() == []


def test_languages_of_held_out_documents(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_language_id"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd):
    got = langid.identify(odd, F.lit(True)).select("doc_id", "text", "lang_id.*").collect()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert {r["lang_pred"] for r in langid.identify(odd, F.lit(False)).select("lang_id.*").collect()} == {"und"}


def test_profiles_against_brute_force(spark):
    from collections import Counter

    texts = ["Ab ab, ba!", "AB é"]
    counts = Counter()
    for t in texts:
        s = "_" + "_".join(re.findall(r"[^\W\d_]+", t.lower())) + "_"
        for n in (1, 2, 3):
            counts.update(g for i in range(len(s) - n + 1) if (g := s[i : i + n]) != "_")
    got = Counter()
    for t in texts:
        for code in langid.ngrams(t).tolist():
            got["".join(chr(c) if (c := code >> 21 * k & 0x1FFFFF) else "_" for k in range(3))] += 1
    plain = Counter({k.rstrip("_") or k: v for k, v in got.items()})
    assert sum(plain.values()) == sum(counts.values()) and plain["a"] >= 3


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op6_quality"](spark, sf).collect()
    held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_of_odd_rows_and_labels(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, None), (5, 0), (99, 1)], "doc_id long, label int")
    for some in (labels, labels.where("label = 1"), labels.where("false")):
        got = quality.train_and_score(odd, some).collect()
        assert len(got) == len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.train_and_score(odd.where("false"), labels).collect() == []


def test_isotonic():
    got = quality.isotonic(np.array([1.0, 1, 1, 1, 1]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(got) >= 0).all() and got[1] == got[2]


def test_media_round_trip(spark, odd):
    rows = {(r["doc_id"], r["payload_sha256"]): r for r in media.features(media.store(odd)).collect()}
    for i, t in enumerate(ODD):
        data = (t or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 or (0 if data else 64))
        r = rows[i, hashlib.sha256(payload).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        wav = media.to_wav(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest()) and media.from_wav(wav) == payload
    assert media.features(media.store(odd.where("false"))).collect() == []


def test_fingerprints_follow_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / media.RATE)).astype(np.uint8)
    peaks = media.peaks(tone)
    assert (peaks[:-2, 2] == 1000 * media.FRAME // media.RATE).all()
    codes = media.fingerprints(tone)
    assert (np.diff(codes >> 24) >= 0).all() and len(codes) == sum(len(peaks) - g for g in (1, 2)) * len(media.BANDS)


def test_main_text_of_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.QUERIES["op10_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", body)
        assert r["text"] == " ".join(entities.unescape(plain).split()) and r["n_chars"] == len(r["text"])


PAGES = [
    (1, "http://a.com/x/1", "<body><div>Menu line</div><p>One&nbsp;two &lt;b&gt;</p><div>Foot</div>"),
    (2, "http://a.com/x/2", "<body><div>Menu line</div><p>Three</p><div>Foot</div></body>"),
    (3, "http://b.com/", "<main>A<b>B</b>c<aside>no</aside><form>no</form><div class='user-comments'>no</div><p>d<p>e</main><footer>no"),
    (4, None, None), (5, "http://a.com/x/2", "<p>Three</p>"), (6, "", "<script>x</script><style>y</style>"), (7, "http://c.com/q", "<article>same</article>"), (8, "http://c.com/r", "<article>same</article>"),
    (9, "http://d.com/a", "<p>copy</p><p>of it</p>"), (10, "http://d.com/b", "<p>copy</p><p>of it</p>"), (7, "http://c.com/q", "<article>same</article>"), (11, "http://e.com/", "text " * 50_000),
]


def test_differencing(spark):
    df = spark.createDataFrame([(*p, "host") for p in PAGES], "page_id long, url string, html string, host string").coalesce(1)
    got = {}
    for r in html_extract.extract(df).collect():
        assert got.setdefault(r["page_id"], r["text"]) == r["text"]
    assert got[1] == "One two <b>" and got[5] == "Three"
    assert got[2] == "Menu line Three Foot"  # page 1 shares most of it, and page 5 is a version of it
    assert got[3] == "ABc d e" and got[4] == "" and got[6] == "" and got[7] == got[8] == "same"
    assert got[9] == got[10] == "copy of it" and len(got[11]) == 5 * 50_000 - 1
    assert html_extract.extract(df).count() == len(PAGES) and html_extract.extract(df.where("false")).collect() == []


def text_of(html, neighbour):
    return html_extract.main_text(html_extract.Page(html).lines, html_extract.Page(neighbour).lines)


def test_differencing_inside_main():
    bars = "<div>Share this</div><div>We moved our offices to the harbour</div>"
    first, second = ("<main>" + bars + f"<p>{t}</p></main><div>Foot</div>" for t in ("The story of the first page, told at some length", "What the second page has to say is different"))
    assert text_of(first, second) == "The story of the first page, told at some length"
    assert text_of(second, first) == "What the second page has to say is different"
    story = "<main><p>1 May</p><p>The same long story on both of the pages</p></main>"
    assert text_of(story, story.replace("1 May", "2 May")) == "1 May The same long story on both of the pages"
    quote = "<article><p>Short quote</p><p>{} tells a longer story of its own</p></article>"
    assert text_of(quote.format("One"), quote.format("Another")) == "Short quote One tells a longer story of its own"
    within = "<main><div>Share this</div><article><p>Quote</p><p>{}</p></article></main>"
    assert text_of(within.format("A text that is long"), within.format("Another, longer still")) == "Quote A text that is long"


def test_names_drop_as_a_whole_and_never_the_article():
    lines = lambda html: [t for t, _, dropped in html_extract.Page(html).lines if not dropped]
    assert lines("<body class='has-sidebar'><article class='post ad-free'>story<div class='ad-free'>more</div><div class='x ad'>no</div></article></body>") == ["story", "more"]
    assert lines("<html class='nav'><body id='search'><main role='menu' class='widget'>story</main><div class='site_nav'>no</div>") == ["story"]


def test_near_copies_keep_their_text():
    story = "<p>{}</p><p>The same long story on both of the pages</p><div>Foot</div>"
    first, second, other = story.format("1 May"), story.format("2 May"), "<p>Something else that is told at length</p><div>Foot</div>"
    assert text_of(first, second) == "1 May The same long story on both of the pages Foot"
    lines = [html_extract.Page(h).lines for h in (first, second, other)]
    assert html_extract.main_text(*lines) == "1 May The same long story on both of the pages"


def test_ranges_change_no_text(spark):
    rows = [(k if k % 7 else None, f"http://h{k % 3}.com/{k % 11}/{k}", f"<div>Top of h{k % 3}</div><p>Page {k} has a text of its own</p><div>Foot</div>") for k in range(60)]
    rows += [(100, None, None), (None, None, None), (None, None, None), rows[5], rows[7], rows[7]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "2", "5", "50", "300"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, html_extract.extract(df).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(g == got[0] for g in got) and len(got[0]) == len(rows)
    assert sum(text == f"Page {url.rsplit('/', 1)[1]} has a text of its own" for _, url, text in got[0] if url) >= 58


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    found = sorted(html_extract.shared_lines(list(a), list(b)))
    assert len(found) == table[-1][-1]
    rest = iter(b)
    assert all(any(a[k] == c for c in rest) for k in found)


def test_equal_rows_have_equal_texts_and_are_one_neighbour(spark):
    one, two = ("http://h/a", "<p>Foot</p><p>Uno dos tres cuatro</p><p>only here</p>"), ("http://h/b", "<p>Foot</p><p>Cinco seis siete ocho</p>")
    alone = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame([(1, *one), (2, *two)], "page_id long, url string, html string")).collect()}
    assert alone == {1: "Uno dos tres cuatro only here", 2: "Cinco seis siete ocho"}
    rows = [(1, *one)] * 3 + [(2, *two)] * 2 + [(9, *one), (None, *two), (3, *two), (3, *two)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        got = html_extract.extract(df.repartition(parts)).collect()
        assert sorted(((r["page_id"], r["url"]) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
        assert all(r["text"] == alone[1 if r["url"] == "http://h/a" else 2] for r in got)


def test_hidden_parts_and_comments_are_no_text():
    page = lambda body: " ".join(t for t, _, dropped in html_extract.Page(body).lines if not dropped)
    assert page("<article>a<section class='comment-thread'>no</section><div hidden>no</div><div style='color:red; DISPLAY : none'>no</div><p style='display:block'>b</p><ol class=commentList>no</ol></article>") == "a b"
    assert page("<div class='site-header-inner'>no</div><ul class='menu-main-container'>no</ul><div class='has-sidebar'>a</div><div class='ad-free'>b</div><div id='commentary'>c</div>") == "a b c"


def test_alignment_is_exact_however_lines_recur(monkeypatch):
    for n in (64, 65, 500):
        assert html_extract.shared_lines(["p", "s", "q"], ["r", "s", "t"] * n) == {1}
    rng = np.random.default_rng(5)
    for bits in (1 << 29, 40):
        monkeypatch.setattr(html_extract, "TABLE_BITS", bits)
        for _ in range(60):
            a, b = (["xyzuvw"[k] for k in rng.integers(0, rng.integers(1, 7), rng.integers(0, 40))] for _ in range(2))
            length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
            found = [a[i] for i in sorted(html_extract.shared_lines(a, b))]
            rest = iter(b)
            assert len(found) == length[-1][-1] and all(x in rest for x in found)
