"""Pages, languages, quality, archives, embeddings and the pipeline."""

import base64
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from folioforge.llm import embed, html_extract, langid, quality, warc

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def cut_cost(odds, edges, side):
    return sum(max(0, x) for x, s in zip(odds, side, strict=True) if not s) + sum(max(0, -x) for x, s in zip(odds, side, strict=True) if s) + sum(w for i, j, w in edges if side[i] != side[j])


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    odds = [rng.uniform(-2, 2) for _ in range(n)]
    edges = [(i, j, rng.uniform(0, 1)) for i in range(n) for j in range(i) if rng.random() < 0.5]
    best = min(cut_cost(odds, edges, side) for side in itertools.product((False, True), repeat=n))
    assert cut_cost(odds, edges, html_extract.min_cut(odds, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><div id="cookie-notice">We use cookies, ok?</div>
<header><h1>Site</h1><ul><li><a href=x>Home</a></ul></header><div class="content"><h2>Title &amp; more</h2><p>One &lt;b&gt; two&nbsp;three,\n  and <b>bo</b>ld.<br><p>Second &#233; para.
<!-- no > here --><script>var x = "</p>";</script><ul><li>item one<li>item two</ul><div class="comments"><p>Nice article, thank you so much for it.</p></div></div>
<form><label>Mail</label></form><div class=sidebar><p>A long text in the sidebar, which could mislead.</p></div><footer>&copy; 2020</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>only text here, in one paragraph.</p><script>never closed"), (5, "x", "<article><p>a<!-- open"), (5, "x", "<article><p>a<!-- open")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract(pages, html_extract.START).collect()
    text = {r.page_id: r.text for r in out}
    assert text[1] == "Title & more\n\nOne <b> two three, and bold.\n\nSecond é para.\n\nitem one\n\nitem two"
    assert text[2] == text[3] == "" and text[5] == "a" and len(out) == 6
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_articles_of_the_test_pages(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", body)]
        assert found[r.page_id] == "\n\n".join(p for p in parts if p)


def test_very_long_pages():
    html = "<body><nav>" + "<a href=x>y</a> " * 10 + "</nav><article>" + "<p>word word word.</p>" * 20_000 + "</article>"
    assert html_extract.main_text(html, html_extract.START).count("\n\n") == 19_999


ARTICLE = "<h1>The river in spring</h1><p>After the long winter the river rises again, and the fields beside it turn green within a week.</p><p>People walk along the dam, look at the water, and talk about the floods of other years.</p>"
READ = ["The river in spring", "After the long winter the river rises again, and the fields beside it turn green within a week.", "People walk along the dam, look at the water, and talk about the floods of other years."]
MENU = '<nav><a href="/a">Home</a> <a href="/b">News</a></nav>'


@pytest.mark.parametrize(
    "html",
    [
        f'<body>{MENU}<div class="site has-sidebar">{ARTICLE}</div><footer>Imprint</footer>',
        f'<body>{MENU}<div class="layout no-header">{ARTICLE}</div><footer>Imprint</footer>',
        f'<body>{MENU}<div class="post social-share">{ARTICLE}</div><footer>Imprint</footer>',
        f'<body>{MENU}<article class="post comment-open">{ARTICLE}</article><footer>Imprint</footer>',
        f'<body>{MENU}<article>{ARTICLE.replace("<h1>", chr(60) + "div class=article-header><h1>").replace("</h1>", "</h1></div>")}</article>',
        f'<body>{MENU}<div class="content">{ARTICLE.replace("<h1>", chr(60) + "div class=article-header><h1>").replace("</h1>", "</h1></div>")}</div>',
        f'<body>{MENU}<article><header class="header"><h1>{READ[0]}</h1></header>{ARTICLE[ARTICLE.index("<p>"):]}</article>',
        f'<body><form id="aspnetForm">{MENU}<div id="x">{ARTICLE}</div><div class="footer">Imprint</div></form>',
        f'<body>{MENU}<div class="widget-wrap"><article>{ARTICLE}</article></div>',
        f'<body><nav><a href="/a">Home</a><div>{ARTICLE}</div>',
        f'<body>{MENU}<article>{ARTICLE}<div class="comments"><div class="comment"><p>What a lovely text about the river, I live there and it is true, every word.</p></div></div></article>',
        f'<body>{MENU}<div class="post">{ARTICLE}</div><section id="comments"><article class="comment"><p>What a lovely text about the river, I live there and it is true, every word.</p></article></section>',
        f'<body>{MENU}<div class="ad">Buy the best boats here, now with oars.</div><main>{ARTICLE}<aside><p>More about rivers, dams and floods in our archive of the region.</p></aside></main>',
    ],
)
def test_ordinary_names_do_not_decide(html):
    assert html_extract.main_text(html, html_extract.START).split("\n\n") == READ


LONG = "".join(f"<p>Paragraph {i} of a part that goes on and on, with sentences, commas, and all that a text has.</p>" for i in range(30))
PARTS = [
    f'<div id="comments">{LONG}</div>',
    f'<section class="comments"><h3>Comments</h3><article class="comment">{LONG}</article></section>',
    f"<footer>{LONG}</footer>",
    f"<aside>{LONG}</aside>",
    f'<aside><h2>Other news</h2>{LONG}</aside>',
    f'<div class="sidebar">{LONG}</div>',
    f'<div class="cookie-consent" role="dialog">{LONG}</div>',
    f"<form>{LONG}</form>",
    f'<div class="related"><h3>More to read</h3>{LONG}</div>',
    f'<div class="related-posts"><article><h3>A card</h3>{LONG}</article></div>',
    f'<div class="newsletter"><h2>Letters</h2>{LONG}</div>',
    f"<header>{LONG}</header>",
    f'<div role="complementary">{LONG}</div>',
]


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("around", ["<div>{}</div>", "{}", '<div class="content">{}</div>', "<article>{}</article>", "<div><div>{}</div></div>"])
def test_boilerplate_is_left_out_however_long_it_is(part, around):
    for page in (f"<body>{MENU}{around.format(ARTICLE)}{part}", f"<body>{MENU}{part}{around.format(ARTICLE)}<footer>Imprint</footer>"):
        assert html_extract.main_text(page, html_extract.START).split("\n\n") == READ


@pytest.mark.parametrize("part", PARTS)
def test_boilerplate_without_an_article(part):
    assert html_extract.main_text(f"<body>{part}", html_extract.START) == ""
    assert html_extract.main_text(f"<body>{MENU}{part}", html_extract.START) == ""


@pytest.mark.parametrize(
    "html",
    [
        f'<body><div class="modal-page">{MENU}<div>{ARTICLE}</div><div class="comments">{LONG}</div></div>',
        f'<body><div id="widget"><div class="menu">{MENU}</div><article>{ARTICLE}</article></div><aside>{LONG}</aside>',
        f'<body><form id="page"><header>Site</header>{MENU}<div>{ARTICLE}</div><footer>{LONG}</footer></form>',
    ],
)
def test_frames_are_told_by_what_they_hold(html):
    assert html_extract.main_text(html, html_extract.START).split("\n\n") == READ


def test_broken_quotes():
    text = lambda html: html_extract.main_text(f"<article>{html}</article>", html_extract.START)
    assert text('<p title="a>Hello there, reader of this page.</p><p>World of words, and more.</p>') == "Hello there, reader of this page.\n\nWorld of words, and more."
    assert text('<p title="a>Hello there.</p><p class="x">World of "quoted" words.</p>') == 'Hello there.\n\nWorld of "quoted" words.'
    assert text("""<p title="a > b" data-x='<b>y</b>'>Hello there, 1 < 2.</p>""") == "Hello there, 1 < 2."
    assert text("<p>unclosed <b") == "unclosed" and text("<p>a <!-- never closed <p>b") == "a"


@pytest.mark.parametrize("part", ["<div>word word word. ", '<p title="a>word word word. ', "<p title='>word. ", "<b><p>word. ", "</span>word <i>", "<!x <?y ", '<a href="x>', "<li><dd>word "])
def test_time_grows_with_the_length_of_broken_pages(part):
    import time

    began = time.perf_counter()
    html_extract.main_text("<article>" + part * 20_000, html_extract.START)
    assert time.perf_counter() - began < 10


def test_forward_algorithm_sums_all_segmentations():
    table = {"▁a": (0.3, 0.1), "a": (0.2, 0.3), "b": (0.1, 0.2), "ab": (0.05, 0.1), "▁ab": (0.01, 0.02), "▁": (0.04, 0.01)}
    model = langid.Model(["x", "y"], table)

    def every(word):
        if not word:
            return [()]
        return [(word[:i], *rest) for i in range(1, len(word) + 1) if word[:i] in table or i == 1 for rest in every(word[i:])]

    weight = lambda s, k: math.prod(table[p][k] if p in table else langid.UNKNOWN for p in s)
    for word in ("▁ab", "▁abab", "▁aqb", "▁abaabbababab"):
        want = [math.log(sum(weight(s, k) for s in every(word))) for k in (0, 1)]
        assert model.log_probabilities([word])[0] == pytest.approx(want)
        use = dict.fromkeys(table, 0.0)
        for s in every(word):
            for p in s:
                if p in use:
                    use[p] += 2 * weight(s, 0) / math.exp(want[0])
        got = langid._expected(model.vocabulary, [word], np.array([2.0]), model.p[:, 0])
        assert dict(zip(table, got, strict=True)) == pytest.approx(use)


def test_words_of_any_length():
    """No cut: the sum over a word of 200 or 5,000 letters in numbers without underflow, and its share in learning."""
    from decimal import Decimal

    table = {"▁a": (0.3, 0.1), "a": (0.2, 0.3), "b": (0.1, 0.2), "ab": (0.05, 0.1), "babababab": (0.01, 0.02)}
    model = langid.Model(["x", "y"], table)
    for n in (200, 5000):
        word = "▁" + "ab" * (n // 2)
        for k in (0, 1):
            ahead = [Decimal(1)]
            for j in range(1, len(word) + 1):
                known = sum(ahead[j - len(p)] * Decimal(q[k]) for p, q in table.items() if word[max(0, j - len(p)) : j] == p)
                ahead.append(known + (ahead[j - 1] * Decimal(langid.UNKNOWN) if word[j - 1] not in table else 0))
            assert model.log_probabilities([word])[0][k] == pytest.approx(float(ahead[-1].ln()))
        use = langid._expected(model.vocabulary, [word], np.array([1.0]), model.p[:, 0])
        assert sum(u * len(p) for u, p in zip(use, table, strict=True)) == pytest.approx(n, abs=2)
    wide = langid.fit({"l": ["x" * 300 + " " + "y" * 300], "m": ["z" * 300]}, ["x", "y", "z", "xxxx", "zzzz"])
    assert wide.table["x"][0] + wide.table["xxxx"][0] > 0.2 and wide.predict(["z" * 1000, "x" * 1000]) == [("m", pytest.approx(1.0)), ("l", pytest.approx(1.0))]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, PIECES, per_language=60)
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.98 and all(0 <= r.score <= 1 for r in out)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "x" * 50_000), (None, "le la de que")], "doc_id bigint, text string").withColumn("lang_pred", F.lit("q"))
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0 and got[4].lang_pred in model.languages
    assert langid.train(docs.filter("false"), PIECES).languages == [] and langid.identify(odd.filter("false"), model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.Model([], {})).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.9
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "w " * 40_000)], "doc_id bigint, text string").withColumn("score", F.lit(9))
    model = quality.train(docs, labels, per_label=60)
    got = [(r.doc_id, r.score) for r in quality.score_documents(odd, model).collect()]
    assert len(got) == 4 and len({s for i, s in got if i in (1, 2)}) == 1
    assert {r.score for r in quality.quality(odd, labels.filter("false")).collect()} == {0.5}
    assert quality.quality(odd.filter("false"), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_long_texts_are_pooled_block_by_block(monkeypatch):
    model = quality.fit(["the quiet river " * 60, "BUY!!! now $$$ " * 60] * 4, np.array([1, 0] * 4), 0.5)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "quiet", "river", "BUY!!!", "$$$"], n)) for n in (1, 700, 64 * 16, 5000)] + [""]
    want = model.scores(texts)
    monkeypatch.setattr(quality, "BLOCK_PASSAGES", 4)
    assert model.scores(texts) == pytest.approx(want, abs=1e-5)


def test_attention_gradients():
    """The fit's loss falls, and attention weighs the passages of each document to one."""
    good, bad = ["the quiet river runs to the sea " * 30] * 20, ["BUY!!! now $$$ " * 60] * 20
    model = quality.fit(good + bad, np.array([1] * 20 + [0] * 20), 0.5)
    scores = model.scores([good[0], bad[0], good[0] + bad[0]])
    assert scores[0] > 0.9 > 0.1 > scores[1]
    x, first = quality.passages([good[0], bad[0]])
    h, e = model.encode(x)
    weight, _ = model._pool(h, e, first)
    assert np.add.reduceat(weight, first[:-1]) == pytest.approx([1, 1], abs=1e-5)


def test_archives(spark, tmp_path):
    rows = [(5, "http://a b", "<p>é</p>" * 50), (3, None, "<p>é</p>" * 50), (9, "u", None), (2, "v", ""), (7, "w", "x" * 100_000), (7, "w", "x" * 100_000), (None, "n", "null id")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit("clash"))
    out = [r for r in warc.archive_and_read(pages, f"{tmp_path}/a").collect()]
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {i: (by[i].record_type, by[i].refers_to) for i in (5, 3, 9, 2, 7)} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 2), 2: ("response", None), 7: ("response", None)}
    with_payload = {r.page_id: r.payload for r in warc.read_archives(spark, f"{tmp_path}/a", payloads=True).collect()}
    assert with_payload[3].decode() == rows[0][2] and with_payload[5] is None
    assert warc.archive_and_read(pages.filter("false"), f"{tmp_path}/b").count() == 0


def test_archives_of_pages_without_id(spark, tmp_path):
    rows = [(None, "a", "same"), (1, "b", "same"), (2, "c", "same"), (None, "d", "same")]
    out = warc.archive_and_read(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"{tmp_path}/a").collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in out) == [("1", "revisit", None), ("2", "revisit", None), ("None", "response", None), ("None", "response", None)]


def test_archives_of_many_equal_rows_and_sessions_with_limits(spark, tmp_path):
    pages = spark.range(1000).selectExpr("case when id < 700 then 7 else id end as page_id", "'u' as url", "case when id < 700 then 'hot' else concat('page ', id) end as html")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        warc.write_archives(pages, f"{tmp_path}/a", file_rows=100)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    out = warc.read_archives(spark, f"{tmp_path}/a").groupBy("record_type").count().collect()
    assert [tuple(r) for r in out] == [("response", 1000)] and len(list(tmp_path.glob("a/part-*"))) >= 10


def test_archive_is_a_plain_zstandard_stream(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>page {i}</p>" * 20) for i in range(300)], "page_id bigint, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/a")
    raw = next(tmp_path.glob("a/part-*")).read_bytes()
    size = int.from_bytes(raw[4:8], "little")
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE_DICTIONARY
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).stream_reader(raw, read_across_frames=True)
    assert reader.read().count(b"WARC/1.1\r\n") == 300


def brute_links(rows, threshold=0.9):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links, label = dict.fromkeys([i for i, _ in rows], 0), {i: i for i, _ in rows}
    near = [(a, b) for a, b in itertools.combinations(sorted(unit), 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    for a, b in near:
        links[a] += 1
        links[b] += 1
    for _ in range(len(rows)):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (links[i], label[i]) for i in links}


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    rows = [(i, (centres[i % 12] + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.3])).tolist()) for i in range(150)]
    rows += [(200, None), (201, [0.0] * 64), (202, [float("nan")] * 64), (203, [None] * 64), (204, [float("inf")] * 64), (205, [1.0, 0.0]), (206, [1.0, 0.1]), (207, [])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"label": F.lit(1), "v": F.lit(2), "rep": F.lit(3)})
    out = embed.embedding_links(vectors).collect()
    assert len(out) == len(rows)
    got, want = {r.vec_id: (r.n_links, r.component_id) for r in out}, brute_links(rows)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found <= there and found >= 0.99 * there
    assert np.mean([got[i] == want[i] for i in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert embed.embedding_links(vectors.filter("false")).count() == 0


@pytest.mark.parametrize("dims, vectors", [(64, 500), (64, 50_000), (64, 10**7), (64, 10**9), (256, 10**6), (768, 10**8)])
def test_recall_of_the_index_at_the_threshold(dims, vectors):
    """Pairs whose cosine is just at the threshold share a key, stored or looked up, in any size of table."""
    rotations, tables = embed.layout(vectors, dims, 0.9)
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 300, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    assert embed.hits(a, b, rotations, tables).any(1).mean() > 0.97


def test_links_of_huge_and_tiny_vectors(spark):
    """Lengths that overflow or underflow when squared; [1, 0] and [0, 1e-200] are at a right angle."""
    rows = [(1, [1e160, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1e-200]), (4, [-1e-200, 0.0]), (5, [1e-200, 1e-200]), (6, [3e-310, 3e-310]), (7, [1.7e308, 1.7e308]), (8, [1e-320, 1e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (1, 3)}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tests.llm.test_text_ops import brute_components, lower

    out = corpus_pipeline.run(spark, SF).collect()
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.quality(docs, labels).filter("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    last = {}
    for i in sorted(rows):
        last[lower(rows[i].text)] = i
    rows = {i: rows[i] for i in last.values()}
    near = brute_components({i: r.text for i, r in rows.items()}, 80)
    rows = {i: r for i, r in rows.items() if near[i][1] == i}
    size = {i: len((r.text or "").encode().split()) for i, r in rows.items()}
    names = sorted({r.source for r in rows.values()}, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i, r in rows.items() if r.source == s) for s in names}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not full:
            break
        left -= sum(2 * total[s] for s in full)
        target |= {s: 2 * total[s] for s in full}
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    times = {}
    for s in names:
        at, budget = 0, math.floor(target[s])
        whole, part = divmod(budget, total[s])
        for i in sorted((i for i, r in rows.items() if r.source == s), key=lambda i: (hashlib.md5(f"{i}|mix".encode()).hexdigest(), i)):
            taken = whole * size[i] + max(0, min(size[i], part - at))
            at += size[i]
            if taken and (n := math.floor(taken / size[i] + 0.5)):
                times[i] = n
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].text.encode()).hexdigest() and r.n_tokens * 4 == len(r.ids)
    assert got == times


def test_stages_at_their_edges(spark, tmp_path):
    """Nulls in any column, empty texts, ties, repeated rows, clashing columns, and an empty table."""
    import corpus_pipeline

    good, kind = "a quiet text about the river and the people who live beside it in the valley", "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, f"{good} number {i} " * 3, "en", "s" if i % 2 else None, 1) for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (None, good + " lone", "en", "s", 1), (22, rows[0][1].upper(), "en", "t", 1), (3, "another text under the id three of the table", "en", "s", 1)]
    rows += [rows[1], rows[1], (30, rows[2][1] + " end", "en", "s", 1)]
    clash = {c: F.lit(7) for c in ("_gone", "_id", "_times", "_copy", "row", "id", "own", "key", "digest", "copy", "size", "kept", "times", "score")}
    docs = spark.createDataFrame(rows, kind).withColumns(clash)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.filter("false"), str(tmp_path))
        out = stage(spark, seen, str(tmp_path))
        assert none.count() == 0
        if name != "tokens":
            assert out.columns == docs.columns == none.columns
            seen = spark.createDataFrame(out.collect(), docs.schema)
        texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in seen.collect())
        if name == "quality":
            assert len(texts) == len(rows)  # no labels, nothing to reject by
        if name == "exact":
            assert (False, 0, rows[0][1]) not in texts and (False, 22, rows[0][1].upper()) in texts and texts.count((False, 1, rows[1][1])) == 3
            assert (False, 21, "") in texts and (False, 20, "") not in texts and len([t for t in texts if t[1] == 3]) == 2
        if name == "near":
            assert (False, 30, rows[2][1] + " end") not in texts and (False, 2, rows[2][1]) in texts and (False, 21, "") in texts
            assert (True, 0, good + " lone") in texts
        if name == "mixing":
            assert all(t[2] for t in texts)
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}


def test_two_pipelines_at_once(spark):
    """Each removes its own scratch tables only."""
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline
    from folioforge.llm import util

    others = set(util.written())
    keep = util.materialize(spark.range(3))
    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(lambda _: sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()), range(2))
    assert first == second and first and keep.count() == 3
    assert len(set(util.written()) - others) == 3  # the one above and the input of each last stage


def test_workers_keep_their_collector(spark):
    import gc

    from folioforge.llm import bpe

    bpe.encode_texts(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert all(r.on for r in spark.range(8).mapInPandas(lambda parts: (p.assign(on=gc.isenabled())[["on"]] for p in parts), "on boolean").collect())


def test_links_of_many_vectors_around_the_threshold(spark):
    """Nearly all balls hold one vector here."""
    import time

    rng = np.random.default_rng(8)
    middle = rng.normal(size=64)
    middle /= np.linalg.norm(middle)
    side = rng.normal(size=(400, 64))
    side -= (side @ middle)[:, None] * middle
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.sqrt(0.9) * middle + np.sqrt(0.1) * side
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, x[7].tolist()), (401, x[7].tolist())]
    began = time.perf_counter()
    got = {r.vec_id: r.n_links for r in embed.embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    y = np.array([v for _, v in rows])
    y /= np.linalg.norm(y, axis=1)[:, None]
    cos = y @ y.T
    assert not (abs(cos - 0.9) < 1e-9).any()
    want = (cos >= 0.9).sum(1) - 1
    assert sum(want) > 20_000 and sum(got[i] == n for i, n in enumerate(want)) >= 0.97 * len(want)
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.995 * sum(want)
    assert time.perf_counter() - began < 60


def test_long_words_have_the_same_sums_in_little_time(monkeypatch):
    import time

    rng = random.Random(4)
    model = langid.fit({"a": ["the river house and other words of the land"] * 3, "b": ["la maison et les autres mots"] * 3}, langid.read_pieces(PIECES), 2)
    monkeypatch.setattr(langid, "SLAB", 300)
    for n in (1, 40, 299, 300, 301, 2500):
        word = "▁" + "".join(rng.choice("abcdefghiétsnrx") for _ in range(n))
        assert np.allclose(model._forward_long(word), model._forward(langid._codes([word], len(word)))[0], rtol=1e-12, atol=1e-9)
    monkeypatch.undo()
    began = time.perf_counter()
    assert model.predict(["".join(rng.choice("acgt") for _ in range(1_000_000))])[0][0] in ("a", "b")
    assert time.perf_counter() - began < 40
