import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from memloom.llm import rollups, sharding, warc
from memloom.llm.markup import blocks_of
from memloom.llm.shared import new_path
from memloom.llm.templates import extract_articles

PAGES = "page_id long, url string, html string, size int, digest string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark, monkeypatch):
    long = "long é " * 200_000
    rows = [(1, "http://a/1", "same", 0, ""), (5, "http://a/5", "same", 0, ""), (3, None, None, 0, ""), (4, "http://a/4", "", 0, ""), (9, "u", long, 0, ""), (None, "u", "same", 0, ""), (7, "u", "\r\n\r\nWARC/1.1\r\n", 0, "")]
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[5] == (4, digest(b"same"), "response", None)
    assert got[1] == (4, digest(b"same"), "revisit", 5) and got[None] == (4, digest(b"same"), "revisit", 5)
    assert got[4] == (0, digest(b""), "response", None) and got[3] == (0, digest(b""), "revisit", 4)
    assert got[9] == (len(long.encode()), digest(long.encode()), "response", None)
    assert got[7][1:] == (digest(b"\r\n\r\nWARC/1.1\r\n"), "response", None)


def test_warc_chunks_are_a_warc_file(spark):
    long = "x" * 700_000
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "http://a/1", long, 0, ""), (2, "http://a/2", "b", 0, "")], PAGES), path)
    chunks = spark.read.parquet(path).sort("record", "chunk").collect()
    assert sum(r["record"] == chunks[0]["record"] for r in chunks) in (1, 3)
    body = b"".join(r["data"] for r in chunks)
    assert body.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body.endswith(b"\r\n\r\n") and long.encode() in body
    assert body.count(b"WARC/1.1") == 2
    damaged = new_path(spark, "warc-test")
    spark.read.parquet(path).withColumn("data", F.expr("overlay(data PLACING X'00' FROM 600)")).write.parquet(damaged)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, damaged).collect()


def test_warc_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def page(article: str, menu: str = "Home", extra: str = "") -> str:
    return (
        f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>{menu}</a></li></ul></nav><header>Site</header>"
        f"<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; tail</h1>{article}<p>Share this story with friends</p></article><aside>Side</aside>{extra}"
        "<div id=comments><p>First!</p></div><form><p>Name</p></form><footer>&copy; me</footer></body></html>"
    )


def test_extraction(spark):
    words = ["alpha beta", "gamma", "delta epsilon zeta", "eta", "theta iota", "kappa"]
    rows = [(i, f"http://h.example/{i}", page(f"<p>{w * 9}<br>second\n\t line {i}<p>third <b>bold</b> {i}"), 0, "") for i, w in enumerate(words)]
    rows += [(20, "http://other.example/1", page("<p>only"), 0, ""), (21, None, None, 0, ""), (22, "", "", 0, ""), (23, "http://x.example/", "plain  text", 0, ""), (24, "http://x.example/2", "<p>a<script>never closed", 0, "")]
    got = {r["page_id"]: r["text"] for r in extract_articles(spark.createDataFrame(rows, PAGES)).collect()}
    for i, w in enumerate(words):
        assert got[i] == f"{w * 9}\nsecond line {i}\nthird bold {i}"
    assert got[20] == "Head & tail\nonly\nShare this story with friends"
    assert got[21] == got[22] == "" and got[23] == "plain text" and got[24] == "a"
    lengths = extract_articles(spark.createDataFrame(rows, PAGES)).where("n_chars != length(text)").count()
    assert lengths == 0
    assert extract_articles(spark.createDataFrame([], PAGES)).count() == 0


def test_articles_without_an_article_element(spark):
    inner = lambda i: f"<h1>Title {i}</h1><div class=body><h2>Part {i}</h2><p>{f'long text {i} ' * 40}</p><ul><li>item {i}</li></ul><blockquote>said {i}</blockquote><table><tr><td>cell {i}</table></div>"
    layout = lambda i: f"<section><h1>Title {i}</h1><p>other layout {i}</p></section>" if i % 7 == 6 else inner(i)
    rows = [(i, f"http://plain.example/{i}", f"<html><body><nav>Home</nav>{layout(i)}<div class=end>All rights</div></body></html>", 0, "") for i in range(14)]
    got = {r["page_id"]: r["text"].split("\n") for r in extract_articles(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(14):
        wanted = [f"Title {i}", f"other layout {i}"] if i % 7 == 6 else [f"Title {i}", f"Part {i}", f"long text {i} " * 39 + f"long text {i}", f"item {i}", f"said {i}", f"cell {i}"]
        assert [t for t in got[i] if t != "All rights"] == wanted


def test_blocks_close_as_html_does():
    texts = [b.text for b in blocks_of("<ul><li>a<li>b <i>c</i></ul><table><tr><td>d<td>e<tr><td>f</table>g<!-- x > y -->h<img alt='>'>i")]
    assert texts == ["a", "b c", "d", "e", "f", "ghi"]


def test_an_open_head_ends_where_the_body_starts():
    texts = lambda html: [(b.text, b.noise) for b in blocks_of(html)]
    head = "<!doctype html><html><head><meta charset=utf-8><title>t</title><link rel=x href=y><style>p{}</style><script>1</script>"
    for start in ("<body>", "", "</head>", "</head><body>", "\n"):
        assert texts(head + start + "<h1>One</h1><p>two<p>three") == [("One", False), ("two", False), ("three", False)]
        assert texts(head + start + "<a href=/>one</a> two") == [("one two", False)] and texts(head + start + "one <b>two</b>") == [("one two", False)]
        assert texts(head + start + "<nav>menu</nav><header>top</header>") == [("menu", True), ("top", True)]


def test_blocks_of_layout_classes():
    blocks = blocks_of("<body class='has-sidebar nav-open'><div class=page-header>x</div><article class='with-comments'><div class='article-header'><h1>a</h1></div><p>b<div class=share-bar>y</div></article></body>")
    assert [b.text for b in blocks if not b.noise] == ["a", "b"]


DOCS = "doc_id long, text string, lang string, source string, size int"


def test_names_inside_the_article_must_be_about_noise_as_a_whole():
    said = lambda html: [b.text for b in blocks_of(html) if not b.noise]
    kept = (
        "<h2 id='search-results'>a</h2><p class='share-price'>b</p><section id='social-science'>c</section><div id='related-work'>d <span class='ad-hoc'>e</span></div>"
        "<h2 id=comments>f</h2><p data-id='comments'>g</p><p>h <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math></p><p class='not-hidden'>i</p>"
    )
    want = ["a", "b", "c", "d e", "f", "g", "h x=2", "i"]
    dropped = (
        "<div class='share-bar'>1</div><div class='ad'>2</div><section id='comments-list'>3</section><div class='shareButtons top'>4</div><ul class='related-posts'><li>5</ul><div hidden>6</div>"
        "<p style='color:red; display: none'>7</p><p class='ad'>8</p><div class='cookie-notice'><p>9</p></div><div class=comment-17>10</div><div id='adv-box'>11</div>"
    )
    assert said(f"<article>{kept}{dropped}</article>") == said(f"<main>{dropped}{kept}</main>") == want
    outside = "<div id='topNav'>1</div><div class='cookiebar'>2</div><div class='hot-search'>3</div><p class='share-price'>b</p><h2 id='search'>a</h2>"
    assert said(f"<body>{outside}</body>") == ["b", "a"]


def test_deeply_nested_pages():
    blocks = blocks_of("<div>" * 3000 + "<p>x" * 500)
    assert len(blocks) == 500 and not any(b.noise for b in blocks)


def test_rollups_brute_force(spark):
    rows = [(i, " ".join(["word"] * n), lang, source, 0) for i, (n, lang, source) in enumerate([(60, "en", "a"), (10, "en", "a"), (70, None, "a"), (55, "de", None), (0, "de", "b")])]
    rows += [(9, None, "en", "a", 0), rows[0]]
    from memloom.llm.tokens import encoder

    wanted = {}
    for _, text, lang, source, _ in rows:
        n = len((text or "").split())
        if n >= 50:
            for version, count in (("words", n), ("byte_bpe_50k", len(encoder()(text)) + 1)):
                docs, tokens = wanted.get((source, lang, version), (0, 0))
                wanted[source, lang, version] = (docs + 1, tokens + count)
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in rollups.corpus_rollups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == wanted
    assert rollups.corpus_rollups(spark.createDataFrame([], DOCS)).count() == 0


def test_rollup_batches_count_once(spark):
    kinds = "change string, kind string, source string, lang string, version string, tokens long, old_tokens long"
    book = rollups.TokenRollups(spark, new_path(spark, "rollup-test"))
    assert book.totals().count() == 0
    first = spark.createDataFrame([("1", "insert", "a", "en", "v", 10, None), ("1", "insert", "a", "en", "v", 10, None), ("2", "insert", "a", "en", "v", 5, None)], kinds)
    assert book.commit("x", first) and not book.commit("x", first)
    assert [tuple(r) for r in book.totals().collect()] == [("a", "en", "v", 2, 15)]
    assert book.commit("y", spark.createDataFrame([("3", "revise", "a", "en", "v", 7, 10), ("4", "delete", "a", "en", "v", 5, None)], kinds))
    assert [tuple(r) for r in book.totals().collect()] == [("a", "en", "v", 1, 7)]
    with pytest.raises(Exception, match="unknown kind"):
        book.commit("z", spark.createDataFrame([("5", "upsert", "a", "en", "v", 7, 10)], kinds))
    assert [tuple(r) for r in book.totals().collect()] == [("a", "en", "v", 1, 7)]


def test_sharding(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 17 + 1), "en", "s", 0) for i in range(3000)] + [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (None, "x", "en", "s", 0), (1, rows_text := "again", "en", "s", 0), (1, rows_text, "en", "s", 0)]
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).toArrow().to_pylist()
    assert len(out) == len(rows) and {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    sizes = {}
    for r in out:
        sizes.setdefault(r["shard"], []).append(r)
    assert set(sizes) == set(range(16))
    total = sum(r["size"] for r in out)
    assert total == sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    for members in sizes.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / 16) < 0.1 * total / 16
    assert out and sorted(map(str, out)) == sorted(map(str, sharding.shard_documents(spark.createDataFrame(rows, DOCS)).toArrow().to_pylist()))
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
    few = sharding.shard_documents(spark.createDataFrame(rows[:2], DOCS)).collect()
    assert len(few) == 2
