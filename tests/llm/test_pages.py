"""Wrappers over pages, and the audit of archives made of them."""

import gzip
import hashlib
import html
import random
import re
import sys
import time

import pytest
from plumbline.llm.fixity import audit, read_leaves, record_spans
from plumbline.llm.wrappers import (
    common,
    common_of_long,
    expression,
    extract_main_text,
    infer,
    infer_wrappers,
    packed,
    read_page,
    rules,
    unpacked,
)

TABLES = "/root/testdata/sf0.01"


def test_alignment_makes_slots_options_and_groups():
    wrapper = infer(
        [
            "<nav>x</nav><div class=c><p>a<p>b</div><div class=z>z</div>",
            "<nav>x</nav><div class=c><p>c<h2>q</h2><p>d<p>e</div>",
        ]
    )
    assert expression(wrapper) == (
        '<#root><nav>"x"</nav> <div.c>(<p>#text</p>)+ (<h2>"q"</h2>)? (<p>#text</p>)*</div> (<div.z>"z"</div>)?</#root>'
    )


def test_a_group_of_two_is_repeated():
    wrapper = infer(["<dl>" + "<dt>k<dd>v" * 5 + "</dl>", "<dl><dt>a<dd>b</dl>"])
    assert expression(wrapper) == "<#root><dl>(<dt>#text</dt>)+ (<dd>#text</dd>)+</dl></#root>"


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header>
    <nav><a>Menu</a></nav><div class="ad">Buy</div><aside>Side</aside><!-- <p>no</p> --><script>var a="</p><p>x";</script>
    <article><h1>Head &amp; more</h1><p>One&nbsp;<b>two</b>
    three<br>four<p>Fi<i>ve</i> &lt;6&gt; &copy <form><input>Mail</form><ul><li>seven<li>eight</ul>
    <section id="comments"><article class="comment">Bad</article></section><div class="newsletter-signup">Join</div>
    <table><tr><td>a<td>b</table></article><div class="cookie-notice">Cookies</div><footer>End</footer></body></html>"""
    want = "Head & more\nOne two three four\nFive <6> ©\nseven\neight\na\nb"
    assert read_page(page, rules(infer([page]))) == want
    assert read_page(page, None) == want


def page_of(i):
    words = "word " * 40
    return f"<body><div id=top>Our site</div><div class=post><h1>Title {i}</h1><p>{words}{i}<p>More {i}</div><div>Imprint</div></body>"


def test_wrapper_finds_the_article_without_landmarks():
    found = rules(infer([page_of(i) for i in range(4)]))
    assert found["main"] == [["#root", "body", "div.post"]]
    assert read_page(page_of(9), found) == f"Title 9\n{'word ' * 40}9\nMore 9"


def test_template_texts_in_the_container_are_left_out():
    pages = [f"<body>Site name<p>{'text ' * 30}{i}<p>Contact us</body>" for i in range(4)]
    found = rules(infer(pages))
    assert read_page(pages[1], found) == f"{'text ' * 30}1\nContact us" or read_page(pages[1], found) == f"{'text ' * 30}1"
    assert "Site name" not in read_page(pages[1], found)


@pytest.mark.parametrize(
    "page", ["", "<", "<p", "text only", "<p>a</b></i>" * 3000, "<div>" * 30_000 + "x", '<a b="' * 3000, "<!--", "<script>x", "<b>x</i>" * 5000]
)
def test_broken_pages_are_read(page):
    read_page(page, None)


def test_extracted_rows(spark):
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    found = {r.page_id: r for r in extract_main_text(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert found[r.page_id].text == want and found[r.page_id].n_chars == len(want)


def test_odd_pages(spark):
    rows = [(1, "http://a.example/x", None), (2, None, "<article>Hi</article>"), (2, None, "<article>Hi</article>"), (None, "http://a.example/", "")]
    rows += [(9, "http://a.example/long", "<article>" + "<p>word" * 30_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "clash", "x", 1) for r in rows], "page_id long, url string, html string, text string, rules string, host int")
    for limit in (16 << 20, 0):
        found = extract_main_text(pages, broadcast_bytes=limit)
        assert found.columns == ["page_id", "url", "text", "n_chars"]
        got = sorted((r.page_id or 0, r.text[:4], r.n_chars) for r in found.collect())
        assert got == [(0, "", 0), (1, "", 0), (2, "Hi", 2), (2, "Hi", 2), (9, "word", 30_000 * 5 - 1)]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_every_different_page_of_a_host_is_aligned(spark):
    """Copies that would fill a sample, two templates, and a text that only some pages share."""
    words = "word " * 40
    rows = [page_of(0)] * 300
    rows += [page_of(i).replace("Imprint", "Imprint" if i % 50 else "Legal") for i in range(1, 200)]
    rows += [f"<body><div id=top>Our site</div><div class=story><div>By us</div><p>{words}{i}<p>More {i}</div><div>Imprint</div></body>" for i in range(150)]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    for group_pages in (5, 64):
        wrappers = infer_wrappers(pages.repartition(7), group_pages=group_pages).collect()
        assert [(r.host, r.pages) for r in wrappers] == [("a.example", 350)]
        found = {r.page_id: r.text for r in extract_main_text(pages, group_pages=group_pages).collect()}
        assert found[7] == found[8] == f"Title 0\n{words}0\nMore 0"
        assert found[350] == f"Title 51\n{words}51\nMore 51"
        assert found[510] == f"{words}11\nMore 11"


def test_copies_of_one_page_are_read_like_the_page(spark):
    pages = spark.createDataFrame([(i, "http://a.example/", page_of(1)) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in extract_main_text(pages).collect()} == {f"Title 1\n{'word ' * 40}1\nMore 1"}


def test_pages_beside_the_landmark_keep_the_template(spark):
    pages = [page_of(i) for i in range(20)] + ["<body><div id=top>Our site</div><article>Teaser</article></body>"]
    found = rules(infer(pages))
    assert read_page(pages[-1], found) == "Teaser"
    assert read_page(pages[3], found) == f"Title 3\n{'word ' * 40}3\nMore 3"


@pytest.mark.parametrize("depth", [70, 2000])
def test_deep_pages_keep_blocks_and_landmarks(depth):
    inner = "<p>one</p><p>two</p>"
    assert read_page("<div>" * depth + inner, None) == "one\ntwo"
    pages = ["<div>" * depth + f"<div>Site</div><article>{inner}{i}</article>" for i in range(4)]
    found = rules(infer(pages))
    assert found["main"] == [["#root", *["div"] * depth, "article"]]
    assert read_page(pages[2], found) == read_page(pages[2], None) == "one\ntwo\n2"
    wrapper = infer(pages)
    assert expression(unpacked(packed(wrapper))) == expression(wrapper)


def test_unclosed_divs_lose_no_more_than_a_share():
    assert read_page("".join(f"<div>text {i:03}" for i in range(300)), None).count("text") >= 0.6 * 300


def test_wrappers_keep_their_form_when_packed():
    wrapper = infer([page_of(i) for i in range(4)])
    assert unpacked(packed(wrapper)) == wrapper


LEAVES = "file string, offset long, length long, digest string, node int, bucket string"


def leaf(file, offset, digest="d", length=10):
    return (file, offset, length, digest, 1, "clash")


@pytest.mark.parametrize("range_bytes", [64, 1 << 16])
def test_audit_finds_what_differs(spark, range_bytes):
    rows = [leaf(f"f{i % 40}", 100 * i, f"d{i}") for i in range(2000)]
    left = [*rows, rows[5], leaf(None, 3), leaf("f1", None)]
    right = [r for i, r in enumerate(rows) if i not in (7, 1500)]
    right[20] = leaf(right[20][0], right[20][1], "other")
    right += [rows[5], leaf("f39", 10**9, "more"), leaf("new", 0)]
    right[100] = leaf(right[100][0], right[100][1], None)
    frames = [spark.createDataFrame(r, LEAVES) for r in (left, right)]
    found = audit(*frames, range_bytes=range_bytes).collect()
    want = {(rows[7][0], 700, "missing"), (rows[1500][0], 150_000, "missing"), ("f39", 10**9, "extra"), ("new", 0, "extra")}
    changed = {(rows[i][0], 100 * i, "changed") for i in (21, 101)}
    assert {(r.file, r.offset, r.status) for r in found} == want | changed and len(found) == 6


def test_audit_of_equal_empty_and_repeated_replicas(spark):
    frame = spark.createDataFrame([leaf("a", 0), leaf("a", 10, "e"), leaf("b", 0)], LEAVES)
    assert audit(frame, frame).count() == 0
    assert audit(frame.limit(0), frame.limit(0)).count() == 0
    assert {r.status for r in audit(frame, frame.limit(0)).collect()} == {"missing"}
    assert [(r.file, r.status) for r in audit(frame, frame.union(frame.where("file = 'b'"))).collect()] == [("b", "changed")]


def record(name, body):
    head = f"WARC/1.1\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return head + body + b"\r\n\r\n"


def test_archives_are_read_by_record(spark, tmp_path):
    records = [record(f"r{i}", b"x" * (50 * i) + b"\r\n\r\nWARC/") for i in range(30)]
    for side in ("one", "two"):
        (tmp_path / side / "sub").mkdir(parents=True)
        bad = [r.replace(b"xxx", b"xyx", 1) if side == "two" and i == 12 else r for i, r in enumerate(records)]
        (tmp_path / side / "plain.warc").write_bytes(b"".join(bad))
        (tmp_path / side / "sub" / "zipped.warc.gz").write_bytes(b"".join(gzip.compress(r, mtime=0) for r in bad))
    spans = list(record_spans(b"".join(records)))
    assert [r for _, _, r in spans] == records and spans[3][0] == sum(map(len, records[:3]))
    assert [n for _, n, _ in record_spans(b"".join(records) + b"WARC/broken")][-1] == 11
    assert list(record_spans(b"")) == []
    leaves = [read_leaves(spark, str(tmp_path / side)) for side in ("one", "two")]
    digests = {r.digest for r in leaves[0].collect()}
    assert digests == {hashlib.sha256(r).hexdigest() for r in records}
    found = audit(*leaves).collect()
    assert ("plain.warc", sum(map(len, records[:12])), "changed") in {(r.file, r.offset, r.status) for r in found}
    assert {r.file for r in found} == {"plain.warc", "sub/zipped.warc.gz"}


ARTICLE = "<h1>Title of it</h1><p>First words of the article, a whole line of them.</p><p>And then the second line.</p>"
COMMENTS = "<div class='comments'><p>I liked it.</p></div>"
WANTED = "Title of it\nFirst words of the article, a whole line of them.\nAnd then the second line."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><article>{ARTICLE}</article><aside>More</aside></div>{COMMENTS}',
        f'<article class="post no-comments">{ARTICLE}</article>{COMMENTS}',
        f'<nav>Home</nav><div id="search-engine-history">{ARTICLE}{COMMENTS}</div>',
        f'<form action="/x"><div>{ARTICLE}</div><input name="q">{COMMENTS}</form>',
        f'<div class="subscribe-layout"><div class="has-sidebar"><main>{ARTICLE}</main></div>{COMMENTS}</div>',
        f'<article>{ARTICLE}</article><div id="comments"><article class="comment">Nice one.</article></div>',
        f'<div id="body-text">{ARTICLE}</div><form>Search here</form>{COMMENTS}<div class="share">Share it</div>',
    ],
)
def test_class_words_cost_no_article(page):
    assert read_page(f"<html><body>{page}</body></html>", None) == WANTED


def test_references_end_with_their_text():
    assert read_page("<article><p>a&<b>amp;</b> b &amp;<i>lt;</i> &eacute;</p></article>", None) == "a&amp; b &lt; é"


def test_lines_of_the_template_leave_articles_by_the_wrapper(spark):
    def page(n):
        body = "".join(f"<p>Line {k} of text {n * 31 + k}, with more words of its own.</p>" for k in range(4))
        return f"<html><body><article><h2>Page {n}</h2>{body}<p>Like this on our site</p></article></body></html>"

    rows = [(n, f"http://one.example/{n}", page(n)) for n in range(20)]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(20):
        lines = read_page(page(n), None).split("\n")
        assert lines[-1] == "Like this on our site"
        assert found[n].split("\n") == lines[:-1]
    # Pages that are nearly copies have no template to speak of: nothing is lost.
    near = [(n, f"http://two.example/{n}", page(3).replace("Page 3", f"Page {n}")) for n in range(20)]
    kept = extract_main_text(spark.createDataFrame(near, "page_id long, url string, html string")).collect()
    assert all(r.text.count("\n") == 5 for r in kept)


def test_alignment_is_longest_at_any_size():
    rng = random.Random(6)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for n, m in ((0, 5), (1, 1), (7, 90), (60, 60), (150, 140)):
        a, b = ([rng.choice("pdsla") for _ in range(k)] for k in (n, m))
        for bits in (1 << 28, 500, 1):
            found = common_of_long(a, b, bits)
            assert all(a[x] == b[y] for x, y in found) and found == sorted(set(found))
            assert len({x for x, _ in found}) == len({y for _, y in found}) == len(found) == length(a, b) == len(common(a, b))
    a, b = ([rng.choice("pdsla") for _ in range(1001)] for _ in range(2))
    assert len(common(a, b)) == length(a, b)


def test_every_differing_record_of_a_place_has_a_row(spark):
    schema = "file string, offset long, length long, digest string"
    left = spark.createDataFrame([("f", 0, 5, "a"), ("f", 0, 5, "b"), ("f", 0, 6, "c"), ("f", 9, 1, "x")], schema)
    right = spark.createDataFrame([("f", 0, 5, "b"), ("f", 0, 7, "d"), ("f", 9, 1, "x"), ("f", 9, 1, "x")], schema)
    found = sorted((r.offset, r.status, r.left_digest or "", r.right_digest or "") for r in audit(left, right).collect())
    assert found == [(0, "changed", "a", "d"), (0, "missing", "c", ""), (9, "changed", "x", "x")]
    lost = audit(left, right.where("digest = 'x'").limit(1)).collect()
    assert [(r.status, r.left_digest) for r in sorted(lost, key=lambda r: r.left_digest)] == [("missing", d) for d in "abc"]


def test_a_large_archive_is_read_in_linear_time():
    member = gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + random.Random(1).randbytes(40_000))
    data = member * 1500  # 60 MB
    started = time.monotonic()
    spans = [(at, n) for at, n, _ in record_spans(data)]
    assert spans == [(i * len(member), len(member)) for i in range(1500)]
    assert time.monotonic() - started < 10
    cut = list(record_spans(member + member[:-4]))
    assert [(at, n) for at, n, _ in cut] == [(0, len(member)), (len(member), len(member) - 4)]


def test_a_page_costs_few_calls(spark):
    """A tag is matched, described and aligned by few calls, however many pages its host has."""
    pages = [r.html for r in spark.read.parquet(f"{TABLES}/pages.parquet").orderBy("page_id").limit(64).collect()]
    tags = sum(page.count("<") for page in pages)
    found: dict = {}

    def calls(work) -> float:
        seen = 0

        def count(frame, event, arg):
            nonlocal seen
            seen += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            work()
        finally:
            sys.setprofile(None)
        return seen / tags

    assert calls(lambda: found.update(rules(infer(pages)))) < 40
    assert calls(lambda: [read_page(page, found) for page in pages]) < 20
