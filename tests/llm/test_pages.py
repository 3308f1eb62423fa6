"""Operators 6 and 8."""

import base64
import hashlib

import pytest

from tallyline.llm import html_extract, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav><div class="ad">buy</div><div id="cookie-notice">cookies</div>
<article><h1>Head &amp; line</h1><p>One <b>bold</b> word.<br>Next<p>Two &lt;three&gt; &eacute;<ul><li>a<li>b</ul><form>x</form><aside>side</aside><!-- c --><div class="comments"><p>reader</p></div></article>
<footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("page, blocks", [(PAGE, ["Head & line", "One bold word. Next", "Two <three> é", "a", "b"]), ("", []), ("plain  text", ["plain text"]), ("<p>a<p>b", ["a", "b"]), ("<main><p>in</p></main><p>out</p>", ["in"]), ("<div>x <span>y</span> z</div>", ["x y z"]), ("<p>a &am</p><article", ["a &am", "<article"]), ("<a title='>'>t</a>", ["t"]), ("<script>never ends", [])])
def test_blocks(page, blocks):
    assert html_extract.content_blocks(html_extract.parse(page)) == blocks


def test_all_articles_and_the_main_text_around_them():
    page = "<nav>menu</nav><main><h1>Headline</h1><p>lead</p><article><p>first one</p><article class='comment'><p>reader</p></article></article><p>between</p><article><p>second, longer one</p></article></main><p>out</p>"
    assert html_extract.content_blocks(html_extract.parse(page)) == ["Headline", "lead", "first one", "between", "second, longer one"]
    assert html_extract.content_blocks(html_extract.parse("<article>a</article><p>x</p><article>b</article>")) == ["a", "b"]


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    assert html_extract.content_blocks(html_extract.parse(deep)) == ["text"]
    assert len(html_extract.content_blocks(html_extract.parse("<p>x</p>" * 20000))) == 20000


def test_tree_matching():
    a, b = (html_extract.parse(f"<div><p>same</p><p>{x}</p></div><p>{y}</p>") for x, y in (("one", "t"), ("two", "t")))
    texts = {id(z): z.text for z in html_extract.leaves(a)}
    assert sorted((texts[k], equal) for k, equal in html_extract.matched(a, b)) == [("one", False), ("same", True), ("t", True)]


def test_template_is_taken_out(spark):
    """A line that stands on every page of a host is no content; the same line on another host's page is."""
    html = lambda k: f"<body><div>Follow our news</div><div><p>text {k} of many</p></div></body>"
    rows = [(k, f"http://a.example/{k}", html(k)) for k in range(30)] + [(99, "http://b.example/1", html(99)), (100, None, None), (101, "http://a.example/x", "")]
    found = {r["page_id"]: r["text"] for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[5] == "text 5 of many" and found[99] == "Follow our news\ntext 99 of many"
    assert found[100] == found[101] == "" and len(found) == len(rows)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_extract.extracted(none).count() == 0
    assert warc.read_back(warc.archived(none)).count() == 0


@pytest.mark.parametrize("least", [0, 3])
def test_archive(spark, least):
    rows = [(5, "u\r\nWARC-Type: x", "same"), (2, "v", "same"), (9, None, "same"), (1, "w", None), (3, "w", ""), (4, "z", "ñ漢"), (4, "z", "ñ漢"), (None, "q", "alone"), (7, "k", "ab"), (8, "k", "ab")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.archived(pages, least=least)
    payloads = [bytes(r["payload"]) for r in archive.payloads.collect()]
    assert len(payloads) == len(set(payloads)) == len({(h or "") for *_, h in rows})
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    wanted = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = first.get(h or "", i) != i
        wanted.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, True))
    got = warc.read_back(archive).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["verified"]) for r in got), key=repr) == sorted(wanted, key=repr)
    for r in got:
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        if r["record_type"] == "response":
            assert body[:-4] in payloads


@pytest.mark.parametrize("page", ['<div class="content has-sidebar"><p>the text</p></div>', '<article class="post with-comments"><p>the text</p></article>', '<div class="share-price-report"><p>the text</p></div>', '<div class="sidebar"><main><p>the text</p></main></div>', '<div class="no-sidebar page"><article><p>the text</p></article></div>'])
def test_names_that_say_nothing(page):
    assert html_extract.content_blocks(html_extract.parse(page)) == ["the text"]


@pytest.mark.parametrize("page", ['<div class="site-footer">x</div>', '<ul class="nav-menu"><li>x</ul>', '<div id="comments_list">x</div>', '<section class="related-posts wrap2">x</section>', '<div class="cookie-notice">x</div>', "<div>" * 200 + "<nav>x</nav>" + "</div>" * 200])
def test_names_and_elements_that_drop(page):
    assert html_extract.content_blocks(html_extract.parse(page + "<p>the text</p>")) == ["the text"]


def plain_match(a, b):
    """Simple tree matching by its definition."""
    if a.tag != b.tag:
        return 0
    if a.tag == "#":
        return 1 + (a.text == b.text)
    table = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain_match(x, y))
    return 1 + table[-1][-1]


def test_matching_is_the_heaviest():
    import random

    r = random.Random(3)

    def tree(depth):
        return "".join(r.choice(["x", "y", "z"]) if depth == 0 or r.random() < 0.4 else f"<{t}>{tree(depth - 1)}</{t}>" for t in (r.choice(["div", "ul", "section"]) for _ in range(r.randint(1, 4))))

    for _ in range(60):
        a, b = html_extract.parse(tree(3)), html_extract.parse(tree(3))
        found = html_extract.Matching(a, b)
        found.texts()
        assert found.known(a, b) == plain_match(a, b)


def test_long_lists_are_matched():
    """300 children on either side, and 20,000; equal ones between others."""
    for n in (300, 20_000):
        page = lambda k: "".join(f"<p>{'same' + str(i) if i % 3 == 0 else f'own {k} {i}'}</p>" for i in range(n))  # noqa: B023, E731
        a, b = html_extract.parse(page(1)), html_extract.parse(page(2))
        found = html_extract.matched(a, b)
        assert len(found) == n and sum(equal for _, equal in found) == (n + 2) // 3


def test_long_lists_have_the_heaviest_match():
    """Long lists without a child that is equal and alone in both, so the cuts at equal children that were made before lose weight."""
    import random

    r = random.Random(4)
    for n, item in ((230, "<p>{}</p>"), (230, "{}<hr>"), (215, "<div>{}<ul><li>x</li></ul></div>")):
        pages = ["".join(item.format(r.choice("abcdefgh")) if r.random() < 0.9 else "<h2>t</h2>" for _ in range(n)) for _ in range(2)]
        a, b = (html_extract.parse(x) for x in pages)
        found = html_extract.Matching(a, b)
        texts = found.texts()
        assert found.known(a, b) == plain_match(a, b)
        assert len(texts) == len({k for k, _ in texts})


def test_match_is_the_same_by_numpy_and_by_loops(monkeypatch):
    import random

    r = random.Random(6)
    pages = ["".join(r.choice(["<p>a</p>", "<p>b</p>", "<div>a<p>c</p></div>", "<div><div>b</div><p>c</p></div>", "text<hr>"]) for _ in range(60)) for _ in range(2)]
    found = []
    for cells in (0, 10**9):
        monkeypatch.setattr(html_extract, "VECTORS", cells)
        a, b = (html_extract.parse(x) for x in pages)
        place = {id(x): k for k, x in enumerate(html_extract.leaves(a))}
        found.append([(place[k], equal) for k, equal in html_extract.matched(a, b)])
    assert found[0] == found[1]


def test_template_texts_stay_elsewhere(spark):
    """A sentence of the article that is the template's text at another place is kept."""
    html = lambda k: f"<body><div>Follow our news</div><article><p>text {k}</p>{'<p>Follow our news</p>' if k == 5 else ''}</article><section>Follow our news</section></body>".replace("<article>", "<div class=text>").replace("</article>", "</div>")
    rows = [(k, f"http://a.example/{k}", html(k)) for k in range(30)]
    found = {r["page_id"]: r["text"] for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[5] == "text 5\nFollow our news" and found[6] == "text 6"


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</p>" * 60_000, "<div>" * 60_000 + "</span>" * 60_000, "a<p " * 200_000, "<span>" * 60_000 + "<hr>" * 60_000, "<span><article>" + "<div>" * 60_000 + "</span>" * 60_000, '<a ">" ' * 100_000, "<script>" + "</script " * 100_000])
def test_parsing_is_linear(page):
    import time

    start = time.process_time()
    html_extract.placed_blocks(html_extract.parse(page))
    assert time.process_time() - start < 8


@pytest.mark.parametrize("page, blocks", [
    ("<form id=aspnetForm><div><h1>Title</h1><p>the story of the page</p></div><input></form>", ["Title", "the story of the page"]),
    ("<form><nav>menu</nav><article><p>story</p><form>x</form></article></form>", ["story"]),
    ("<p>the story of the page</p><form><p>your name</p></form>", ["the story of the page"]),
    ("<div class=content>the long story of the page</div><section><article>Teaser</article></section>", ["the long story of the page", "Teaser"]),
    ("<div class=topbar>x</div><div class=siteFooter>x</div><div class=adbox>x</div><div class=gdpr-bar>x</div><p>story</p>", ["story"]),
    ('<p>a</p><a title="never ends>b</a><p>c</p>', ["a", "b", "c"]),
])
def test_forms_teasers_and_names(page, blocks):
    assert html_extract.content_blocks(html_extract.parse(page)) == blocks


def test_texts_of_deep_places_have_their_own_paths():
    deep = lambda tag: "<div>" * 400 + f"<{tag}>x</{tag}>" + "</div>" * 400
    one, two = (list(html_extract.placed_leaves(html_extract.parse(deep(tag))))[0][1] for tag in ("section", "ul"))
    assert one != two
