"""Main text of pages."""

import pytest

from lexifold.llm import html_main

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body>"
    "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- <p>no</p> --><div class='x7'>Site wide {host}</div>"
    "{body}<footer>&copy; {host}</footer></body></html>"
)


def text_of(html, template=frozenset()):
    return html_main.main_text(html_main.parse(html), set(template))


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><h1>A &amp; B</h1><p>one\n  two&nbsp;x</p><p>three</article>", "A & B\none two x\nthree"),
        ("<article><p><b>bold<br><p>next</p></article>", "bold\nnext"),
        ("<article><p>a<br>b</p><aside>no</aside><form><input>no</form><div class='comments'><p>no</p></div></article>", "a b"),
        ("<article><header><h1>Kept</h1></header><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></article>", "Kept\n1\n2\nx\ny"),
        ("<main><p>main</p></main><p>outside</p>", "main"),
        ("<header>no</header><p>only body</p><div class='cookie-notice'>no</div>", "only body"),
        ("<article><p>&lt;b&gt; &#233; &unknown; 1 &lt 2</p></article>", "<b> é &unknown; 1 < 2"),
        ("<article><p>first</p></article><article><p>second</p></article>", "first\nsecond"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("", ""),
    ],
)
def test_main_text(body, text):
    page = PAGE.format(body=body, host="h")
    div = [n for n in html_main._candidates(html_main.parse(page)) if n == _hash_of("<div class='x7'>Site wide h</div>")]
    assert div and text_of(page, div) == text


def _hash_of(html):
    return html_main.subtree_hash(html_main.parse(html).below[0])


@pytest.mark.parametrize(
    "html",
    [
        "<body class='has-sidebar'><article><p>kept</p></article></body>",
        "<html class='no-sidebar'><body id='menu'><p>kept</p></body></html>",
        "<body><article class='post social-post'><p>kept</p></article></body>",
        "<body><article class='promo'><p>kept</p></article></body>",
        "<main id='content-navigation'><p>kept</p></main>",
        "<div role='main' class='social'><p>kept</p></div>",
        "<div class='page with-sidebar'><div id='modal'><article><p>kept</p></article></div></div>",
        "<div class='with-sidebar'><p>kept</p></div>",
        "<article><p>kept</p><div class='comments'><article class='comment'><p>no</p></article></div></article>",
        "<div id='site-menu'>no</div><article><p>kept</p><div class='post-related'>no</div></article><p>no</p>",
    ],
)
def test_class_words_hide_no_outer_element(html):
    assert text_of(html) == "kept"


def test_template_takes_no_prose_out_of_an_article():
    html = "<article><div><section><p><strong>Note:</strong> see <a href='/x'>the <i>guide</i></a></p></section></div><span>end</span><div>Like</div></article>"
    tree = html_main.parse(html)
    todo, every = [tree], set()
    while todo:
        node = todo.pop()
        every.add(html_main.subtree_hash(node))
        todo += [n for n in node.below if isinstance(n, html_main.Node)]
    assert text_of(html, every) == "Note: see the guide\nend"
    assert text_of("<article><p>a <b>same</b> c</p></article>", {_hash_of("<b>same</b>")}) == "a same c"


@pytest.mark.parametrize(
    "html",
    [
        "<article><p>kept</p></article><article class='comment'><p>no</p></article>",
        "<section class='comments'><article><p>no</p></article></section><article><p>kept</p><p>kept</p></article>",
        "<article><p>kept, and longer than the others</p></article><div class='user-feedback'><article><p>no</p></article></div>",
        "<div class='related'><article>no</article></div><div class='promo'><article><p>kept</p><p>kept</p></article></div>",
    ],
)
def test_comments_that_are_articles_go(html):
    assert "no" not in text_of(html).split() and text_of(html).startswith("kept")


@pytest.mark.parametrize(
    "html",
    ["<p class='notice'>kept</p>", "<section id='share'><p>kept</p></section>", "<ul><li class='menu'>kept</ul>", "<h2 id='comments'>kept</h2>"],
)
def test_words_take_no_prose_out_of_an_article(html):
    assert text_of(f"<article>{html}</article>") == "kept"
    assert text_of(f"<article>{html}<div id='comments'>no</div><section class='share'><p>no</p></section></article>") == "kept"


def test_copies_of_a_page_make_no_template(spark):
    lines = "<article><div>Line one.</div><div>Line two.</div></article>"
    rows = [(i, f"http://x.org/{i}", "<div>All of</div><p>the page</p>") for i in range(5)]
    rows += [(10 + i, f"http://x.org/a{i}", lines) for i in range(5)]
    rows += [(20 + i, f"http://x.org/b{i}", f"<p>own {i}</p><div>Every page</div>") for i in range(6)]
    rows += [(30, "http://x.org/c", "<div>Every page</div>")]
    found = {r["page_id"]: r["text"] for r in html_main.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {found[i] for i in range(5)} == {"All of\nthe page"}
    assert {found[10 + i] for i in range(5)} == {"Line one.\nLine two."}
    assert [found[20 + i] for i in range(6)] == [f"own {i}" for i in range(6)]
    assert found[30] == ""


def test_deep_and_broken_markup():
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 3) == "deep"
    assert text_of("</p></div><<p>a <b>b</i> c") .endswith("c")
    assert text_of("") == text_of("<!-- x") == ""


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for i in range(30):
        body = f"<div>own {i}</div>" + ("<div>Shared sentence</div>" if i < 2 else "")
        rows.append((i, f"http://a.org/{i}", PAGE.format(body=body, host="a.org"), "x"))
        quoted = f"<article><p>everyone quotes this</p><p>own {i}</p><div class='z'>Like and follow</div></article>"
        rows.append((100 + i, f"https://B.org:80/{i}?q", PAGE.format(body=quoted, host="b"), "x"))
    rows += [(500, "http://few.org/1", PAGE.format(body="<p>few</p>", host="few"), "x")]
    rows += [(600, None, None, None), (601, "", "", "x"), (None, "nonsense", "<p>null id</p>", "x")]
    rows += [(602, "http://c.org", "<p>" + "long " * 50_000, "x")] * 2
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_templates_are_removed_by_host(pages):
    found = {}
    for r in html_main.extract_pages(pages).collect():
        assert r["n_chars"] == len(r["text"])
        found.setdefault(r["page_id"], []).append(r["text"])
    assert sum(map(len, found.values())) == pages.count()
    assert found[0] == ["own 0\nShared sentence"] and found[5] == ["own 5"]
    assert found[100] == ["everyone quotes this\nown 0"] and found[129] == ["everyone quotes this\nown 29"]
    assert found[500] == ["Site wide few\nfew"]
    assert found[600] == found[601] == [""] and found[None] == ["null id"]
    assert found[602] == [("long " * 50_000).strip()] * 2
    assert html_main.extract_pages(pages.limit(0)).count() == 0


def test_hot_hosts_are_salted(pages, monkeypatch):
    from lexifold.llm import common

    plain = sorted(map(str, html_main.extract_pages(pages).collect()))
    monkeypatch.setattr(common.JoinBound, "__init__", lambda self: [object.__setattr__(self, k, v) for k, v in (("bytes", 0), ("hot_share", 3), ("salts", 4))] and None)
    assert sorted(map(str, html_main.extract_pages(pages).collect())) == plain
