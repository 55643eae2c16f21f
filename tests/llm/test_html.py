import time
from html.parser import HTMLParser

import pytest

from brindle.llm.html import extract, main_text

P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."


def test_articles():
    page = f"<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=1>menu</a></li></ul></nav><!-- ad --><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p><b>{P}<br><p>a  b\n\tc</p><ul><li>one<li>two</ul></article><aside>{P}</aside><footer>&copy; x</footer></body></html>"
    assert main_text(page) == f"Head & more\n{P}\na b c\none\ntwo"


def test_containers_without_an_article():
    page = f"<body><div id=header><a href=/>Home</a></div><div class=nav><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><div id=content><h1>Title</h1><p>{P}<p>{P}<p>Short.</div><div id=sidebar><p>{P}</p></div><div class='comments'><p>{P} {P} {P}</p></div><form><p>{P}</p></form><div id=footer>c</div>"
    assert main_text(page) == f"Title\n{P}\n{P}\nShort."
    links = "".join(f"<p><a href=1>{P}</a></p>" for _ in range(5))
    assert main_text(f"<body><div>{links}</div><div><p>{P}</p></div></body>") == P
    assert main_text(f"<div class='cookie-notice'>{P} {P}</div><div><div class=post><p>{P}</p></div></div>") == P


def test_odd_pages(spark):
    assert main_text(None) == "" and main_text("") == "" and main_text("just &lt;text&gt; x") == "just <text> x"
    assert main_text("<p>a<div>b</p></span></td>c<table><tr><td>d") and main_text("<") == "<" and main_text("<script>x") == ""
    deep = "<div>" * 3000 + f"<p>{P}</p>"
    assert main_text(deep) == P
    rows = [(1, "u", f"<p>{P}</p>", 5), (1, "u", f"<p>{P}</p>", 5), (None, None, None, 5), (2, "v", "", None), (3, "w", "<p>é😀</p>" + "<p>x</p>" * 3000, 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got][:4] == [(1, "u", len(P)), (1, "u", len(P)), (None, None, 0), (2, "v", 0)]
    assert got[4].text.startswith("é😀\nx\n") and got[4].n_chars == len(got[4].text)
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


class Slow(HTMLParser):
    """The blocks of the article elements of a page by the library's own parser: an independent reading of plain pages."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "div", "br", "article", "section", "table", "tr", "td", "blockquote", "pre"}
    LEFT_OUT = {"script", "style", "aside", "nav", "footer", "form", "button"}
    NAMES = {"ad", "comments", "comment", "share", "related", "newsletter", "cookie", "sidebar", "promo"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.run = [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.end()
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self.open.append((tag, tag in self.LEFT_OUT or any(k in ("class", "id") and set((v or "").replace("-", " ").split()) & self.NAMES for k, v in attrs)))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.end()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(out for _, out in self.open):
            self.run.append(data)


def test_pages_against_another_parser(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows)).collect()}
    assert got == {r.page_id: "\n".join(Slow(r.html).out) for r in rows}


@pytest.mark.parametrize("page", ["<a " + '"' * 10**5, "<a " + "'\"" * 10**5 + ">x", "<a b='" * 10**5, "<p " * 10**5, "<" * 10**5, "<b>" * 10**5 + "</i>" * 10**5, "<!--" * 10**5, "<p>x" * 10**5, "<script>" * 10**5, "<a b=" + " " * 10**5, "<div>" * 10**5 + "</div>" * 10**5 + "<header>" * 10**4, "&amp" * 10**5])
def test_malformed_pages_take_linear_time(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 20


def test_siblings_of_a_container_are_kept():
    page = f"<body><h1>Title</h1><div>{''.join(f'<p>{P}</p>' for _ in range(10))}</div><h2>Part</h2><ul><li>One<li>Two</ul>loose <b>text</b><div><p>Short closing.</p></div><ul><li><a href=1>a link</a><li><a href=2>more</a></ul></body>"
    assert main_text(page) == "\n".join(["Title", *[P] * 10, "Part", "One", "Two", "loose text", "Short closing."])


def test_quotes_hold_values_together():
    assert main_text(f"<p title='a > b'>{P}</p><p title=it's>{P}</p>") == f"{P}\n{P}"
