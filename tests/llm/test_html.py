"""Extraction on small pages; templates against a plain count; the given pages against another parser."""

import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from sitescan.llm.html import extracted, main_text, templates, walk

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p><b>One
 two<br><p>Three &lt;four&gt; caf&eacute; <i>five</i>six</p><aside>Side</aside><div class="cookie-notice"><p>Cookies</p></div>
<ul><li>a<li>b</ul><form>F<input></form><section class="comments"><p>me too</p></section></article>
<footer>&copy; F</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "A & B\n\nOne two\n\nThree <four> café fivesix\n\na\n\nb"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p> \n </p>") == ""
    assert main_text("<p>1 < 2 &am") == "1 < 2 &am"
    assert main_text("<p>a<p>b</artic") == "a\n\nb"
    assert main_text("<p>a<!-- cut") == "a"
    assert main_text("<p>a</p><script>cut") == "a"
    assert main_text("x" * 200_000) == "x" * 200_000
    assert main_text("<div>" * 3000 + "deep") == "deep"


def site():
    rows = []
    for i in range(12):
        box = "<div><span>Our shop</span> sells</div>" if i < 9 else ""
        rows.append((i, "https://H.example:80/p", f"<body>{box}<div><p>text {i}</p><p>again</p></div></body>", "x"))
    return [*rows, (20, None, rows[0][2], "x"), (21, "https://o.example/", rows[0][2], "x"), (22, "u", None, "x"), (0, rows[0][1], rows[0][2], "x")]


def test_templates_are_deleted_per_host(spark):
    df = spark.createDataFrame(site(), "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in extracted(df).collect()}
    assert got[1, "https://H.example:80/p"] == "text 1"  # the repeated line is a subtree of its own here
    assert got[20, None] == "Our shop sells\n\ntext 0\n\nagain"
    assert got[22, "u"] == ""
    assert extracted(df).count() == len(site())
    found = {(r.host, r.hash) for r in templates(df).collect()}
    count = Counter(h for html in {r[2] for r in site()[:12]} for h in walk(html)[1])
    assert found == {("h.example", h) for h, n in count.items() if n >= 5 and n >= 0.3 * 12}
    # the same where templates are joined to the pages
    assert sorted(extracted(df, most_shipped=0).collect(), key=str) == sorted(extracted(df).collect(), key=str)
    assert extracted(df.limit(0)).count() == 0


def test_repeated_paragraphs_of_an_article_stay(spark):
    rows = [(i, "http://h/", f"<article><p>same</p><p>{i}</p></article><div>foot</div>") for i in range(10)]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"same\n\n{r.page_id}" for r in got)


def test_class_rules_take_whole_names_and_spare_the_page():
    assert main_text("<body class='no-sidebar'><p>a</p></body>") == "a"
    assert main_text("<article class='post comments-open'><p>a</p></article>") == "a"
    assert main_text("<html class='has-header'><body class='sidebar'><main id='search'><p>a</p></main></body></html>") == "a"
    assert main_text("<div id='page' class='has-header'><div class='entry-header'><h1>h</h1></div><p>a</p></div>") == "h\n\na"
    assert main_text("<div class='sidebar'><article><p>a</p></article></div>") == "a"
    assert main_text("<div class='widget'><div class='share'><p>x</p></div><main><p>a</p></main></div>") == "a"
    assert main_text("<article><p>a</p></article><div class='comments'><article><p>me too</p></article></div>") == "a"
    assert main_text("<article><p>a</p><div class='main-nav'><p>n</p></div><div class='ad box'><p>b</p></div></article>") == "a"


def test_notices_in_articles_and_sections_of_large_hosts_go(spark):
    rows = [(i, "http://big/", f"<body>{'<div><p>Section menu</p><p>more</p></div>' if i % 4 == 0 else ''}<article><p>Our notice</p><p>{i}</p><p>{i // 2}</p></article><p>{i} end</p></body>") for i in range(3000)]
    rows += [(9000 + i, "http://flat/", f"<body>{'<div><p>Section menu</p><p>more</p></div>' if i % 4 == 0 else ''}<div><p>text {i}</p><p>end</p></div></body>") for i in range(3000)]
    rows += [(20_000 + i, "http://few/", f"<body><div><p>Shop</p><p>sells</p></div><div><p>{i}</p><p>x{i}</p></div></body>") for i in range(3)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{i}\n\n{i // 2}" for i in range(3000))
    assert all(got[9000 + i] == f"text {i}" for i in range(3000))
    assert all(got[20_000 + i] == f"{i}\n\nx{i}" for i in range(3))


def test_menus_with_changing_entries_are_templates(spark):
    link = lambda i: f"<li><a href='/{i}'>entry {i}</a></li>"
    rows = [(i, "http://h/", f"<body><div id='top'><ul>{''.join(link(7 * i + k) for k in range(3 + i % 3))}</ul></div><div><p>text {i}</p><p>end {i}</p></div><footer>f {i}</footer></body>") for i in range(40)]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"text {r.page_id}\n\nend {r.page_id}" and r.n_removed == 2 for r in got)


def test_depth_costs_no_more_than_length():
    for page in ("<div>" * 16_000 + "deep", "<i><div>" + "<b></i>" * 16_000, "<div class=ad>" * 8_000 + "<main>x</main>"):
        began = time.process_time()
        walk(page)
        assert time.process_time() - began < 1


class Articles(HTMLParser):
    """The article's blocks of pages whose only parts are nav, div.ad, article and footer."""

    def __init__(self):
        super().__init__()
        self.blocks, self.now, self.inside = [], [], False

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.blocks += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "div", "ul", "li"):
            self.cut()
        elif tag == "br" and self.inside:
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_given_pages_against_another_parser(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    try:
        pages = spark.read.parquet(path)
    except Exception:
        pytest.skip("no test data")
    html = {r.page_id: r.html for r in pages.collect()}
    removed = 0
    for r in extracted(pages).collect():
        other = Articles()
        other.feed(html[r.page_id] or "")
        other.close()
        assert r.text == "\n\n".join(other.blocks)
        removed += r.n_removed > 0
    assert removed > len(html) / 2
