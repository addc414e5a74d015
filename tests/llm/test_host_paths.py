"""Main text of pages: odd markup, votes of hosts, the given pages against a plain reading."""

import html
import re

from tidebook.llm import host_paths as hp


def text(page):
    return hp.chosen(hp.blocks(page), None)


def test_furniture_goes_and_the_article_stays():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div><div id=sidebar-left><p>Side</p></div>
    <!-- <p>no</p> --><article class="post-12"><header><h1>Head &amp; line</h1></header><p>One  <b>two</b>
    three<br>four<p>Five &lt;six&gt; &amp seven<div class="ad">Buy</div><ul><li>a<li>b</ul><blockquote>said</blockquote><form><input><p>mail</p></form>
    <section class="comments"><p>First!</p></section><footer>by me</footer></article><aside>more</aside><footer>&copy; all</footer></body></html>"""
    assert text(page) == "Head & line\n\nOne two three four\n\nFive <six> & seven\n\na\n\nb\n\nsaid"


def test_odd_markup():
    assert text("") == "" and text("<") == "<" and text("plain words") == "plain words"
    assert text("<p>a</p></div></div><p>b") == "a\n\nb"
    assert text('<p title="a>b">x</p><p title=it\'s>y</p><p class="unclosed>z</p>') == "x\n\ny\n\nz"
    assert text("<p>a<script>if (1 < 2) {}") == "a"
    assert text("<p>a<!-- never closed <p>b") == "a"
    assert text("<P>A</P><DIV>B<SPAN CLASS='ad'>no</SPAN>C</DIV>") == "A\n\nBC"
    assert text("<p>x &am") == "x &am" and text("<p>&#8364;&eacute;&nbsp;z") == "€é z"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"


def test_sections_are_one_article():
    page = "<body><div id=x><h1>t</h1><div class='sec-1'><p>" + "a " * 50 + "</p></div><div class='sec-2'><p>" + "b " * 50 + "</p></div></div></body>"
    assert hp.vote(hp.blocks(page))[0] == ">body>div"
    assert text(page).startswith("t\n\na a")


WORDS = "The harbour opened late and the boats waited outside. "


def test_wrappers_with_marking_names_keep_their_text():
    for page in (
        "<body><div class='elementor-widget-container'><p>{0}</p></div></body>",
        "<body><div class='content-sidebar-wrap'><article><p>{0}</p></article></div></body>",
        "<body><main><div class='share-price-report'><p>{0}</p></div></main></body>",
        "<body><div class='x-widget x-widget-wrap'><div class='x-widget-body'><p>{0}</p></div></div></body>",
    ):
        assert text(page.format(WORDS * 5)) == (WORDS * 5).strip()
    builder = "<body><div class='e-widget e-widget-title'><h1>T</h1></div><div class='e-widget e-widget-text'><p>{0}</p></div><div class='comments-area'><p>{0}{0}</p></div></body>"
    assert text(builder.format(WORDS)) == "T\n\n" + WORDS.strip()
    longer = "<body><div class='text'><p>{0}</p></div><div class='related-posts'><p>{0}{0}</p></div><div id='comments'><p>" + WORDS * 40 + "</p></div></body>"
    assert text(longer.format(WORDS * 2)) == (WORDS * 2).strip()
    assert text("<body><div class='comments'><p>" + WORDS + "</p></div></body>") == ""


def test_lede_and_end_beside_the_container_stay():
    page = "<body><div class='top'><p>A lede of one sentence.</p></div><div class='text'><p>{0}</p></div><div class='end'><p>And so it closed.</p></div><div class='x'><p>short</p></div></body>"
    got = text(page.format(WORDS * 30))
    assert got.startswith("A lede of one sentence.\n\nThe harbour") and "And so it closed." in got


def test_the_host_decides_between_containers_that_a_page_cannot_tell_apart(spark):
    usual = "<body><div class='text'><p>{0}</p></div></body>"
    mixed = "<body><div class='text'><p>{0}</p></div><div class='aside-col'><p>Our offices move in spring.</p></div></body>"
    rows = [(i, "http://h.example/", usual.format(WORDS * (i + 4))) for i in range(5)] + [(9, "http://h.example/9", mixed.format(WORDS * 9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in hp.main_text(pages).collect()}
    assert got == {**{i: (WORDS * (i + 4)).strip() for i in range(5)}, 9: (WORDS * 9).strip()}
    assert "offices" in text(mixed.format(WORDS * 9))


def test_hosts_vote(spark):
    usual = "<body><div class='text p{0}'><p>{1}</p></div><div class='box'><p>short</p></div></body>"
    odd = "<body><div class='text p9'><p>tiny</p></div><div class='box'><p>" + "a much longer box than usual " * 9 + "</p></div></body>"
    rows = [(i, f"http://Host.example:80/{i}", usual.format(i, "long words here " * 9)) for i in range(9)] + [(9, "https://u@host.example/odd", odd)]
    rows += [(10, None, "<p>no host</p>"), (11, "http://empty.example/", None), (12, "http://empty.example/", ""), (None, "http://x.example/", "<p>no id"), (0, "http://Host.example:80/0", rows[0][2])]
    rows += [(13, "http://host.example/other", "<main><p>another layout</p></main>")]
    pages = spark.createDataFrame([(*r, "clash", "x") for r in rows], "page_id long, url string, html string, host string, path string").repartition(3)
    got = sorted(((r.id, r.url, r.text) for r in hp.main_text(pages).collect()), key=repr)
    long = " ".join(["long words here"] * 9)
    want = [(r[0], r[1], long if "long words" in (r[2] or "") else {9: " ".join(["a much longer box than usual"] * 9), 10: "no host", None: "no id", 13: "another layout"}.get(r[0], "")) for r in rows]
    assert got == sorted(want, key=repr)
    assert hp.main_text(pages.limit(0)).collect() == []


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.id: r.text for r in hp.main_text(pages).collect()}
    for row in pages.collect():
        inner = row.html.split("<article>")[1].split("</article>")[0]
        parts = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert got[row.page_id] == "\n\n".join(" ".join(p.split()) for p in parts if p.split())
