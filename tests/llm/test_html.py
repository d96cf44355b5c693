import time
from collections import Counter
from itertools import combinations

import pytest

from lexspark.llm import html

from . import brute


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "y") for r in rows], "page_id long, url string, html string, type string, host int, text string")


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>m</ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
    <article><h1>Head &amp; line</h1><p><b>one<br>two<p>three&nbsp;&eacute;</p><aside>side</aside><section id="comments"><p>me too</p></section><form>f</form><script>var t="</p>";</script></article><footer>f</footer></body></html>"""
    rows = [(1, "http://h.example/a", page), (2, "http://h.example/b", None), (3, None, ""), (4, "http://h.example/c", "<p>shared</p><p>own four</p><p>end</p>"), (5, "http://h.example/d", "<p>shared</p><p>own five</p><p>end</p>"), (6, "http://x.example/d", "<p>shared</p>"), (6, "http://x.example/d", "<p>shared</p>")]
    got = sorted((r.page_id, r.text) for r in html.main_texts(frame(spark, rows)).collect())
    assert got == [(1, "Head & line one two three é"), (2, ""), (3, ""), (4, "own four"), (5, "own five"), (6, "shared"), (6, "shared")]
    assert html.main_texts(frame(spark, rows).where("false")).collect() == []


def test_differencing_over_copies_and_article_pages(spark):
    side = lambda own: f"<div>shared menu</div><p>{own}</p><div>shared end</div>"
    copies = [(i, f"http://h.example/b{i:02}", side("own copy")) for i in range(10, 40)]
    rows = [(1, "http://h.example/a", side("own first")), *copies, (90, "http://h.example/z", "<div>shared menu</div><article>whole article</article><div>shared end</div>")]
    for n in (1, 4, 9):  # whatever borders lie in the group of copies
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: r.text for r in html.main_texts(frame(spark, rows)).collect()}
        assert got == {1: "own first", **{i: "own copy" for i, _, _ in copies}, 90: "whole article"}
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_text_beside_article_cards(spark):
    rows = [(i, f"http://h.example/{i}", f"<div>menu</div><div>text of {i}</div><article>card {i}</article>") for i in range(3)]
    assert sorted(r.text for r in html.main_texts(frame(spark, rows)).collect()) == [f"text of {i} card {i}" for i in range(3)]


def test_marks_are_whole_names():
    zones = lambda page: [z for _, z in html.blocks(page)]
    for tag in ('style="overflow:hidden"', 'title="the hidden valley"', 'class="content-with-sidebar"', 'class="no-sidebar"', "data-x='class=ad' id=text", 'class="sidebar"', "id=menu", 'role="banner"'):
        assert zones(f"<div {tag}><article><p>a</p></article></div>") == ["article"], tag
        assert zones(f"<article><div {tag}><p>a</p></div></article>") == (["apart"] if tag in ('class="sidebar"', "id=menu", 'role="banner"') else ["article"]), tag
    assert zones('<form id=f><main style="overflow:hidden">a</main></form>') == ["main"]
    assert zones("<article>a</article><div class=related><article>card</article></div>") == ["article", "apart"]
    assert zones("<article>a<section id=comments><article>b</article></section></article>") == ["article", "apart"]
    for tag in ("hidden", "hidden=''", "aria-hidden=true", "class='a cookie-notice' x"):
        assert zones(f"<div {tag}><p>a</p></div><p>b</p>") == ["apart", "open"], tag
    assert zones("<div hidden><article>a</article></div>") == ["apart"]


def test_long_page(spark):
    rows = [(1, "u", "<article>" + "<p>word one</p>" * 50_000 + "</article>"), (2, "u", "<div>" * 5000 + "deep"), (3, "u", "<" * 10_000)]
    got = {r.page_id: r.text for r in html.main_texts(frame(spark, rows)).collect()}
    assert got[1] == " ".join(["word one"] * 50_000) and got[2] == "deep"


def test_common_lines_equal_brute_force():
    for a in ("abcab", "xaybz", "aab", ""):
        for b in ("acb", "abz", "ba", "aab"):
            best = max(n for n in range(len(a) + 1) for c in combinations(a, n) if "".join(c) in {"".join(d) for m in range(len(b) + 1) for d in combinations(b, m)})
            assert len(html.common_lines(list(a), list(b))) == best


def test_common_lines_of_long_lists():
    import random

    rng = random.Random(3)
    for n in (40, 150):
        for kinds in (3, 30, 200):
            a, b = ([rng.randrange(kinds) for _ in range(n)] for _ in range(2))
            found = sorted(html.common_lines(a, b))
            rest = iter(b)
            assert all(a[i] in rest for i in found) and len(found) == len(brute.common(a, b))
    a = list(range(20_000))
    b = a[:]
    rng.shuffle(b)
    began = time.process_time()
    assert len(html.common_lines(a, b)) > 200
    assert time.process_time() - began < 5


@pytest.mark.parametrize("tables", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, tables):
    """Over all given pages; differencing deletes lines of some of them."""
    folder = f"/root/testdata/{tables}"
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    want = brute.main_texts(pages)
    got = {r.page_id: (r.text, r.n_shared) for r in html.query(spark, folder).collect()}
    assert {p: t for p, (t, _) in got.items()} == {p: t for p, (t, _) in want.items()}
    assert got == want
    assert sum(n > 0 for _, n in got.values()) > 2


def test_differencing_alone_decides_pages_without_structure(spark):
    """The given pages with every element turned into a plain one: nothing but the neighbours tells menus and footers from text."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    for name in ("nav", "footer", "article", 'div class="ad"'):
        pages = [(p, u, h.replace(f"<{name}>", "<div>").replace(f"</{name}>", "</div>")) for p, u, h in pages]
    got = {r.page_id: (r.text, r.n_shared) for r in html.main_texts(frame(spark, pages)).collect()}
    assert got == brute.main_texts(pages)
    whole = {p: " ".join(t for t, _ in brute.page_lines(h)) for p, _, h in pages}
    assert sum(whole[p] != t for p, (t, _) in got.items()) > 10


@pytest.mark.parametrize("unit", ["<a ", "<a \"", "<a '>\"", "<!", "</", "<!-- ", "<b>", "<div>", "</p>", "<script ", "<a b=\"c>d\" ", "<i><b></i>", "<td>x</p>", "\"'<a >'\""])
def test_hostile_pages_take_linear_time(unit):
    page = "<p>text</p>" + unit * (1_000_000 // len(unit)) + "<p>end"
    began = time.process_time()
    html.blocks(page)
    assert time.process_time() - began < 8


def test_unclosed_tags_and_quotes():
    assert html.blocks("<p>a</p>1 < 2 <b") == [("a", "open"), ("1 < 2 <b", "open")]
    assert html.blocks('<p title="x>a</p><p>b') == [("a", "open"), ("b", "open")]
    assert html.blocks('<p title="x>y">a</p>') == [("a", "open")]
    assert html.blocks("<!-- <p>no") == []


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, "<p>a</p>"), (1, "", "<article>b</article>"), (1, "", "<article>b</article>"), (1, "http://h/w", ""), (2, "http://h/x", "<div>m</div><p>c</p>"), (None, "http://h/x", "<div>m</div><p>d</p>")]
    got = Counter((r.page_id, r.url, r.text) for r in html.main_texts(frame(spark, rows)).collect())
    assert got == Counter([(None, None, ""), (None, None, "a"), (1, "", "b"), (1, "", "b"), (1, "http://h/w", ""), (2, "http://h/x", "c"), (None, "http://h/x", "d")])
