"""Article extraction against plain reading of the generated pages, and hand-written pages."""

import html
import re
from collections import Counter

from augurline.llm import wrappers as w


def plain(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)[1]
    body = re.sub(r"</?(p|h1)>", "\0", body).replace("<b>", "").replace("</b>", "").replace("<br>", "\n")
    return "\n\n".join(x for x in (" ".join(html.unescape(y).split()) for y in body.split("\0")) if x)


def test_generated_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in w.articles(pages.repartition(3)).collect()}
    for r in pages.collect():
        text = plain(r["html"])
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


def blog(i):
    more = "<aside class='box'>see also</aside>" if i % 2 else ""
    comments = "<div class='comments'><h3>Comments</h3><p>first!</p></div>" if i % 3 else "<ul id=comment-list><li>hi</ul>"
    return f"""<html><body><div class="top-nav"><a href=/>home</a></div><div id=main><div class=content><h2>Title {i}</h2>
    <p>Para one of {i} &amp; more<p>Second &lt;b&gt; {'x' * 90} {i}<ul><li>item {i}<li>other</ul>{more}
    <div class="ad-slot">buy</div><form><p>mail</p></form></div>{comments}</div><div class=footer>(c) {i}</div></body></html>"""


def test_pages_without_article_tags(spark):
    rows = [(i, f"http://Blog.example/{i}", blog(i)) for i in range(9)]
    odd = [None, "", "   ", "plain text & more", "<p>only</p>", "<article><p>a<script>x<p>y</p></script>  b\n\tc</p></article>", "<b" * 500, "<div>" * 3000 + "deep" + "</div>" * 3000, "<article>" + "<p>long words</p>" * 5000, "<!-- <p>no</p> --><main>m<br>n</main>", "<p>&eacute;&#x41;&bogus;&#0;</p>"]
    rows += [(100 + i, None if i % 2 else "http://[broken", t) for i, t in enumerate(odd)] + [rows[0]]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, host string").repartition(4)
    got = w.articles(df).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(9):
        assert text[i] == f"Title {i}\n\nPara one of {i} & more\n\nSecond <b> {'x' * 90} {i}\n\nitem {i}\n\nother", text[i]
    assert [text[100 + i] for i in (0, 1, 2, 3, 4, 5, 7)] == ["", "", "", "plain text & more", "only", "a b c", "deep"]
    assert text[108].count("long words") == 5000 and text[109] == "m n" and text[110].startswith("éA&bogus;")
    assert w.articles(df.limit(0)).count() == 0


def wrapper(*pages):
    whole = w.shape([w.tree(pages[0])])
    for page in pages[1:]:
        whole = w.merged(whole, w.shape([w.tree(page)]))
    return whole


def test_wrappers_have_repeats_optionals_and_slots():
    page = "<ul><li>a</li><li>b</li></ul><p>same</p>"
    other = "<ul><li>c</li></ul><h1>t</h1><p>same</p>"
    want = "(<#root> (<ul> (<li> #TEXT </li>)+ </ul>) (<h1> t </h1>)? (<p> same </p>) </#root>)"
    assert w.pattern(wrapper(page, other), parent=2) == want
    assert w.pattern(wrapper(other, page), parent=2) == want


def test_alignment_knows_no_order():
    import itertools
    import json

    pages = [blog(1), blog(2), blog(3), "<p>x<p>y<h2>z</h2><p>u", "<div><p>a</p></div><h2>q</h2><p>x"]
    want = json.dumps(wrapper(*pages), sort_keys=True)
    for some in itertools.permutations(pages):
        assert json.dumps(wrapper(*some), sort_keys=True) == want
        left, right = wrapper(*some[:2]), wrapper(*some[2:])
        assert json.dumps(w.merged(left, right), sort_keys=True) == want


def test_long_sequences_take_linear_time():
    import time

    page = "<div>" + "<p>a</p><h2>b</h2>" * 60_000 + "</div>"
    start = time.time()
    assert w.extract(page, w.plan(wrapper(page, page.replace("a", "c", 5)))).count("a") == 60_000
    assert time.time() - start < 60


def site(i):
    return f"""<body><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li>About us</li></ul><p>We use small files on your machine.</p>
    <div><h1>Story {i}</h1><p>Words of story {i}, {'many ' * (i + 3)}of them.</p><p>More on {i}.</p></div><p>Copyright Some Site</p></body>"""


def test_templates_without_any_names_are_left_out():
    plan = w.plan(wrapper(*map(site, range(10))))
    for i in range(10):
        want = f"Story {i}\n\nWords of story {i}, {'many ' * (i + 3)}of them.\n\nMore on {i}."
        assert w.extract(site(i), plan) == want
        flat = site(i).replace("<div>", "").replace("</div>", "")
        assert w.extract(flat, w.plan(wrapper(*(site(k).replace("<div>", "").replace("</div>", "") for k in range(10))))) == want
    alone = w.extract(site(3), None)  # one page can't tell what the site repeats
    assert "Story 3" in alone
    same = wrapper(*[site(4)] * 5)  # nor can copies of one page
    assert "Words of story 4" in w.extract(site(4), w.plan(same))


def test_names_of_classes_do_not_drop_articles():
    for name in ("comments-on-law", "side note", "related-work", "tags", "search-results", "comments", "social"):
        pages = [f"<body><article><h1>Title {i}</h1><div class='{name}'><p>{'text of it ' * 40}{i}</p><p>and {i}</p></div></article></body>" for i in range(6)]
        for plan in (w.plan(wrapper(*pages)), None):
            for i, page in enumerate(pages):
                assert w.extract(page, plan) == f"Title {i}\n\n{'text of it ' * 40}{i}\n\nand {i}", (name, plan)
    page = "<article><h1>T</h1><p>" + "long text " * 30 + "</p><div class='comments'><p>first!</p></div><div id=related-posts>see</div></article>"
    assert w.extract(page, None) == "T\n\n" + ("long text " * 30).strip()


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i, f"http://{'abc'[i % 3]}.example/{i}", (site, blog)[i % 2](i % 12)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(tuple(r) for r in w.articles(df.repartition(1)).collect())
    assert all(r[2].startswith(("Story", "Title")) for r in want)
    for n in (3, 17):
        assert sorted(tuple(r) for r in w.articles(df.repartition(n)).collect()) == want


def test_deep_elements_close_themselves_only():
    deep = lambda n, inner: f"<html><body><div id=page><article><p>head</p>{'<div>' * n}{inner}{'</div>' * n}<p>tail</p></article></div><p>outside</p></body></html>"
    for n in (3, 390, 395, 396, 397, 400, 500, 3000):
        page = deep(n, "text")
        assert w.extract(page, None) == "head\n\ntext\n\ntail", n
        page = deep(n, "<p>one<b> bold</b> end<nav>menu <div>x</div></nav><aside>also</aside><form><p>mail</p></form><p>two<ul><li>a<li>b</ul>last")
        assert w.extract(page, None) == "head\n\none bold end\n\ntwo\n\na\n\nb\n\nlast\n\ntail", n
    page = f"<body>{'<div>' * 500}<article><p>deep article</p></article>{'</div>' * 500}<footer>f</footer></body>"
    assert w.extract(page, None) == "deep article"
