import math
import re
from collections import Counter
from html import unescape

import pytest
from pyspark.sql import functions as F
from voxframe.llm import html_extract as he
from voxframe.llm import queries

SHELL = """<!DOCTYPE html><html lang="en"><head><title>T {k}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/a">Home</a></li><li>News</li></ul></nav><header class="site">Site name</header><!-- ad <p>no</p> -->
<div class="ad">Buy {k} now</div><div id="cookie-notice">We use cookies</div><aside>More</aside>
<article><h1>Title {k} &amp; more</h1><p><b>First  {k}.<br><p>Second&nbsp;para <i>{k}</i>
 &eacute;t&#233; &lt;tag&gt;</p><ul><li>one {k}<li>two</ul><form><label>Mail</label><input><button>Send</button></form><div class="comments"><p>Nice {k}!</p></div></article>
<section class="sidebar"><p>Links</p></section><footer>&copy; Site</footer></body></html>"""
WANTED = "Title {k} & more\nFirst {k}.\nSecond para {k} été <tag>\none {k}\ntwo"
#: No semantic marks at all: only the style tree can tell.
PLAIN = "<html><body><div class=x1><div>Home News Contact</div></div><div class=x2><div>Story {k} begins.</div><div>It goes on, {k}.</div></div><div class=x3>All rights kept</div></body></html>"
KIND = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: (r.text, r.n_chars) for r in he.main_texts(spark.createDataFrame(rows, KIND)).collect()}


def test_marked_page(spark):
    got = texts(spark, [(k, f"http://h{k % 2}.org/{k}", SHELL.format(k=k)) for k in range(6)])
    for k in range(6):
        want = WANTED.format(k=k)
        assert got[k] == (want, len(want))


def test_the_tree_finds_shared_branches(spark):
    got = texts(spark, [(k, "http://plain.org/", PLAIN.format(k=k)) for k in range(30)])
    assert all(got[k][0] == f"Story {k} begins.\nIt goes on, {k}." for k in range(30))


def test_copies_of_an_article_stay(spark):
    page = "<article><h1>Same</h1><p>Always the same text.</p></article>"
    got = texts(spark, [(k, "http://copies.org/", page) for k in range(20)])
    assert all(t == "Same\nAlways the same text." for t, _ in got.values())


def test_the_tree_leaves_articles_whole(spark):
    page = "<article><h1>{}</h1><p>{}</p>{}</article>"
    quote = "<blockquote>Only copies say so.</blockquote><ul><li>and this</li></ul>"
    pages = [(k, "http://renamed.org/", page.format(f"Title {k}", "The same body.", "")) for k in range(2)]
    pages += [(10 + k, "http://onetitle.org/", page.format("Daily", f"Body {k}.", "")) for k in range(5)]
    pages += [(20 + k, "http://large.org/", page.format(f"T {k}", f"Body {k}.", "")) for k in range(40)]
    pages += [(60 + k, "http://large.org/", page.format("Copied", "Copied body.", quote)) for k in range(2)]
    got = texts(spark, pages)
    assert [got[k][0] for k in range(2)] == [f"Title {k}\nThe same body." for k in range(2)]
    assert [got[10 + k][0] for k in range(5)] == [f"Daily\nBody {k}." for k in range(5)]
    assert [got[60 + k][0] for k in range(2)] == ["Copied\nCopied body.\nOnly copies say so.\nand this"] * 2


def test_the_tree_keeps_body_text_without_marks(spark):
    page = "<html><body><div>Home News</div><h1>{}</h1><p>{}</p>{}</body></html>"
    pages = [(k, "http://renamed.org/", page.format(f"Title {k}", "The same body.", "")) for k in range(5)]
    pages += [(20 + k, "http://large.org/", page.format(f"T {k}", f"Body {k}.", "")) for k in range(40)]
    pages += [(60 + k, "http://large.org/", page.format(f"Copied {k // 2}", "Copied body.", "<blockquote>Only copies say so.</blockquote>")) for k in range(4)]
    got = texts(spark, pages)
    assert [got[k][0] for k in range(5)] == [f"Home News\nTitle {k}\nThe same body." for k in range(5)]
    assert [got[20 + k][0] for k in range(40)] == [f"T {k}\nBody {k}." for k in range(40)]
    assert [got[60 + k][0] for k in range(4)] == [f"Copied {k // 2}\nCopied body.\nOnly copies say so." for k in range(4)]


INNER = "<h1>Title</h1><p>Body.</p>"


@pytest.mark.parametrize("wrapped", [
    "<div class='site has-sidebar'><article>{}</article></div>", "<div id='page' class='no-sidebar'><article>{}</article></div>", "<form id='aspnetForm'><article>{}</article></form>",
    "<form id='aspnetForm'><div>{}</div></form>", "<article class='post has-comments'>{}</article>", "<div class='widget'><main>{}</main></div>", "<aside><article>{}</article></aside>",
    "<article class='comment'>{}</article>", "<main><form><article>{}</article></form></main>", "<div class='sidebar'>{}</div>", "<article data-id='comments'>{}</article>", "<header><article>{}</article></header>",
    "<main><form id='aspnetForm'>{}</form></main>",
])
def test_marked_wrappers_keep_their_article(wrapped):
    nav = "<nav>Home</nav>"
    assert he.main_text(f"<html><body>{nav}{wrapped.format(INNER)}<footer>End</footer></body></html>", frozenset()) == "Title\nBody."


@pytest.mark.parametrize("slug", ["<h2 id='related-work'>S</h2>", "<h2 id='comments'>S</h2>", "<section id='search-methods'>S</section>", "<div class='social-policy'>S</div>", "<p class='notice-period'>S</p>", "<div class='header'>S</div>"])
def test_slugs_keep_their_section(slug):
    assert he.main_text(f"<article>{INNER}{slug}</article>", frozenset()) == "Title\nBody.\nS"


@pytest.mark.parametrize("gone", ["<div class='comments'>S</div>", "<div class='x comment-list'><article>S</article></div>", "<div id='cookie-notice'>S</div>", "<form>S</form>", "<form class='subscribe'><h1>S</h1></form>", "<aside>S</aside>", "<div class='site-footer'>S</div>", "<aside><article>S</article></aside>", "<div role='navigation'>S</div>"])
def test_marks_still_remove(gone):
    assert he.main_text(f"<article>{INNER}{gone}</article>", frozenset()) == "Title\nBody."


def test_the_tree_decides_weak_marks(spark):
    page = "<article><p>Body {k}.</p><div class=post-share>Tell a friend</div><div class=social-policy>Rule {k}</div></article>"
    got = texts(spark, [(k, "http://weak.org/", page.format(k=k)) for k in range(6)])
    assert all(got[k][0] == f"Body {k}.\nRule {k}" for k in range(6))


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "plain words", "<p>un<p>closed <div>x", "<script>never closed", "<a b='c>d", "a < b & c", "<!-- open", "<p>" * 3000 + "x" + "</p>" * 3000])
def test_odd_pages(spark, html):
    (text, n), = texts(spark, [(1, None, html)]).values()
    assert n == len(text) and "<p" not in text
    if html in ("plain words", "a < b & c"):
        assert text == html


def test_empty(spark):
    assert texts(spark, []) == {}


def test_importance_against_the_formula(spark):
    pages = [("h", PLAIN.format(k=k % 4)) for k in range(12)] + [("g", "<p>once</p>")]
    got = {(r.host, r.node): r for r in he.importance(spark.createDataFrame(pages, "host string, html string")).collect()}
    shapes, words, count = {}, {}, Counter()
    for host, html in pages:
        blocks, nodes = he.parse(html)
        seen = {(p, 0, v) for p, v in nodes} | {(p, 1, he.number(t)) for p, t, _, _ in blocks}
        for p, kind, value in seen:
            (shapes if kind == 0 else words).setdefault((host, p), Counter())[value] += 1
        count.update({(host, p) for p, _, _ in seen})
    assert set(got) == set(count)
    for key, m in count.items():
        s, w = shapes.get(key, Counter()), words.get(key, Counter())
        n = sum(s.values())
        look = 1.0 if m == 1 else -sum(c / n * math.log(c / n, m) for c in s.values())
        said = 1.0 if m == 1 or not w else 1 - sum(math.log(c, m) for c in w.values()) / len(w)
        assert got[key].importance == pytest.approx((1 - 0.9 ** len(s)) * look + 0.9 ** len(s) * said, abs=1e-9)


def plain(html):
    """The article of a page of the table, by a plain reading of its one template."""
    article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(b for b in blocks if b)


def test_pages_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    assert all(r.text == plain(html[r.page_id]) for r in he.main_texts(df).collect())


def test_the_tree_alone_finds_the_articles(spark):
    """Without a look at any tag's, class's or role's meaning: hosts of 15 pages and more, every page. Without the tree, none."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    assert all(r.text == plain(html[r.page_id]) for r in he.main_texts(df, marks=False).collect())
    assert not any(he.main_text(h, marks=False) == plain(h) for h in list(html.values())[:200])


def test_the_tree_decides_where_a_host_has_pages_enough(spark, monkeypatch):
    """In the registered query; also when no tag says what it is. Then, without the tree, no page comes out right."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    got = queries.op5_html_extract(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 2500 and all((r.text, r.found_by) == (plain(html[r.page_id]), "tree") for r in got)
    nameless = df
    for n, tag in enumerate(("article", "main", "nav", "aside", "footer", "header", "section", "form", "div class=.?ad.?")):
        nameless = nameless.withColumn("html", F.regexp_replace("html", f"<{tag}[^>]*>", f"<div class=t{n}>"))
        nameless = nameless.withColumn("html", F.regexp_replace("html", f"</{tag}>", "</div>"))
    assert all(r.text == plain(html[r.page_id]) for r in he.main_texts(nameless).collect())
    monkeypatch.setattr(he, "HIGH", 2.0)
    assert not any(r.text == plain(html[r.page_id]) for r in he.main_texts(nameless).collect())


def test_clashing_names(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = df
    for name in ("host", "low", "high", "trusted", "found_by", "text", "n_chars", "page", "found"):
        more = more.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, he.main_texts(more).collect())) == sorted(map(tuple, he.main_texts(df).collect()))


def test_comments_and_marks_inside_the_trees_part(spark):
    """A reader's comments are as new on every page as the article, so their marks tell them also where the tree decides."""
    kinds = ["<p>P{k}a</p>", "<p>P{k}b</p><p>P{k}c</p>", "<blockquote>Q{k}</blockquote>", "<h2>H{k}</h2><p>P{k}d</p>", "<p>P{k}e</p><ul><li>L{k}</ul>"]
    bodies = ["".join(kinds[(k + j * (1 + k // 5)) % 5] for j in range(1 + k % 4)).format(k=k) for k in range(30)]
    rows = [(k, "http://nameless.org/", site(k, f"<h1>T{k}</h1>" + bodies[k] + f"<div class=comments><p>said {k}</p></div>")) for k in range(30)]
    got = {r.page_id: (r.text, r.found_by) for r in he.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(30):
        assert got[k] == ("\n".join([f"T{k}", *re.findall(r"[A-Z]\d+[a-e]?", bodies[k])]), "tree"), k


def site(k, body):
    """A page whose parts have no telling names, and texts of their own in every part."""
    menu = "".join(f"<li>m{k}x{j}</li>" for j in range(3 + k % 4))
    return f"<html><body><div class=t1><ul>{menu}</ul></div><div class=t2>Offer {k} for {k}</div><div class=t3>{body}</div><div class=t4>Page {k}, seen {k * k}</div></body></html>"


def test_the_tree_finds_the_main_part_by_its_make_up(spark):
    kinds = ["<p>P{k}a</p>", "<p>P{k}b</p><p>P{k}c</p>", "<blockquote>Q{k}</blockquote>", "<h2>H{k}</h2><p>P{k}d</p>", "<p>P{k}e</p><ul><li>L{k}</ul>"]
    bodies = ["".join(kinds[(k + j * (1 + k // 5)) % 5] for j in range(1 + k % 4)).format(k=k) for k in range(30)]
    got = texts(spark, [(k, "http://nameless.org/", site(k, f"<h1>T{k}</h1>" + bodies[k])) for k in range(30)])
    for k in range(30):
        assert got[k][0] == "\n".join([f"T{k}", *re.findall(r"[A-Z]\d+[a-e]?", bodies[k])]), k
    # One layout for all: the tree has no main part to tell, and texts that are new on every page stay.
    flat = texts(spark, [(k, "http://flat.org/", site(k, f"<p>P{k}</p>")) for k in range(30)])
    assert f"P{7}" in flat[7][0] and "Offer 7" in flat[7][0]


def test_items_of_lists_count_once():
    of = lambda n: dict(he.parse("<ul>" + "<li>x</li>" * n + "</ul>")[1])
    assert of(3) == of(9)
    assert dict(he.parse("<div><p>x</p></div>")[1]) != dict(he.parse("<div><p>x</p><p>x</p></div>")[1])


def test_a_hosts_judged_nodes_are_few(spark):
    pages = [("big.org", PLAIN.format(k=k) + f"<div class=only{k}>x{k}</div>") for k in range(300)]
    nodes = he.judged(he.importance(spark.createDataFrame(pages, "host string, html string"), True)).first()
    assert 0 < len(nodes.low) + len(nodes.high) < 20
