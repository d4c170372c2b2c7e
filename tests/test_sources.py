"""Feeds, index pages and files, from small documents of our own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gazette.sources import feeds, files, pages



def window():
    return F.lit("2026-05-20").cast("timestamp"), F.lit("2026-05-31 23:59:59.999999").cast("timestamp")


ENGINEERING = """<html><body>
<a href="/engineering/fast-scans"><h3>Fast scans of wide tables</h3><span>May 28, 2026</span></a>
<a href="/engineering/late-data"><h3>Late data, early answers</h3><span>May 22, 2026</span></a>
<a href="/engineering/fast-scans"><h3>Fast scans of wide tables</h3><span>May 28, 2026</span></a>
<a href="/engineering/old"><h3>An old story</h3><span>Jan 2, 2025</span></a></body></html>"""
GLUE = """<a class="glue-card" href="/a"><p class="glue-label">May 21, 2026</p><span class="headline-5">Small models</span></a>
<a class="glue-card" href="https://other.example/b"><p class="glue-label">May 30, 2026</p><span class="headline-5">Large tables</span></a>
<a class="glue-card" href="/c"><span class="headline-5">No date</span></a>"""
LIST = """<li class="post-list__item"><p class="grid-post__date">May 25, 2026</p><a class="grid-post__link" href="/x">Graphs at rest</a><a class="t-14 t-bold" href="/t">Data</a></li>
<li class="post-list__item"><p class="grid-post__date">May 26, 2026</p></li>"""
BLOG = """<div><div class="c"><a href="/blog/one/"><h3>Report one</h3></a><time>May 27, 2026</time></div>
<div class="c"><a href="/blog/two/"><h3>Report two</h3></a></div>
<div class="c"><a href="/blog/">Blog</a><a href="/blog/next?page=2">Next</a></div></div>"""
PARENT = """<article><a href="/blog/p1"><h2>Kernels | Qwen</h2></a><span>May 24, 2026</span></article>
<article><a href="/blog/page/2">Older posts</a></article><article><a href="/blog/">Blog</a></article>"""
NEWS = """<div class="n"><a href="/news/alpha"><h2>Alpha release notes</h2></a><span>May 29, 2026</span></div>
<div class="n"><a href="/news/alpha"><h2>Alpha release notes</h2></a></div>
<div class="n"><a href="/news/"><h2>News</h2></a></div><div class="n"><a href="/news/b"><h2>Beta</h2></a><span>2026-05-29</span></div>"""


def scraped(spark, spec, html):
    df = spark.createDataFrame([("https://site.example/index/", spec, html)], "url string, spec string, html string")
    return pages.scrape(df)


@pytest.mark.parametrize(
    ("spec", "html", "offered", "expected"),
    [
        ("engineering", ENGINEERING, 4, ["Fast scans of wide tables", "Late data, early answers"]),
        ("glue", GLUE, 3, ["Small models", "Large tables"]),
        ("post-list", LIST, 2, ["Graphs at rest"]),
        ("blog", BLOG, 3, ["Report one", "Report two"]),
        ("blog-parent", PARENT, 3, ["Kernels"]),
        ("news", NEWS, 3, ["Alpha release notes"]),
    ],
)
def test_pages(spark, spec, html, offered, expected):
    got = scraped(spark, spec, html)
    assert got.first().candidates == offered and got.first().error is None
    assert [r.title for r in pages.posts_in_window(got, *window()).orderBy("ord").collect()] == expected


def test_dates_belong_to_the_link_that_they_stand_with():
    def dates(html):
        return {e["link"][-5:]: e["published"] for e in pages.entries_of(pages.BY_NAME["engineering"], html, "https://s.example/")[1]}

    cards = "".join(f"<li><a href='/engineering/no-{k}'>{'<em>Feb 0%d, 2025</em>' % k if k % 2 else ''}<h4>Tables {k}</h4></a></li>" for k in range(1, 5))
    assert dates(f"<ul>{cards}</ul>") == {"/no-1": "Feb 01, 2025", "/no-3": "Feb 03, 2025"}
    links = "".join(f"<p><a href='/engineering/no-{k}'><h4>Shards {k}</h4></a></p>" for k in (7, 8, 9))
    assert dates(f"<article><header>Issue of March 9, 2025</header>{links}</article>") == {f"/no-{k}": "March 9, 2025" for k in (7, 8, 9)}


def test_an_item_that_breaks_leaves_the_others(spark, monkeypatch):
    plain = pages.entry_of

    def entry_of(x, *rest):
        if "two" in x.text():
            raise KeyError("two")
        return plain(x, *rest)

    monkeypatch.setattr(pages, "entry_of", entry_of)
    offered, entries, errors = pages.entries_of(pages.BY_NAME["blog"], BLOG, "https://s.example/")
    assert offered == 3 and [e["candidates"][0] for e in entries] == ["Report one"] and len(errors) == 1 and "KeyError" in errors[0]


def test_page_health(spark):
    df = spark.createDataFrame([("https://a.example/", "glue", GLUE), ("https://b.example/", "glue", "<p>x</p>"), ("https://c.example/", "glue", None)], "url string, spec string, html string")
    got = pages.scrape(df)
    rows = {r.url: (r.status, r.candidates) for r in pages.page_health(got, pages.posts_in_window(got, *window())).collect()}
    assert rows == {"https://a.example/": ("ok", 3), "https://b.example/": ("empty", 0), "https://c.example/": ("failed", None)}


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>T</title>
<item><title> One </title><link>https://f.example/1</link><pubDate>Tue, 26 May 2026 10:00:00 GMT</pubDate><description>d</description><category>x</category><category>y</category></item>
<item><title>Two</title><link>https://f.example/2</link><pubDate>not a date</pubDate></item>
<item><title>Three</title><link>https://f.example/3</link><pubDate>2020-01-01T10:00:00Z</pubDate></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><title>Only updated</title><link rel="alternate" href="https://g.example/1"/><updated>2026-05-25T10:00:00Z</updated><category term="z"/></entry></feed>"""


def test_feeds(spark, tmp_path):
    for name, said in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "<rss><channel><item><title>broken</channel></rss>")):
        (tmp_path / name).write_text(said)
    paths = [str(tmp_path / f"{k}.xml") for k in "abc"]
    rows = feeds.entries(spark, paths)
    kept = feeds.posts_in_window(rows, *window())
    assert {(r.title, r.link, tuple(r.tags)) for r in kept.collect()} == {("One", "https://f.example/1", ("x", "y")), ("Only updated", "https://g.example/1", ("z",))}
    health = {r.url.rsplit("/", 1)[1]: (r.status, r.candidates) for r in feeds.feed_health(spark, paths, rows, kept).collect()}
    assert health["a.xml"] == ("ok", 3) and health["b.xml"] == ("ok", 1) and health["c.xml"][0] == "failed"


def test_posts_by_day(spark, tmp_path):
    path = str(tmp_path / "runs")
    row = lambda d, t: spark.createDataFrame([(d, t, "s")], "date string, title string, summary string")
    files.write_posts(row("2024-01-01", "a").unionByName(row("2024-01-02", "b")), path)
    files.write_posts(row("2024-01-02", "c"), path)
    assert sorted((str(r.date), r.title) for r in files.read_posts(spark, path).collect()) == [("2024-01-01", "a"), ("2024-01-02", "c")]
    assert [str(r.date) for r in files.run_days(files.read_posts(spark, path)).collect()] == ["2024-01-01", "2024-01-02"]
    assert files.read_posts(spark, str(tmp_path / "none")).count() == 0


def test_objects_and_recipients(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("[")
    assert files.read_object(spark, str(tmp_path / "o.json"), "a int").first().a == 1
    assert files.read_object(spark, str(tmp_path / "bad.json"), "a int").count() == 0
    assert files.read_object(spark, str(tmp_path / "missing.json"), "a int").count() == 0
    (tmp_path / "r.txt").write_text(" a@b.example \nno\nc@d\nü@ö.example\n")
    assert [r.email for r in files.recipients(spark, str(tmp_path / "r.txt")).collect()] == ["a@b.example", "ü@ö.example"]
    assert files.recipients(spark, listed=["x@y.example"]).count() == 1


def test_eval_set(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"criteria": "c", "articles": [{"id": "a", "expected_band": "high", "title": "t", "content": "x"}]}')
    assert files.read_eval_set(spark, str(tmp_path / "e.json")).first().id == "a"


#: The specifications whose pages of many posts are read in steps that go with their posts.
LARGE = ("engineering", "blog", "blog-parent", "news")


@pytest.mark.parametrize("spec", LARGE)
def test_steps_go_with_the_posts_of_a_page(spec, monkeypatch):
    from gazette.functions.dom import Node
    from gazette.plans.sources import SHAPES

    walked = []
    walk = Node.walk
    monkeypatch.setattr(Node, "walk", lambda x: (walked.append(1) or y for y in walk(x)))

    def steps(n):
        walked.clear()
        before, title, date, end = SHAPES[spec]
        html = "".join(f"{before}{k}{title}Report {k}{date}Jan 8, 2024{end}" for k in range(n))
        offered, entries, errors = pages.entries_of(pages.BY_NAME[spec], f"<html><body>{html}</body></html>", "https://s.example/")
        assert offered == len(entries) == n and not errors
        return len(walked)

    assert steps(400) < 2.2 * steps(200)


def plain_date(link, spec):
    """The date near a link by rendering each scope around it without the other links."""
    post = lambda x: x.name == "a" and re.search(spec.link, x.attrs.get("href", ""))
    for scope in [link, *link.ancestors()][: spec.depth]:
        html = scope.html() if scope is link else scope.html(lambda x, scope=scope: x is scope or x is link or not post(x))
        for date in spec.dates:
            if found := re.search(date, html):
                return found[1]
    return ""


def test_dates_are_those_of_each_scope_read_by_itself():
    from gazette.functions.dom import parse

    dice = random.Random(5)
    said = ["May 2", "8, 2024", "May 28, 2024", " ", "é", "2024-01-0", "5", "2024-01-05", "1/2", "/2024", "x < y", "<br>", "</a>", "<!-- May 5, 2024 -->"]

    def markup(depth):
        kinds = [lambda: dice.choice(said)] * 4 + [lambda: f"<div>{markup(depth - 1)}</div>", lambda: f"<h2>{markup(depth - 1)}", lambda: f'<a href="/{dice.choice(("blog", "news", "engineering"))}/{dice.randint(1, 9)}">{markup(depth - 1)}{dice.choice(("</a>", "</a>", ""))}'] * 2
        return "".join(dice.choice(kinds[: 4 if depth < 1 else None])() for _ in range(dice.randint(1, 4)))

    found = 0
    for _ in range(300):
        html = markup(4)
        for name in ("engineering", "blog", "news"):
            root, spec = parse(html), pages.BY_NAME[name]
            page = pages.Page(root, spec)
            for x in root.find("a"):
                if re.search(spec.link, x.attrs["href"]):
                    assert page.date_near(x) == plain_date(x, spec), html
                    assert [page.heading_below(y) for y in x.ancestors()] == [next((h.text("") for h in y.find(*pages.HEADINGS)), None) for y in x.ancestors()]
                    found += bool(page.date_near(x))
    assert found > 200


def test_pages_are_read_once_for_their_health(spark):
    from gazette.plans import catalog

    plan = catalog.QUERIES["src11_page_health"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "MapInPandas" not in plan


def test_a_few_pages_and_their_posts_are_dealt_over_tasks(spark):
    from gazette.plans.sources import index_pages

    tasks = lambda df: df.select(F.spark_partition_id().alias("task")).distinct().count()
    read = pages.scrape(index_pages(spark, "/root/testdata/sf0.001"))
    assert tasks(read) > 1
    days = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    assert tasks(pages.posts_in_window(read, *days)) > 1


@pytest.mark.parametrize(("spec", "html", "first"), [("blog-parent", PARENT, ["Kernels | Qwen"]), ("blog", BLOG, ["Report one"])])
def test_a_text_is_a_candidate_once(spec, html, first):
    _, entries, _ = pages.entries_of(pages.BY_NAME[spec], html, "https://s.example/")
    assert entries[0]["candidates"] == first
    assert all(len(e["candidates"]) == len(set(e["candidates"])) for e in entries)


def test_selectors_are_read_once():
    from gazette.functions import dom

    dom._tests.cache_clear()
    root = dom.parse("<p class='a b' id='x1'>1</p><p class='a'>2</p><b>3</b>" * 3)
    assert [x.text() for _ in range(4) for x in dom.select(root, "p.a.b, b")] == ["1", "3"] * 12
    assert [x.text() for x in dom.select(root, "p[id^=x]")] == ["1"] * 3 and dom._tests.cache_info().misses == 2
    with pytest.raises(ValueError, match="no simple selector"):
        dom.select(root, "p > b")


@pytest.mark.parametrize(("spec", "html"), [("news", NEWS), ("blog", BLOG)])
def test_a_page_is_rendered_once_and_an_address_resolved_once(spec, html, monkeypatch):
    from gazette.functions.dom import Node

    rendered, resolved, plain_html, plain_url = [], [], Node.html, pages.joined_url
    monkeypatch.setattr(Node, "html", lambda x, *a, **b: (rendered.append(x), plain_html(x, *a, **b))[1])
    monkeypatch.setattr(pages, "joined_url", lambda base, href: (resolved.append(href), plain_url(base, href))[1])
    offered, entries, _ = pages.entries_of(pages.BY_NAME[spec], html, "https://s.example/")
    assert entries and len(rendered) == 1 and len(resolved) <= offered
