"""HTML functions of one document."""

from gazette.functions import html
from gazette.functions.dom import parse, select


def test_visible_text():
    assert html.visible_text("<p>a <b>b</b></p><script>x</script><style>y</style><!-- c --><p>d &amp; e") == "a b d & e"
    assert html.visible_text("") == html.visible_text(None) == ""
    assert html.prose_text("<p>a</p><pre>code</pre><code>c</code>b") == "a b"


def test_tree_survives_bad_markup():
    assert parse("<p><b>x</p>y</i><br>z").html() == "<p><b>x</b></p>y<br/>z"


def test_select():
    root = parse('<div class="a b"><a href="/blog/x">1</a><a href="/y">2</a></div>')
    assert [x.text() for x in select(root, "a[href*='/blog/']")] == ["1"]
    assert len(select(root, "div.a.b")) == 1 and not select(root, "div.c")


def test_content_html():
    said = '<nav>n</nav><p id="i" class="c" onclick="x">t</p><noscript><img src="s"></noscript><svg></svg>'
    assert html.content_html(said) == '<p class="c">t</p><noscript><img src="s"/></noscript>'


def test_sanitized():
    said = '<script>x</script><section><a href="javascript:x" title="t">a</a></section><img src="https://e.example/i.png" onerror="x"><table id="q"><tr><td colspan="2">c</td></tr></table><!-- c -->'
    want = '<a title="t">a</a><img src="https://e.example/i.png"/><table class="table table-bordered"><tr><td colspan="2">c</td></tr></table>'
    assert html.sanitized(said) == want


def test_main_content():
    long = "word " * 50
    assert html.main_content(f"<body><nav>n</nav><article>{long}</article></body>").startswith("<article>")
    assert html.main_content(f"<body><article>x</article><p>{long}</p></body>").startswith("<body>")
    assert html.main_content("no body") == ""


def test_images():
    said = '<img src="/a.png"><img src="data:x"> ![t](b.png) <img>'
    assert html.images(said, "https://e.example/p/") == ["https://e.example/a.png", "https://e.example/p/b.png"]


def test_sourced_images():
    said = '<p>x</p><img src="/a.png"/><img src="/b.png"/><img/>'
    assert html.sourced_images(said, 'src="/a.png"', []) == ('<p>x</p><img src="/a.png"/>', ["/b.png", ""])
    assert html.sourced_images("<p>x</p>", "", None) == ("<p>x</p>", [])


def test_markdown():
    got = html.markdown_html("# T\n\na **b** `c<d`\n\n- x\n- y\n\n```\nz < 1\n```\n<script>bad</script>")
    assert "<h1>T</h1>" in got and "<strong>b</strong>" in got and '<code class="highlight">c&lt;d</code>' in got
    assert "<ul><li>x</li><li>y</li></ul>" in got and '<pre class="pre-scrollable">' in got and "bad" not in got


def test_markdown_blocks():
    said = "| a | b |\n|---|:-:|\n| 1 | **2** |\n\n- x\n  - y\n    1. z\n- w\n\n> q _e_ snake_case\n> r\n\nsee [t][k] and [K][] and [no][where]\n\n[k]: https://e.example/a_b_c"
    got = html.markdown_html(said)
    assert '<tr><th>a</th><th>b</th></tr>' in got and "<tr><td>1</td><td><strong>2</strong></td></tr>" in got and 'class="table table-bordered"' in got
    assert "<ul><li>x<ul><li>y<ol><li>z</li></ol></li></ul></li><li>w</li></ul>" in got
    assert "<blockquote><p>q <em>e</em> snake_case<br/>\nr</p></blockquote>" in got
    assert '<a href="https://e.example/a_b_c">t</a> and <a href="https://e.example/a_b_c">K</a> and [no][where]' in got


def test_deep_and_broken_pages():
    deep = "<p>x" * 100_000
    for f in (html.visible_text, html.content_html, html.sanitized, html.main_content, html.markdown_html, html.prose_text):
        assert isinstance(f(deep), str)
    assert html.measured(deep)[0] == 199_999 and html.sections(deep) == {}
    assert html.sanitized("<x>" * 50_000 + "a" + "</y>" * 50_000) == "a"
    assert parse("<script>a < b</script><p>a &lt; b<style>c > d</style></p>").html() == "<script>a < b</script><p>a &lt; b<style>c > d</style></p>"


def test_captions_belong_to_the_innermost_figure():
    count = lambda said: html.captioned_images(parse(said))
    assert count("<figure><img><img><figcaption>c</figcaption></figure><img>") == 2
    assert count("<figure><img><figure><img><figcaption></figcaption></figure><figcaption>c</figcaption></figure>") == 0
    assert count("<figure><img><figure><img></figure><figcaption>c</figcaption></figure>") == 1


def test_sections():
    got = html.sections("<p>skip</p><h3>📌 One</h3><p>a</p><p>b</p><h3>Other</h3><p>c</p><h3>📊 Two</h3><p>d</p>")
    assert got == {"📌": "a b", "📊": "d"}
