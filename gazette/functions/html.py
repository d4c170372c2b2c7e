"""HTML operators that need a tree: plain functions of one document, and the Arrow-batched UDFs over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gazette import fixed
from gazette.functions.dom import HIDDEN, Node, Raw, parse, select


def visible_text(html: str | None, without: tuple[str, ...] = ()) -> str:
    """Visible text; elements of the given names count as absent."""
    root = parse(html)
    if without:
        root.prune(lambda x: x.name in without)
    return root.text()


def prose_text(html: str | None) -> str:
    """Visible text without code."""
    return visible_text(html, ("pre", "code"))


def content_html(html: str | None) -> str:
    """Without site furniture and decorative attributes."""
    root = parse(html)
    root.prune(lambda x: x.name in fixed.NON_CONTENT_TAGS)
    for x in root.walk():
        x.attrs = {k: v for k, v in x.attrs.items() if k in fixed.CONTENT_ATTRIBUTES}
    return root.html()


def is_safe(url: str) -> bool:
    found = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", url or "")
    return bool(found) and found[1].lower() in fixed.SAFE_SCHEMES


def sanitized(html: str | None) -> str:
    """Allowed elements and attributes only. Scripts and styles go with what they hold; comments go too."""
    def shown(x: Node) -> bool | None:
        if x.name in ("script", "style"):
            return False
        if x.name not in fixed.ALLOWED_TAGS:
            return None
        allowed = fixed.ALLOWED_ATTRIBUTES.get(x.name, ())
        x.attrs = {k: v for k, v in x.attrs.items() if k in allowed and (k not in ("href", "src") or is_safe(v))}
        if x.name == "table":
            x.attrs["class"] = "table table-bordered"
        return True

    return parse(html).html(shown, raw=False)


def main_content(html: str | None) -> str:
    """The container with the longest visible text (first of equals), if it holds half of the body's, else the body."""
    root = parse(html)
    body, sizes = next(iter(root.find("body")), None), text_sizes(root)
    best, most = None, 0
    for selector in fixed.CONTENT_SELECTORS:
        for x in select(root, selector):
            if (n := sizes[id(x)]) > most:
                best, most = x, n
    if best is not None and most >= (sizes[id(body)] if body else 0) * fixed.CONTAINER_SHARE:
        return best.html()
    return body.html() if body else ""


def text_sizes(root: Node) -> dict[int, int]:
    """Length of each element's visible text, by the element's identity, from one walk: children come after parents, so sums go backwards."""
    nodes = [root, *root.walk()]
    own: dict[int, list[int]] = {}
    for x in reversed(nodes):
        size, parts = 0, 0
        for c in x.children:
            if isinstance(c, Node):
                if c.name not in HIDDEN:
                    size, parts = size + own[id(c)][0], parts + own[id(c)][1]
            elif not isinstance(c, Raw) and (n := len(c.strip())):
                size, parts = size + n, parts + 1
        own[id(x)] = [size, parts]
    return {k: size + max(0, parts - 1) for k, (size, parts) in own.items()}


def images(html: str | None, base: str | None) -> list[str]:
    """Absolute http URLs of image elements and of Markdown images, sorted."""
    found = [x.attrs.get("src", "") for x in parse(html).find("img")] + re.findall(r"!\[.*?]\((.*?)\)", html or "")
    return sorted({u for s in found if s for u in [joined_url(base or "", s)] if u.startswith("http")})


def joined_url(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def sourced_images(summary: str | None, source: str | None, known: list[str] | None) -> tuple[str, list[str]]:
    """The summary without images that the source doesn't have, and the addresses of what was dropped (empty for none)."""
    address = lambda x: x.attrs.get("src", "").strip()
    root, listed, page = parse(summary), frozenset(known or ()), source or ""
    sourced = lambda src: bool(src) and (src in listed or src in page)
    dropped = root.prune(lambda x: x.name == "img" and not sourced(address(x)))
    return (root.html() if dropped else summary or ""), [address(x) for x in dropped]


def sections(html: str | None) -> dict[str, str]:
    """Prose of each marked section: from a top-level h3 with a marker to the next h3. Later ones replace earlier."""
    return sections_of(parse(html))


def sections_of(root: Node) -> dict[str, str]:
    """The same of a tree; code in it is gone afterwards."""
    root.prune(lambda x: x.name in ("pre", "code"))
    out: dict[str, str] = {}
    marker, held = None, []
    for x in [*root.children, Node("h3", {}, None)]:
        if isinstance(x, Node) and x.name == "h3":
            if marker:
                out[marker] = " ".join(held).strip()
            heading = x.text("")
            marker, held = next((m for m in fixed.SECTION_MARKERS if m in heading), None), []
        elif marker:
            held.append(x.text() if isinstance(x, Node) and x.name not in HIDDEN else x.strip() if not isinstance(x, Node | Raw) else "")
    return out


def markdown_html(text: str | None) -> str:
    """A subset of Markdown as HTML, sanitized: headings, fenced code, nested lists, quotations, tables, emphasis, links (also by reference), images, paragraphs.

    HTML in the text passes through the sanitizer; what fails to convert is escaped, never let through.
    """
    try:
        html = _markdown(text or "")
        html = html.replace("<code>", '<code class="highlight">').replace("<pre>", '<pre class="pre-scrollable">')
        return sanitized(html)
    except Exception:
        return escape(text or "")


def _inline(text: str, targets: dict[str, str]) -> str:
    """Spans of a line: code first, whose text nothing else touches, then images, links and emphasis."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(f"<code>{escape(m[1], quote=False)}</code>")
        return f"\0{len(kept) - 1}\0"

    def named(m: re.Match) -> str:
        to = targets.get((m[2] or m[1]).casefold())
        return m[0] if to is None else f'<a href="{to}">{m[1]}</a>'

    text = re.sub(r"`([^`]+)`", keep, text)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img alt="\1" src="\2">', text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', text)
    text = re.sub(r"\[([^\]]+)\]\[([^\]]*)\]", named, text)
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"(?<!\w)__(.+?)__(?!\w)", r"<strong>\1</strong>", text)
    text = re.sub(r"(?<!\*)\*([^*\n]+)\*(?!\*)", r"<em>\1</em>", text)
    text = re.sub(r"(?<![\w/\"=])_([^_\n]+)_(?![\w\"])", r"<em>\1</em>", text)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text)


_ITEM = re.compile(r"( *)([-*+]|\d+\.)\s+(.*)")
_RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*")


def _markdown(text: str) -> str:
    out: list[str] = []
    for k, part in enumerate(re.split(r"(?ms)^```[^\n]*\n(.*?)^```\s*$", text)):
        if k % 2:
            out.append(f"<pre><code>{escape(part, quote=False)}</code></pre>")
            continue
        targets: dict[str, str] = {}

        def aside(m: re.Match, targets=targets) -> str:
            targets[m[1].casefold()] = m[2]
            return ""

        part = re.sub(r"(?m)^ {0,3}\[([^\]]+)\]:\s*(\S+).*$", aside, part)
        out += [x for block in re.split(r"\n\s*\n", part) if block.strip() for x in _block(block.strip("\n").split("\n"), targets)]
    return "\n".join(out)


def _block(lines: list[str], targets: dict[str, str], quoted: int = 0) -> Iterator[str]:
    """HTML of a block without blank lines: a heading, then a quotation, list, table, raw HTML or paragraph."""
    if m := re.match(r"(#{1,6})\s+(.*)", lines[0]):
        yield f"<h{len(m[1])}>{_inline(m[2], targets)}</h{len(m[1])}>"
        lines = lines[1:]
    if not lines:
        return
    if lines[0].startswith(">") and quoted < 20:
        inner = [re.sub(r"^> ?", "", x) for x in lines]
        held = "".join(y for x in "\n".join(inner).split("\n\n") if x.strip() for y in _block(x.split("\n"), targets, quoted + 1))
        yield f"<blockquote>{held}</blockquote>"
    elif all(_ITEM.fullmatch(x) for x in lines):
        yield _list([_ITEM.fullmatch(x).groups() for x in lines], targets)
    elif len(lines) > 1 and "|" in lines[0] and _RULE.fullmatch(lines[1]):
        cells = lambda x, tag: "<tr>" + "".join(f"<{tag}>{_inline(c.strip(), targets)}</{tag}>" for c in x.strip().strip("|").split("|")) + "</tr>"
        yield f"<table><thead>{cells(lines[0], 'th')}</thead><tbody>{''.join(cells(x, 'td') for x in lines[2:])}</tbody></table>"
    elif lines[0].lstrip().startswith("<"):
        yield "\n".join(lines)
    else:
        yield "<p>" + "<br>\n".join(_inline(x, targets) for x in lines) + "</p>"


def _list(items: list[tuple[str, str, str]], targets: dict[str, str]) -> str:
    """Items (indent, mark, text) as lists, one within the other by indent; open lists wait on a stack."""
    out: list[str] = []
    waiting: list[tuple[int, str]] = []
    for indent, mark, said in items:
        depth, tag = len(indent), "ol" if mark[0].isdigit() else "ul"
        while waiting and depth < waiting[-1][0]:
            out.append(f"</li></{waiting.pop()[1]}>")
        if waiting and (depth == waiting[-1][0] or depth < waiting[-1][0] + 2):
            out.append("</li>")
            if waiting[-1][1] != tag:
                out.append(f"</{waiting[-1][1]}><{tag}>")
                waiting[-1] = (waiting[-1][0], tag)
        else:
            out.append(f"<{tag}>")
            waiting.append((depth, tag))
        out.append(f"<li>{_inline(said, targets)}")
    out += [f"</li></{tag}>" for _, tag in reversed(waiting)]
    return "".join(out)


_KINDS = {"int": IntegerType(), "texts": ArrayType(StringType()), "text": StringType()}
_MEASURES = (
    ("length", "int"), ("sections", "texts"), ("required_sections", "int"), ("missing", "texts"), ("subheads", "int"), ("absence_filler", "int"), ("code_blocks", "int"),
    ("tables", "int"), ("images", "int"), ("captioned", "int"), ("prose", "text"), ("results", "text"), ("earlier", "text"),
)
MEASUREMENT = StructType([StructField(name, _KINDS[kind]) for name, kind in _MEASURES])


def captioned_images(root: Node) -> int:
    """Images whose innermost figure has a caption with text; of several captions in a figure the first one counts."""
    captions: dict[int, bool] = {}
    images: list[int | None] = []
    # Beside each element the chain of figures that it stands in, the innermost first.
    ahead: list[tuple[Node, tuple]] = [(root, ())]
    while ahead:
        node, figures = ahead.pop()
        if node.name == "figure":
            figures = (id(node), figures)
        elif node.name == "img":
            images.append(figures[0] if figures else None)
        elif node.name == "figcaption":
            said, above = bool(node.text("")), figures
            while above and above[0] not in captions:
                captions[above[0]] = said
                above = above[1]
        ahead += [(x, figures) for x in reversed(node.children) if isinstance(x, Node)]
    return sum(captions.get(f, False) for f in images if f is not None)


def measured(html: str | None) -> tuple:
    """What the rubric needs of a summary's tree; texts for the measures that are native."""
    root = parse(html)
    pictures, pres, tables, subheads = (len(root.find(*names)) for names in (("img",), ("pre",), ("table",), ("h4", "h5", "h6")))
    captioned = captioned_images(root)
    root.prune(lambda x: x.name in ("pre", "code"))
    text, parts = root.text(), sections_of(root)
    present = [m for m in fixed.SECTION_MARKERS if m in parts]
    earlier = " ".join(parts.get(m, "") for m in fixed.EARLIER_SECTIONS)
    return (len(text), present, sum(m in parts for m in fixed.REQUIRED_SECTIONS), [m for m in fixed.SECTION_MARKERS if m not in parts], subheads, sum(text.count(p) for p in fixed.ABSENCE_FILLER), pres, tables, pictures, captioned, text, parts.get(fixed.RESULTS_SECTION, ""), earlier)


def _string_udf(f):
    @F.pandas_udf(StringType())
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda x: None if x is None else attempted(f, x))

    return run


def attempted(f, html: str) -> str | None:
    """The function's result; a document that it can't take gives null and leaves the others alone."""
    try:
        return f(html)
    except (ValueError, AssertionError, RecursionError):
        return None


visible_text_udf = _string_udf(visible_text)
prose_text_udf = _string_udf(prose_text)
content_html_udf = _string_udf(content_html)
sanitized_udf = _string_udf(sanitized)
main_content_udf = _string_udf(main_content)
markdown_udf = _string_udf(markdown_html)


@F.pandas_udf(ArrayType(StringType()))
def images_udf(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([images(h, b) for h, b in zip(html, base, strict=True)])


@F.pandas_udf(StringType())
def join_url_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else joined_url(b or "", h) for b, h in zip(base, href, strict=True)])


@F.pandas_udf(StructType([StructField("html", StringType()), StructField("dropped", ArrayType(StringType()))]))
def sourced_images_udf(summary: pd.Series, source: pd.Series, known: pd.Series) -> pd.DataFrame:
    rows = [sourced_images(a, b, list(c) if c is not None else []) for a, b, c in zip(summary, source, known, strict=True)]
    return pd.DataFrame({"html": [r[0] for r in rows], "dropped": [r[1] for r in rows]})


@F.pandas_udf(MEASUREMENT)
def measured_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measured(x) for x in html], columns=[name for name, _ in _MEASURES])
