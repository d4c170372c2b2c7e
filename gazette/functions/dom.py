"""A small HTML tree on the standard parser.

No element is closed by implication: an end tag closes the nearest open element of its name and all
within, and is ignored if there is none. Text of scripts, styles and templates is never visible text.
Every walk goes with a stack of its own, so elements may nest as deep as a page likes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from html import escape
from html.parser import HTMLParser
from itertools import accumulate

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset({"script", "style", "template"})


class Node:
    """An element. Children are elements, texts, and comments or declarations kept as raw markup."""

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str | Raw] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        ahead = [x for x in reversed(self.children) if isinstance(x, Node)]
        while ahead:
            node = ahead.pop()
            yield node
            ahead += [x for x in reversed(node.children) if isinstance(x, Node)]

    def strings(self) -> Iterator[str]:
        ahead = self.children[::-1]
        while ahead:
            x = ahead.pop()
            if isinstance(x, Node):
                if x.name not in HIDDEN:
                    ahead += x.children[::-1]
            elif not isinstance(x, Raw):
                yield x

    def text(self, joiner: str = " ") -> str:
        """Stripped, non-empty texts, joined."""
        return joiner.join(s for s in map(str.strip, self.strings()) if s)

    def find(self, *names: str) -> list[Node]:
        return [x for x in self.walk() if x.name in names]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def prune(self, gone: Callable[[Node], bool]) -> list[Node]:
        """Take out the elements below that ``gone`` says, with what they hold; what was taken out, in document order."""
        out, ahead = [], [self]
        while ahead:
            node = ahead.pop()
            kept = []
            for x in node.children:
                if isinstance(x, Node) and gone(x):
                    x.parent = None
                    out.append(x)
                else:
                    kept.append(x)
            node.children = kept
            ahead += [x for x in reversed(kept) if isinstance(x, Node)]
        return out

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def html(self, shown: Callable[[Node], bool | None] = lambda node: True, raw: bool = True, places: dict[int, tuple[int, int]] | None = None) -> str:
        """Markup of the element. ``shown`` says of each element whether it stands, only what it holds does (None), or neither; ``raw`` whether comments do.

        ``places`` gets where the markup of each element begins and ends, by the element's identity; one that doesn't stand has the place where it would.
        """
        out: list[str] = []
        ahead: list[Node | str] = [self]
        plain = False
        marks: dict[int, tuple[int, int]] = {}
        while ahead:
            x = ahead.pop()
            if isinstance(x, _End):
                out.append(x)
                plain = False
                marks[x.of] = marks[x.of][0], len(out)
            elif isinstance(x, Raw):
                out += [x] * raw
            elif isinstance(x, str):
                out.append(x if plain else escape(x, quote=False))
            else:
                stands, begins = shown(x) if x.name else None, len(out)
                if stands:
                    said = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in x.attrs.items())
                    out.append(f"<{x.name}{said}/>" if x.name in VOID else f"<{x.name}{said}>")
                    if x.name not in VOID:
                        ahead.append(_End(f"</{x.name}>"))
                        ahead[-1].of = id(x)
                        plain = x.name in ("script", "style")
                marks[id(x)] = begins, len(out)
                if stands or stands is None:
                    ahead += x.children[::-1]
        if places is not None:
            marks[id(self)] = 0, len(out)
            ends = [0, *accumulate(map(len, out))]
            places |= {k: (ends[begin], ends[end]) for k, (begin, end) in marks.items()}
        return "".join(out)


class _End(str):
    """A finished end tag; ``of`` is the identity of its element."""


class Raw(str):
    """Markup that is no element: comments and declarations."""


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)
        self.names: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {}, self.open)
        for k, v in attrs:
            node.attrs[k] = v or ""
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.names[tag]:
            return
        node = self.open
        while node.name != tag:
            self.names[node.name] -= 1
            node = node.parent
        self.names[tag] -= 1
        self.open = node.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.open.children.append(Raw(f"<!--{data}-->"))

    def handle_decl(self, decl: str) -> None:
        self.open.children.append(Raw(f"<!{decl}>"))


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"^([a-z0-9]*)((?:\.[\w-]+)*)(?:\[([\w-]+)([*^]?)=['\"]?([^'\"\]]+)['\"]?\])?$")


@cache
def _tests(selector: str) -> tuple[tuple[str, tuple[str, ...], str | None, str, str], ...]:
    tests = [_SIMPLE.match(x.strip()) for x in selector.split(",")]
    if not all(tests):
        raise ValueError(f"no simple selector: {selector}")
    return tuple((name, tuple(classes.split(".")[1:]), *rest) for name, classes, *rest in (m.groups() for m in tests))


def select(root: Node, selector: str) -> list[Node]:
    """Elements that match one of the comma-separated simple selectors: tag, classes, one attribute test."""
    tests = _tests(selector)

    def fits(node: Node) -> bool:
        for name, classes, attribute, kind, value in tests:
            if name and node.name != name or classes and any(c not in node.classes() for c in classes):
                continue
            if attribute:
                own = node.attrs.get(attribute)
                if own is None or not (value in own if kind == "*" else own.startswith(value) if kind == "^" else own == value):
                    continue
            return True
        return False

    return [x for x in root.walk() if fits(x)]
