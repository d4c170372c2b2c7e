"""Prompt templates: checked placeholders, and the split of a fixed head from what varies, for caching."""

from __future__ import annotations

import re
from dataclasses import dataclass

CACHE_MARK = "<!-- cache -->"


@dataclass(frozen=True)
class Template:
    """A text with {placeholders}; each named variable must occur, and no other may."""

    text: str
    variables: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        found = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", self.text))
        if odd := found ^ set(self.variables):
            raise ValueError(f"placeholders and variables differ: {sorted(odd)}")

    def filled(self, **values: str) -> str:
        if missing := set(self.variables) - set(values):
            raise ValueError(f"no value for {sorted(missing)}")
        out = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", lambda m: str(values[m[1]]), self.text)
        return out.replace("{{", "{").replace("}}", "}")

    def split(self) -> tuple[str, str]:
        """The head before the mark, which can be cached, and the rest; no mark, no head."""
        head, mark, rest = self.text.partition(CACHE_MARK)
        return (head, rest) if mark else ("", self.text)
