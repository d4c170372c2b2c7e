"""The greeting: drafted, measured, revised once if its length is off; the closer of the two stays."""

from __future__ import annotations

from collections.abc import Callable


def measure(text: str, language: str) -> int:
    """Characters of Korean, words of other languages."""
    return len(text.strip()) if language == "ko" else len(text.split())


def greet(draft: str, revise: Callable[[str, int], str], band: tuple[int, int], language: str) -> str:
    low, high = band
    far = lambda x: max(low - measure(x, language), measure(x, language) - high, 0)
    if far(draft) == 0:
        return draft
    try:
        revised = revise(draft, measure(draft, language))
    except Exception:
        return draft
    return revised if far(revised) < far(draft) else draft
