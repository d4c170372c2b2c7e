"""Issues and articles as HTML, file names, sizes."""

from __future__ import annotations

from html import escape
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette import fixed
from gazette.functions import scores, text, urls
from gazette.functions.html import visible_text_udf
from gazette.operators.joins import with_logo
from gazette.operators.ranking import global_rank


def articles(posts: DataFrame, logos: DataFrame, language: str) -> DataFrame:
    """The view of summarized posts: safe link, logo, label, day, reading minutes; in render order with ``place``.

    Order is by score, then day, then file name; a row without a summary is left out.
    """
    rows = with_logo(posts.where(F.coalesce("summary", F.lit("")) != ""), logos)
    view = rows.withColumns(
        {
            "link": F.when(urls.is_safe_url(F.col("link")), F.col("link")).otherwise(""),
            "source_label": text.source_label(F.col("source")),
            "day": F.date_format("published", "yyyy-MM-dd"),
            "reading_minutes": scores.reading_minutes(visible_text_udf("summary"), language),
            "file": text.post_filename(F.col("title"), F.col("source"), F.col("link")),
        }
    )
    return global_rank(view, [F.desc("score"), F.desc("day"), F.asc("file")], "place")


def card(article: dict[str, Any], language: str) -> str:
    """One article as a table row. Title, lede and tags are escaped; summary and links are sanitized before."""
    labels = fixed.LABELS.get(language, fixed.LABELS["en"])
    e = lambda k: escape(str(article.get(k) or ""))
    badge = f'<span class="score" title="{labels["relevance"]}">★ {article["score"]:.2f}</span>' if (article.get("score") or 0) > 0 else ""
    minutes = f" · {labels['reading_time'].format(minutes=article['reading_minutes'])}" if article.get("reading_minutes") else ""
    tags = "".join(f'<span class="tag">#{escape(t)}</span>' for t in article.get("tags") or [])
    lede = f'<p class="lede">{e("one_liner")}</p>' if article.get("one_liner") else ""
    more = "".join(f"<div>• {x}</div>" for x in article.get("anchors") or [])
    resources = f'<hr/><div class="resources"><b>{labels["resources"]}</b>{more}</div>' if more else ""
    logo = f'{article["source_label"]} logo' if article.get("source_label") else ""
    button = f'<p><a href="{e("link")}" rel="noopener noreferrer">{labels["view_more"]}</a></p>' if article.get("link") else ""
    return (
        f'<tr><td class="card"><img src="{e("logo")}" alt="{escape(logo)}" width="80"/><h2>{e("title")}</h2>'
        f'<p class="muted">{labels["published_on"]} {e("day")}{minutes} {badge}</p>'
        f"{f'<p>{tags}</p>' if tags else ''}{lede}<div>{article.get('summary') or ''}</div>{button}{resources}</td></tr>"
    )


def issue(cards: list[str], title: str, introduction: str, footer: str, day: str, language: str) -> str:
    """The whole issue, white space tightened outside pre elements."""
    body = "\n".join(cards)
    html = (
        f'<!DOCTYPE html>\n<html lang="{escape(language)}">\n<head><meta charset="utf-8"/><title>{escape(title)}</title></head>\n<body>\n'
        f'<div style="display:none">{escape(introduction[:140])}</div>\n<h1>{escape(title)}</h1>\n<p>{escape(day)}</p>\n<p>{escape(introduction)}</p>\n'
        f"<table>\n{body}\n</table>\n<p>{escape(footer)}</p>\n</body>\n</html>"
    )
    return tight(html)


def tight(html: str) -> str:
    """White space runs as one blank, except within pre elements."""
    import re

    parts = re.split(r"(?is)(<pre\b[^>]*>.*?</pre>)", html)
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]*\r?\n[ \t\r\n]*", " ", parts[k]))
    return "".join(parts)


def size_of(html: str) -> dict[str, Any]:
    """Bytes, share of what a mail client shows, and whether it is clipped."""
    n = len(html.encode())
    return {"bytes": n, "kb": n / 1024, "share": 100 * n / fixed.CLIP_BYTES, "clipped": n > fixed.CLIP_BYTES}


def file_name(base: str, stage: str, day: str, language: str, place: int | None = None) -> str:
    return f"{base}-{stage}-{day}-{language}{'' if place is None else f'-a{place:02d}'}.html"


def page_offsets(height: int) -> list[int]:
    """Where screenshots of a long page begin."""
    return list(range(0, height, fixed.PAGE_STEP))


