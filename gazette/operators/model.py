"""The model stages: injected callables run over partitions, results joined by key.

A batch that fails is tried item by item; an item that fails has a null response, so every row comes
back. Stages are written to the shared folder before they branch, so that no call is made twice because
two consumers read its result; a lost executor repeats only the calls of its unfinished tasks.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette import fixed
from gazette.functions import scores, text
from gazette.functions.html import content_html_udf, markdown_udf, sourced_images_udf, visible_text_udf
from gazette.operators.ranking import select_for_digest
from gazette.shared import materialize


class Model(Protocol):
    """Turns inputs into responses, in order. Must be picklable."""

    def batch(self, inputs: list[dict[str, Any]]) -> list[dict[str, Any] | None]: ...

    def one(self, item: dict[str, Any]) -> dict[str, Any] | None: ...


class RuleScorer:
    """A deterministic offline scorer: word count decides. For tests and dry runs."""

    def one(self, item):
        words = len(item["text"].split())
        return {"title": "", "score": f"{min(20, words // 25) / 20:.2f}", "reason": f"{words} words"}

    def batch(self, inputs):
        return [self.one(x) for x in inputs]


class RuleSummarizer:
    """A deterministic offline summarizer: the first sentence and a paragraph."""

    def one(self, item):
        plain = item["text"]
        return {"summary": f"{plain[:200]}", "one_liner": plain.split(". ")[0][:80], "tags": "offline, summary", "urls": ""}

    def batch(self, inputs):
        return [self.one(x) for x in inputs]


@dataclass(frozen=True)
class Repaired:
    """A model whose raw texts are parsed, and given to a fixer once where that fails."""

    raw: Callable[[dict[str, Any]], str]
    parse: Callable[[str], dict[str, Any]]
    fix: Callable[[str, str], str] | None = None

    def one(self, item):
        said = self.raw(item)
        try:
            return self.parse(said)
        except ValueError as e:
            if self.fix is None:
                raise
            return self.parse(self.fix(said, str(e)))

    def batch(self, inputs):
        return [self.one(x) for x in inputs]


def parse_tags(said: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict[str, str]:
    """Inner text of the first element of each name; a required one that is missing or empty is an error."""
    out = {}
    for name in required + optional:
        found = re.search(rf"(?is)<{name}[^>]*>(.*?)</{name}>", said)
        if found and found[1].strip():
            out[name] = found[1].strip()
        elif name in required:
            raise ValueError(f"no {name}")
    return out


def with_retries(call: Callable[[], Any], attempts: int, wait: Callable[[int], float]) -> Any:
    """The call's result, tried again after a wait; the last failure is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            time.sleep(wait(k))
    return None


def with_fallback(model: Model, inputs: list[dict[str, Any]], size: int, attempts: int = 1, wait: Callable[[int], float] = lambda k: 0.0) -> list[dict[str, Any] | None]:
    """Responses in order; a failed chunk is tried item by item, a failed item is None."""
    out: list[dict[str, Any] | None] = []
    for a in range(0, len(inputs), size):
        chunk = inputs[a : a + size]
        try:
            found = model.batch(chunk)
            if len(found) != len(chunk):
                raise ValueError("a batch gave another number of responses")
        except Exception:
            found = []
            for x in chunk:
                try:
                    found.append(with_retries(lambda x=x: model.one(x), attempts, wait))
                except Exception:
                    found.append(None)
        out += found
    return out


def respond(rows: DataFrame, model: Model, fields: tuple[str, ...], concurrency: int | None = None, size: int = 10) -> DataFrame:
    """(post_id, text) -> (post_id, response struct of strings or null)."""
    schema = f"post_id long, response struct<{','.join(f'{f}:string' for f in fields)}>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = with_fallback(model, [{"text": t or ""} for t in batch["text"]], size)
            held = [None if r is None else {f: None if r.get(f) is None else str(r[f]) for f in fields} for r in said]
            yield pd.DataFrame({"post_id": batch["post_id"], "response": pd.Series(held, dtype=object, index=batch.index)})

    spread = rows if concurrency is None else rows.repartition(concurrency)
    return spread.select("post_id", "text").mapInPandas(run, schema)


REJECTION = "post_id long, stage string, reason string"


def gate(posts: DataFrame, least: int = fixed.MIN_CONTENT_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Posts with enough visible text (``visible`` added), and the rejections."""
    seen = posts.withColumn("visible", visible_text_udf(F.coalesce("content", F.lit(""))))
    n = F.length("visible")
    reason = F.format_string("Insufficient content: %d visible chars (minimum %d). Skipped before summarization.", n, F.lit(least))
    return seen.where(n >= least), seen.where(n < least).select("post_id", F.lit("gate").alias("stage"), reason.alias("reason"))


def score_posts(posts: DataFrame, scorer: Model, min_score: float = fixed.MIN_SCORE, concurrency: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts that reach the score (title and score overwritten), and the rejections: empty content, no response, unparseable, below."""
    empty = posts.where("content = ''").select("post_id", F.lit("score").alias("stage"), F.lit("No content available to evaluate.").alias("reason"))
    asked = posts.where("content <> ''").select("post_id", F.col("visible").alias("text"))
    said = materialize(respond(asked, scorer, ("title", "score", "reason"), concurrency), "scores")
    rows = posts.where("content <> ''").join(said, "post_id")
    score = F.when(F.col("response").isNotNull(), scores.score_of(F.col("response.score")))
    rows = rows.withColumns({"score": score, "title": F.coalesce(F.nullif(F.col("response.title"), F.lit("")), F.col("title"))})
    reason = (
        F.when(F.col("response").isNull(), "Filtering failed (no model response).")
        .when(F.col("score").isNull(), F.concat(F.lit("Filter response unparseable: "), F.coalesce("response.score", F.lit(""))))
        .when(F.col("score") < min_score, F.coalesce("response.reason", F.lit("No reason provided.")))
    )
    rows = rows.withColumn("why", reason)
    kept = rows.where("why IS NULL").drop("why", "response")
    return kept, empty.unionByName(rows.where("why IS NOT NULL").select("post_id", F.lit("score").alias("stage"), F.col("why").alias("reason")))


def summarize_posts(posts: DataFrame, summarizer: Model, concurrency: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts with summary (sanitized, only sourced images), one_liner, tags, links and unsourced links; and the rejections."""
    asked = posts.select("post_id", content_html_udf("content").alias("text"))
    said = materialize(respond(asked, summarizer, ("summary", "one_liner", "tags", "urls"), concurrency), "summaries")
    rows = posts.drop("summary", "one_liner", "tags", "urls").join(said, "post_id")
    why = F.when(F.col("response").isNull(), "Summarization failed (no model response).").when(F.coalesce("response.summary", F.lit("")) == "", "Summary validation failed: summary is empty")
    rows = rows.withColumn("why", why)
    good = rows.where("why IS NULL")
    images = F.col("images") if "images" in posts.columns else F.array().cast("array<string>")
    made = good.withColumn("checked", sourced_images_udf(markdown_udf("response.summary"), "content", images))
    lede = text.collapsed(visible_text_udf(F.coalesce("response.one_liner", F.lit(""))))
    urls_ = safe_links(F.col("response.urls"))
    out = made.withColumns({"summary": text.with_periods(F.col("checked.html")), "dropped_images": F.col("checked.dropped"), "one_liner": lede, "tags": text.first_tags(text.tags_of(F.col("response.tags"))), "links": urls_, "unsourced": F.filter(F.transform(urls_, lambda x: x["url"]), lambda u: ~F.contains(F.col("content"), u))})
    return out.drop("response", "checked", "why"), rows.where("why IS NOT NULL").select("post_id", F.lit("summary").alias("stage"), F.col("why").alias("reason"))


def safe_links(said):
    """Array of (url, anchor) of a text with Markdown links, or of a comma list; unsafe schemes are left out."""
    from gazette.functions.urls import is_safe_url

    said = F.coalesce(said, F.lit(""))
    pattern = F.lit(r"\[(.*?)]\((.*?)\)")
    marked = F.zip_with(F.regexp_extract_all(said, pattern, F.lit(1)), F.regexp_extract_all(said, pattern, F.lit(2)), lambda t, u: F.struct(text.trimmed(u).alias("url"), t.alias("label")))
    listed = F.transform(text.tags_of(said), lambda u: F.struct(u.alias("url"), u.alias("label")))
    both = F.filter(F.when(F.size(marked) > 0, marked).otherwise(listed), lambda x: is_safe_url(x["url"]))
    return F.transform(both, lambda x: F.struct(x["url"].alias("url"), text.anchor(x["url"], x["label"]).alias("anchor")))


def process_posts(posts: DataFrame, scorer: Model | None, summarizer: Model, max_posts: int | None = None, max_per_source: int | None = None, min_length: int = fixed.MIN_CONTENT_LENGTH, min_score: float = fixed.MIN_SCORE, concurrency: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Gate, score (unless there is no scorer), select, summarize: the issue's posts and all rejections.

    The limit comes before the summaries, which cost most.
    """
    kept, rejected = gate(posts, min_length)
    kept = materialize(kept, "gated")
    if scorer is not None:
        kept, more = score_posts(kept, scorer, min_score, concurrency)
        rejected = rejected.unionByName(more)
    elif "score" not in kept.columns:
        kept = kept.withColumn("score", F.lit(0.0))
    chosen = materialize(select_for_digest(kept, max_posts, max_per_source), "chosen")
    done, more = summarize_posts(chosen, summarizer, concurrency)
    return done, rejected.unionByName(more)
