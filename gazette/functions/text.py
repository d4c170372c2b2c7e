"""String builders: Column in, Column out, native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette import fixed


def trimmed(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    """Case-folded as far as the supported scripts need: lower case, and sharp s as two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def title_key(title: Column) -> Column:
    """Key under which titles are the same: folded, punctuation as blanks, blanks collapsed."""
    return collapsed(F.regexp_replace(folded(title), r"[^\p{L}\p{N}_\s]", " "))


def plain_spaces(text: Column) -> Column:
    """Narrow and plain no-break spaces as spaces."""
    return F.translate(text, "  ", "  ")


def tags_of(text: Column) -> Column:
    """Trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), trimmed), lambda x: x != "")


def first_tags(tags: Column) -> Column:
    """Distinct in order, capped; the default if there is none."""
    default = F.array(*map(F.lit, fixed.DEFAULT_TAGS))
    return F.when(F.size(tags) > 0, F.slice(F.array_distinct(tags), 1, fixed.MAX_TAGS)).otherwise(default)


def source_label(source: Column) -> Column:
    return F.when(source == fixed.UNKNOWN, "").otherwise(F.initcap(F.replace(source, F.lit("_"), F.lit(" "))))


def post_filename(title: Column, source: Column, link: Column) -> Column:
    """Lower-case title without punctuation, blanks as underscores, behind the source and before a short hash of the link."""
    plain = F.replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s-]", ""), F.lit(" "), F.lit("_"))
    return F.concat(source, F.lit("-"), plain, F.lit("-"), F.substring(F.sha1(link), 1, 8), F.lit(".json"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def escaped(text: Column) -> Column:
    """HTML-escaped."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def closed_references(html: Column) -> Column:
    """HTML in which only character references with their semicolon count; what a cut leaves of one is text. Browsers, and the tree, would read some of those."""
    return F.regexp_replace(html, r"&(?!(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def anchor(url: Column, text: Column) -> Column:
    return F.concat(F.lit('<a href="'), escaped(trimmed(url)), F.lit('">'), escaped(trimmed(text)), F.lit("</a>"))


def is_nav_text(text: Column) -> Column:
    """Whether a text is navigation: guillemets, or no word that names a subject."""
    low = folded(F.translate(text, " ", " "))
    words = F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))
    empty = F.array(*map(F.lit, fixed.NAV_WORDS + fixed.TITLE_STOPWORDS))
    return low.contains("«") | low.contains("»") | ~F.exists(words, lambda w: ~F.array_contains(empty, w))


def credible_title(candidates: Column) -> Column:
    """The first candidate that can be a title; null if none can."""
    tidy = F.transform(candidates, collapsed)
    return F.get(F.filter(tidy, lambda t: (t != "") & (F.length(t) <= fixed.TITLE_MAX_CHARS) & ~is_nav_text(t)), F.lit(0))


def without_call_to_action(name: Column) -> Column:
    return F.regexp_replace(name, fixed.CALL_TO_ACTION, "")


def is_korean(text: Column, threshold: float = 0.1) -> Column:
    """Whether Hangul makes up the share of what is no white space; false for blanks."""
    dense = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.when(dense == 0, False).otherwise(F.regexp_count(text, F.lit("[가-힣]")) / dense >= threshold)


def occurrences(text: Column, phrase: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])(?U)\s+"), trimmed), lambda s: s != "")


def plain_register(text: Column) -> Column:
    """Last 30 characters of sentences that end in the plain form."""
    plain = F.filter(sentences(text), lambda s: s.endswith("다.") & ~s.endswith("니다."))
    return F.transform(plain, lambda s: F.right(s, F.lit(30)))


def quantities(text: Column) -> Column:
    """Distinct numbers with a unit."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(fixed.MEASURED), F.lit(0)), trimmed))


def marker_counts(text: Column, markers: dict[str, str]) -> Column:
    """Map of marker to number of matches; markers without any are left out."""
    pairs = [x for name, pattern in markers.items() for x in (F.lit(name), F.regexp_count(text, F.lit(pattern)))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def terminal_colons(html: Column) -> Column:
    return F.regexp_count(html, F.lit(fixed.TERMINAL_COLON))


def with_periods(html: Column) -> Column:
    """Sentence-final colons as periods."""
    return F.regexp_replace(html, fixed.TERMINAL_COLON, "$1.")


def tag_content(text: Column, tag: str) -> Column:
    """Stripped inner text of the first element of that name; null if there is none or it is empty."""
    inner = trimmed(F.regexp_extract(text, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return F.nullif(inner, F.lit(""))


def tight_html(html: Column) -> Column:
    """White space runs shortened to one blank, except within pre elements."""
    pattern = r"(?is)<pre\b[^>]*>.*?</pre>"
    outside = F.transform(F.split(html, pattern, -1), lambda p: F.regexp_replace(F.regexp_replace(p, r"[ \t]*\r?\n[ \t\r\n]*", " "), r"[ \t]{2,}", " "))
    inside = F.concat(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(outside, inside, lambda a, b: F.concat(a, b)), "")


def regex_text(html: Column) -> Column:
    """Visible text by patterns alone: scripts, styles and comments dropped, tags as blanks, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(plain))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
