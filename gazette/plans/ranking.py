"""W, S and U-03/U-06 queries: ranking, selection, greedy duplicate removal, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette import fixed
from gazette.functions import text
from gazette.operators import frames
from gazette.operators.ranking import global_rank, greedy_dedup, ranked, select_for_digest
from gazette.plans.registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"


@query(
    "w01_relevance_rank",
    f"WITH {frames.SCORED} SELECT post_id, score, row_number() OVER (ORDER BY score DESC, published DESC, ord) AS rank FROM scored",
)
def w01(spark, sf):
    return ranked(frames.scored(spark, sf).select("post_id", "score", "published", "ord")).select("post_id", "score", "rank")


def line_up(spark, sf, max_posts, cap):
    """Date window, length gate, score threshold, then the line-up."""
    posts = frames.scored(spark, sf)
    inside = posts.where(F.col("published").between(F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-25 23:59:59.999999").cast("timestamp")))
    good = inside.where((F.length("content") >= fixed.MIN_CONTENT_LENGTH) & (F.col("score") >= fixed.MIN_SCORE))
    chosen = select_for_digest(good, max_posts, cap)
    return chosen.select("post_id", "title", "source", "score", F.date_format("published", STAMP).alias("published"), "position")


def line_up_sql(max_posts, cap):
    limit = f"LIMIT {max_posts}" if max_posts else ""
    over = f"nth > {cap}" if cap else "false"
    return f"""WITH {frames.SCORED},
good AS (SELECT * FROM scored WHERE published BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 23:59:59.999999' AND length(content) >= 600 AND score >= 0.7::double),
own AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, published DESC, ord) AS nth FROM good),
chosen AS (SELECT *, {over} AS late FROM own ORDER BY late, score DESC, published DESC, ord {limit})
SELECT post_id, title, source, score, strftime(published, '%Y-%m-%d %H:%M:%S') AS published, row_number() OVER (ORDER BY score DESC, published DESC, late, ord) AS position FROM chosen"""


@query("w02_select_for_digest", line_up_sql(5, 2))
def w02(spark, sf):
    return line_up(spark, sf, 5, 2)


@query("w03_backfill", line_up_sql(30, 1))
def w03(spark, sf):
    return line_up(spark, sf, 30, 1)


@query("s02_all_without_limit", line_up_sql(None, None))
def s02(spark, sf):
    return line_up(spark, sf, None, None)


@query("s02_cap_without_limit", line_up_sql(None, 2))
def s02_cap(spark, sf):
    return line_up(spark, sf, None, 2)


def keyed(spark, sf):
    """Posts of all sources in order of fetching, with the title's key."""
    return frames.posts(spark, sf).withColumn("title_key", text.title_key(F.col("title")))


TITLE_KEY = "trim(regexp_replace(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "w04_greedy_dedup",
    f"""WITH RECURSIVE {frames.POSTS}, keyed AS (SELECT post_id, 'l' || (post_id % 211) AS link, {TITLE_KEY} AS k, row_number() OVER (ORDER BY ord) AS n FROM posts),
walk AS (
  SELECT 0::bigint AS n, []::varchar[] AS links, []::varchar[] AS keys, []::bigint[] AS ids
  UNION ALL
  SELECT k.n, CASE WHEN ok THEN list_append(links, k.link) ELSE links END, CASE WHEN ok AND k.k <> '' THEN list_append(keys, k.k) ELSE keys END, CASE WHEN ok THEN list_append(ids, k.post_id) ELSE ids END
  FROM (SELECT w.links, w.keys, w.ids, k.*, NOT list_contains(w.links, k.link) AND (k.k = '' OR NOT list_contains(w.keys, k.k)) AS ok FROM walk w JOIN keyed k ON k.n = w.n + 1) k)
SELECT post_id, k AS title_key FROM keyed WHERE list_contains((SELECT ids FROM walk ORDER BY n DESC LIMIT 1), post_id)""",
)
def w04(spark, sf):
    rows = keyed(spark, sf).withColumn("link", F.concat(F.lit("l"), F.col("post_id") % 211))
    return greedy_dedup(rows).select("post_id", "title_key")


@query(
    "w05_in_page_dedup",
    f"WITH {frames.POSTS} SELECT source, lower(title) AS k, min(post_id) AS post_id FROM posts GROUP BY 1, 2",
)
def w05(spark, sf):
    return frames.posts(spark, sf).groupBy("source", F.lower("title").alias("k")).agg(F.min("post_id").alias("post_id"))


@query(
    "w06_render_order",
    f"""WITH {frames.SCORED}, named AS (SELECT post_id, source, score, strftime(published, '%Y-%m-%d') AS day, source || '-' || lpad(post_id::varchar, 9, '0') || '.json' AS file FROM scored)
SELECT post_id, file, row_number() OVER (ORDER BY score DESC, day DESC, file) AS place FROM named""",
)
def w06(spark, sf):
    rows = frames.scored(spark, sf)
    named = rows.select("post_id", "score", F.date_format("published", "yyyy-MM-dd").alias("day"), F.concat("source", F.lit("-"), F.lpad(F.col("post_id").cast("string"), 9, "0"), F.lit(".json")).alias("file"))
    return global_rank(named, [F.desc("score"), F.desc("day"), F.asc("file")], "place").select("post_id", "file", "place")


@query(
    "w07_article_names",
    f"""WITH {frames.SCORED} SELECT post_id, 'newsletter-dev-2024-01-31-en-a' || CASE WHEN n < 100 THEN lpad(n::varchar, 2, '0') ELSE n::varchar END || '.html' AS name
FROM (SELECT post_id, row_number() OVER (ORDER BY score DESC, published DESC, ord) AS n FROM scored)""",
)
def w07(spark, sf):
    placed = select_for_digest(frames.scored(spark, sf).select("post_id", "source", "score", "published", "ord"), None, None)
    number = F.col("position").cast("string")
    padded = F.when(F.col("position") < 100, F.lpad(number, 2, "0")).otherwise(number)
    return placed.select("post_id", F.concat(F.lit("newsletter-dev-2024-01-31-en-a"), padded, F.lit(".html")).alias("name"))


@query(
    "w08_first_credible_title",
    r"""WITH c AS (SELECT doc_id, [split_part(text, chr(10), 2), '  ', 'Read more', left(split_part(text, chr(10), 1), 60), source] AS candidates FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, list_transform(candidates, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS tidy FROM c)
SELECT doc_id, list_filter(tidy, lambda x: x <> '' AND length(x) <= 250 AND NOT (contains(lower(x), '«') OR contains(lower(x), '»') OR
  len(list_filter(regexp_extract_all(replace(lower(x), 'ß', 'ss'), '\p{L}+'), lambda w: NOT list_contains([NAV], w))) = 0))[1] AS title FROM t""".replace("NAV", ", ".join(f"'{w}'" for w in fixed.NAV_WORDS + fixed.TITLE_STOPWORDS)),
)
def w08(spark, sf):
    d = frames.table(spark, sf, "documents").where("text IS NOT NULL")
    candidates = F.array(F.split_part("text", F.lit("\n"), F.lit(2)), F.lit("  "), F.lit("Read more"), F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(60)), "source")
    return d.select("doc_id", text.credible_title(candidates).alias("title"))


@query("s01_by_date", f"WITH {frames.POSTS} SELECT post_id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM posts ORDER BY posts.published DESC, ord")
def s01(spark, sf):
    return frames.posts(spark, sf).orderBy(F.desc("published"), "ord").select("post_id", F.date_format("published", STAMP).alias("published"))


@query(
    "s06_tag_cap",
    f"""WITH {frames.POSTS}, w AS (SELECT post_id, unnest(string_split(content, ' ')) AS word, generate_subscripts(string_split(content, ' '), 1) AS i FROM posts),
f AS (SELECT post_id, word, min(i) AS i FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY i) AS n FROM f)
SELECT post_id, string_agg(word, '|' ORDER BY i) AS tags FROM r WHERE n <= 5 GROUP BY post_id""",
)
def s06(spark, sf):
    words = F.split("content", " ")
    return frames.posts(spark, sf).select("post_id", F.array_join(text.first_tags(words), "|").alias("tags"))


@query("s07_newest_run", f"WITH {frames.POSTS} SELECT strftime(max(published), '%Y-%m-%d') AS newest FROM posts")
def s07(spark, sf):
    return frames.posts(spark, sf).agg(F.date_format(F.max("published"), "yyyy-MM-dd").alias("newest"))


@query(
    "s03_weakest_dimensions",
    f"""WITH {frames.SCORED}, u AS (SELECT 1 AS k, 'length' AS dimension, avg(score) AS mean FROM scored UNION ALL SELECT 2, 'structure', avg(least(1.0, n_chars / 5000.0::double)) FROM scored UNION ALL SELECT 3, 'lede', avg(length(title) / 80.0::double) FROM scored UNION ALL SELECT 4, 'caption', avg(score * score) FROM scored)
SELECT dimension, round(mean, 6) AS mean FROM u ORDER BY mean, k LIMIT 3""",
)
def s03(spark, sf):
    s = frames.scored(spark, sf)
    means = s.agg(F.avg("score").alias("length"), F.avg(F.least(F.lit(1.0), F.col("n_chars") / 5000.0)).alias("structure"), F.avg(F.length("title") / 80.0).alias("lede"), F.avg(F.col("score") * F.col("score")).alias("caption"))
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("dimension"), F.col(c).alias("mean")) for k, c in enumerate(means.columns, 1)])
    return means.select(F.explode(names).alias("x")).select("x.*").orderBy("mean", "k").limit(3).select("dimension", F.round("mean", 6).alias("mean"))


@query(
    "s04_top_markers",
    f"""WITH {frames.POSTS}, m AS (SELECT post_id, unnest(['the', 'and', 'de', 'que', 'der', 'und']) AS marker, content FROM posts), c AS (SELECT post_id, marker, (length(content) - length(replace(content, ' ' || marker || ' ', ''))) // (length(marker) + 2) AS n FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, marker) AS k FROM c WHERE n > 0) SELECT post_id, string_agg(marker || '=' || n, ',' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY post_id""",
)
def s04(spark, sf):
    markers = ("the", "and", "de", "que", "der", "und")
    counts = F.array(*[F.struct((-text.occurrences(F.col("content"), f" {m} ")).alias("n"), F.lit(m).alias("marker")) for m in markers])
    top = F.slice(F.array_sort(F.filter(counts, lambda x: x["n"] < 0)), 1, 3)
    named = F.array_join(F.transform(top, lambda x: F.concat(x["marker"], F.lit("="), (-x["n"]).cast("string"))), ",")
    return frames.posts(spark, sf).select("post_id", named.alias("top")).where("top <> ''")

