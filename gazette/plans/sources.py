"""SRC queries: pages in the shapes of the index-page specifications, made from the documents table, and address checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.operators import frames, guard
from gazette.plans.registry import query
from gazette.shared import materialize, new_path
from gazette.sources import feeds, files, pages


#: A post on an index page of each kind: what stands before its number, its title, its date and the end.
SHAPES = {
    "engineering": ('<div><a href="/engineering/p', '"><h3>', "</h3><span>", "</span></a></div>"),
    "glue": ('<a class="glue-card" href="/glue/p', '"><span class="headline-5">', '</span><p class="glue-label">', "</p></a>"),
    "post-list": ('<li class="post-list__item"><a class="grid-post__link" href="/list/p', '">', '</a><p class="grid-post__date">', '</p><a class="t-14 t-bold">Data</a></li>'),
    "blog": ('<div class="card"><a href="/blog/p', '"><h3>', "</h3></a><time>", "</time></div>"),
    "blog-parent": ('<article><a href="/blog/p', '"><h2>', "</h2></a><span>", "</span></article>"),
    "news": ('<div><a href="/news/p', '"><h2>', "</h2></a><span>", "</span></div>"),
}
FOLDER = {"engineering": "engineering", "glue": "glue", "post-list": "list", "blog": "blog", "blog-parent": "blog", "news": "news"}


def index_pages(spark, sf, spec="blog"):
    """An index page for each source, with all its posts. A page holds what a site lists, so its size is a site's."""
    p = frames.posts(spark, sf)
    before, title, date, end = map(F.lit, SHAPES[spec])
    card = F.concat(before, "post_id", title, F.lit("Report "), "post_id", date, F.date_format("published", "MMM d, yyyy"), end)
    html = F.concat(F.lit("<html><body>"), F.array_join(F.array_sort(F.collect_list(card)), "\n"), F.lit("</body></html>"))
    return p.groupBy("source").agg(html.alias("html")).select(F.concat(F.lit("https://"), "source", F.lit(".example.com/blog/")).alias("url"), F.lit(spec).alias("spec"), "html")


DAYS = "TIMESTAMP '2024-01-08'", "TIMESTAMP '2024-01-14 23:59:59.999999'"


def page_posts(spec):
    def run(spark, sf):
        found = pages.posts_in_window(pages.scrape(index_pages(spark, sf, spec)), F.expr(DAYS[0]), F.expr(DAYS[1]))
        return found.select("link", "title", F.array_join("tags", ",").alias("tags"), F.date_format("published", "yyyy-MM-dd").alias("day"))

    return run


for number, spec in enumerate(("engineering", "glue", "post-list", "blog", "blog-parent", "news"), 4):
    query(
        f"src{number:02d}_{spec.replace('-', '_')}_pages",
        f"WITH {frames.POSTS} SELECT 'https://' || source || '.example.com/{FOLDER[spec]}/p' || post_id AS link, 'Report ' || post_id AS title, '{'Data' if spec == 'post-list' else ''}' AS tags, strftime(published, '%Y-%m-%d') AS day FROM posts WHERE date_trunc('day', published) BETWEEN {DAYS[0]} AND {DAYS[1]}",
    )(page_posts(spec))


@query("src01_feed_posts", f"WITH {frames.POSTS} SELECT link, 'Report ' || post_id AS title, strftime(published, '%Y-%m-%d %H:%M:%S') AS published FROM posts WHERE post_id % 9 <> 0 AND published BETWEEN {DAYS[0]} AND {DAYS[1]}")
def src01(spark, sf):
    """A feed for each source, written as XML and read back with the XML reader; every ninth date can't be read."""
    p = frames.posts(spark, sf)
    said = F.when(F.col("post_id") % 9 == 0, "some day").otherwise(F.concat(F.lit("Mon, "), F.date_format("published", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    item = F.concat(F.lit("<item><title>Report "), "post_id", F.lit("</title><link>"), "link", F.lit("</link><pubDate>"), said, F.lit("</pubDate></item>"))
    path = new_path(spark, "feeds")
    feed = p.groupBy("source").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value"))
    feed.write.partitionBy("source").text(path)
    kept = feeds.posts_in_window(feeds.entries(spark, path), F.expr(DAYS[0]), F.expr(DAYS[1]))
    return kept.select("link", "title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("snk01_posts_by_day", f"WITH {frames.SCORED} SELECT CASE WHEN day(published) = 9 THEN 'new' || post_id ELSE title END AS title, strftime(published, '%Y-%m-%d') AS date, score FROM scored")
def snk01(spark, sf):
    """All days written, one of them again: its rows are replaced, the others' stay."""
    rows = frames.scored(spark, sf).select("title", "link", "source", "score", F.date_format("published", "yyyy-MM-dd").alias("date"), F.dayofmonth("published").alias("d"), "post_id")
    path = new_path(spark, "runs")
    files.write_posts(rows.drop("d", "post_id"), path)
    files.write_posts(rows.where("d = 9").withColumn("title", F.concat(F.lit("new"), "post_id")).drop("d", "post_id"), path)
    return files.read_posts(spark, path).select("title", F.col("date").cast("string").alias("date"), "score")


@query("h20_article_view", f"""WITH {frames.SCORED}, v AS (SELECT post_id, score, strftime(published, '%Y-%m-%d') AS day, source, greatest(1, round_even(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) / 200.0::double, 0)::int) AS minutes,
source || '-' || replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), ' ', '_') || '-' || left(sha1(link), 8) || '.json' AS file FROM scored)
SELECT post_id, upper(left(source, 1)) || substr(source, 2) AS label, day, minutes, row_number() OVER (ORDER BY score DESC, day DESC, file) AS place FROM v""")
def h20(spark, sf):
    from gazette.operators import render

    rows = frames.scored(spark, sf).withColumn("summary", F.translate("content", "<&", "  "))
    logos = frames.literal(spark, [("unknown", "u.png")], "source string, logo string")
    return render.articles(rows, logos, "en").select("post_id", F.col("source_label").alias("label"), "day", F.col("reading_minutes").alias("minutes"), "place")


@query("src11_page_health", f"WITH {frames.POSTS} SELECT 'https://' || source || '.example.com/blog/' AS url, 'blog' AS fetcher, CASE WHEN count(*) FILTER (date_trunc('day', published) BETWEEN {DAYS[0]} AND {DAYS[1]}) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) FILTER (date_trunc('day', published) BETWEEN {DAYS[0]} AND {DAYS[1]}) AS post_count, 0::bigint AS duplicates, count(*) AS candidates, NULL::varchar AS error FROM posts GROUP BY source UNION ALL SELECT 'https://lost.example.com/', 'blog', 'failed', 0, 0, NULL, 'ValueError: page is missing'")
def src11(spark, sf):
    lost = frames.literal(spark, [("https://lost.example.com/", "blog", None)], "url string, spec string, html string")
    scraped = materialize(pages.scrape(index_pages(spark, sf).unionByName(lost)), "scraped")
    return pages.page_health(scraped, pages.posts_in_window(scraped, F.expr(DAYS[0]), F.expr(DAYS[1])))


@query("src13_may_fetch", "SELECT page_id, true AS allowed FROM pages")
def src13(spark, sf):
    return frames.table(spark, sf, "pages").select("page_id", guard.may_fetch_udf("url").alias("allowed"))


@query("f12_valid_emails", "SELECT c_custkey AS id, c_custkey % 3 <> 0 AS valid FROM customer")
def f12(spark, sf):
    c = frames.table(spark, sf, "customer")
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("reader "), "c_custkey", F.lit("@example"))).otherwise(F.concat(F.lit(" reader"), "c_custkey", F.lit("@example.org ")))
    return c.select(F.col("c_custkey").alias("id"), guard.is_email_udf(said).alias("valid"))
