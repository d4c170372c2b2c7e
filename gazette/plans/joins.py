"""J queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette import fixed
from gazette.operators import frames, joins
from gazette.plans.registry import query

P = f"WITH {frames.POSTS} "
HOSTS = ("https://www.amazon.science/x", "https://medium.com/@Pinterest_Engineering/feed", "https://medium.com/netflix-techblog", "https://MEDIUM.com/", "https://medium.com/@nobody/x", "https://x.ai:443/news", "https://x.ai/news", "", "https://www.qwenlm.github.io/blog", "https://example.org")
MAP = ", ".join(f"('{k}', '{v}')" for k, v in fixed.SOURCE_OF.items())


@query(
    "j01_source_of_link",
    f"WITH m(key, mapped) AS (VALUES {MAP}), c(k, v) AS (VALUES {', '.join(f'({k}, {chr(39)}{v}{chr(39)})' for k, v in enumerate(HOSTS))}), h AS (SELECT k, regexp_replace(lower(regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host, lower(regexp_extract(v, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+@*([^/?#]+)', 1)) AS handle FROM c) SELECT k, coalesce(a.mapped, b.mapped, 'unknown') AS source FROM h LEFT JOIN m a ON h.host = 'medium.com' AND h.handle <> '' AND a.key = h.handle LEFT JOIN m b ON b.key = h.host",
)
def j01(spark, sf):
    rows = frames.literal(spark, list(enumerate(HOSTS)), "k int, link string")
    return joins.with_source(rows, joins.source_map(spark)).select("k", "source")


@query("j01_source_of_page", f"WITH m(key, mapped) AS (VALUES {MAP}) SELECT page_id, coalesce(mapped, 'unknown') AS source FROM pages LEFT JOIN m ON key = regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')")
def j01_pages(spark, sf):
    return joins.with_source(frames.table(spark, sf, "pages"), joins.source_map(spark), "url").select("page_id", "source")


@query("j02_logos", P + ", l(source, logo) AS (VALUES ('src0', 'a.png'), ('src1', 'b.png'), ('unknown', 'u.png')) SELECT post_id, coalesce(l.logo, 'u.png') AS logo FROM posts LEFT JOIN l USING (source)")
def j02(spark, sf):
    logos = frames.literal(spark, [("src0", "a.png"), ("src1", "b.png"), ("unknown", "u.png")], "source string, logo string")
    return joins.with_logo(frames.posts(spark, sf), logos).select("post_id", "logo")


@query("j03_expected_band", f"WITH {frames.POSTS}, {frames.REPEATS} SELECT post_id, coalesce(any_value(expected_band), '?') AS band FROM posts LEFT JOIN repeats ON article_id = post_id GROUP BY post_id")
def j03(spark, sf):
    bands = frames.repeats(spark, sf).select(F.col("article_id").alias("post_id"), "expected_band").distinct()
    return frames.posts(spark, sf).join(bands, "post_id", "left").select("post_id", F.coalesce("expected_band", F.lit("?")).alias("band"))


@query("j04_merge_by_link", P + "SELECT link, 'new ' || post_id AS summary, title FROM posts WHERE post_id % 3 = 0")
def j04(spark, sf):
    old = frames.posts(spark, sf).select("link", "title", F.lit("old").alias("summary"))
    new = frames.posts(spark, sf).where("post_id % 3 = 0").select("link", F.concat(F.lit("new "), "post_id").alias("summary"))
    return joins.merged_by_link(old, new, ["summary"])


PEOPLE = "p AS (SELECT c_custkey AS id, 'Reader' || c_custkey || '@example.org' AS email FROM customer)"


def people(spark, sf):
    return frames.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Reader"), "c_custkey", F.lit("@example.org")).alias("email"))


@query("j05_ledger_anti_join", f"WITH {PEOPLE} SELECT id, email FROM p WHERE id % 4 <> 0")
def j05(spark, sf):
    done = people(spark, sf).where("id % 4 = 0").select(F.concat(F.lit(" "), F.upper("email")).alias("email"))
    return joins.undelivered(people(spark, sf), done)


@query("j06_without_flaky", f"WITH {frames.HEALTH} SELECT url, status FROM health WHERE NOT contains(url, 'src1') AND NOT contains(url, 'moved.')")
def j06(spark, sf):
    patterns = frames.literal(spark, [("src1",), ("moved.",), ("",)], "pattern string")
    return joins.without_flaky(frames.health(spark, sf), patterns).select("url", "status")


@query("j08_unsourced_links", P + ", u AS (SELECT post_id, content, unnest([left(content, 10), 'https://nowhere.example', substr(content, 20, 12), '']) AS u FROM posts) SELECT post_id, count(*) FILTER (u <> '' AND NOT contains(content, u)) AS unsourced FROM u GROUP BY post_id")
def j08(spark, sf):
    named = F.array(F.left("content", F.lit(10)), F.lit("https://nowhere.example"), F.substring("content", 20, 12), F.lit(""))
    found = joins.unsourced(frames.posts(spark, sf).withColumn("urls", named), "urls", "content")
    return found.select("post_id", F.size("unsourced").cast("long").alias("unsourced"))


@query("j09_responses_by_key", P + "SELECT post_id, CASE WHEN post_id % 5 = 0 THEN NULL ELSE 'r' || post_id END AS response FROM posts")
def j09(spark, sf):
    posts = frames.posts(spark, sf).select("post_id")
    responses = posts.where("post_id % 5 <> 0").select("post_id", F.concat(F.lit("r"), "post_id").alias("response"))
    return posts.join(responses, "post_id", "left")


@query("j10_compare_runs", f"WITH {frames.SCORED}, a AS (SELECT source, avg(score) AS m FROM scored WHERE post_id % 2 = 0 GROUP BY 1), b AS (SELECT source, avg(score) AS m FROM scored WHERE post_id % 2 = 1 GROUP BY 1) SELECT source, round(b.m - a.m, 6) AS delta, CASE WHEN abs(b.m - a.m) < 0.005 THEN '=' WHEN b.m > a.m THEN 'up' ELSE 'down' END AS arrow FROM a JOIN b USING (source)")
def j10(spark, sf):
    s = frames.scored(spark, sf)
    both = s.groupBy("source").agg(F.avg(F.when(F.col("post_id") % 2 == 0, F.col("score"))).alias("a"), F.avg(F.when(F.col("post_id") % 2 == 1, F.col("score"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    d = F.col("b") - F.col("a")
    return both.select("source", F.round(d, 6).alias("delta"), F.when(F.abs(d) < 0.005, "=").when(d > 0, "up").otherwise("down").alias("arrow"))


@query("j11_route_urls", "SELECT DISTINCT url, CASE WHEN contains(url, 'blog.') THEN 'BlogPages' WHEN contains(url, '/en/') THEN 'EnglishPages' WHEN contains(url, 'example') AND contains(url, '/fr/') THEN 'FrenchPages' ELSE 'RssFetcher' END AS fetcher FROM pages")
def j11(spark, sf):
    registry = frames.literal(spark, [(1, "blog.", "BlogPages"), (2, "/en/", "EnglishPages"), (3, "/fr/", "FrenchPages")], "rank int, fragment string, fetcher string")
    return joins.routed(frames.table(spark, sf, "pages").select("url").distinct(), registry)


@query("j12_profile_resolution", "WITH p(name) AS (VALUES ('global.m1'), ('eu.m2'), ('m3'), ('eu.m1')), w(m) AS (VALUES ('m1'), ('m2'), ('m3'), ('m4')) SELECT m, coalesce((SELECT name FROM p WHERE name = 'global.' || m), (SELECT name FROM p WHERE name = 'eu.' || m), (SELECT name FROM p WHERE name = m)) AS profile FROM w")
def j12(spark, sf):
    profiles = frames.literal(spark, [("global.m1",), ("eu.m2",), ("m3",), ("eu.m1",)], "name string")
    out = frames.literal(spark, [("m1",), ("m2",), ("m3",), ("m4",)], "m string")
    for k, prefix in enumerate(("global.", "eu.", "")):
        named = profiles.select(F.col("name").alias(f"n{k}"))
        out = out.join(named, F.concat(F.lit(prefix), "m") == F.col(f"n{k}"), "left")
    return out.select("m", F.coalesce("n0", "n1", "n2").alias("profile"))
