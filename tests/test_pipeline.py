"""Model stages, rubric, evaluation, rendering, delivery, alerts, settings, guards, streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gazette import config
from gazette.operators import alerts, delivery, evalmetrics, greeting, guard, health, joins, model, prompts, render, rubric
from gazette.sources import files
from gazette.streaming import digest


class Flaky(model.RuleScorer):
    """Fails on batches and on some items."""

    def batch(self, inputs):
        raise RuntimeError("no batches")

    def one(self, item):
        if "bad" in item["text"]:
            raise RuntimeError("no")
        return super().one(item)


def test_fallback_keeps_alignment():
    got = model.with_fallback(Flaky(), [{"text": "a"}, {"text": "bad"}, {"text": "c d"}], 2)
    assert [r and r["reason"] for r in got] == ["1 words", None, "2 words"]


POSTS = "post_id long, ord long, link string, source string, title string, content string, published timestamp"


def posts(spark):
    day = datetime(2024, 1, 1)
    long = "<p>" + "word " * 600 + "</p>"
    rows = [(1, long), (2, "<p>" + "bad word " * 300 + "</p>"), (3, "short"), (4, "<p>" + "few " * 200 + "</p>"), (5, long)]
    return spark.createDataFrame([(k, k, f"https://a.example/{k}", "a", f"t{k}", c, day) for k, c in rows], POSTS)


def test_process_posts(spark):
    done, rejected = model.process_posts(posts(spark), Flaky(), model.RuleSummarizer(), max_posts=1)
    assert [(r.post_id, r.position) for r in done.collect()] == [(1, 1)]
    why = {r.post_id: r.reason for r in rejected.collect()}
    assert why[2] == "Filtering failed (no model response)." and why[3].startswith("Insufficient content: 5 ") and why[4] == "200 words"
    assert set(why) == {2, 3, 4}


def test_unsourced_images_are_dropped(spark):
    class Liar(model.RuleSummarizer):
        def one(self, item):
            return {"summary": "x\n\n![a](https://nowhere.example/i.png)", "one_liner": "<b>l</b>\n m", "tags": "", "urls": "[t](https://u.example), [x](javascript:1)"}

    done, _ = model.summarize_posts(posts(spark).where("post_id = 1"), Liar())
    row = done.first()
    assert "img" not in row.summary and row.dropped_images == ["https://nowhere.example/i.png"]
    assert (row.one_liner, row.tags) == ("l m", ["uncategorized"])
    assert [x.url for x in row.links] == ["https://u.example"] == row.unsourced


def test_rubric(spark):
    html = "<h3>📌 a</h3><p>지연이 22% 줄었습니다.</p><h3>🛠️ b</h3><p>이것은 빠르다.</p><figure><img src='x'/><figcaption>c</figcaption></figure><h3>📊 c</h3><p>22% 개선되었습니다:</p>"
    df = spark.createDataFrame([("a", html, "이 글은 짧습니다."), ("b", None, None)], "article_id string, summary_html string, one_liner string")
    rows = {r.article_id: r for r in rubric.evaluate(df).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.structure_score, a.register_score, a.terminal_colon_score, a.distinctiveness_score, a.caption_score) == (1.0, 0.8, 0.0, 0.8, 1.0)
    assert a.lede_score == pytest.approx(0.3) and b.length == 0 and b.lede_score == 0
    assert [r.dimension for r in rubric.weakest(rubric.evaluate(df)).collect()][0] == "length"


def test_eval_report(spark):
    rows = [(i, b, s) for i, b, scores in (("a", "high", (0.85, 0.85)), ("b", "strong", (0.70, 0.65)), ("c", "high", (0.83, 0.83))) for s in scores]
    df = spark.createDataFrame(rows, "article_id string, expected_band string, score double")
    r = evalmetrics.report(evalmetrics.article_stats(df)).first()
    assert (r.determinism_rate, r.grid_rate, r.band_match_rate) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1.0)


def test_health_lines(spark):
    rows = [("u1", "f", "ok", 3, 1, 5, None), ("u2", "f", "empty", 0, 0, 0, None), ("u3", "f", "empty", 0, 0, None, None), ("u4", "f", "failed", 0, 0, None, None)]
    df = spark.createDataFrame(rows, "url string, fetcher string, status string, post_count long, duplicates long, candidates long, error string")
    assert health.summary_line(health.counts(df)).first().line == "1 ok, 2 empty (1 with nothing to filter), 1 failed (3 posts)"
    lines = [r.line for r in health.report_lines(df).orderBy("url").collect()]
    assert lines[0] == "  - u1: 3 posts (1 deduped)" and "LIKELY BROKEN" in lines[1] and "no count" in lines[2] and lines[3].endswith("unknown error")


def test_rendering(spark):
    rows = [(1, "https://a.example/1", "eugene_yan", "A <b>", "<p>x</p>", 0.9, datetime(2024, 1, 2)), (2, "javascript:x", "unknown", "B", "<p>y</p>", 0.9, datetime(2024, 1, 3)), (3, "l", "s", "C", "", 1.0, datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "post_id long, link string, source string, title string, summary string, score double, published timestamp")
    logos = spark.createDataFrame([("unknown", "u.png")], "source string, logo string")
    view = render.articles(df, logos, "en").orderBy("place").collect()
    assert [(r.post_id, r.link, r.logo, r.source_label) for r in view] == [(2, "", "u.png", ""), (1, "https://a.example/1", "u.png", "Eugene Yan")]
    html = render.issue([render.card(r.asDict(), "en") for r in view], "T", "<script>", "F", "2024-01-03", "en")
    assert "A &lt;b&gt;" in html and "<script>" not in html and "★ 0.90" in html
    assert not render.size_of(html)["clipped"] and render.size_of("x" * 102_401)["clipped"]
    assert render.file_name("newsletter", "dev", "2024-01-03", "en", 3) == "newsletter-dev-2024-01-03-en-a03.html"
    assert render.page_offsets(2000) == [0, 1950]


def test_delivery_resumes(spark, tmp_path):
    people = spark.createDataFrame([("a@x.example",), ("B@x.example",), ("c@x.example",), ("a@x.example",)], "email string")
    where, sent = str(tmp_path), []

    def crash(email):
        if email.startswith("c"):
            return False
        sent.append(email)
        return True

    first = delivery.deliver(people, where, "dev", "2024-01-01", "en", crash)
    assert (first["succeeded"], first["failed"]) == (2, ["c@x.example"])
    again = spark.createDataFrame([("A@X.example",), ("c@x.example",)], "email string")
    second = delivery.deliver(again, where, "dev", "2024-01-01", "en", lambda e: sent.append(e) or True)
    assert (second["skipped"], second["attempted"]) == (1, 1) and sent.count("c@x.example") == 1


def test_alarms(spark):
    fields = spark.createDataFrame([("Crawl", "ALERT", 2, "Log", "a\nb\n"), ("Crawl", "ALERT", 1, "Longer", "2"), ("Crawl", "ALERT", 0, "Day", "1"), ("Run", "OK", 0, "Log", "x\ny")], "event string, status string, ord int, field string, value string")
    rows = {r.event: r for r in alerts.alarms(fields, "p", F.lit("2026-06-10 04:12:00").cast("timestamp")).collect()}
    assert rows["Crawl"].subject == "[p] Crawl — ALERT"
    assert rows["Crawl"].message == "Crawl ALERT\n\nDay:    1\nLonger: 2\n\nLog:\na\nb\n\n— 2026-06-10 04:12:00 UTC"
    assert rows["Run"].message == "Run OK\n\n\nLog:\nx\ny\n\n— 2026-06-10 04:12:00 UTC"
    run = "failed int, broken int, total_posts int, rejected int, chosen int, failed_deliveries int, resolved int, bytes int, error string"
    fires = lambda *x: [r.event for r in alerts.due(spark.createDataFrame([x], run)).collect() if r.fires]
    assert fires(None, None, 3, 3, 0, None, 0, None, None) == ["empty digest", "no recipients"]
    assert fires(None, None, 3, 0, 0, None, None, 102_400, None) == fires(*[None] * 9) == []
    assert fires(1, 0, 3, 1, 2, 4, 9, 102_401, "x") == ["crawl health", "partial delivery", "clipped issue", "run failure"]


def test_messages():
    m = delivery.message("S", "news@a.example", ["r@b.example"], "<p>é</p>")
    assert (m["Subject"], m["To"], m["List-Unsubscribe"]) == ("S", "r@b.example", "<mailto:news@a.example?subject=unsubscribe>") and "@a.example>" in m["Message-ID"]
    assert m.get_payload()[0].get_payload(decode=True).decode() == "<p>é</p>"
    assert delivery.message("S", "nobody", ["r@b.example"], "")["List-Unsubscribe"] is None
    sent = []
    send = delivery.sender_of(lambda *x: sent.append(x[:2]), "S", "news@a.example", "<p>x</p>")
    assert send("r@b.example") and not send("") and sent == [("news@a.example", ["r@b.example"])]


def test_a_run_that_breaks_off_leaves_its_ledger(spark, tmp_path):
    people = spark.createDataFrame([("a@x.example",), ("A@X.example",), ("b@x.example",), ("c@x.example",)], "email string")

    def crash(email):
        if email.startswith("c"):
            raise KeyboardInterrupt
        return True

    with pytest.raises(KeyboardInterrupt):
        delivery.deliver(people, str(tmp_path), "dev", "2024-01-01", "en", crash)
    sent = []
    after = delivery.deliver(people, str(tmp_path), "dev", "2024-01-01", "en", lambda e: sent.append(e) or True, batch=1)
    assert (after["resolved"], after["skipped"], sent) == (3, 2, ["c@x.example"])


def test_regenerated_days_and_greetings(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    post = "title string, link string, content string, summary string, one_liner string, tags array<string>, urls array<string>, date string"
    rows = [("B", "l2", "c", "old", "o", ["t"], [], "2024-01-02"), ("A", "l1", "c", "old", "o", ["t"], [], "2024-01-02"), ("C", "l3", "", "old", "o", [], [], "2024-01-02")]
    files.write_posts(spark.createDataFrame(rows, post), path)
    listed = files.list_posts(spark, path, "2024-01-02").collect()
    assert [(r.file, r.title) for r in listed] == sorted((r.file, r.title) for r in listed) and len(listed) == 3
    new = spark.createDataFrame([("l1", "new", "n", ["u"], ["x"]), ("l3", "new", "n", [], [])], "link string, summary string, one_liner string, tags array<string>, urls array<string>")
    files.write_regenerated(files.read_posts(spark, path, "2024-01-02"), new, path, "-b")
    assert [(r.title, r.summary, r.tags) for r in files.read_posts(spark, path, "2024-01-02-b").collect()] == [("A", "new", ["u"])]
    assert files.read_posts(spark, path, "2024-01-02").count() == 3 and files.read_greeting(spark, path, "2024-01-02") is None
    files.write_greeting(spark, path, "2024-01-02", "Guten Tag\né")
    assert files.read_greeting(spark, path, "2024-01-02") == "Guten Tag\né" and files.read_posts(spark, path, "2024-01-02").count() == 3


def test_overridden_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS old, map('b', CAST(NULL AS INT), 'c', 3) AS new")
    assert df.select(joins.overridden(F.col("old"), F.col("new")).alias("x")).first().x == {"a": 1, "b": None, "c": 3}


def test_repeated_quantities_are_sorted(spark):
    html = "<h3>🛠️ b</h3><p>9% 그리고 22% 입니다.</p><h3>📊 c</h3><p>22% 그리고 9% 입니다.</p>"
    row = rubric.evaluate(spark.createDataFrame([("a", html, "")], "article_id string, summary_html string, one_liner string")).first()
    assert row.repeated_quantities == sorted(["22%", "9%"])


def test_greetings():
    revise = lambda text, n: "w " * 12
    assert greeting.greet("w " * 15, revise, (10, 20), "en") == "w " * 15
    assert greeting.greet("w " * 40, revise, (10, 20), "en") == "w " * 12
    assert greeting.greet("w " * 25, lambda t, n: "w " * 5, (10, 20), "en") == "w " * 25


def test_prompts():
    t = prompts.Template("fixed {{x}} <!-- cache --> about {topic}", ("topic",))
    assert t.filled(topic="T") == "fixed {x} <!-- cache --> about T" and t.split() == ("fixed {{x}} ", " about {topic}")
    for bad in (("{a}", ()), ("x", ("a",))):
        with pytest.raises(ValueError):
            prompts.Template(*bad)


def test_repair():
    parse = lambda said: model.parse_tags(said, ("score",), ("title",))
    good = model.Repaired(lambda item: "<score>", parse, lambda said, why: f"<score> 1 </score><TITLE>{why}</TITLE>")
    assert good.one({}) == {"score": "1", "title": "no score"}
    assert model.with_fallback(model.Repaired(lambda item: "", parse), [{}], 1) == [None]


def test_settings():
    assert config.load({"selection": {"min_score": None, "max_posts": 4}}).selection == config.Selection(max_posts=4)
    for bad in ({"schedule": "x"}, {"issue": {"send_emails": True}}, {"odd": 1}):
        with pytest.raises(ValueError):
            config.load(bad)


def test_guards():
    blocked = ["http://127.0.0.1", "http://2130706433/", "http://0x7f.1/", "http://[::1]/", "http://10.0.0.1", "http://169.254.169.254/x", "file:///etc", "http://localhost", ""]
    assert not any(map(guard.may_fetch, blocked))
    assert guard.may_fetch("https://example.org/a") and guard.may_fetch("http://8.8.8.8/")
    assert [guard.is_email(x) for x in ("a.b+c@d.example", "a@b", "a b@c.example", "@c.example", "a@-c.example", "a@c.123", ".a@c.example")] == [True, False, False, False, False, False, False]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"link": "l1", "published": "2024-01-02", "source": "s"}\n{"link": "l1", "published": "2024-01-03", "source": "s"}\n{"link": "l2", "published": "?", "source": "s"}\n')
    entries = digest.read_entries(spark, str(tmp_path / "in"))
    counts = digest.weekly_counts(entries).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert [(r.source, r.n) for r in spark.table("weeks").collect()] == [("s", 2)]
    got = []
    for n in "12":
        q = digest.deliver_stream(entries, str(tmp_path / f"check{n}"), str(tmp_path / "ledger"), lambda df, k: got.append(df.count()))
        q.awaitTermination()
    assert got == [1, 0]


def test_score_column_is_kept_without_scorer(spark):
    done, _ = model.process_posts(posts(spark).withColumn("score", F.col("post_id") / 10), None, model.RuleSummarizer(), max_posts=2)
    assert sorted(r.post_id for r in done.collect()) == [4, 5]
