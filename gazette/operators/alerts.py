"""Alerts: when they fire and how they read, both as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette import fixed


def alarms(fields: DataFrame, project: str, at: Column | None = None) -> DataFrame:
    """(event, status, ord, field, value) -> (event, status, subject, message), one row for each event and status.

    Fields of one line stand first, in order, their values aligned; then fields of several lines as blocks; then the time in UTC.
    """
    several = F.contains("value", F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "field", "value", several.alias("several"))))
    width = F.max(F.when(~several, F.length("field") + 1))
    events = fields.groupBy("event", "status").agg(rows.alias("rows"), F.coalesce(width, F.lit(0)).alias("width"))
    inline = F.transform(F.filter("rows", lambda r: ~r["several"]), lambda r: F.concat(F.rpad(F.concat(r["field"], F.lit(":")), F.col("width"), F.lit(" ")), F.lit(" "), r["value"]))
    blocks = F.transform(F.filter("rows", lambda r: r["several"]), lambda r: F.concat(F.lit("\n"), r["field"], F.lit(":\n"), F.trim(r["value"], F.lit("\n"))))
    title = F.concat_ws(" ", "event", "status")
    stamp = F.concat(F.lit("\n— "), F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    message = F.array_join(F.concat(F.array(title, F.lit("")), inline, blocks, F.array(stamp)), "\n")
    subject = F.concat(F.lit(f"[{project}] "), "event", F.lit(" — "), "status")
    return events.select("event", "status", subject.alias("subject"), message.alias("message"))


def predicates() -> dict[str, Column]:
    """When each event is due, over a run's summary row: failed, broken, total_posts, rejected, chosen, failed_deliveries, resolved, bytes, error.

    What is null calls for nothing.
    """
    get = lambda name: F.coalesce(F.col(name), F.lit(0))
    return {
        "crawl health": get("failed") + get("broken") > 0,
        "empty digest": (get("total_posts") > 0) & (get("rejected") > 0) & F.coalesce(F.col("chosen") == 0, F.lit(False)),
        "partial delivery": get("failed_deliveries") > 0,
        "no recipients": F.coalesce(F.col("resolved") == 0, F.lit(False)),
        "clipped issue": get("bytes") > fixed.CLIP_BYTES,
        "run failure": F.coalesce(F.length("error") > 0, F.lit(False)),
    }


def due(run: DataFrame) -> DataFrame:
    """(event, fires) for each event of a run's summary row, in a fixed order."""
    rows = F.array(*[F.struct(F.lit(k).alias("event"), v.alias("fires")) for k, v in predicates().items()])
    return run.select(F.explode(rows).alias("x")).select("x.*")
