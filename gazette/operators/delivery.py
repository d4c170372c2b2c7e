"""Delivery with a ledger: who has an issue never gets it again, whatever breaks in between.

The ledger is an append-only table, a row for each success, partitioned by stage, day and language. A run
takes distinct recipients that the ledger lacks and sends on the driver, one by one: sending must not be
repeated by task retries. Successes are appended ``BATCH`` at a time, and also when a run breaks off, so only a
driver that is killed repeats messages, ``BATCH`` at most.
"""

from __future__ import annotations

from collections.abc import Callable
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText
from email.utils import make_msgid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators.joins import undelivered

#: Successes that one append records.
BATCH = 50
LEDGER = "email string, updated_at timestamp, stage string, day string, language string"


def ledger_key(stage: str, day: str, language: str, prefix: str = "") -> str:
    return f"{prefix}/ledger/{stage}/{day}/{language}".lstrip("/")


def read_ledger(spark: SparkSession, path: str, stage: str, day: str, language: str) -> DataFrame:
    """Who was served; an absent or unreadable ledger is an empty one."""
    try:
        rows = spark.read.schema("email string, updated_at timestamp").json(f"{path}/{ledger_key(stage, day, language)}")
        rows.limit(1).collect()
        return rows
    except Exception:
        return spark.createDataFrame([], "email string, updated_at timestamp")


def record(spark: SparkSession, path: str, stage: str, day: str, language: str, emails: list[str]) -> None:
    rows = spark.createDataFrame([(e,) for e in emails], "email string").withColumn("updated_at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").json(f"{path}/{ledger_key(stage, day, language)}")


def message(subject: str, sender: str, recipients: list[str], html: str) -> MIMEMultipart:
    """An HTML message. A sender with a domain names it in the message's id, and is where readers unsubscribe."""
    out = MIMEMultipart("alternative")
    out["Subject"], out["From"], out["To"] = subject, sender, ", ".join(recipients)
    _, at, domain = sender.partition("@")
    out["Message-ID"] = make_msgid(domain=domain) if at else make_msgid()
    if at:
        out["List-Unsubscribe"] = f"<mailto:{sender}?subject=unsubscribe>"
    out.attach(MIMEText(html, "html", "utf-8"))
    return out


def sender_of(transport: Callable[[str, list[str], str], None], subject: str, sender: str, html: str) -> Callable[[str], bool]:
    """What ``deliver`` sends with: a message for each recipient over the transport (sender, recipients, message text), whose errors are failures."""

    def send(email: str) -> bool:
        if not email:
            return False
        transport(sender, [email], message(subject, sender, [email], html).as_string())
        return True

    return send


def deliver(recipients: DataFrame, path: str, stage: str, day: str, language: str, send: Callable[[str], bool], use_ledger: bool = True, batch: int = BATCH) -> dict:
    """Counts of resolved, skipped, attempted and succeeded addresses, and the failed ones. A send that raises or says false has failed.

    Addresses that differ in case only are one, and the first in order stands for them.
    """
    spark = recipients.sparkSession
    email = F.trim("email")
    distinct = recipients.where(email != "").groupBy(F.lower(email).alias("_key")).agg(F.min(email).alias("email")).drop("_key")
    done = read_ledger(spark, path, stage, day, language) if use_ledger else spark.createDataFrame([], "email string")
    waiting = undelivered(distinct, done).orderBy("email")
    resolved, attempted, succeeded, failed, held = distinct.count(), 0, 0, [], []

    def keep() -> None:
        if use_ledger and held:
            record(spark, path, stage, day, language, held)
            held.clear()

    try:
        for row in waiting.toLocalIterator():
            attempted += 1
            try:
                ok = send(row.email)
            except Exception:
                ok = False
            if not ok:
                failed.append(row.email)
                continue
            succeeded += 1
            held.append(row.email)
            if len(held) >= batch:
                keep()
    finally:
        keep()
    return {"resolved": resolved, "skipped": resolved - attempted, "attempted": attempted, "succeeded": succeeded, "failed": failed}
