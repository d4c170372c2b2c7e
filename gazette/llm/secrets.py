"""Secrets in text, found with SQL functions only, over a ledger of content-addressed blobs.

A *version* is any row with a text: a document, or one state of a file under a path. Its blob is the
SHA-256 of the text. The ledger holds one row for each (blob, rule set) ever scanned, with the spans
found, also where none were. A scan takes the distinct blobs of the versions, leaves out the pairs
that the ledger has, matches the rest, appends them, and joins the findings back to every version.

Spans come from two passes of the same pattern: ``split`` gives what lies between matches and
``regexp_extract_all`` the matches, so that running sums of their lengths are positions in code points.
They are summed in two levels, over runs of ``RUN`` matches and within each, so the work goes with the
number of matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.shared import new_path


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Maximal runs below the length never contain a longer match, so lengths can stand in the pattern
#: of the access and hex rules; in the assign rule a failing match still consumes its text.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Name of a rule set in the ledger. Change it with any rule.
RULES_VERSION = "1"

#: Matches whose spans are gathered in one fold.
RUN = 128

SPAN = "struct<start:int,kind:int,name:string,end:int>"


#: Spans of a rule's matches as SQL over the columns text and pattern_<order>; ``{ }`` hold the rule.
#: Steps are (characters before a match, characters of it, of its tested group); the last has no match.
#: A transform over an array of one is a name for a value that is used more than once.
SPANS = """
CASE WHEN regexp_like(text, pattern_{order}) THEN get(transform(array(arrays_zip(
    transform(split(text, pattern_{order}, -1), s -> length(s)),
    transform(regexp_extract_all(text, pattern_{order}, 0), s -> length(s)),
    transform(regexp_extract_all(text, pattern_{order}, {group}), s -> length(s)))), steps ->
  get(transform(array(transform(sequence(0, CAST(floor((size(steps) - 1) / {run}) AS INT)), k -> slice(steps, k * {run} + 1, {run}))), parts ->
    get(transform(array(transform(parts, p -> aggregate(p, 0, (n, x) -> n + x.`0` + coalesce(x.`1`, 0)))), lengths ->
      flatten(transform(parts, (p, i) -> aggregate(p,
        named_struct('at', aggregate(slice(lengths, 1, i), 0, (n, x) -> n + x), 'found', CAST(array() AS array<{span}>)),
        (state, x) -> named_struct('at', state.at + x.`0` + coalesce(x.`1`, 0), 'found',
          CASE WHEN x.`1` IS NOT NULL AND x.`2` >= {least} THEN
            concat(state.found, array(named_struct('start', state.at + x.`0`, 'kind', {order}, 'name', '{kind}', 'end', state.at + x.`0` + coalesce(x.`1`, 0))))
          ELSE state.found END),
        state -> state.found)))), 0)), 0)), 0)
ELSE CAST(array() AS array<{span}>) END"""


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) -> (blob, spans), spans in order of start, then rule."""
    named = blobs.select("blob", "text", *[F.lit(rule.pattern).alias(f"pattern_{k}") for k, rule in enumerate(rules)])
    found = ", ".join(SPANS.format(order=k, group=rule.group, least=rule.least, kind=rule.kind, run=RUN, span=SPAN) for k, rule in enumerate(rules))
    return named.select("blob", F.expr(f"array_sort(concat({found}))").alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = f"blob string, spans array<{SPAN}>, rules string"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> DataFrame:
    """The versions with ``blob`` and ``spans`` behind their own columns; what the ledger lacked is scanned and appended.

    Null text counts as empty. Every row of ``versions`` comes back, also rows that repeat, and every
    column; beside a caller's own ``blob`` or ``spans`` ours are named with an underscore more. Two runs
    that append the same pair at once leave two equal ledger rows, which the read makes one. An empty
    table adds nothing and gives an empty result.
    """
    spark = versions.sparkSession
    text = F.coalesce("text", F.lit(""))
    seen = read_ledger(spark, ledger).where(F.col("rules") == version).select("blob")
    # Copies are combined within each task before they meet, so a blob of a third of all rows is a row for each task.
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).distinct()
    if not seen.isEmpty():
        blobs = blobs.join(seen, "blob", "left_anti")
    scan(blobs, rules).withColumn("rules", F.lit(version)).write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger).where((F.col("rules") == version) & (F.size("spans") > 0)).select("blob", "spans").distinct()
    blob, spans = (free(name, versions.columns) for name in ("blob", "spans"))
    key = free("scanned", versions.columns)
    keyed = versions.withColumn(blob, F.sha2(text, 256)).join(found.select(F.col("blob").alias(key), F.col("spans").alias(spans)), F.col(blob) == F.col(key), "left").drop(key)
    return keyed.withColumn(spans, F.coalesce(F.col(spans), F.array().cast(f"array<{SPAN}>")))


def free(name: str, taken: list[str]) -> str:
    """The name, with as many underscores as it takes to be a new one."""
    while name in taken:
        name += "_"
    return name


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def findings(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULES_VERSION) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans.

    Nulls and empty texts have no span; rows that repeat give rows that repeat, a null doc_id stays null; an
    empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    found = scan_versions(docs.select("doc_id", "text"), ledger or new_path(docs.sparkSession, "secret-ledger"), rules, version)
    base = [k for k, rule in enumerate(rules) if rule.base]
    kept = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{rules[k].kind}")

    return found.select("doc_id", *map(count, base), F.sha2(joined(kept), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
