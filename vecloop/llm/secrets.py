"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its text. A ledger table holds, for each blob
and rule version, what the scan found (nothing found is an entry too). A run scans only the (blob, rule
version) pairs that the ledger lacks, appends them, and joins the ledger back to all paths. A copied or
unchanged text is never scanned twice; a new rule version re-scans each blob once, for that rule alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecloop.llm.common import batches, pick, tidy
from vecloop.session import write_and_reread


@dataclass(frozen=True)
class Rule:
    """A pattern with leftmost, non-overlapping matches; a match counts if ``group`` has ``least`` characters.

    ``hints``: lower-case strings of which a text that matches has one (empty: always search).
    A changed pattern must get a new ``version``.
    """

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# Fixed patterns of the base rules. The hex rule has its least length in the pattern: runs are maximal,
# so that drops exactly the short ones. The order is the order of kinds at equal starts.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        12,
        2,
        hints=("passw", "secret", "token", "api"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}"),
)

LEDGER_SCHEMA = "blob string, rule string, found array<struct<start:int,stop:int>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_LEDGER = pa.schema([("blob", pa.string()), ("rule", pa.string()), ("found", _FOUND)])


def scan_text(text: str, rule: Rule, compiled: re.Pattern, lowered: str) -> list[dict]:
    """Spans of a rule in a whole text, in code points, end exclusive."""
    if rule.hints and not any(h in lowered for h in rule.hints):
        return []
    spans = ((m.start(), m.end(), m.end(rule.group) - m.start(rule.group)) for m in compiled.finditer(text))
    return [{"start": a, "stop": b} for a, b, n in spans if n >= rule.least]


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def blobs_of(versions: DataFrame) -> DataFrame:
    """Each distinct ``(blob, text)`` once. Copies within a task go before the shuffle, so that a text that
    is copied everywhere arrives once per task; only digests seen are kept in memory."""

    def unseen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in parts:
            keep = []
            for i, blob in enumerate(part.column(0).to_pylist()):
                if (digest := bytes.fromhex(blob)) not in seen:
                    seen.add(digest)
                    keep.append(i)
            yield part.take(pa.array(keep, pa.int32()))

    schema = "blob string, text string"
    local = versions.select("blob", "text").mapInArrow(tidy(unseen), schema)
    return local.repartition("blob").mapInArrow(tidy(unseen), schema)


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """New ledger entries: every blob of ``versions (blob, text)`` by every rule version the ledger lacks."""
    wanted = {r.key: r for r in rules}
    known = ledger.where(F.col("rule").isin(list(wanted))).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    blobs = blobs_of(versions).join(known, "blob", "left")
    todo = F.array_except(F.array(*[F.lit(k) for k in wanted]), F.coalesce("known", F.array().cast("array<string>")))
    pairs = blobs.select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ASCII: no letter outside A-Z folds into one of the patterns.
        compiled = {k: re.compile(r.pattern, re.ASCII) for k, r in wanted.items()}

        def entries():
            for part in parts:
                for blob, text, keys in zip(*[c.to_pylist() for c in part.columns]):
                    lowered = text.lower()
                    for k in keys:
                        yield blob, k, scan_text(text, wanted[k], compiled[k], lowered)

        yield from batches(entries(), _LEDGER)

    return pairs.mapInArrow(tidy(scan), LEDGER_SCHEMA)


def versions_of(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(path, blob, text)`` of every row; a null text is the empty blob."""
    rows = pick(docs, path=path_col, text=text_col)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("blob"), "text")


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = BASE_RULES, **columns: str) -> DataFrame:
    """Append what ``docs`` adds to the ledger at ``path`` (made if absent), and return the ledger.

    The scan reads the ledger as it was before; a run that dies before its commit adds nothing, and the
    next run finds the same pairs unseen.
    """
    spark = docs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(path) if there else empty_ledger(spark)
    scan_unseen(versions_of(docs, **columns), ledger, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def spans_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``(blob, spans)`` once a blob, for these rule versions: spans is a sorted array of (start, place, name, stop).

    A pair that is in the ledger twice, as after two runs at once, counts once.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    names = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.name))])
    entries = ledger.where(F.col("rule").isin([r.key for r in rules])).withColumns(
        {"place": order[F.col("rule")], "name": names[F.col("rule")]}
    )
    spans = F.transform(
        "found",
        lambda s: F.struct(s["start"].alias("start"), F.col("place"), F.col("name"), s["stop"].alias("stop")),
    )
    return entries.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(spans)))).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, **columns: str) -> DataFrame:
    """Every row of ``docs`` with what the ledger knows of its blob under these rule versions.

    Returns ``path, blob, <n of each rule's name>, spans`` (see ``spans_by_blob``). Rows of one path (its
    historical versions, or repeats) each get a row. A null path stays null.
    """
    # Written first: a join that reads two plain tables can split a blob that most paths share.
    by_blob = write_and_reread(spans_by_blob(ledger, rules), "spans")
    rows = versions_of(docs, **columns).select("path", "blob").join(by_blob, "blob", "left")
    count = lambda name: F.size(F.filter("spans", lambda s: s["name"] == name)).cast("long")
    return rows.select("path", "blob", *[count(r.name).alias(f"n_{r.name}") for r in rules], "spans")


def span_text(spans: str = "spans") -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))
