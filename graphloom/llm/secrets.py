"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (sha256).  The ledger, an append-only table,
has a row for each blob and rule version that was scanned, and one for each span found.  A scan
takes only the pairs of blob and rule version that the ledger lacks, whatever paths and
however many copies have the blob; findings are then joined back to all paths.

Rules run as built-in regular expression functions: a text split at the matches gives what
lies between them, so the running sum of lengths gives every match's place in code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import apart, fresh_path, remember


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost and without overlap; a match counts if its ``group`` has ``least`` characters.

    ``hints``: a text without any of them (compared in lower case) has no match.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()


# The base rules. A run shorter than the least length never makes a longer one
# start elsewhere in it, so the last two count their characters in the pattern.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
         ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)

#: A row for each scan of a blob by a rule (start and stop null) and for each span that it found.
LEDGER = "blob string, kind string, version int, start long, stop long"


def _matches(text: Column, lower: Column, rule: Rule) -> Column:
    """What lies before each match of the rule's pattern, the match's length and whether it counts; first a row of the scan itself."""
    found, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern)
    good = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least) if rule.group else (lambda m: F.length(m) >= rule.least)
    row = lambda gap, size, counts: F.struct(gap.cast("long").alias("gap"), size.cast("long").alias("size"), counts.alias("good"))
    each = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: row(F.length(g), F.length(m), good(m)))
    hinted = reduce(lambda x, y: x | y, [F.contains(lower, F.lit(h)) for h in rule.hints]) if rule.hints else F.lit(True)
    scan = F.array(row(F.lit(0), F.lit(0), F.lit(False)))
    return F.when(hinted & F.regexp_like(text, F.lit(rule.pattern)), F.concat(scan, each)).otherwise(scan)


class BlobLedger:
    """Scans, remembers and joins back.  ``path`` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES):
        self.spark, self.rules = spark, rules
        self.path = path or remember(spark, fresh_path(spark, "blob-ledger"))
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def _current(self) -> DataFrame:
        """The rows of the rules' present versions."""
        return self.rows().filter(reduce(lambda x, y: x | y, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in self.rules]))

    @staticmethod
    def addressed(versions: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        return versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))

    def scan(self, versions: DataFrame) -> None:
        """Scan the texts of ``versions`` (text) as far as the ledger lacks them.

        The rows of one call are committed together; a call that fails leaves the ledger
        as it was, and the next call scans what is missing.

        A match is a row, and its place the running sum of the lengths before it: the work
        grows with a text and its matches, whatever their number.
        """
        blobs = self.addressed(versions).dropDuplicates(["blob"])
        have = self._current().filter("start is null").groupBy("blob").agg(F.collect_set("kind").alias("have"))
        todo = blobs.join(have, "blob", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
        todo = todo.filter(F.size("have") < len(self.rules)).withColumn("lower", F.lower("text"))
        scans = [
            F.when(~F.array_contains("have", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _matches(F.col("text"), F.col("lower"), r).alias("found")))
            for r in self.rules
        ]
        each = todo.select("blob", F.explode(F.array_compact(F.array(*scans))).alias("x")).select("blob", "x.kind", "x.version", F.posexplode("x.found").alias("at", "m"))
        before = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = each.withColumn("stop", F.sum(F.col("m.gap") + F.col("m.size")).over(before)).filter("at = 0 or m.good")
        span = lambda c: F.when(F.col("at") > 0, c)
        placed.select("blob", "kind", "version", span(F.col("stop") - F.col("m.size")).alias("start"), span(F.col("stop")).alias("stop")).write.mode("append").parquet(self.path)

    def spans(self) -> DataFrame:
        """(blob, start, stop, number, kind) of all findings, each once; ``number`` is the rule's place."""
        numbers = F.create_map(*[x for i, r in enumerate(self.rules) for x in (F.lit(r.kind), F.lit(i))])
        return self._current().filter("start is not null").select("blob", "start", "stop", numbers[F.col("kind")].alias("number"), "kind").distinct()

    def findings(self, paths: DataFrame, merged: bool = False) -> DataFrame:
        """``paths`` with blob and spans: an array of (start, stop, number, kind) in that order.

        With ``merged`` spans that overlap are one, named after the first.
        """
        spans = self.spans()
        if merged:
            order = Window.partitionBy("blob").orderBy("start", "number")
            reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
            spans = spans.withColumn("new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
            spans = spans.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            first = F.min(F.struct("start", "number", "kind"))
            spans = spans.groupBy("blob", "island").agg(F.max("stop").alias("end"), first.alias("s")).select("blob", "s.start", F.col("end").alias("stop"), "s.number", "s.kind")
        spans = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "number", "kind"))).alias("spans"))
        own = [c for c in paths.columns if c not in ("blob", "spans")]
        addressed = paths.select(*[F.col(f"`{c}`") for c in own], F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"))
        joined = apart(addressed, "blob").join(apart(spans, "blob"), ["blob", "apart"], "left").drop("apart")
        return joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint,number:int,kind:string>>")))


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Find secrets in every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans (``kind:start:end`` by
    start, then kind as listed).  The ledger's rules are the base rules, so the spans are
    the base spans.  Null text counts as empty.  Rows are independent: repeated doc_ids and
    null ids each give a row.  An empty table gives no rows.  Other columns are not read.

    Copies are scanned once; the join back meets hot blobs by a join that Spark can split.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(docs)
    found = ledger.findings(docs.select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["number"], s["stop"], s["kind"])))
    joined = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select(F.col("doc_id").cast("long"), count("assign"), count("access"), count("hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


CHUNK = 4_096


def _between(chunks: Column, start: Column, stop: Column) -> Column:
    """The code points from ``start`` up to ``stop`` of a text cut into ``chunks``: only the chunks touched are read."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(stop / CHUNK).cast("int")
    at, to = (F.pmod(x, F.lit(CHUNK)).cast("int") for x in (start, stop))
    head, tail = F.get(chunks, first), F.coalesce(F.get(chunks, last), F.lit(""))
    whole = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(stop <= start, F.lit("")).when(first == last, F.substring(head, at + 1, to - at)).otherwise(
        F.concat(F.substring(head, at + 1, F.lit(CHUNK)), whole, F.substring(tail, F.lit(1), to)))


def redact_documents(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``<kind>``; all columns kept, other rows unchanged.

    Overlapping spans are joined and named after the first.  Null text stays null.  Rows
    are independent, whatever their ids; an empty table gives no rows.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.scan(docs)
    own = [c for c in docs.columns if c != "text"]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], "text")
    found = ledger.findings(renamed, merged=True)
    found = found.withColumn("chunks", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    chunks, spans = F.col("chunks"), F.col("spans")
    pieces = F.transform(spans, lambda s, i: F.concat(_between(chunks, F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0)), s["start"]), F.lit("<"), s["kind"], F.lit(">")))
    rest = _between(chunks, F.get(spans, F.size(spans) - 1)["stop"], F.length("text").cast("long"))
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    place = {c: f"own_{i}" for i, c in enumerate(own)}
    return found.select(*[text.alias("text") if c == "text" else F.col(place[c]).alias(c) for c in docs.columns])
