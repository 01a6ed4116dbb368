"""The corpus pipeline: quality, line dedup, near-duplicates, secrets, packing.

Each stage takes the documents that the stage before kept, and all but the last return the
columns of ``documents``; ``n_chars`` follows the text.  A stage's decisions are in its rows:
rejected documents and copies are gone, repeated lines are cut out, secrets are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common, line_dedup, packing, quality, secrets, shingle_join

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL has the classifier's trees or the tokenizer's merges.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """With a hash of the text: what is decided by text holds for rows of the same id and text."""
    return docs.withColumn("text_key", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` (keyed) with, or without, a row of the same doc_id (null or not) and text_key in ``keys``."""
    keys = keys.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"))
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["k_id"]) & (docs["text_key"] == keys["k_text"]), how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.3 or more stay, whatever other rows of their doc_id (null or repeated) score.
    A row carries its own score: null and empty texts are scored like others, other columns
    than those of documents are left out, an empty table gives no rows.  Labels of the
    held-out fold are not read."""
    labels = common.labels(spark, sf_dir).select("doc_id", "quality")
    scores = quality.score_documents(docs.select(*COLUMNS), labels, common.id_text_remainder("doc_id", 5) != 0, tuple(c for c in COLUMNS if c != "doc_id"))
    return scores.filter("score >= 0.3").select(*COLUMNS)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has are cut out; documents stay, even if nothing is left of them
    (the text is then empty, and packing makes it one end token).  Null text becomes empty; rows of a
    null doc_id are one document after all others, rows of one doc_id are one document; an empty table
    gives no rows; other columns are left out."""
    return _columns(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: of the smallest doc_id (a null one only where no
    row of the group has an id), there of the smallest md5 of the text, and of rows alike in both one.
    Texts without words are no group and stay.  Rows are judged by their own text, so other
    texts of a repeated or null doc_id are not touched.  An empty table gives no rows; other columns are left out."""
    docs = _keyed(docs)
    found = shingle_join.group_documents(docs.select("doc_id", "text", "text_key"), keep=("text_key",))
    keys = found.filter("label is not null").groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("n"))
    keys = common.written(keys, "group-keys", size=common.stored_bytes(found))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = keys.groupBy("label").agg(F.min(place).alias("first")).select("label", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_text"))
    marked = keys.join(first, "label")
    copies = marked.filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_text"))))
    kept = _joined(docs, copies, "left_anti")
    repeated = common.written(keys.filter("n > 1").select("doc_id", "text_key"), "repeated-rows")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    alike = Window.partitionBy("doc_id", "text_key").orderBy("lang", "source", "n_chars")
    once = _joined(kept, repeated, "left_semi").withColumn("place", F.row_number().over(alike)).filter("place = 1")
    return _joined(kept, repeated, "left_anti").select(*COLUMNS).unionAll(once.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; all rows stay, whatever their ids, null text stays null.
    An empty table gives no rows; other columns are left out."""
    return _columns(secrets.redact_documents(docs.select(*COLUMNS)))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence.  Null and empty texts are their end id
    alone; rows of a null or repeated doc_id are packed each by itself; an empty table gives no rows."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_runs", line_runs),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture_packing", mixture_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again by the next, and
    nothing else that it wrote is left.  What the last one reads stays until ``common.sweep``."""
    docs, others = common.documents(spark, sf_dir), common.left(spark)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        common.sweep(spark, docs, besides=others)
    return STAGES[-1][1](spark, docs, sf_dir)
