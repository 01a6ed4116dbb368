"""The logical tables, derived from the star schema, events and texts.

Customers and suppliers are functions, parts are types; an order's line items are calls.
Each function reads the named tables of a folder of Parquet files and returns one logical
table; only the columns it needs reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.joins import spread

REFERENCE_DATE = "2001-08-01"
#: Sentences that the synthetic transcripts lack: of every class and none, with entities of every form, in several scripts.
CUES = (
    "We decided to keep the Build Cache small.", "We should add `parse_item` to store.py soon.", "The build failed in load_items again.", "It turns out the reason is loadItems.",
    "I changed the file store.py today.", "Not sure whether load_items is slow.", "It works because it was verified.", "Did we decide to change the Build Cache?", "Let me look at `parse_item` first.",
    "Это новый вопрос?", "TODO: check the Build Cache once more.", "Nothing to see here.", "Это другой вопрос?",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, qualified_name, kind, scope, file, region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name"))  # 25 rows by the schema

    def functions(source: str, prefix: str, key: str, name: str, nation_key: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(key, name, nation_key).join(places, F.col(nation_key) == F.col("n_nationkey"))
        return rows.select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"),
            F.concat_ws("::", "n_name", name).alias("qualified_name"), F.lit("f").alias("kind"), F.col("n_name").alias("scope"),
            F.concat_ws("/", "r_name", "n_name").alias("file"), F.col("r_name").alias("region"))

    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"), F.lit("t").alias("kind"), F.col("p_brand").alias("scope"),
        F.concat_ws("/", "p_type", "p_brand").alias("file"), F.lit("PARTS").alias("region"))
    return functions("customer", "c", "c_custkey", "c_name", "c_nationkey").unionByName(
        functions("supplier", "s", "s_suppkey", "s_name", "s_nationkey")).unionByName(parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst): a customer calls the suppliers of its line items, a supplier the parts of first lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    calls = spread(ordered(spark, sf_dir), "o_custkey", "l_suppkey").distinct()
    uses = spread(lines.filter("l_linenumber = 1").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct()
    return calls.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).unionAll(
        uses.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, l_suppkey) of each line item that has an order.  Only the orders of a task are held, lines pass by."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the test functions."""
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, sha, ts."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, kind, target, agent, confidence, ts; signups infer, errors flag, purchases verify."""
    kind = F.create_map(*[F.lit(x) for x in ("signup", "infer", "error", "flag", "purchase", "verify", "view", "view", "click", "click")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.element_at(kind, F.col("event_type")).alias("kind"), F.col("user_id").cast("string").alias("target"),
        (F.col("user_id") % 3).alias("agent"), (F.col("value") / (F.col("value") + 10)).alias("confidence"), "ts")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def cued_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages, each with one of :data:`CUES` at its end."""
    last = F.element_at(F.array(*map(F.lit, CUES)), (F.col("turn") % len(CUES) + 1).cast("int"))
    return messages(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", last))


def stamps(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """path, size, content_hash of an older and a newer state of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if new:
        text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
        docs = docs.filter("doc_id % 7 <> 0").withColumn("text", text)
    else:
        docs = docs.filter("doc_id % 10 <> 0")
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("content_hash"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and path: the url without its scheme."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
