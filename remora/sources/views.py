"""Memories, documents as memories, and batches of queries, from the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Items a query may ask for at most.
MOST = 100
#: Items of a query that names no number.
USUAL = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add requests: one a conversation, with its messages in order."""
    c = table(spark, sf_dir, "conversations")
    body = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(body.alias("messages")).select(
        F.concat(F.lit("r"), "conv_id").alias("request_id"),
        F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_id"),
        F.concat(F.lit("s"), "conv_id").alias("session_id"),
        "conv_id",
        "messages",
    )


def derive(rows: DataFrame) -> DataFrame:
    """Memory columns from user_id, session_id, idx, seq, role, content and created (a timestamp)."""
    created = F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    role = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))
    out = rows.filter(F.trim("content") != "").withColumn("created_at", created).withColumn("role", role)
    summary = F.concat("role", F.lit(": "), "content")
    return out.select(
        X.memory_id(F.col("user_id"), F.col("session_id"), F.col("created_at"), F.col("idx"), F.col("content")).alias("memory_id"),
        "user_id",
        "session_id",
        "role",
        "content",
        summary.alias("summary"),
        F.lit("fact").alias("task_type"),
        F.lit("cold").alias("layer"),
        X.entities(summary).alias("core_entities"),
        "created_at",
        F.to_date("created").alias("source_date"),
        F.substring("created_at", 1, 7).alias("time_bucket"),
        "seq",
        F.lit(0.0).alias("heat"),
        F.lit(0).alias("count"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return derive(
        c.select(
            F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_id"),
            F.concat(F.lit("s"), "conv_id").alias("session_id"),
            F.col("turn").alias("idx"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
            "role",
            F.col("text").alias("content"),
            F.expr("TIMESTAMP '2023-01-01 00:00:00' + make_interval(0, 0, 0, cast(conv_id % 20000 AS int), 0, cast(turn AS int), 0)").alias("created"),
        )
    )


def doc_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return derive(
        d.select(
            F.col("source").alias("user_id"),
            F.concat_ws("-", "source", "lang").alias("session_id"),
            F.lit(0).alias("idx"),
            F.col("doc_id").alias("seq"),
            F.lit("user").alias("role"),
            F.col("text").alias("content"),
            F.expr("TIMESTAMP '2023-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 365 AS int), 0, 0, 0)").alias("created"),
        )
    )


#: What makes a question Chinese, dated, or one for the latest, by turns of the item's id.
ASKED_CHINESE, ASKED_DATE, ASKED_LATEST = "请问关于这件事情的全部详细记录内容是什么呢" * 5, " in March 2023", "the latest "


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question of one user, with a top_k that may be missing, zero or too large."""
    b = table(spark, sf_dir, "benchmark")
    turn, text = F.col("item_id") % 4, F.trim("text")
    query = F.when(turn == 1, F.concat(F.lit(ASKED_CHINESE + " "), text)).when(turn == 2, F.concat(text, F.lit(ASKED_DATE))).when(turn == 3, F.concat(F.lit(ASKED_LATEST), text)).otherwise(text)
    top_k = F.when(F.col("item_id") % 10 == 0, 9999).when(F.col("item_id") % 10 == 1, 0).when(F.col("item_id") % 10 == 2, None).otherwise((3 + F.col("item_id") % 9).cast("int"))
    return b.select(F.col("item_id").alias("q_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("user_id"), query.alias("query"), top_k.alias("top_k"), F.lit("2023-06-15").cast("date").alias("anchor"))


def items_wanted(top_k) -> object:
    """30 where none are named, and 1 to MOST."""
    return F.greatest(F.lit(1), F.least(F.coalesce(F.nullif(top_k, F.lit(0)), F.lit(USUAL)), F.lit(MOST)))


_COLUMNS = """substring(md5(concat_ws('#', user_id, session_id, created_at, idx::VARCHAR, content)), 1, 12) AS memory_id, user_id, session_id,
  role, content, role || ': ' || content AS summary, 'fact' AS task_type, 'cold' AS layer, created_at, created::DATE AS source_date,
  substring(created_at, 1, 7) AS time_bucket, seq, 0.0::DOUBLE AS heat, 0 AS count"""
_ENTITIES = """list_filter(regexp_extract_all(regexp_replace(summary, '[^\\x00-\\x7F]', '_', 'g'), '\\b([A-Z][a-z]{2,}(?:\\s+[A-Z][a-z]{2,})?)\\b', 1),
  lambda x: lower(x) NOT IN ('the','and','but','for','with','you','your','this','that','there','then','they','them','when','what','which','who'))"""


def _sql(name: str, source: str) -> str:
    return f"""{name}_0 AS (SELECT *, strftime(created, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at FROM ({source}) WHERE trim(content) <> ''),
{name}_1 AS (SELECT {_COLUMNS} FROM {name}_0),
{name}_2 AS (SELECT *, {_ENTITIES} AS found FROM {name}_1),
{name} AS (SELECT * EXCLUDE (found), list_filter(found, lambda x, i: list_position(found, x) = i)[1:8] AS core_entities FROM {name}_2)"""


#: The same views for DuckDB, as common table expressions.
MEMORIES = _sql("memories", """SELECT 'u' || (conv_id % 10) AS user_id, 's' || conv_id AS session_id, turn AS idx, conv_id * 1000 + turn AS seq,
  coalesce(nullif(trim(role), ''), 'unknown') AS role, text AS content,
  TIMESTAMP '2023-01-01' + to_days((conv_id % 20000)::INT) + to_minutes(turn::BIGINT) AS created FROM conversations""")
DOCS = _sql("docs", """SELECT source AS user_id, concat_ws('-', source, lang) AS session_id, 0 AS idx, doc_id AS seq, 'user' AS role, text AS content,
  TIMESTAMP '2023-01-01' + to_days((doc_id % 365)::INT) AS created FROM documents""")
QUERIES = f"""queries AS (SELECT item_id AS q_id, 'src' || (item_id % 20) AS user_id,
  CASE item_id % 4 WHEN 1 THEN '{ASKED_CHINESE} ' || trim(text) WHEN 2 THEN trim(text) || '{ASKED_DATE}' WHEN 3 THEN '{ASKED_LATEST}' || trim(text) ELSE trim(text) END AS query,
  CASE item_id % 10 WHEN 0 THEN 9999 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE 3 + item_id % 9 END AS top_k, DATE '2023-06-15' AS anchor FROM benchmark)"""
