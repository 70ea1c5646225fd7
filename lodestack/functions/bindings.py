"""The engine's tables as expressions over the driver's tables; the SQL texts are the same expressions for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import table

#: Start of all synthetic times, 2024-01-01T00:00:00Z.
EPOCH = 1704067200

EVENT_NAMES = {"view": "chat.question.asked", "click": "chat.answer.generated", "error": "chat.retrieval.failed", "purchase": "document.uploaded"}
LOGIN = "auth.login.success"

AUDIT_SQL = """audit AS (
  SELECT event_id AS id, user_id, ts AS created_at, value,
    CASE event_type WHEN 'view' THEN 'chat.question.asked' WHEN 'click' THEN 'chat.answer.generated' WHEN 'error' THEN 'chat.retrieval.failed' WHEN 'purchase' THEN 'document.uploaded' ELSE 'auth.login.success' END AS event_type,
    CASE WHEN event_type IN ('view', 'click', 'error') THEN 'CHAT' WHEN event_type = 'purchase' THEN 'DOCUMENT' ELSE 'AUTH' END AS event_category,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
)"""
MESSAGES_SQL = f"""messages AS (
  SELECT conv_id AS conversation_id, turn, role, text AS content,
    {EPOCH} + conv_id * 3600 + turn * 30 + (conv_id * 7 + turn * 13) % 20 AS created_s
  FROM conversations
)"""
DOCS_SQL = f"""docs AS (
  SELECT doc_id, text, lang, source AS collection, concat(source, '_', doc_id, '.txt') AS filename, n_chars AS file_size,
    CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' ELSE 'private' END AS visibility,
    CASE doc_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'hr' WHEN 2 THEN 'finance' ELSE 'it' END AS allowed_role,
    {EPOCH} + (doc_id * 3571) % 2592000 AS updated_s, doc_id % 150 AS owner_id
  FROM documents
)"""


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, created_at, value, event_type, event_category, status, k (a number in the metadata)."""
    e = table(spark, sf_dir, "events")
    name = F.lit(LOGIN)
    for raw, full in EVENT_NAMES.items():
        name = F.when(F.col("event_type") == raw, full).otherwise(name)
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").alias("created_at"),
        "value",
        name.alias("event_type"),
        F.upper(F.substring_index(name, ".", 1)).alias("event_category"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("is_active"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation_id, turn, role, content, created_s (seconds since 1970)."""
    c = table(spark, sf_dir, "conversations")
    made = F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 30 + (F.col("conv_id") * 7 + F.col("turn") * 13) % 20
    return c.select(F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"), made.cast("long").alias("created_s"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, collection, filename, file_size, visibility, allowed_role, updated_s, owner_id."""
    d = table(spark, sf_dir, "documents")
    pick = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % n + 1).cast("int"))
    return d.select(
        "doc_id",
        "text",
        "lang",
        F.col("source").alias("collection"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("n_chars").alias("file_size"),
        pick(3, ["public", "restricted", "private"]).alias("visibility"),
        pick(4, ["admin", "hr", "finance", "it"]).alias("allowed_role"),
        (F.lit(EPOCH) + (F.col("doc_id") * 3571) % 2592000).cast("long").alias("updated_s"),
        (F.col("doc_id") % 150).alias("owner_id"),
    )
