"""Chat sessions and messages: summaries, histories within a token limit, ordinals, replay and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalar import message_tokens


def session_summaries(sessions: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions with their number of messages, newest first, at most 100."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    out = sessions.join(counts, "session_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    return out.orderBy(F.desc("updated_at"), F.desc("session_id")).limit(max(1, min(100, limit)))


def model_context_messages(messages: DataFrame) -> DataFrame:
    return messages.where("status = 'completed' AND content <> ''")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` of each session."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ordinal")))
    return messages.withColumn("place", place).where(F.col("place") <= n).drop("place")


def model_context(messages: DataFrame, window: int = 200, usable: int = 40) -> DataFrame:
    """The last ``usable`` usable messages of the last ``window``, in sessions that end with a user's message."""
    kept = last_messages(model_context_messages(last_messages(messages, window)), usable)
    last = kept.groupBy("session_id").agg(F.max_by("role", "ordinal").alias("last_role")).where("last_role = 'user'")
    return kept.join(last.select("session_id"), "session_id", "left_semi")


def complete_turns(messages: DataFrame, token_limit: int) -> DataFrame:
    """The newest adjacent user and assistant pairs of each session until the first that would pass the limit."""
    by = Window.partitionBy("session_id").orderBy("ordinal")
    now = messages.withColumn("tokens", message_tokens("content")).withColumn("last_role", F.lag("role").over(by)).withColumn("last", F.lag(F.struct("ordinal", "content", "tokens")).over(by))
    turns = now.where("role = 'assistant' AND last_role = 'user'").select("session_id", F.col("last.ordinal").alias("user_ordinal"), F.col("ordinal").alias("assistant_ordinal"), F.col("last.content").alias("user_content"), F.col("content").alias("assistant_content"), (F.col("last.tokens") + F.col("tokens")).alias("tokens"))
    spent = F.sum("tokens").over(Window.partitionBy("session_id").orderBy(F.desc("user_ordinal")))
    return turns.withColumn("spent", spent).where(F.col("spent") <= token_limit)


def assign_ordinals(turns: DataFrame, current: DataFrame) -> DataFrame:
    """The next two ordinals of its session for each new turn, in order of arrival."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "request_id"))
    top = current.groupBy("session_id").agg(F.max("ordinal").alias("top"))
    out = turns.join(top, "session_id", "left").withColumn("top", F.coalesce("top", F.lit(0))).withColumn("n", n)
    return out.withColumn("user_ordinal", F.col("top") + 2 * F.col("n") - 1).withColumn("assistant_ordinal", F.col("top") + 2 * F.col("n")).drop("n", "top")


def recover_interrupted(messages: DataFrame) -> DataFrame:
    """Assistant messages left pending or streaming become failed, with an error that may be retried."""
    open_ = (F.col("role") == "assistant") & F.col("status").isin("pending", "streaming")
    error = F.to_json(F.struct(F.lit("generation_interrupted").alias("code"), F.lit(True).alias("retryable")))
    return messages.withColumn("error", F.when(open_, error).otherwise(F.col("error"))).withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))


def replay(messages: DataFrame) -> DataFrame:
    """The events that tell a stored assistant message again: (session_id, request_id, seq, type, content)."""
    rows = recover_interrupted(messages).where("role = 'assistant'")
    event = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.cast("string").alias("content"))
    none = F.lit(None)
    delta = F.when(F.col("content") != "", F.array(event("delta", F.col("content"))))
    empty = F.array().cast("array<struct<type:string,content:string>>")
    last = F.when(F.col("status") == "completed", event("completed", none)).when(F.col("status") == "cancelled", event("cancelled", none)).otherwise(event("error", F.col("error")))
    told = F.when(F.col("status") == "completed", F.concat(F.array(event("accepted", none)), F.coalesce(delta, empty), F.array(last))).otherwise(F.array(event("accepted", none), last))
    return rows.select("session_id", "request_id", F.posexplode(told).alias("seq", "e")).select("session_id", "request_id", "seq", "e.type", "e.content")
