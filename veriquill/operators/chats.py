"""Chats: listing, history, recovery, upserts and deletes over sessions, documents and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def session_documents(messages: DataFrame) -> DataFrame:
    """conv_id, status: the document of each session; a fifth of them have none."""
    kinds = F.element_at(F.array(*map(F.lit, ("failed", "indexing", "ready", "ready"))), (F.col("conv_id") % 5).cast("int"))
    return messages.select("conv_id").distinct().where("conv_id % 5 <> 0").select("conv_id", kinds.alias("status"))


def list_sessions(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """conv_id, state, message_count, most recent first: no document is empty, then failed, indexing, locked once a user wrote, else ready."""
    per = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max(F.col("role") == "user").alias("asked"), F.max("turn").alias("last"))
    joined = per.join(documents, "conv_id", "left")
    status = F.col("status")
    state = F.when(status.isNull(), "empty").when(status == "failed", "failed").when(status == "indexing", "indexing").when(F.col("asked"), "locked").otherwise("ready")
    return joined.select("conv_id", state.alias("state"), "message_count", "last").orderBy(F.desc("last"), "conv_id")


def delete_sessions(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages that are left when sessions go with all they own."""
    return messages.join(gone, "conv_id", "left_anti")


def history_pairs(messages: DataFrame) -> DataFrame:
    """Questions that the next message answers: conv_id, turn, question, answer, and the pair's place from the end."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = messages.select("*", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("answer"))
    paired = paired.where("role = 'user' and next_role = 'assistant'")
    from_end = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return paired.select("conv_id", "turn", F.col("text").alias("question"), "answer", from_end.cast("long").alias("from_end"))


def upsert_latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def clean_questions(messages: DataFrame, most: int = 4000) -> DataFrame:
    """User questions, trimmed, without blank ones and repeats (case folded) in their conversation; the first stays."""
    asked = messages.where("role = 'user'").select("conv_id", "turn", F.substring(F.trim("text"), 1, most).alias("question")).where("question <> ''")
    first = Window.partitionBy("conv_id", F.lower("question")).orderBy("turn")
    return asked.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def recover(messages: DataFrame) -> DataFrame:
    """Rows that a restart has to end: an answer in progress becomes an error, a score in progress is skipped as interrupted."""
    status = F.element_at(F.array(*map(F.lit, ("answered", "streaming", "no_sources"))), (F.col("turn") % 3 + 1).cast("int"))
    score = F.element_at(F.array(*map(F.lit, ("done", "pending", "running", "failed"))), (F.col("conv_id") % 4 + 1).cast("int"))
    rows = messages.select("conv_id", "turn", status.alias("status"), score.alias("score"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("status") == "streaming", "error").otherwise(F.col("status")).alias("status"),
        F.when(F.col("score").isin("pending", "running"), "skipped").otherwise(F.col("score")).alias("score"),
        F.when(F.col("score").isin("pending", "running"), "interrupted").alias("skipped_reason"),
    )


def recovered(documents: DataFrame, messages: DataFrame) -> DataFrame:
    """kind, n: how many rows a restart ends: documents being indexed (failed), answers in progress (error), scores not done (skipped)."""
    counts = messages.agg(F.count_if(F.col("status") == "streaming").alias("answers"), F.count_if(F.col("score").isin("pending", "running")).alias("scores"))
    indexed = documents.agg(F.count_if(F.col("status") == "indexing").alias("documents"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("documents", "answers", "scores")]
    return counts.crossJoin(F.broadcast(indexed)).select(F.inline(F.array(*kinds)))
