"""Writes to sessions as folds of logs, who may see them, and what they may spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# What a running question and a scoring task are reserved, and the owner of the public session.
RUNNING, SCORING, DEMO = 0.60, 0.08, "demo"


def fold_sessions(log: DataFrame) -> DataFrame:
    """session_id, title, updated_seq from a log (session_id, seq, kind, title): the last title that a create or rename gave, and the last
    entry that was no rename, which alone moves a session up. Sessions without a create do not exist."""
    named = F.col("kind").isin("create", "rename")
    out = log.groupBy("session_id").agg(
        F.max_by(F.when(named, F.col("title")), F.when(named, F.col("seq"))).alias("title"),
        F.max(F.when(F.col("kind") != "rename", F.col("seq"))).alias("updated_seq"),
        F.max(F.col("kind") == "create").alias("made"),
    )
    return out.where("made").drop("made")


def next_seq(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def upsert_contexts(contexts: DataFrame, messages: DataFrame) -> DataFrame:
    """The latest context (message_id, page, seq, text) of each message and page, for messages that exist."""
    known = contexts.join(messages.select("message_id").distinct(), "message_id", "left_semi")
    return known.groupBy("message_id", "page").agg(F.max_by("text", "seq").alias("text"))


def append_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """messages and why not: null where the session exists and the message is added."""
    known = sessions.select("session_id", F.lit(True).alias("known")).distinct()
    return messages.join(known, "session_id", "left").withColumn("error", F.when(F.col("known").isNull(), "session_not_found")).drop("known")


def update_fields(rows: DataFrame, key: str, changes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rows with the fields that changes (key and some of them) give; a field that rows do not have is an error.

    With a column `named` (array<string>) in changes, those fields are set, to null too; without it, all that are not null.
    """
    named = "named" in changes.columns
    changes = changes if named else changes.withColumn("named", F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in changes.columns if c != key] or [F.lit(None).cast("string")]), lambda c: c.isNotNull()))
    unknown = set(changes.columns) - {key, "named", *fields} | set(fields) - set(rows.columns)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    new = changes.select(key, F.struct(*[c for c in changes.columns if c != key]).alias("_new"))
    joined = rows.join(new, key, "left")
    given = lambda c: F.coalesce(F.array_contains("_new.named", c), F.lit(False))
    return joined.select(*[F.when(given(c), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in rows.columns])


def export_chats(messages: DataFrame) -> DataFrame:
    """session_id, chat: a JSON text of the finished messages (session_id, seq, role, status, text) in order, of sessions that have an answer."""
    done = messages.where((F.col("role") != "assistant") | F.col("status").isin("answered", "no_sources"))
    chat = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))), lambda m: F.struct(m.role.alias("role"), m.text.alias("text"))))
    return done.groupBy("session_id").agg(F.max(F.col("role") == "assistant").alias("some"), chat.alias("chat")).where("some").drop("some")


def access(owner: Column, visitor: Column, write: Column, private: bool = True) -> Column:
    """200, 403 or 404: the public session may be read, not changed; another's session does not exist for a visitor."""
    foreign = owner != visitor if private else F.lit(False)
    return F.when(owner.isNull(), 404).when(owner == DEMO, F.when(write, 403).otherwise(200)).when(foreign, 404).otherwise(200)


def budget_gate(spent: DataFrame, running: DataFrame, limit: float) -> DataFrame:
    """user_id, reserve, allowed: new work is refused once what is spent and what running work will cost come to the limit."""
    open_ = running.groupBy("user_id").agg((F.count_if(F.col("kind") == "question") * RUNNING + F.count_if(F.col("kind") == "score") * SCORING).alias("reserve"))
    rows = spent.join(open_, "user_id", "left").withColumn("reserve", F.coalesce("reserve", F.lit(0.0)))
    return rows.select("user_id", F.round("reserve", 2).alias("reserve"), (F.round(F.col("spent_usd") + F.col("reserve"), 6) < limit).alias("allowed"))


def session_room(sessions: DataFrame, limit: int) -> DataFrame:
    """room: whether another session may be made; public ones do not count, a limit of 0 is none."""
    return sessions.agg((F.lit(limit <= 0) | (F.count_if(F.col("owner") != DEMO) < limit)).alias("room"))


def retired(sessions: DataFrame) -> DataFrame:
    """The spend ledger as one row: what sessions that go (amount, index_key) have spent, and the keys that were paid for, sorted."""
    keys = F.array_sort(F.collect_set("index_key"))
    return sessions.agg(F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 4).alias("retired_usd"), F.to_json(keys).alias("retired_keys"))


def calls_with_output(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """outputs with the arguments of their call; {} where there is none."""
    return outputs.join(calls.select("call_id", "args"), "call_id", "left").withColumn("args", F.coalesce("args", F.lit("{}")))


def markers_to_cites(markers: DataFrame, cites: DataFrame) -> DataFrame:
    """answer_id, n, cite_id: the cite whose index a marker names, else the one at its place."""
    order = Window.partitionBy("answer_id").orderBy("idx")
    placed = cites.select("answer_id", F.row_number().over(order).alias("n"), F.col("cite_id").alias("by_place"))
    named = cites.select("answer_id", F.col("idx").alias("n"), F.col("cite_id").alias("by_index"))
    return markers.join(named, ["answer_id", "n"], "left").join(placed, ["answer_id", "n"], "left").select("answer_id", "n", F.coalesce("by_index", "by_place").alias("cite_id"))


def after_last_question(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, role) after the last user message of their conversation; all where there is none."""
    last = F.max(F.when(F.col("role") == "user", F.col("seq"))).over(Window.partitionBy("conv_id"))
    return events.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")


def first_terminal(events: DataFrame) -> DataFrame:
    """message_id, status: the first final state of each message; later ones do not count."""
    final = events.where(F.col("status").isin("answered", "no_sources", "error", "stopped"))
    return final.groupBy("message_id").agg(F.min_by("status", "seq").alias("status"))


def final_text(items: DataFrame) -> DataFrame:
    """run_id, text: of runs (run_id, seq, kind, text) whose text did not come in pieces (kind piece), the last message after the last call."""
    per = Window.partitionBy("run_id")
    called = F.max(F.when(F.col("kind") == "call", F.col("seq"))).over(per)
    pieces = F.max((F.col("kind") == "piece") & (F.trim(F.coalesce("text", F.lit(""))) != "")).over(per)
    rows = items.withColumn("_called", called).withColumn("_pieces", pieces)
    rows = rows.where((F.col("kind") == "message") & ~F.col("_pieces") & (F.col("_called").isNull() | (F.col("seq") > F.col("_called"))))
    return rows.groupBy("run_id").agg(F.max_by("text", "seq").alias("text"))


def clone_rows(rows: DataFrame, key: str, to: Column, since: Column) -> DataFrame:
    """rows (key and others, among them key_source) under the key that `to` gives, where it does; of a public source the keys' owner is none."""
    copied = rows.where(to.isNotNull()).withColumn("_to", to).withColumn("key_source", F.when(since, "none").otherwise(F.col("key_source")))
    return copied.withColumn(key, F.col("_to")).drop("_to")


def cost_range(runs: DataFrame, rates: DataFrame, whole_pages: int, least: float = 0.25) -> DataFrame:
    """run_id, low, likely, high: what runs (run_id, pages, and a model for each kind of work: kind, model) will cost, null with a model of no rate.

    rates: kind, model, low, likely, high for a report of whole_pages pages. Indexing costs go with the pages, questions too but for `least` of
    them, scores do not.
    """
    share = F.col("pages") / whole_pages
    factor = F.when(F.col("kind") == "index", share).when(F.col("kind") == "question", F.greatest(share, F.lit(least))).otherwise(1.0)
    rows = runs.join(F.broadcast(rates), ["kind", "model"], "left")
    total = lambda c: F.when(F.bool_and(F.col(c).isNotNull()), F.round(F.sum(F.col(c) * factor), 6)).alias(c)
    return rows.groupBy("run_id").agg(total("low"), total("likely"), total("high"))
