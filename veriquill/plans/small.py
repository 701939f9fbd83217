"""Queries on token counts, metrics, copied texts, clones and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R, usage as U
from ..functions.terms import content_terms
from ..operators import chats, evidence, sessions, spend, stored
from ..sources import tables as S
from ..sources.shared import shared_dir
from ..streaming import transcripts
from .kept import _content
from .queries import _MODELS, STATE
from .registry import query

_LIST = "[" + ", ".join(f"'{m}'" for m in [*_MODELS, "o3-mini", "GPT-10"]) + "]"


@query(f"SELECT event_id, regexp_replace({_LIST}[event_id % {len(_MODELS) + 2} + 1], '^openai/', '') AS model, regexp_matches(lower({_LIST}[event_id % {len(_MODELS) + 2} + 1]), '^(?:o[0-9]+|gpt-(?:[5-9]|1[0-9]))(?:[._-]|$)') AS thinking FROM events")
def model_kinds(spark, d):
    name = F.element_at(F.array(*map(F.lit, [*_MODELS, "o3-mini", "GPT-10"])), (F.col("event_id") % (len(_MODELS) + 2) + 1).cast("int"))
    return S.read(spark, d, "events").select("event_id", U.bare_model(name).alias("model"), U.is_thinking(name).alias("thinking"))


@query("SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4) AS n FROM documents")
def rough_tokens(spark, d):
    return S.read(spark, d, "documents").select("doc_id", U.rough_tokens(F.col("text")).alias("n"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE user_id * 10 END AS input, CASE WHEN event_id % 3 = 2 THEN 0 ELSE user_id END AS cached, CASE WHEN event_id % 3 = 0 THEN 7 ELSE 0 END AS written, CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id END AS output, CASE WHEN event_id % 3 = 1 THEN 3 ELSE 0 END AS thought FROM events"""
)
def usage_shapes(spark, d):
    """Usage as two kinds of interfaces report it, and responses without any."""
    n = lambda name, v: F.concat(F.lit(f'"{name}": '), v.cast("string"))
    first = F.concat(F.lit('{"usage": {'), n("input_tokens", F.col("user_id") * 10), F.lit(', "input_tokens_details": {'), n("cached_tokens", F.col("user_id")), F.lit(', "cache_write_tokens": 7}, '), n("output_tokens", F.col("event_id")), F.lit("}}"))
    second = F.concat(F.lit('{"usage": {'), n("prompt_tokens", F.col("user_id") * 10), F.lit(', "prompt_tokens_details": {'), n("cached_tokens", F.col("user_id")), F.lit("}, "), n("completion_tokens", F.col("event_id")), F.lit(', "completion_tokens_details": {"reasoning_tokens": 3}}}'))
    body = F.when(F.col("event_id") % 3 == 0, first).when(F.col("event_id") % 3 == 1, second).otherwise(F.lit('{"usage": null}'))
    return S.read(spark, d, "events").select("event_id", U.usage_of(body).alias("u")).select("event_id", "u.*")


@query(
    """WITH m AS (SELECT user_id, event_type AS metric, arg_max(value, event_id) AS v, max(event_id) AS e FROM events GROUP BY ALL), o AS (SELECT user_id, metric, CASE WHEN e % 4 = 0 THEN 'failed' WHEN e % 4 = 1 THEN 'No usable score for this answer (the judge found nothing to score)' END AS error FROM m)
    SELECT user_id, count(*) FILTER (WHERE error IS NULL) AS n_ok, coalesce(string_agg(metric || ': ' || error, '; ' ORDER BY metric) FILTER (WHERE error IS NOT NULL), '') AS errors FROM o GROUP BY user_id"""
)
def metric_outcomes(spark, d):
    """Of each metric a value or an error, and the errors of all."""
    latest = S.read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("metric")).agg(F.max_by("value", "event_id").alias("v"), F.max("event_id").alias("e"))
    value = F.when(F.col("e") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("v"))
    outcome = U.metric_outcome(value, F.when(F.col("e") % 4 == 0, "failed"))
    rows = latest.select("user_id", F.struct("metric", outcome["value"].alias("value"), outcome["error"].alias("error")).alias("o"))
    told = rows.groupBy("user_id").agg(F.count_if(F.col("o.error").isNull()).alias("n_ok"), U.errors_of(F.collect_list("o")).alias("m"))
    lines = F.array_sort(F.transform(F.map_entries("m"), lambda x: F.concat(x.key, F.lit(": "), x.value)))
    return told.select("user_id", "n_ok", F.array_join(lines, "; ").alias("errors"))


@query("SELECT conv_id, turn, md5(replace(text, '.', ' [r' || conv_id || '.pdf p.' || (turn + 1) || '].') || ' [r' || conv_id || '.pdf p.9]') AS t, 'Item' || chr(9) || 'Value' || chr(10) || 'a b' || chr(9) || turn AS tsv FROM conversations")
def copied_text(spark, d):
    """Answers as they are copied: with references in place of markers, and a table as text."""
    marked = F.concat(F.replace(F.regexp_replace("text", "\\.", " \t[[c1]]."), F.lit("\u0000"), F.lit("")), F.lit("[[c12]] [[c3]]"))
    name = F.concat(F.lit("r"), "conv_id", F.lit(".pdf"))
    cites = F.array(*[F.struct(F.lit(n).alias("n"), name.alias("name"), page.cast("int").alias("page")) for n, page in ((1, F.col("turn") + 1), (12, F.lit(9)))])
    table = F.concat(F.lit("| Item | Value |\n|---|:-:|\n|  a  b | "), "turn", F.lit("|\nnot a row"))
    return S.messages(spark, d).select("conv_id", "turn", F.md5(U.with_references(marked, cites)).alias("t"), U.table_text(table).alias("tsv"))


@query("SELECT conv_id AS run_id, md5(arg_max(text, turn)) AS text FROM (SELECT *, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS c FROM conversations) WHERE role = 'assistant' AND (c IS NULL OR turn > c) AND conv_id % 4 <> 1 GROUP BY conv_id")
def final_texts(spark, d):
    """The last message of runs whose text was not streamed; system turns stand for calls, and some runs have pieces."""
    kind = F.when(F.col("role") == "system", "call").when(F.col("role") == "assistant", "message").otherwise("other")
    m = S.messages(spark, d).select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), kind.alias("kind"), "text")
    pieces = m.where("run_id % 4 <= 1").groupBy("run_id").agg(F.lit(0).alias("seq"), F.lit("piece").alias("kind"), F.when(F.col("run_id") % 4 == 1, "x").otherwise(" ").alias("text"))
    return sessions.final_text(m.unionByName(pieces)).select("run_id", F.md5("text").alias("text"))


@query("SELECT CASE WHEN copied THEN 'copy-' || conv_id ELSE 's-' || conv_id END AS session_id, turn AS page, md5(text) AS text, CASE WHEN copied AND conv_id % 2 = 0 THEN 'none' ELSE 'owner' END AS key_source FROM (SELECT *, false AS copied FROM conversations UNION ALL SELECT *, true FROM conversations WHERE conv_id % 3 = 0)")
def session_clone(spark, d):
    """Pages of sessions, and of copies of every third, written and read back; keys of public ones are not copied."""
    rows = S.messages(spark, d).select(F.concat(F.lit("s-"), "conv_id").alias("session_id"), F.col("turn").alias("page"), F.md5("text").alias("text"), F.lit("owner").alias("key_source"), "conv_id")
    copies = sessions.clone_rows(rows, "session_id", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("copy-"), "conv_id")), F.col("conv_id") % 2 == 0)
    out = rows.unionByName(copies).drop("conv_id")
    table = stored.StoredTable(spark, shared_dir(spark), out.schema, ["session_id", "page"])
    table.commit(out)
    return table.read()


# USD (low, likely, high) of one piece of work on a report of 308 pages.
RATES = [
    ("index", "gpt-5.6-luna", 0.07, 0.26, 0.32), ("index", "gpt-6-luna", 0.07, 0.12, 0.32), ("question", "gpt-6-luna", 0.004, 0.009, 0.022), ("question", "gpt-5.6-luna", 0.008, 0.018, 0.046), ("question", "gpt-5.6-terra", 0.082, 0.18, 0.46),
    ("question", "gpt-6.1-sol", 0.080, 0.175, 0.44), ("question", "gpt-5.6-sol", 0.16, 0.35, 0.88), ("question", "gpt-6-astra", 0.40, 0.88, 2.20), ("score", "gpt-4o-mini", 0.003, 0.007, 0.020), ("score", "gpt-4.1-mini", 0.008, 0.018, 0.054),
    ("score", "gpt-4.1", 0.042, 0.088, 0.27), ("score", "gpt-4o", 0.052, 0.11, 0.34),
]
_RATE_ROWS = ", ".join(f"('{k}', '{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, m, a, b, c in RATES)


@query(
    f"""WITH r(kind, model, low, likely, high) AS (VALUES {_RATE_ROWS}), p AS (SELECT c_custkey AS run_id, c_nationkey * 40 + 1 AS pages FROM customer), w AS (SELECT run_id, pages, 'index' AS kind, CASE WHEN run_id % 5 = 0 THEN 'x' ELSE 'gpt-6-luna' END AS model FROM p UNION ALL SELECT run_id, pages, 'question', 'gpt-6.1-sol' FROM p UNION ALL SELECT run_id, pages, 'score', 'gpt-4.1' FROM p),
    f AS (SELECT *, CASE kind WHEN 'index' THEN pages / 308 WHEN 'question' THEN greatest(pages / 308, 0.25::DOUBLE) ELSE 1 END AS f FROM w LEFT JOIN r USING (kind, model))
    SELECT run_id, CASE WHEN bool_and(low IS NOT NULL) THEN round(sum(low * f), 6) END AS low, CASE WHEN bool_and(low IS NOT NULL) THEN round(sum(likely * f), 6) END AS likely, CASE WHEN bool_and(low IS NOT NULL) THEN round(sum(high * f), 6) END AS high FROM f GROUP BY run_id"""
)
def cost_ranges(spark, d):
    work = F.array(F.struct(F.lit("index").alias("kind"), F.when(F.col("c_custkey") % 5 == 0, "x").otherwise("gpt-6-luna").alias("model")), F.struct(F.lit("question").alias("kind"), F.lit("gpt-6.1-sol").alias("model")), F.struct(F.lit("score").alias("kind"), F.lit("gpt-4.1").alias("model")))
    runs = S.read(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_nationkey") * 40 + 1).alias("pages"), F.inline(work))
    rates = spark.createDataFrame(RATES, "kind string, model string, low double, likely double, high double")
    return sessions.cost_range(runs, rates, 308)


@query(
    f"""WITH t AS (SELECT item_id, unnest({_content('text')}) AS term FROM benchmark), f AS (SELECT item_id, md5(term) AS h, 1 + ln(count(*)) AS w FROM t GROUP BY item_id, term),
    b AS (SELECT item_id, CAST('0x' || substr(h, 1, 2) AS BIGINT) % 64 AS bucket, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN w ELSE -w END) AS v FROM f GROUP BY item_id, bucket), n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS norm FROM b)
    SELECT item_id, bucket, round(v / norm, 6) AS v FROM n WHERE norm > 0 UNION ALL SELECT item_id, 0, 1.0::DOUBLE FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM n WHERE norm > 0) UNION ALL SELECT -1, 0, 1.0::DOUBLE"""
)
def content_embedding(spark, d):
    """Hashed vectors of content terms; a text without any has the first unit vector."""
    items = S.read(spark, d, "benchmark").select("item_id", "text")
    items = items.unionByName(spark.createDataFrame([(-1, "is the")], items.schema))
    found = evidence.hashed_embedding(items.select("item_id", F.explode(content_terms(F.col("text"))).alias("term")), "item_id").where("not isnan(v)")
    none = items.join(found.select("item_id").distinct(), "item_id", "left_anti").select("item_id", F.lit(0).cast("long").alias("bucket"), F.lit(1.0).alias("v"))
    return found.unionByName(none)


_MESSAGES = "m AS (SELECT user_id AS session_id, CASE event_type WHEN 'purchase' THEN 'answered' WHEN 'view' THEN 'no_sources' WHEN 'error' THEN 'error' ELSE 'streaming' END AS status, event_id % 2 = 0 AS has_usage, CASE WHEN event_id % 3 > 0 THEN value - 5 END AS cost_usd, ['done', 'partial', 'failed', 'skipped', 'pending'][event_id % 5 + 1] AS score_status FROM events), d AS (SELECT user_id AS session_id, props AS index_key, CASE WHEN event_id % 3 = 0 THEN 'visitor' ELSE 'server' END AS key_source, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'ready' END AS status, event_id % 2 AS progress FROM events WHERE event_type = 'signup'), gone AS (SELECT props AS index_key FROM events WHERE event_id % 50 = 1)"
_SESSIONS = f"""{_MESSAGES}, per AS (SELECT session_id, round(coalesce(sum(greatest(cost_usd, 0)), 0), 6) AS answer_cost_usd, count(*) FILTER (WHERE status IN ('answered', 'no_sources') AND cost_usd IS NULL) AS unpriced_answers, count(*) FILTER (WHERE status = 'error' AND NOT has_usage) AS unpriced_failed, count(*) FILTER (WHERE score_status IN ('done', 'partial', 'failed')) AS evaluations FROM m GROUP BY session_id),
    k AS (SELECT session_id, count(DISTINCT index_key) AS index_keys FROM d WHERE key_source = 'server' AND NOT (status = 'failed' AND progress = 0) AND index_key NOT IN (SELECT index_key FROM gone) GROUP BY session_id), snap AS (SELECT per.*, coalesce(index_keys, 0) AS index_keys FROM per LEFT JOIN k USING (session_id))"""


def _sessions(spark, d):
    e = S.read(spark, d, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    status = F.when(kind == "purchase", "answered").when(kind == "view", "no_sources").when(kind == "error", "error").otherwise("streaming")
    score = F.element_at(F.array(*map(F.lit, ("done", "partial", "failed", "skipped", "pending"))), (n % 5 + 1).cast("int"))
    messages = e.select(F.col("user_id").alias("session_id"), status.alias("status"), (n % 2 == 0).alias("has_usage"), F.when(n % 3 > 0, F.col("value") - 5).alias("cost_usd"), score.alias("score_status"))
    documents = e.where("event_type = 'signup'").select(F.col("user_id").alias("session_id"), F.col("props").alias("index_key"), F.when(n % 3 == 0, "visitor").otherwise("server").alias("key_source"), F.when(n % 4 == 0, "failed").otherwise("ready").alias("status"), (n % 2).alias("progress"))
    return spend.session_snapshot(messages, documents, e.where(n % 50 == 1).select(F.col("props").alias("index_key")))


@query(f"WITH {_SESSIONS} SELECT session_id, round(answer_cost_usd, 4) AS answer_cost_usd, unpriced_answers, unpriced_failed, index_keys, evaluations FROM snap")
def session_usage(spark, d):
    """What sessions have used, without keys that were paid for before."""
    return _sessions(spark, d).withColumn("answer_cost_usd", F.round("answer_cost_usd", 4))


@query(f"WITH {_SESSIONS} SELECT round(sum(answer_cost_usd + unpriced_answers * 0.5::DOUBLE + unpriced_failed * 0.1::DOUBLE + index_keys * 0.4::DOUBLE + evaluations * 0.08::DOUBLE) + 12.5, 1) AS spent_usd FROM snap")
def spend_total(spark, d):
    return spend.total_spend(_sessions(spark, d), 12.5).withColumn("spent_usd", F.round("spent_usd", 1))


@query("WITH x AS (SELECT user_id, event_id AS \"at\", greatest(value, 0) AS c, user_id % 7 + coalesce(sum(greatest(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) SELECT user_id, \"at\", b < 150 AS charged FROM x")
def budget_charges(spark, d):
    """Which of a user's charges are taken before the budget is used up."""
    e = S.read(spark, d, "events")
    spent = e.select("user_id", (F.col("user_id") % 7).cast("double").alias("spent_usd")).distinct()
    return spend.charge(spent, e.select("user_id", F.col("event_id").alias("at"), F.col("value").alias("cost_usd")), 150.0).select("user_id", "at", "charged")


@query(
    """WITH c AS (SELECT conv_id AS answer_id, turn AS read_seq, turn % 4 AS page, turn % 3 = 0 AS cited, text FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY answer_id, page ORDER BY read_seq) AS r, bool_or(cited) OVER (PARTITION BY answer_id, page) AS c FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY c DESC, read_seq, page) AS n FROM f WHERE r = 1)
    SELECT answer_id, page, c AS cited, row_number() OVER (PARTITION BY answer_id ORDER BY read_seq, page) AS place, md5(substr(text, 1, 30)) AS text FROM k WHERE n <= 3"""
)
def contexts_kept(spark, d):
    c = S.messages(spark, d).select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("read_seq"), (F.col("turn") % 4).alias("page"), (F.col("turn") % 3 == 0).alias("cited"), "text")
    return evidence.kept_contexts(c, 3, 30).select("answer_id", "page", "cited", "place", F.md5("text").alias("text"))


@query("SELECT event_id, CASE user_id % 6 WHEN 0 THEN '203.0.113.' || user_id % 256 WHEN 1 THEN 'peer' WHEN 2 THEN '2001:db8::' || user_id % 10 WHEN 3 THEN 'peer' WHEN 4 THEN '1:2:3:4:5:6:7:8' ELSE 'peer' END AS address FROM events")
def proxied_address(spark, d):
    """The address that the second proxy from the end saw, of either kind."""
    kind, n = F.col("user_id") % 6, F.col("user_id")
    seen = F.when(kind == 0, F.concat(F.lit("203.0.113."), n % 256)).when(kind == 1, F.lit("1::2::3")).when(kind == 2, F.concat(F.lit("2001:db8::"), n % 10)).when(kind == 3, F.lit("1:2:3:4:5:6:7:8:9")).when(kind == 4, F.lit("1:2:3:4:5:6:7:8"))
    forwarded = F.when(seen.isNull(), F.lit("10.0.0.1")).otherwise(F.concat(F.lit("spoofed, "), seen, F.lit(" , 10.0.0.1")))
    return S.read(spark, d, "events").select("event_id", R.forwarded_address(forwarded, F.lit("peer"), 2).alias("address"))


@query(f"WITH s AS ({STATE}) SELECT 'documents' AS kind, count(*) FILTER (WHERE status = 'indexing') AS n FROM s UNION ALL SELECT 'answers', count(*) FILTER (WHERE turn % 3 = 1) FROM conversations UNION ALL SELECT 'scores', count(*) FILTER (WHERE conv_id % 4 IN (1, 2)) FROM conversations")
def recovered_rows(spark, d):
    m = S.messages(spark, d)
    status = F.element_at(F.array(*map(F.lit, ("answered", "streaming", "no_sources"))), (F.col("turn") % 3 + 1).cast("int"))
    score = F.element_at(F.array(*map(F.lit, ("done", "pending", "running", "failed"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return chats.recovered(chats.session_documents(m), m.select(status.alias("status"), score.alias("score")))


@query()
def message_fold(spark, d):
    """What the rows that a reader is shown come to."""
    return transcripts.folded(transcripts.shown(S.run_events(spark, d))).withColumn("text", F.md5("text"))
