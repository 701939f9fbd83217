"""Queries on writes, imports, names, intervals, costs and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D, errors as E, text as T
from ..operators import imports, naming, sessions, spend, statistics, stored
from ..sources import tables as S
from ..sources.shared import shared_dir
from .queries import _MODELS, _TABLE
from .registry import query


@query(
    """WITH c AS (SELECT c_custkey AS session_id, c_mktsegment AS status, c_nationkey AS pages FROM customer), u AS (SELECT session_id + 1000000 * (session_id % 2) AS session_id, 'replaced' AS status, pages + 100 AS pages FROM c WHERE session_id % 3 = 0)
    SELECT * FROM (SELECT * FROM u UNION ALL SELECT * FROM c WHERE session_id NOT IN (SELECT session_id FROM u)) WHERE pages % 5 <> 4"""
)
def store_writes(spark, d):
    """A table after a first write, an upsert that comes twice, and a delete."""
    rows = S.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("session_id"), F.col("c_mktsegment").alias("status"), F.col("c_nationkey").cast("long").alias("pages"))
    table = stored.StoredTable(spark, shared_dir(spark), rows.schema, ["session_id"])
    table.upsert(rows, "first")
    changed = rows.where("session_id % 3 = 0").select((F.col("session_id") + F.col("session_id") % 2 * 1_000_000).alias("session_id"), F.lit("replaced").alias("status"), (F.col("pages") + 100).alias("pages"))
    for _ in range(2):
        table.upsert(changed, "second")
    table.delete(table.read().where("pages % 5 = 4").select("session_id"), ["session_id"], "third")
    return table.read()


_CHATS = "m AS (SELECT conv_id AS session_id, turn AS seq, role, text, turn % 5 <> 3 OR role <> 'assistant' AS done FROM conversations), s AS (SELECT session_id FROM m WHERE done GROUP BY session_id HAVING bool_or(role = 'assistant'))"


def _chats(spark, d):
    m = S.messages(spark, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("message_id"), "role", F.when(F.col("turn") % 5 == 3, "streaming").otherwise("answered").alias("status"), "text")
    pages = m.where("role = 'assistant' and seq % 2 = 1").select("message_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("page"), F.lit("p").alias("text"))
    return imports.write_chats(m, pages)


@query(f"WITH {_CHATS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS at, substr(sha256(session_id || ':m-' || session_id || '-' || seq), 1, 32) AS message_id, role, md5(text) AS text, 'Chat ' || session_id AS title, CASE WHEN role = 'assistant' AND seq % 2 = 1 THEN 2 ELSE 0 END AS n_contexts FROM m JOIN s USING (session_id) WHERE done")
def chat_import(spark, d):
    """Chats written as JSON and read again, among bodies that are no chats."""
    files = _chats(spark, d).select(F.col("session_id").alias("file_id"), "body")
    odd = files.where("file_id % 7 = 0").select("file_id", F.explode(F.array(F.lit("[1]"), F.lit("{"), F.lit('{"format": 2, "document": {}}'), F.lit(None).cast("string"), F.substring("body", 1, 40))).alias("body"))
    out = imports.read_chats(files.unionByName(odd), F.col("file_id").cast("string"))
    return out.select(F.col("session_id").cast("long").alias("session_id"), F.col("at").cast("long").alias("at"), "message_id", "role", F.md5("text").alias("text"), "title", "n_contexts")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def tool_results(spark, d):
    """Results of tools as bare text, as an item, as a list of items, or as none."""
    quoted = F.to_json(F.struct(F.lit("text").alias("type"), F.col("props").alias("text")))
    kind = F.col("event_id") % 5
    output = F.when(kind == 0, F.concat(F.lit("Error: "), "props")).when(kind == 1, F.col("props")).when(kind == 2, quoted).when(kind == 3, F.concat(F.lit("["), quoted, F.lit("]"))).otherwise(F.to_json(F.array(F.col("props"))))
    # a bare object without text is no item, but it is the result itself only as text in JSON
    output = F.when(kind == 1, F.concat(F.lit('{"text": "'), F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"}'))).otherwise(output)
    return S.read(spark, d, "events").select("event_id", imports.get(imports.tool_result(output), "$.k", "bigint").alias("k"))


@query(
    """SELECT user_id, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no key' WHEN 2 THEN 'unknown provider' WHEN 3 THEN 'not readable' END AS error, CASE user_id % 5 WHEN 0 THEN 'groq' WHEN 4 THEN 'ollama' END AS provider, CASE user_id % 5 WHEN 0 THEN 'm' || user_id END AS model FROM (SELECT DISTINCT user_id FROM events)"""
)
def model_choices(spark, d):
    kind = F.col("user_id") % 5
    body = F.when(kind == 0, F.concat(F.lit('{"provider": " Groq ", "api_key": "k?>~", "chat_model": "m'), "user_id", F.lit('"}'))).when(kind == 1, '{"provider": "openai"}').when(kind == 2, '{"provider": "x"}').when(kind == 4, '{"provider": "ollama", "api_key": null}').otherwise("[not json")
    # Spark may break long base64 into lines
    header = F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    choice = imports.model_choice(header)
    return S.read(spark, d, "events").select("user_id").distinct().select("user_id", choice["error"].alias("error"), choice["provider"].alias("provider"), choice["model"].alias("model"))


@query("SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus AS questions FROM orders WHERE o_orderpriority <> o_orderstatus")
def question_setting(spark, d):
    setting = F.concat("o_orderpriority", F.lit(" || \\n"), F.lower("o_orderpriority"), F.lit("\r\n \n"), "o_orderstatus", F.lit("||"), "o_orderstatus")
    return S.read(spark, d, "orders").select("o_orderkey", F.array_join(imports.question_list(setting), "|").alias("questions"))


@query()
def storage_names(spark, d):
    """Files named after customers' segments and nations: many of one name, some that end like a number handed out."""
    kind = F.col("c_custkey") % 4
    name = F.when(kind == 0, F.concat(F.initcap("c_mktsegment"), F.lit(".pdf"))).when(kind == 1, F.concat(F.lit("C:\\up\\"), F.lower("c_mktsegment"), F.lit("_2.PDF"))).when(kind == 2, F.concat(F.lit("Résumé "), "c_nationkey")).otherwise(F.lit(None).cast("string"))
    return naming.unique_names(S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), name.alias("name")), S.read(spark, d, "nation").select(F.concat(F.lit("Resume_"), "n_nationkey", F.lit(".pdf")).alias("name")).where("name like '%3.pdf'"))


@query(
    r"""SELECT page_id, strip_accents('Ré' || page_id || 'ü') || '.pdf' AS slug, trim(regexp_extract(url, '([^/]*)$', 1) || ' é') AS shown, CASE WHEN regexp_extract(url, '([^/]*)$', 1) = '' THEN '' ELSE replace(regexp_extract(url, '([^/]*)$', 1), '?', '_') END || '_ b.pdf' AS safe FROM pages"""
)
def file_names(spark, d):
    name = F.concat(F.lit("Ré"), "page_id", F.lit("ü.Pdf"))
    return S.read(spark, d, "pages").select("page_id", D.slug(name).alias("slug"), D.shown_name(F.concat("url", F.lit("\t é \n")), F.lit("x")).alias("shown"), D.safe_name(F.concat("url", F.lit("|\x07 b.PDF"))).alias("safe"))


@query(
    """WITH s AS (SELECT user_id AS step, epoch_us(min(ts)) AS lo, epoch_us(min(ts)) + 3600000000 * (1 + user_id % 3) AS hi FROM events GROUP BY user_id), e AS (SELECT epoch_us(ts) AS t, event_id AS id, value FROM events)
    SELECT step, max(value) AS peak, round(avg(value), 6) AS mean, arg_max(value, (t, id)) AS last, count(value) AS n FROM s LEFT JOIN e ON t BETWEEN lo AND hi GROUP BY step"""
)
def interval_samples(spark, d):
    """What all users' events say in the hours after each user's first one."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = S.read(spark, d, "events").select(at.alias("t"), F.col("event_id").alias("id"), "value", "user_id")
    steps = events.groupBy(F.col("user_id").alias("step")).agg(F.min("t").alias("lo")).withColumn("hi", F.col("lo") + (F.col("step") % 3 + 1) * 3_600_000_000)
    return statistics.interval_statistics(steps, events).withColumn("mean", F.round("mean", 6))


_SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@query(
    f"WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), p(share) AS (VALUES {', '.join(f'({s}::DOUBLE)' for s in _SHARES)}) SELECT share, n, value FROM p JOIN v ON i = least(n - 1, floor(share * n)::BIGINT)"
)
def score_percentiles(spark, d):
    return statistics.order_statistics(S.read(spark, d, "events").select("value"), _SHARES)


_MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in _MODELS) + "]"
_PRICE = ", ".join("('{}', {}, {}, {}, {}, {})".format(p[0], p[1], p[2], p[3], "NULL" if p[4] is None else p[4], str(p[5]).lower()) for p in spend.PRICES)
_FULL = f"""u AS (SELECT event_id, user_id, event_type AS stage, {_MODEL_LIST}[event_id % {len(_MODELS)} + 1] AS model, CAST(floor(value * 1000) AS BIGINT) AS cached, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), w AS (SELECT *, cached + k * 9000 AS input, k * 10 AS output, k * 700 AS writes, 1 + event_id % 4 AS requests, regexp_replace(model, '^openai/', '') AS name FROM u),
    price(id, i, c, o, cw, s) AS (VALUES {_PRICE}), x AS (SELECT w.*, coalesce(p.i, r.i) AS i, coalesce(p.c, r.c) AS c, coalesce(p.o, r.o) AS o, coalesce(p.cw, r.cw, p.i, r.i) AS cw, coalesce(p.s, r.s) AND input // requests > 272000 AS long, least(greatest(cached, 0), input) AS used FROM w LEFT JOIN price p ON name = p.id LEFT JOIN price r ON regexp_replace(name, '-(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{8}})$', '') = r.id),
    y AS (SELECT *, least(greatest(writes, 0), input - used) AS wr FROM x), cost AS (SELECT *, round((((input - used - wr) * i::DOUBLE + used * c::DOUBLE + wr * cw::DOUBLE) * CASE WHEN long THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END + output * o::DOUBLE * CASE WHEN long THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) / 1000000::DOUBLE, 8) AS cost_usd FROM y)"""


def _full_usage(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    events = S.read(spark, d, "events")
    more = events.select("event_id", F.col("event_type").alias("stage"), (k * 6500).alias("more"), (k * 700).alias("cache_write_tokens"), (F.col("event_id") % 4 + 1).alias("requests"))
    return spend.usage_events(events).join(more, "event_id").withColumn("input_tokens", F.col("input_tokens") + F.col("more")).drop("more")


@query(f"WITH {_FULL} SELECT event_id, cost_usd FROM cost")
def usage_cost_writes(spark, d):
    """Costs with writes to the cache, of inputs that are sums of several prompts."""
    return spend.with_cost(_full_usage(spark, d), spend.prices(spark)).select("event_id", "cost_usd")


@query(f"WITH {_FULL} SELECT stage, model, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input_tokens, CAST(sum(output) AS BIGINT) AS output_tokens, round(sum(cost_usd), 1) AS usd, bool_and(cost_usd IS NOT NULL) AS usd_complete FROM cost GROUP BY stage, model")
def meter_by_stage(spark, d):
    usage = _full_usage(spark, d)
    return spend.meter(usage, spend.with_cost(usage, spend.prices(spark)), ("stage", "model")).withColumn("usd", F.round("usd", 1))


@query(r"SELECT doc_id, md5(regexp_replace('sk-abc12 sk-a*b.c-12 ' || text, '(sk-|gsk_|xai-|tgp_|AIza)[A-Za-z0-9_*.-]{6,}', '\1...', 'g')) AS t FROM documents")
def key_fragments(spark, d):
    """Keys of six signs at least, with the stars and points that messages of errors put in them."""
    return S.read(spark, d, "documents").select("doc_id", F.md5(T.redact_keys(F.concat(F.lit("sk-abc12 sk-a*b.c-12 "), "text"), 6, "*.")).alias("t"))


_FAULTS = [
    (None, "", "The file has no text layer", False), (None, "", "could not extract a structure", False), (None, "", "PDF needs a Password", False), (None, "OSError", "cannot write", True), (429, "APIError", "You exceeded your current quota", False),
    (429, "RateLimitError", "slow down", False), (401, "", "x", False), (404, "NotFoundError", "no such thing", False), (503, "", "busy", False), (None, "APITimeoutError", "", False), (400, "", "the model y was not found", False), (429, "", "add credit", False), (None, "ValueError", "odd", False),
]
_KINDS = ["scanned", "no_outline", "encrypted", "storage", "quota", "rate_limit", "auth", "model", "upstream", "upstream", "other", "rate_limit", "other"]
_OWN_KINDS = ["scanned", "no_outline", "encrypted", "storage", "quota", "rate_limit", "auth", "model", "upstream", "upstream", "model", "quota", "other"]
_ANSWERS = ["agent_failed", "agent_failed", "agent_failed", "agent_failed", "openai_rate_limit", "openai_rate_limit", "openai_auth", "openai_model", "agent_failed", "agent_failed", "openai_model", "openai_rate_limit", "agent_failed"]


@query(
    f"""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN {_OWN_KINDS}[event_id % {len(_FAULTS)} + 1] ELSE {_KINDS}[event_id % {len(_FAULTS)} + 1] END AS fault, {_ANSWERS}[event_id % {len(_FAULTS)} + 1] AS answer_error FROM events"""
)
def error_classes(spark, d):
    """Each event fails in one of the ways listed here, with the stock provider or another."""
    fault = F.element_at(F.array(*[F.struct(F.lit(s).cast("int").alias("status"), F.lit(n).alias("name"), F.lit(m).alias("message"), F.lit(f).alias("no_file")) for s, n, m, f in _FAULTS]), (F.col("event_id") % len(_FAULTS) + 1).cast("int"))
    rows = S.read(spark, d, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("own"), fault.alias("f"))
    statuses = F.filter(F.array("f.status"), lambda s: s.isNotNull())
    return rows.select("event_id", E.index_fault(statuses, F.array("f.name"), F.col("f.message"), F.col("f.no_file"), F.col("own")).alias("fault"), E.answer_error(F.col("f.status"), F.lit(None).cast("string"), F.col("f.message"), F.col("own")).alias("answer_error"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'error' WHEN user_id % 3 > 0 AND event_id % 2 > 0 THEN 'answered' ELSE 'no_sources' END AS status, CASE WHEN event_type = 'view' AND user_id % 2 = 1 THEN 'failed' WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS score FROM events")
def answer_states(spark, d):
    """What became of answers, and of scores whose task may be gone."""
    e = S.read(spark, d, "events")
    live = e.select("user_id").distinct().where("user_id % 2 = 0").withColumn("live", F.lit(True))
    text = F.when(F.col("event_id") % 7 == 0, F.lit(" ")).otherwise(F.lit("x"))
    state = F.when(F.col("event_type") == "view", "running").otherwise("done")
    return e.join(live, "user_id", "left").select("event_id", E.answer_status(text, F.col("user_id") % 3, F.col("event_id") % 2).alias("status"), E.shown_score(state, F.col("live")).alias("score"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE c_nationkey END AS c_nationkey, c_name FROM customer")
def field_update_null(spark, d):
    rows = S.read(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_name")
    changes = rows.where("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(7).cast("long").alias("c_nationkey"), F.lit("x").alias("c_name"), F.array(F.lit("c_mktsegment"), F.lit("c_nationkey")).alias("named"))
    return sessions.update_fields(rows, "c_custkey", changes, ("c_mktsegment", "c_nationkey", "c_name"))
