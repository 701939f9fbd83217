"""Registered queries over the Parquet tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chats, evidence, scoring, spend
from ..sources import tables as S
from ..streaming import limits
from .registry import NUMBERS, ORACLES, PAGES, QUERIES, SQUASH, query  # noqa: F401

STATE = "SELECT conv_id, CASE conv_id % 5 WHEN 1 THEN 'failed' WHEN 2 THEN 'indexing' ELSE 'ready' END AS status FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 <> 0"


@query(
    f"""WITH d AS ({STATE}), m AS (SELECT conv_id, count(*) AS message_count, bool_or(role = 'user') AS asked, max(turn) AS last FROM conversations GROUP BY conv_id)
    SELECT m.conv_id, CASE WHEN status IS NULL THEN 'empty' WHEN status = 'failed' THEN 'failed' WHEN status = 'indexing' THEN 'indexing' WHEN asked THEN 'locked' ELSE 'ready' END AS state,
    message_count, last FROM m LEFT JOIN d USING (conv_id)"""
)
def session_list(spark, d):
    m = S.messages(spark, d)
    return chats.list_sessions(m, chats.session_documents(m))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def session_detail(spark, d):
    return S.messages(spark, d).where("conv_id = 3").select("conv_id", "turn", "role", "text").orderBy("turn")


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id")
def session_delete_cascade(spark, d):
    m = S.messages(spark, d)
    return chats.delete_sessions(m, m.where("role = 'system'").select("conv_id").distinct()).groupBy("conv_id").agg(F.count("*").alias("n"))


PAIRS = """p AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""


@query(f"WITH {PAIRS} SELECT conv_id, turn, md5(question) AS q, md5(answer) AS a FROM p")
def history_pairs(spark, d):
    return chats.history_pairs(S.messages(spark, d)).select("conv_id", "turn", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, from_end FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM p) WHERE from_end <= 2")
def history_last_n(spark, d):
    return chats.history_pairs(S.messages(spark, d)).where("from_end <= 2").select("conv_id", "turn", "from_end")


@query("SELECT conv_id, role, turn, md5(text) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def message_upsert(spark, d):
    return chats.upsert_latest(S.messages(spark, d), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", F.md5("text").alias("t"))


@query(
    """WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'answered' WHEN 1 THEN 'streaming' ELSE 'no_sources' END AS status, CASE conv_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' ELSE 'failed' END AS score FROM conversations)
    SELECT conv_id, turn, CASE WHEN status = 'streaming' THEN 'error' ELSE status END AS status, CASE WHEN score IN ('pending', 'running') THEN 'skipped' ELSE score END AS score, CASE WHEN score IN ('pending', 'running') THEN 'interrupted' END AS skipped_reason FROM r"""
)
def message_recover(spark, d):
    return chats.recover(S.messages(spark, d))


@query(
    """WITH q AS (SELECT conv_id, turn, substr(trim(text), 1, 4000) AS question FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, md5(question) AS question FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(question) ORDER BY turn) AS r FROM q WHERE question <> '') WHERE r = 1"""
)
def question_dedupe(spark, d):
    return chats.clean_questions(S.messages(spark, d)).select("conv_id", "turn", F.md5("question").alias("question"))


@query(
    """WITH f AS (SELECT conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM conversations WHERE turn = 0), h AS (SELECT *, substr(flat, 1, 60) AS head FROM f), c AS (SELECT *, strpos(reverse(head), ' ') AS p FROM h)
    SELECT conv_id, CASE WHEN length(flat) <= 60 THEN flat ELSE regexp_replace(CASE WHEN p > 0 AND 60 - p >= 30 THEN substr(head, 1, 60 - p) ELSE head END, '[ .,;:-]+$', '') || '…' END AS title FROM c"""
)
def auto_title(spark, d):
    return S.messages(spark, d).where("turn = 0").select("conv_id", T.make_title(F.col("text")).alias("title"))


CITES = """c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, length(text) % 9 + 1 AS page, length(text) % 3 <> 0 AS verified, (length(text) % 9 + 1) % 4 <> 0 AS read FROM conversations WHERE role = 'assistant')"""


@query(f"WITH {CITES} SELECT conv_id, page, count(*) AS refs, string_agg('c' || idx, ',' ORDER BY idx) AS citation_ids FROM c GROUP BY conv_id, page")
def answer_sources(spark, d):
    return evidence.sources(evidence.citations(S.messages(spark, d)))


@query(
    f"""WITH {CITES} SELECT conv_id, count(*) AS n_cites, count(*) FILTER (WHERE verified) AS n_verified, count(*) FILTER (WHERE NOT verified) AS n_page_only, count(*) FILTER (WHERE NOT read) AS n_unread, count(DISTINCT page) AS n_pages FROM c GROUP BY conv_id"""
)
def answer_stats(spark, d):
    return evidence.answer_stats(evidence.citations(S.messages(spark, d)))


@query(f"WITH {CITES} SELECT conv_id, idx, page FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS r WHERE r.conv_id = c.conv_id AND r.page = c.page AND r.read)")
def answer_unread(spark, d):
    c = evidence.citations(S.messages(spark, d))
    return c.join(c.where("read").select("conv_id", "page").distinct(), ["conv_id", "page"], "left_anti").select("conv_id", "idx", "page")


@query(f"WITH {CITES} SELECT conv_id, page, min(idx) AS first_read FROM c GROUP BY conv_id, page")
def context_dedupe(spark, d):
    return evidence.citations(S.messages(spark, d)).groupBy("conv_id", "page").agg(F.min("idx").alias("first_read"))


@query(f"WITH {CITES} SELECT conv_id, idx FROM (SELECT conv_id, idx, row_number() OVER (PARTITION BY conv_id ORDER BY verified DESC, idx) AS r FROM c) WHERE r <= 2")
def context_select_cap(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy(F.desc("verified"), "idx")
    return evidence.citations(S.messages(spark, d)).withColumn("r", F.row_number().over(order)).where("r <= 2").select("conv_id", "idx")


@query(
    """WITH t AS (SELECT 'Sales rose <cite doc="' || doc_id || '" page="' || (n_chars % 40 + 1) || '" quote="a  b"/> and <cite page=' || (n_chars % 7 + 1) || '/>.' AS raw, doc_id FROM documents),
    e AS (SELECT doc_id, unnest(regexp_extract_all(raw, '<cite[^<>]*/>')) AS tag, unnest(range(1, len(regexp_extract_all(raw, '<cite[^<>]*/>')) + 1)) AS n FROM t)
    SELECT doc_id, n, CAST(regexp_extract(tag, 'page="?([0-9]+)', 1) AS BIGINT) AS page, regexp_replace(regexp_extract(tag, 'quote="([^"]*)"', 1), '\\s+', ' ', 'g') AS quote FROM e"""
)
def answer_cites_wellformed(spark, d):
    raw = F.concat(F.lit('Sales rose <cite doc="'), "doc_id", F.lit('" page="'), F.col("n_chars") % 40 + 1, F.lit('" quote="a  b"/> and <cite page='), F.col("n_chars") % 7 + 1, F.lit("/>."))
    tags = S.read(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(raw, F.lit("<cite[^<>]*/>"), 0)).alias("at", "tag"))
    quote = F.regexp_replace(F.regexp_extract("tag", 'quote="([^"]*)"', 1), "\\s+", " ")
    return tags.select("doc_id", (F.col("at") + 1).cast("long").alias("n"), F.regexp_extract("tag", 'page="?([0-9]+)', 1).cast("long").alias("page"), quote.alias("quote"))


VERDICTS = "v AS (SELECT doc_id // 10 AS q, doc_id % 10 AS rank, quality AS v FROM labels)"


@query(f"WITH {VERDICTS} SELECT q, count(*) AS n, round(avg(v), 4) AS score FROM v GROUP BY q")
def score_faithfulness(spark, d):
    return scoring.faithfulness(scoring.verdicts(S.read(spark, d, "labels")))


@query(
    f"""WITH {VERDICTS}, w AS (SELECT q, v, sum(v) OVER o AS hits, row_number() OVER o AS k FROM v WINDOW o AS (PARTITION BY q ORDER BY rank))
    SELECT q, round(sum(v * hits / k) / (sum(v) + 1e-10), 4) AS score FROM w GROUP BY q"""
)
def score_context_precision(spark, d):
    return scoring.context_precision(scoring.verdicts(S.read(spark, d, "labels")))


@query(
    """WITH r AS (SELECT vec_id // 4 AS q, vec_id % 4 AS k, CAST(embedding AS DOUBLE[]) AS e, label = 0 AS none FROM embeddings)
    SELECT a.q, round(avg(list_cosine_similarity(a.e, b.e)) * CASE WHEN bool_and(a.none) THEN 0 ELSE 1 END, 4) AS score FROM r a JOIN r b ON a.q = b.q AND a.k > 0 AND b.k = 0 GROUP BY a.q"""
)
def score_relevancy(spark, d):
    return scoring.relevancy(S.read(spark, d, "embeddings"))


@query(
    """WITH s AS (SELECT user_id AS q, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN value END AS score FROM events)
    SELECT q, count(score) AS n_ok, CASE WHEN count(score) >= 3 THEN 'done' WHEN count(score) > 0 THEN 'partial' ELSE 'failed' END AS status FROM s GROUP BY q"""
)
def score_status(spark, d):
    e = S.read(spark, d, "events")
    return scoring.status(e.select(F.col("user_id").alias("q"), F.when(F.col("event_type").isin("view", "click", "purchase"), F.col("value")).alias("score")))


_MODELS = [*[p[0] for p in spend.PRICES], "gpt-4.1-2025-04-14", "openai/gpt-4o", "gpt-4.1-nano"]
_LIST = "[" + ", ".join(f"'{m}'" for m in _MODELS) + "]"
_TABLE = ", ".join("('{}', {}, {}, {}, {})".format(p[0], p[1], p[2], p[3], str(p[5]).lower()) for p in spend.PRICES)
COSTS = f"""u AS (SELECT event_id, user_id, event_type, props, {_LIST}[event_id % {len(_MODELS)} + 1] AS model, CAST(floor(value * 1000) AS BIGINT) AS cached_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    w AS (SELECT *, cached_tokens + k * 2500 AS input_tokens, k * 10 AS output_tokens, regexp_replace(model, '^openai/', '') AS name FROM u),
    price(id, i, c, o, s) AS (VALUES {_TABLE}),
    x AS (SELECT w.*, coalesce(p.i, r.i) AS i, coalesce(p.c, r.c) AS c, coalesce(p.o, r.o) AS o, coalesce(p.s, r.s) AND input_tokens > 272000 AS long, least(greatest(cached_tokens, 0), input_tokens) AS used FROM w LEFT JOIN price p ON name = p.id LEFT JOIN price r ON regexp_replace(name, '-(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{8}})$', '') = r.id),
    cost AS (SELECT event_id, user_id, event_type, props, model, input_tokens, output_tokens, round((((input_tokens - used) * CAST(i AS DOUBLE) + used * CAST(c AS DOUBLE)) * CASE WHEN long THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END + greatest(output_tokens, 0) * CAST(o AS DOUBLE) * CASE WHEN long THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) / 1000000::DOUBLE, 8) AS cost_usd FROM x)"""
SNAP = """snap AS (SELECT user_id, round(coalesce(sum(CASE WHEN event_type <> 'error' THEN greatest(cost_usd, 0) END), 0), 6) AS answer_cost_usd, count(*) FILTER (WHERE event_type <> 'error' AND cost_usd IS NULL) AS unpriced_answers,
    count(*) FILTER (WHERE event_type = 'error' AND cost_usd IS NULL) AS unpriced_failed, count(DISTINCT CASE WHEN event_type = 'signup' THEN props END) AS index_keys, count(*) FILTER (WHERE event_type = 'view') AS evaluations FROM cost GROUP BY user_id)"""


def _costs(spark, d):
    events = S.read(spark, d, "events")
    usage = spend.usage_events(events)
    return events, usage, spend.with_cost(usage, spend.prices(spark))


@query(f"WITH {COSTS} SELECT event_id, model, cost_usd FROM cost")
def usage_cost(spark, d):
    return _costs(spark, d)[2].select("event_id", "model", "cost_usd")


@query(f"WITH {COSTS}, {SNAP} SELECT user_id, round(answer_cost_usd, 4) AS answer_cost_usd, unpriced_answers, unpriced_failed, index_keys, evaluations FROM snap")
def usage_snapshot(spark, d):
    events, _, costs = _costs(spark, d)
    return spend.snapshot(costs, events).withColumn("answer_cost_usd", F.round("answer_cost_usd", 4))


@query(
    f"""WITH {COSTS}, {SNAP}, t AS (SELECT user_id, CAST(answer_cost_usd + unpriced_answers * 0.5 + unpriced_failed * 0.1 + index_keys * 0.4 + evaluations * 0.08 AS DOUBLE) AS spent FROM snap)
    SELECT user_id, round(spent, 3) AS spent_usd, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, spent / 50)), 3) AS used FROM t"""
)
def budget_fraction(spark, d):
    events, _, costs = _costs(spark, d)
    return spend.budget(spend.snapshot(costs, events))


@query(f"WITH {COSTS} SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 4) AS usd, bool_and(cost_usd IS NOT NULL) AS usd_complete FROM cost GROUP BY model")
def meter_by_model(spark, d):
    _, usage, costs = _costs(spark, d)
    return spend.meter(usage, costs).withColumn("usd", F.round("usd", 4))


@query(f"WITH {COSTS}, m AS (SELECT DISTINCT model FROM cost) SELECT model, arg_max(id, length(id)) AS priced_as FROM m LEFT JOIN price ON model = id OR starts_with(model, id || '-') GROUP BY model")
def price_longest_prefix(spark, d):
    return spend.longest_prefix(spend.usage_events(S.read(spark, d, "events")), spend.prices(spark))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_trailing_count(spark, d):
    return limits.trailing_count(S.read(spark, d, "events"))


@query()
def rate_limiter(spark, d):
    return limits.sliding_limiter(S.read(spark, d, "events"))


@query()
def limiter_operations(spark, d):
    """Views are single hits, clicks hits of two, purchases refunds, errors recorded in any case, other events questions."""
    return limits.limited(S.limiter_operations(spark, d))


@query("SELECT event_id, round(least(0.95::DOUBLE, max(value / 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS progress FROM events")
def progress_high_water(spark, d):
    return limits.high_water(S.read(spark, d, "events"))


@query(
    """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER o > INTERVAL 1 DAY THEN 1 ELSE 0 END AS cut FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
    t AS (SELECT user_id, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS turn FROM g) SELECT user_id, turn, count(*) AS n FROM t GROUP BY user_id, turn"""
)
def turn_gaps(spark, d):
    return limits.turns(S.read(spark, d, "events"))


@query(
    """SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS kinds, arg_max(event_type, (ts, event_id)) AS last_kind, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS last_purchase FROM events GROUP BY user_id"""
)
def event_fold(spark, d):
    return limits.fold(S.read(spark, d, "events"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS answered, count(*) FILTER (WHERE event_type = 'error') AS failed, bool_and(event_type IN ('purchase', 'error')) AS done FROM events GROUP BY user_id")
def batch_counts(spark, d):
    return limits.batch_counts(S.read(spark, d, "events"))


@query(f"WITH {PAGES} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE length(regexp_replace(text, '\\s', '', 'g')) >= 20) AS text_pages, count(*) FILTER (WHERE length(regexp_replace(text, '\\s', '', 'g')) >= 20) < 0.05 * count(*) AS scanned FROM pg GROUP BY doc_id")
def page_scan_flag(spark, d):
    full = F.count_if(F.length(F.regexp_replace("text", "\\s", "")) >= 20)
    return S.pages(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_pages"), full.alias("text_pages"), (full < F.count("*") * 0.05).alias("scanned"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ' || chr(9))) AS clean FROM documents")
def page_clean_text(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean"))


@query(f"SELECT doc_id, len(n) AS n_numbers, array_to_string(n, '|') AS numbers FROM (SELECT doc_id, {NUMBERS.format('text')} AS n FROM documents)")
def page_numbers(spark, d):
    n = T.numbers(F.col("text"))
    return S.read(spark, d, "documents").select("doc_id", F.size(n).cast("long").alias("n_numbers"), F.array_join(n, "|").alias("numbers"))


@query(f"WITH q AS (SELECT item_id, {SQUASH.format('text')} AS q FROM benchmark), s AS (SELECT doc_id, {SQUASH.format('text')} AS s FROM documents) SELECT doc_id, item_id FROM s JOIN q ON contains(s, q) WHERE length(q) >= 4")
def quote_exact_doc(spark, d):
    return evidence.locate_exact(S.read(spark, d, "documents"), S.read(spark, d, "benchmark"), ["doc_id"]).select("doc_id", "item_id")


@query(
    f"""WITH {PAGES}, q AS (SELECT item_id, {SQUASH.format('text')} AS q, {NUMBERS.format('text')} AS need FROM benchmark), s AS (SELECT doc_id, page, {SQUASH.format('text')} AS s, {NUMBERS.format('text')} AS have FROM pg)
    SELECT doc_id, page, item_id, len(list_filter(need, lambda x: NOT list_contains(have, x))) = 0 AS guarded FROM s JOIN q ON contains(s, q) WHERE length(q) >= 4"""
)
def quote_exact_page(spark, d):
    return evidence.locate_exact(S.pages(spark, d), S.read(spark, d, "benchmark"), ["doc_id", "page"])


@query(
    f"""WITH {PAGES}, q AS (SELECT DISTINCT item_id, {SQUASH.format('text')} AS q, {NUMBERS.format('text')} AS need FROM benchmark), d AS (SELECT doc_id, {SQUASH.format('text')} AS s FROM documents),
    p AS (SELECT doc_id, page, {NUMBERS.format('text')} AS have, sum(length({SQUASH.format('text')})) OVER (PARTITION BY doc_id ORDER BY page) AS hi FROM pg),
    h AS (SELECT doc_id, item_id, s, q, need, unnest(range(1, length(s) - length(q) + 2)) AS i FROM d JOIN q ON contains(s, q) WHERE length(q) >= 4),
    o AS (SELECT doc_id, item_id, need, i, i + length(q) - 1 AS upto FROM h WHERE substr(s, i, length(q)) = q),
    b AS (SELECT o.doc_id, item_id, need, i, min(page) FILTER (WHERE hi >= i) AS page, min(page) FILTER (WHERE hi >= upto) AS last_page FROM o JOIN p USING (doc_id) GROUP BY o.doc_id, item_id, need, i)
    SELECT DISTINCT b.doc_id, item_id, b.page, last_page, (SELECT len(list_filter(need, lambda x: NOT list_contains(flatten(list(have)), x))) = 0 FROM p WHERE p.doc_id = b.doc_id AND p.page BETWEEN b.page AND b.last_page) AS guarded FROM b"""
)
def quote_whole_page(spark, d):
    return evidence.locate_pages(S.read(spark, d, "documents"), S.read(spark, d, "benchmark"))


NODES = """n AS (SELECT doc_id, max(page) AS n FROM pg GROUP BY doc_id), node AS (SELECT doc_id, 'n-0-1' AS node_id, 0 AS depth, 1 AS lo, n AS hi FROM n
    UNION ALL SELECT doc_id, 'n-1-' || lo, 1, lo, least(n, lo + 15) FROM (SELECT doc_id, n, unnest(range(1, n + 1, 16)) AS lo FROM n) UNION ALL SELECT doc_id, 'n-2-' || lo, 2, lo, least(n, lo + 3) FROM (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS lo FROM n))"""


@query(
    f"""WITH {PAGES}, {NODES} SELECT doc_id, page, node_id FROM (SELECT pg.doc_id, page, node_id, row_number() OVER (PARTITION BY pg.doc_id, page ORDER BY lo = page DESC, depth DESC, hi - lo, lo DESC, node_id) AS r FROM pg JOIN node ON pg.doc_id = node.doc_id AND page BETWEEN lo AND hi) WHERE r = 1"""
)
def page_section(spark, d):
    pages = S.pages(spark, d)
    return evidence.deepest_section(pages, evidence.section_nodes(pages))


@query(f"WITH {PAGES}, {NODES} SELECT doc_id, count(*) AS n_nodes, CAST(max(depth) AS BIGINT) AS depth FROM node GROUP BY doc_id")
def tree_flat(spark, d):
    return evidence.section_nodes(S.pages(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"))


@query(
    """WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'user'), i AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM p),
    r AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM i GROUP BY conv_id, g) SELECT conv_id, string_agg(CASE WHEN lo = hi THEN '' || lo ELSE lo || '-' || hi END, ',' ORDER BY lo) AS runs FROM r GROUP BY conv_id"""
)
def page_runs(spark, d):
    return evidence.page_runs(S.messages(spark, d).where("role <> 'user'"), "conv_id", "turn")


@query(
    """WITH t AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS x FROM benchmark), k AS (SELECT item_id, regexp_replace(x, '[^a-z]', '', 'g') AS x FROM t) SELECT item_id, count(*) AS n, count(DISTINCT x) AS distinct_tokens FROM k WHERE x <> '' GROUP BY item_id"""
)
def quote_tokens(spark, d):
    t = S.read(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("x")).select("item_id", F.regexp_replace("x", "[^a-z]", "").alias("x"))
    return t.where("x <> ''").groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("x").alias("distinct_tokens"))


_TOKENS = "list_transform(regexp_extract_all(lower(text), '[0-9]+(?:[.,][0-9]+)*|\\p{L}+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN replace(x, ',', '') ELSE x END)"
_QUIET = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


@query(
    f"""WITH q AS (SELECT item_id, {_TOKENS} AS t FROM benchmark), w AS (SELECT DISTINCT item_id, greatest(8, floor(len(t) * 1.5))::INT AS win, tok, least(length(tok), 8) + CASE WHEN regexp_matches(tok, '[0-9]') THEN 3 ELSE 0 END AS w FROM (SELECT item_id, t, unnest(t) AS tok FROM q) WHERE length(tok) > 1 AND tok NOT IN {_QUIET}),
    s AS (SELECT item_id, sum(w) AS total FROM w GROUP BY item_id), d AS (SELECT doc_id, unnest({_TOKENS}) AS tok, unnest(range(0, len({_TOKENS}))) AS pos FROM documents),
    h AS MATERIALIZED (SELECT doc_id, item_id, pos, tok, w, win FROM d JOIN w USING (tok)),
    f AS (SELECT doc_id, item_id, frame, sum(w) AS score FROM (SELECT DISTINCT a.doc_id, a.item_id, a.pos AS frame, b.tok, b.w FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos <= a.pos AND b.pos > a.pos - a.win) GROUP BY ALL),
    b AS (SELECT doc_id, item_id, max(score) AS score, arg_min(frame, (-score, frame)) AS pos FROM f GROUP BY ALL)
    SELECT item_id, doc_id, pos, round(score::DOUBLE / total, 6) AS share FROM b JOIN s USING (item_id) WHERE round(score::DOUBLE / total, 6) >= 0.55::DOUBLE"""
)
def block_window(spark, d):
    return evidence.densest_window(S.read(spark, d, "documents").select("doc_id", "text"), S.read(spark, d, "benchmark"))


@query(
    f"""WITH {PAGES}, v AS (SELECT DISTINCT doc_id, page, unnest(regexp_extract_all(regexp_replace(text, '([^0-9.,])', '\\1\\1', 'g'), '(?:^|[^0-9.,])([1-9][0-9]{{0,3}})(?:[^0-9.,]|$)', 1)) AS v FROM pg),
    s AS (SELECT doc_id, v::BIGINT - page AS shift, count(DISTINCT page) AS support FROM v GROUP BY ALL) SELECT doc_id, arg_min(shift, (-support, shift)) AS shift, max(support) AS support FROM s GROUP BY doc_id"""
)
def folio_vote(spark, d):
    return evidence.folio_votes(S.pages(spark, d))


@query("SELECT conv_id, turn, md5(text) AS t FROM conversations")
def markers_stripped(spark, d):
    marked = F.concat(F.regexp_replace("text", "\\.", " [[c1]]."), F.lit(" [[c2]]"))
    return S.messages(spark, d).select("conv_id", "turn", F.md5(T.strip_markers(marked)).alias("t"))


@query("SELECT doc_id, regexp_matches(text, '(?i)(token|secret|api_key) = \"[0-9a-f]{16,}\"') AS secret, regexp_matches(text, 'AKIA[0-9A-Z]{16}') AS access_key FROM documents")
def secret_audit(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.col("text").rlike('(?i)(token|secret|api_key) = "[0-9a-f]{16,}"').alias("secret"), F.col("text").rlike("AKIA[0-9A-Z]{16}").alias("access_key"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages")
def html_page_title_links(spark, d):
    return S.html_fields(S.read(spark, d, "pages"))


@query("SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN value / 100 >= t THEN 1.0 ELSE 0.0 END), 6) AS share FROM events CROSS JOIN (VALUES (0.5), (0.6), (0.7), (0.8), (0.9), (0.95)) AS x(t) GROUP BY t")
def acceptance_curve(spark, d):
    shares = S.read(spark, d, "events").agg(*[F.round(F.avg(F.when(F.col("value") / 100 >= t, 1.0).otherwise(0.0)), 6).alias(str(k)) for k, t in enumerate((0.5, 0.6, 0.7, 0.8, 0.9, 0.95))])
    return shares.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(str(k)).alias("share")) for k, t in enumerate((0.5, 0.6, 0.7, 0.8, 0.9, 0.95))])))
