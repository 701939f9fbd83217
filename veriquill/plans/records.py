"""Registered queries on records, frames, addresses and small statistics, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import records as R, text as T
from ..operators import evidence
from ..sources import tables as S
from .queries import NUMBERS, PAGES, SQUASH, query


@query(
    f"""WITH q AS (SELECT item_id, {SQUASH.format('text')} AS q, {NUMBERS.format('text')} AS need FROM benchmark), s AS (SELECT doc_id, {SQUASH.format('text')} AS s, {NUMBERS.format('text')} AS have FROM documents)
    SELECT doc_id, item_id, list_has_all(have, need) AS guarded FROM s JOIN q ON contains(s, q) WHERE length(q) >= 4"""
)
def quote_numeric_guard(spark, d):
    return evidence.locate_exact(S.read(spark, d, "documents"), S.read(spark, d, "benchmark"), ["doc_id"])


@query(
    """WITH s AS (SELECT DISTINCT turn AS lo, turn + 3 AS hi FROM conversations)
    SELECT lo, array_to_string(list_sort(list_distinct(list_filter(list_concat([lo], range(least(lo, hi), hi + 1), [1]), lambda p: p BETWEEN 1 AND 8))), ',') AS pages FROM s"""
)
def page_spec_expand(spark, d):
    turns = S.messages(spark, d).select(F.col("turn").cast("long").alias("lo")).distinct()
    spec = F.concat_ws(",", "lo", F.concat_ws("-", F.col("lo") + 3, "lo"), F.lit("1"))
    return turns.select("lo", F.array_join(R.expand_pages(spec, F.lit(8)), ",").alias("pages"))


@query(f"WITH {PAGES}, k AS (SELECT * FROM pg WHERE page % 5 <> 0), n AS (SELECT doc_id, unnest(range(1, max(page) + 1)) AS page FROM k GROUP BY doc_id) SELECT doc_id, page, md5(coalesce(text, '')) AS t FROM n LEFT JOIN k USING (doc_id, page)")
def page_fill(spark, d):
    return evidence.dense_pages(S.pages(spark, d).where("page % 5 <> 0")).select("doc_id", "page", F.md5("text").alias("t"))


@query(
    f"""WITH {PAGES}, v AS (SELECT doc_id, CASE WHEN page % 6 = 5 THEN page - 1 ELSE -(doc_id % 7) END AS shift FROM pg WHERE page % 4 <> 0), c AS (SELECT doc_id, shift, count(*) AS hits FROM v GROUP BY doc_id, shift),
    t AS (SELECT doc_id, sum(hits) AS total, max(hits) AS hits, arg_min(shift, (-hits, shift)) AS shift FROM c GROUP BY doc_id) SELECT doc_id, shift, hits FROM t WHERE hits >= 3 AND hits >= 0.6 * total"""
)
def folio_offset_note(spark, d):
    label = F.when(F.col("page") % 4 == 0, "iv").when(F.col("page") % 6 == 5, "1").otherwise((F.col("page") + F.col("doc_id") % 7).cast("string"))
    return evidence.offset_notes(S.pages(spark, d).select("doc_id", "page", label.alias("label")))


@query("SELECT event_id, CASE WHEN value >= 80 THEN 'high' WHEN value >= 50 THEN 'medium' WHEN value IS NOT NULL THEN 'low' END AS band, CASE WHEN value >= 100 THEN 'exhausted' WHEN value > 80 THEN 'low' WHEN value IS NOT NULL THEN 'ok' ELSE 'off' END AS usage_level FROM events")
def score_bands(spark, d):
    share = F.col("value") / 100
    return S.read(spark, d, "events").select("event_id", R.score_band(share).alias("band"), R.usage_level(share).alias("usage_level"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'disabled' WHEN user_id % 7 = 0 THEN 'no_api_key' WHEN value < 10 THEN 'empty_answer' WHEN event_id % 3 = 0 THEN 'no_contexts' END AS skipped FROM events"""
)
def score_skip_reason(spark, d):
    e = S.read(spark, d, "events")
    return e.select("event_id", R.skip_reason(F.col("event_type") == "error", F.col("user_id") % 7 == 0, F.col("value") < 10, F.col("event_id") % 3 == 0).alias("skipped"))


@query("SELECT event_id, md5('event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10)) AS frame FROM events")
def frame_write(spark, d):
    return S.read(spark, d, "events").select("event_id", F.md5(R.frame(F.col("event_type"), F.col("props"))).alias("frame"))


@query("SELECT event_id, 1::BIGINT AS n, event_type AS name, props AS data FROM events UNION ALL SELECT event_id, 2::BIGINT, 'done', '{}' || chr(10) || 'x' FROM events")
def frame_parse(spark, d):
    body = F.concat(F.lit(": ping\r\n\r\n"), R.frame(F.col("event_type"), F.col("props")), F.lit("event: done\ndata: {}\ndata: x\n\n"))
    return R.parse_frames(S.read(spark, d, "events"), "event_id", body)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0")
def json_lines(spark, d):
    line = F.concat(F.when(F.col("event_id") % 3 == 0, "warning: ").otherwise(""), "props")
    return R.json_lines(S.read(spark, d, "events").select("event_id", line.alias("line")), "line", "k long").select("event_id", "k")


@query("SELECT event_id, CASE WHEN user_id % 300 <= 255 THEN '10.0.0.' || user_id % 300 ELSE '192.0.2.1' END AS address FROM (SELECT event_id, user_id * 37 AS user_id FROM events)")
def client_address(spark, d):
    forwarded = F.concat(F.lit("10.0.0."), (F.col("user_id") * 37 % 300).cast("string"), F.lit(", 198.51.100.7"))
    return S.read(spark, d, "events").select("event_id", R.client_address(forwarded, F.lit("192.0.2.1")).alias("address"))


@query("SELECT conv_id, turn, substr(sha256(conv_id || ':' || turn), 1, 32) AS new_id FROM conversations")
def import_ids(spark, d):
    return S.messages(spark, d).select("conv_id", "turn", R.imported_id(F.col("conv_id"), F.col("turn")).alias("new_id"))


@query("SELECT user_id, CAST(sum(greatest(0, round_even(value * 1000, 0))) AS BIGINT) AS elapsed_ms FROM events GROUP BY user_id")
def step_elapsed(spark, d):
    return S.read(spark, d, "events").groupBy("user_id").agg(F.sum(F.greatest(F.lit(0), F.bround(F.col("value") * 1000)).cast("long")).alias("elapsed_ms"))


@query("SELECT event_id, round(0.1::DOUBLE * (1 - exp(-value / 15)) * 0.999::DOUBLE, 6) AS progress FROM events")
def progress_curve(spark, d):
    return S.read(spark, d, "events").select("event_id", F.round((1 - F.exp(-F.col("value") / 15)) * 0.1 * 0.999, 6).alias("progress"))


@query("SELECT doc_id, md5(regexp_replace('key sk-a1_B2-c3, ' || text, '(sk-|gsk_|xai-|tgp_|AIza)[A-Za-z0-9_-]+', '\\1...', 'g')) AS t FROM documents")
def key_redaction(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.md5(T.redact_keys(F.concat(F.lit("key sk-a1_B2-c3, "), "text"))).alias("t"))


@query(
    """WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[0-9]+|[a-z]+')) AS term FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark), c AS (SELECT term, count(*) AS df FROM t GROUP BY term)
    SELECT term, df, round(ln(1 + n::DOUBLE / (1 + df)) * CASE WHEN regexp_matches(term, '[0-9]') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 6) AS idf FROM c, n"""
)
def term_idf(spark, d):
    items = S.read(spark, d, "benchmark")
    terms = items.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[0-9]+|[a-z]+"), 0)).alias("term"))
    return evidence.inverse_frequency(terms, "item_id", items.count())


@query(
    """WITH s AS (SELECT user_id AS step, min(ts) AS lo, min(ts) + INTERVAL 6 HOUR AS hi FROM events GROUP BY user_id)
    SELECT step, max(value) AS peak, round(avg(value), 6) AS mean, arg_max(value, (ts, event_id)) AS last FROM s JOIN events e ON e.user_id = step AND ts BETWEEN lo AND hi GROUP BY step"""
)
def interval_peak(spark, d):
    e = S.read(spark, d, "events")
    first = F.min("ts").over(Window.partitionBy("user_id"))
    inside = e.withColumn("lo", first).where(F.col("ts") <= F.col("lo") + F.expr("INTERVAL 6 HOURS"))
    return inside.groupBy(F.col("user_id").alias("step")).agg(F.max("value").alias("peak"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query(
    """WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, 0::BIGINT AS at, 'batch_start' AS kind FROM f UNION ALL SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), event_type FROM events
    UNION ALL SELECT user_id, n + 1, 'batch_done' FROM f UNION ALL SELECT user_id, n + 2, 'done' FROM f"""
)
def batch_multiplex(spark, d):
    return R.batch_stream(S.read(spark, d, "events"))


@query(
    """WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[0-9]+|[a-z]+')) AS term FROM benchmark), f AS (SELECT item_id, md5(term) AS h, 1 + ln(count(*)) AS w FROM t GROUP BY item_id, term),
    b AS (SELECT item_id, CAST('0x' || substr(h, 1, 2) AS BIGINT) % 64 AS bucket, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 1 THEN w ELSE -w END) AS v FROM f GROUP BY item_id, bucket)
    SELECT item_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS v FROM b"""
)
def text_embedding(spark, d):
    items = S.read(spark, d, "benchmark")
    terms = items.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[0-9]+|[a-z]+"), 0)).alias("term"))
    return evidence.hashed_embedding(terms, "item_id")
