"""Queries for cited quotes and claims: where they stand, and how a cite is resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, folios, locate
from ..sources import tables as S
from .registry import NUMBERS, PAGES, SQUASH, query

#: The rule of sources.tables.cites in SQL.
CITES = """cite AS (SELECT doc_id, p + doc_id // 4 % 3 - 1 AS page, n, CASE doc_id % 4 WHEN 0 THEN array_to_string(w[3:14], ' ') WHEN 1 THEN array_to_string(list_concat(w[3:6], w[8:20]), ' ')
    WHEN 2 THEN array_to_string(w[2:9], ' ') || ' ... ' || array_to_string(w[14:21], ' ') ELSE array_to_string(list_reverse(w[1:12]), ' ') END AS quote FROM
    (SELECT doc_id, n, p, string_split(lines[p], ' ') AS w FROM (SELECT doc_id, lines, len(lines) AS n, doc_id % len(lines) + 1 AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))))"""
EXACT = f"""{CITES}, {PAGES}, c AS (SELECT doc_id, greatest(1, least(page, n)) AS hint, {SQUASH.format('quote')} AS q, {NUMBERS.format('quote')} AS need FROM cite),
    w AS (SELECT c.doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS word, unnest(range(0, len(regexp_split_to_array(text, '\\s+')))) AS i FROM c JOIN pg ON c.doc_id = pg.doc_id AND c.hint = pg.page),
    t AS (SELECT doc_id, word, {SQUASH.format('word')} AS tok, sum(length({SQUASH.format('word')})) OVER (PARTITION BY doc_id ORDER BY i) AS hi, i FROM w),
    s AS (SELECT doc_id, string_agg(tok, '' ORDER BY i) AS s FROM t GROUP BY doc_id),
    o AS (SELECT doc_id, hint, q, need, k FROM (SELECT c.*, s, unnest(range(1, length(s) - length(q) + 2)) AS k FROM c JOIN s USING (doc_id) WHERE length(q) >= 4) WHERE substr(s, k, length(q)) = q),
    m AS (SELECT o.doc_id, hint, q, need, k, bool_or(hi - length(tok) = k - 1) AND bool_or(hi = k - 1 + length(q)) AS whole, flatten(list({NUMBERS.format('word')})) AS have FROM o JOIN t ON o.doc_id = t.doc_id AND tok <> '' AND hi > k - 1 AND hi - length(tok) < k - 1 + length(q) GROUP BY o.doc_id, hint, q, need, k),
    ok AS (SELECT * FROM m WHERE len(list_filter(need, lambda x: NOT list_contains(have, x))) = 0)"""


@query(f"WITH {EXACT} SELECT doc_id, hint AS page, CASE WHEN bool_or(whole) THEN 1.0::DOUBLE ELSE 0.97::DOUBLE END AS score, CAST(least(200, CASE WHEN bool_or(whole) THEN count(*) FILTER (WHERE whole) ELSE count(*) END) AS INT) AS places FROM ok GROUP BY doc_id, hint")
def quote_exact_cited(spark, d):
    found = locate.on_cited_page(S.cites(spark, d), S.pages(spark, d)).withColumn("here", locate.exact_match(F.col("text"), F.col("quote"))).where("here is not null")
    return found.select("doc_id", F.col("hint").alias("page"), F.round("here.score", 4).alias("score"), F.col("here.places").alias("places"))


@query()
def quote_locate_best(spark, d):
    """Exact, fuzzy, fragments or area on the cited page."""
    found = locate.locate_on_page(S.cites(spark, d), S.pages(spark, d))
    return found.select("doc_id", "hint", F.coalesce("here.method", F.lit("page")).alias("method"), F.round(F.coalesce("here.score", F.lit(0.0)), 4).alias("score"), "here.first_word", "here.last_word")


@query()
def quote_locate_neighbour(spark, d):
    found = locate.locate(S.cites(spark, d), S.pages(spark, d))
    return found.select("doc_id", "hint", "found_page", "stage", F.coalesce("match.method", F.lit("page")).alias("method"), F.round(F.coalesce("match.score", F.lit(0.0)), 4).alias("score"))


@query()
def cite_resolve(spark, d):
    return locate.resolve(S.cites(spark, d), S.pages(spark, d)).drop("cite_id", "matched")


@query()
def answer_cites(spark, d):
    """Tags in odd forms: the text with markers, and each cite with its claim."""
    return answers.with_cites(S.answers(spark, d)).select("answer_id", F.md5("answer.text").alias("text"), "answer.dropped", F.posexplode_outer("answer.cites").alias("at", "cite")).select("answer_id", "text", "dropped", "cite.n", "cite.page", "cite.quote", "cite.claim")


@query()
def answer_build(spark, d):
    pages = S.pages(spark, d)
    return answers.build(S.answers(spark, d), pages, pages.where(F.col("page") % 4 != 0))


@query()
def folio_labels(spark, d):
    return folios.folio_labels(S.numbered_pages(spark, d))


@query()
def printed_labels(spark, d):
    pages = S.numbered_pages(spark, d)
    return folios.printed_labels(pages, pages.select("doc_id", "page", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("A-"), "page")).otherwise(F.col("page").cast("string")).alias("label")))
