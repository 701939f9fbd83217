"""Queries on outlines, sections, evidence and the citations of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms as W
from ..operators import answers, evidence, outline, ranking, support
from ..sources import tables as S
from ..sources.shared import materialize
from ..streaming import transcripts
from .registry import query

#: The reports of sources.tables.report_pages in SQL, without their text, and the nodes of their outlines.
REPORTS = f"rp AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) // {S.REPORT_LINES} + (len(string_split(text, chr(10))) % {S.REPORT_LINES} > 0)::INT + 1)) AS page FROM documents WHERE text IS NOT NULL), rn AS (SELECT doc_id, max(page) AS n FROM rp GROUP BY doc_id)"
TREE = f"""nd AS (SELECT doc_id, 'n-0-1' AS node_id, 0 AS depth, 1 AS lo, n AS hi FROM rn UNION ALL SELECT doc_id, 'n-1-' || lo, 1, lo, least(n, lo + {S.CHAPTER - 1}) FROM (SELECT doc_id, n, unnest(range(1, n + 1, {S.CHAPTER})) AS lo FROM rn)
    UNION ALL SELECT doc_id, 'n-2-' || lo, 2, lo, least(n, lo + {S.SECTION - 1}) FROM (SELECT doc_id, n, unnest(range(1, n + 1, {S.SECTION})) AS lo FROM rn))"""
#: Places among siblings: an odd tree has four things before its root.
PLACED = f"SELECT *, CASE WHEN doc_id % 5 = 0 THEN '4' ELSE '0' END || CASE WHEN depth > 0 THEN '.' || (lo - 1) // {S.CHAPTER} ELSE '' END || CASE WHEN depth > 1 THEN '.' || (lo - 1) % {S.CHAPTER} // {S.SECTION} ELSE '' END AS place FROM nd"


def _nodes(spark, d):
    return outline.flatten(outline.newest(S.outlines(spark, d), "doc_id"))


def _joined(place):
    return F.array_join(F.transform(place, lambda x: x.cast("string")), ".")


@query(
    f"""WITH {REPORTS}, {TREE} SELECT doc_id, place, CAST(depth AS INT) AS depth, node_id, lo, hi, true AS exact FROM ({PLACED}) UNION ALL SELECT doc_id, '2', 0, NULL, 9, 3, true FROM rn WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, '3', 0, NULL, 1, 1, false FROM rn WHERE doc_id % 5 = 0"""
)
def outline_flat(spark, d):
    return _nodes(spark, d).select("doc_id", _joined("place").alias("place"), "depth", "node_id", "lo", "hi", "exact")


@query(f"WITH {REPORTS}, {TREE}, p AS ({PLACED}) SELECT doc_id, place, regexp_replace(place, '\\.?[0-9]+$', '') AS parent, node_id, lo AS start_index, hi AS end_index FROM p UNION ALL SELECT doc_id, '2', '', NULL, 9, 3 FROM rn WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, '3', '', NULL, 1, 1 FROM rn WHERE doc_id % 5 = 0")
def outline_shown(spark, d):
    return outline.prune(_nodes(spark, d)).select("doc_id", _joined("place").alias("place"), _joined("parent").alias("parent"), "node_id", "start_index", "end_index")


@query(
    f"""WITH {REPORTS}, {TREE} SELECT doc_id, page, node_id, lo, hi FROM (SELECT rp.doc_id, page, node_id, lo, hi, row_number() OVER (PARTITION BY rp.doc_id, page ORDER BY lo = page DESC, depth DESC, hi - lo, lo DESC) AS r FROM rp JOIN nd ON rp.doc_id = nd.doc_id AND page BETWEEN lo AND hi) WHERE r = 1"""
)
def page_breadcrumb(spark, d):
    """The section of each page of a report, and the titles on the way to it (not in the comparison: they are words of the pages)."""
    nodes = _nodes(spark, d)
    found = evidence.deepest_section(S.report_pages(spark, d).select("doc_id", "page"), nodes, "place")
    return found.join(nodes.select("doc_id", "place", "node_id", "lo", "hi"), ["doc_id", "place"]).select("doc_id", "page", "node_id", "lo", "hi")


@query()
def page_units(spark, d):
    return support.page_units(S.report_pages(spark, d)).select("doc_id", "page", "unit", F.size("words").alias("n_words"), F.array_join(F.transform("joined", lambda j: j.cast("string")), ",").alias("joined"), "is_row", F.md5("told").alias("told"), "label", "amount")


@query()
def outline_ranks(spark, d):
    """Sections of a document's own outline by how well they answer its questions."""
    ranked = ranking.rank_nodes(S.report_questions(spark, d), materialize(outline.ranked_nodes(_nodes(spark, d))), ("doc_id",))
    return ranked.select("doc_id", "question_id", _joined("node_id").alias("place"), "score", "rank")


def _scored(spark, d, texts=False):
    nodes = materialize(outline.ranked_nodes(_nodes(spark, d)))
    questions = S.report_questions(spark, d)
    weighed = ranking.weigh(questions, nodes, ("doc_id",))
    ranked = ranking.rank_nodes(questions, nodes, ("doc_id",), weighed)
    relevance = outline.page_relevance(ranked, nodes, ("doc_id", "question_id"))
    return support.score_units(support.page_units(S.report_pages(spark, d)), questions, nodes, relevance, weighed, texts)


@query()
def unit_scores(spark, d):
    return _scored(spark, d).select("doc_id", "question_id", "page", "unit", "score", F.array_join(F.array_sort("matched"), " ").alias("matched"))


@query()
def unit_pick(spark, d):
    return support.pick_units(_scored(spark, d)).select("doc_id", "question_id", "page", "unit", "score", "pick")


@query()
def support_answers(spark, d):
    """Answers of picked units, with a cite of each unit's best words."""
    return support.compose(support.pick_units(_scored(spark, d, texts=True))).select("answer_id", "question_id", F.md5("raw").alias("raw"))


_PLAIN = "regexp_replace(text, '<cite[^>]*/>|\\[\\[c[0-9]+\\]\\]|\\[[0-9]+(?:,\\s*[0-9]+)*\\]', '', 'g')"


@query(
    rf"""WITH l AS (SELECT conv_id, turn, list_transform(regexp_split_to_array({_PLAIN}, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^\s*(?:[-*•]|[0-9]+[.)])\s+', '')) AS l, {_PLAIN} AS plain FROM conversations WHERE role = 'assistant'),
    s AS (SELECT *, list_transform(flatten(list_transform(l, lambda x: string_split(regexp_replace(trim(x), '([.!?])\s+([A-Z“(£0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: regexp_replace(trim(x), '\s+', ' ', 'g')) AS s FROM l),
    k AS (SELECT *, list_filter(s, lambda x: len(string_split(x, ' ')) >= 3) AS k FROM s)
    SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN least(12, len(list_distinct(k))) WHEN trim(array_to_string(l, chr(10))) <> '' THEN 1 ELSE 0 END AS n, md5(CASE WHEN len(k) > 0 THEN k[1] ELSE trim(array_to_string(l, chr(10))) END) AS first FROM k"""
)
def answer_statements(spark, d):
    """How many statements an answer makes, and the first of them."""
    said = S.messages(spark, d).where("role = 'assistant'").select("conv_id", "turn", W.statements(F.col("text")).alias("s"))
    return said.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.md5(F.coalesce(F.get("s", F.lit(0)), F.lit(""))).alias("first"))


def _citations(spark, d):
    pages = S.pages(spark, d)
    nodes = evidence.section_nodes(pages).select("doc_id", F.col("node_id").alias("place"), "node_id", F.array("node_id").alias("path"), "depth", "lo", "hi")
    labels = pages.where("page % 5 <> 4").select("doc_id", "page", F.concat(F.lit("p"), "page").alias("label"))
    return answers.citations(answers.with_cites(S.answers(spark, d)), pages, labels, nodes)


@query()
def answer_citations(spark, d):
    c = _citations(spark, d)
    return c.select("answer_id", "cite_id", "page", "cited_page", "printed_page", F.array_join("section_path", " > ").alias("section"), "node_id", F.md5("quote").alias("quote"), "source", "method", F.round("score", 4).alias("score"))


@query()
def answer_page_sources(spark, d):
    return answers.sources(_citations(spark, d)).select("answer_id", "page", "printed_page", "refs", "citation_ids", F.array_join("section_path", " > ").alias("section"))


@query()
def run_shown(spark, d):
    """Steps, text and cites of runs as a reader sees them while they go on."""
    return transcripts.shown(S.run_events(spark, d)).select("answer_id", "seq", "place", "kind", "step", "label", "pages", "elapsed_ms", F.md5("text").alias("text"), "n", "page", F.md5("quote").alias("quote"), F.md5("claim").alias("claim"))
