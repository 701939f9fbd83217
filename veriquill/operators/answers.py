"""Answers with cites: tags become numbered markers, each cite gets its claim, its place in the document and its section."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import cites as C
from ..functions.text import strip_markers
from ..sources.shared import materialize
from . import evidence, locate

CITE = "struct<n: int, doc: string, page: long, quote: string, start: int, stop: int, claim: string>"


def _scanned(raws: pd.Series, most: pd.Series) -> pd.DataFrame:
    rows = []
    for raw, pages in zip(raws, most, strict=True):
        events, dropped = C.scan(raw, None if pages is None or pages != pages else int(pages))
        rows.append((C.shown(events).strip(), dropped, [{**e._asdict(), "claim": C.claim_for(raw, e.start)} for e in events if isinstance(e, C.Cite)]))
    return pd.DataFrame(rows, columns=["text", "dropped", "cites"])


def with_cites(answers: DataFrame) -> DataFrame:
    """answers (answer_id, raw, most_pages) with answer: its text with markers, how many cites were dropped, and the cites in order.

    A null answer is empty; without most_pages no page that a long holds is too high. Markers that a raw answer has itself go first.
    """
    # told to be nondeterministic: else the filter that comes with exploding cites is pushed below and scans each answer a second time, in a worker of its own
    scanned = F.pandas_udf(_scanned, f"text string, dropped int, cites array<{CITE}>").asNondeterministic()
    return answers.withColumn("answer", scanned(strip_markers(F.coalesce("raw", F.lit(""))), F.col("most_pages")))


def cites_of(answers: DataFrame) -> DataFrame:
    """answer_id, cite_id, page, quote, claim: one row for each cite, for answers as with_cites() gives them."""
    return answers.select("answer_id", F.inline("answer.cites")).select("answer_id", F.col("n").cast("long").alias("cite_id"), "page", "quote", "claim")


def citations(answers: DataFrame, pages: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """answer_id, cite_id, page, cited_page, printed_page, section_path, node_id, node_range, quote, source, method, score, claim: one row for each cite.

    answers: as with_cites() gives them, about documents (answer_id is the doc_id); labels: doc_id, page, label of printed numbers; nodes: of
    outlines, as outline.flatten() gives them. quote is the page's own text where the cite was found, null if nowhere.
    """
    cites = cites_of(answers).withColumnRenamed("answer_id", "doc_id")
    found = locate.resolve(cites.withColumn("cite_id", F.struct("cite_id", F.col("page").alias("cited_page"), "claim")), pages)
    # written once: the section of each page and the rows themselves come from it, so that claims are aligned in Python once
    found = materialize(found.select("doc_id", "cite_id.*", "page", F.col("matched").alias("quote"), "source", "method", "score"))
    printed = labels.select("doc_id", "page", F.col("label").alias("printed_page"))
    shown = found.select("doc_id", "page").distinct()
    sections = evidence.deepest_section(shown, nodes.select("doc_id", F.col("place").alias("node"), "depth", "lo", "hi"), "node")
    sections = sections.join(nodes.select("doc_id", F.col("place").alias("node"), F.col("path").alias("section_path"), "node_id", F.array("lo", "hi").alias("node_range")), ["doc_id", "node"])
    out = found.join(printed, ["doc_id", "page"], "left").join(sections.drop("node"), ["doc_id", "page"], "left")
    return out.select(F.col("doc_id").alias("answer_id"), "cite_id", "page", "cited_page", "printed_page", "section_path", "node_id", "node_range", "quote", "source", "method", "score", "claim")


def sources(citations: DataFrame) -> DataFrame:
    """answer_id, page, printed_page, refs, citation_ids, section_path: the pages that an answer cites, with the ids in answer order and what the first of them says."""
    ids = F.transform(F.array_sort(F.collect_list("cite_id")), lambda n: F.concat(F.lit("c"), n.cast("string")))
    first = lambda c: F.min_by(c, "cite_id").alias(c)
    return citations.groupBy("answer_id", "page").agg(first("printed_page"), F.count("*").alias("refs"), F.array_join(ids, ",").alias("citation_ids"), first("section_path"))


def build(answers: DataFrame, pages: DataFrame, read: DataFrame) -> DataFrame:
    """answer_id, n_cites, n_verified, n_aligned, n_page_only, n_unread, n_dropped of answers about documents (answer_id is the doc_id).

    read: doc_id, page of the pages that were read. A cite is unread by the page that it names, not by the one where its quote was found.
    """
    done = with_cites(answers)
    cites = cites_of(done).withColumnRenamed("answer_id", "doc_id")
    found = locate.resolve(cites, pages).select("doc_id", "cite_id", "source")
    unread = cites.join(read.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_unread"))
    count = lambda s: F.count_if(F.col("source") == s)
    per = found.groupBy("doc_id").agg(F.count("*").alias("n_cites"), count("model").alias("n_verified"), count("aligned").alias("n_aligned"), count("none").alias("n_page_only"))
    out = done.select(F.col("answer_id").alias("doc_id"), F.col("answer.dropped").cast("long").alias("n_dropped")).join(per, "doc_id", "left").join(unread, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[zero(c) for c in ("n_cites", "n_verified", "n_aligned", "n_page_only", "n_unread")], "n_dropped")
