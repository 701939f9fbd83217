"""Which sections of an outline answer a question, and which pages are still to be read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.terms import content, content_terms, pairs, terms
from ..sources.shared import materialize

# What a term counts in a title, among key items and in a summary; the share of phrases; the least share of the best score.
IN_TITLE, IN_KEYS, IN_SUMMARY, PHRASE, LEAST_SHARE, FIGURE = 2.0, 1.5, 1.0, 0.25, 0.25, 0.3
MOST_PAGES = 4
#: Rows about questions that are broadcast; more are joined by a shuffle.
FEW = 200_000


def _held(asked: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """by, node_id, term, worth: what nodes hold of the terms and pairs of terms of questions (by, question_id, seq) of their outline.

    A term counts where it is worth most; pairs have no worth. Each node's texts are read once and nothing of them is shuffled but, with an outline's
    columns, the node itself, to meet all that its questions ask. It then stays one row, with an array `has` of term and worth.
    """
    none = F.array().cast("array<string>")
    read = nodes.select(*by, "node_id", *[F.coalesce(terms(F.col(c)), none).alias(c) for c in ("title", "keys", "summary")])
    asks = asked.select(*by, F.concat(F.array_distinct("seq"), pairs(F.col("seq"))).alias("asks"))
    title, keys, summary = F.array_distinct("title"), F.array_except("keys", "title"), F.array_except(F.array_except("summary", "title"), F.col("keys"))
    two = pairs(F.filter(F.concat("title", "keys", "summary"), content))
    if by:
        read = read.join(asks.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("asks"))).alias("asks")), by)
        title, keys, summary, two = (F.array_intersect(c, "asks") for c in (title, keys, summary, two))
    each = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).cast("double").alias("worth")))
    has = F.concat(each(title, IN_TITLE), each(keys, IN_KEYS), each(summary, IN_SUMMARY), each(two, None))
    read = read.where("node_id is not null").select(*by, "node_id", has.alias("has"))
    if by:
        return read
    held = read.select("node_id", F.inline("has"))
    return held.join(_few(asks.select(F.explode("asks").alias("term")).distinct()), "term").select("node_id", "term", "worth")


def _met(rows: DataFrame) -> DataFrame:
    """rows, to be joined by a shuffle."""
    return rows.hint("merge")


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if there are at most FEW of them."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def question_weights(asked: DataFrame, nodes: DataFrame, outline: tuple[str, ...] = (), held: DataFrame | None = None) -> DataFrame:
    """by, question_id, term, w: how much each term of a question (outline's columns, question_id, seq) says among the nodes of its outline.

    Terms weigh more the fewer nodes have them, figures less. An outline without nodes counts as one of one node.
    """
    by = list(outline)
    held = _held(asked, nodes, by) if held is None else held
    held = (held.select(*by, F.inline("has")) if by else held).where("worth is not null")
    asked_terms = asked.select(*by, "question_id", F.explode(F.array_distinct("seq")).alias("term"))
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("n_nodes"))
    counts = asked_terms.select(*by, "term").distinct().join(held.groupBy(*by, "term").agg(F.count("*").alias("df")), [*by, "term"], "left")
    counts = counts.join(sizes, by, "left") if by else counts.crossJoin(F.broadcast(sizes))
    share = F.greatest(F.coalesce("n_nodes", F.lit(1)), F.lit(1)) / (F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)) + 1)
    weight = F.log1p(share) * F.when(F.col("term").rlike("^[0-9]"), FIGURE).otherwise(1.0)
    return asked_terms.join(counts.select(*by, "term", weight.alias("w")), [*by, "term"])


class Weighed(NamedTuple):
    """Questions as terms (by, question_id, text, seq), what nodes hold of them, and what each term of a question weighs."""

    asked: DataFrame
    held: DataFrame
    weights: DataFrame


def weigh(questions: DataFrame, nodes: DataFrame, outline: tuple[str, ...] = ()) -> Weighed:
    """What rank_nodes() and support.score_units() both start from, read and worked out once."""
    by = list(outline)
    asked = materialize(questions.select(*by, "question_id", "text", content_terms(F.col("text")).alias("seq")))
    held = materialize(_held(asked, nodes, by))
    return Weighed(asked, held, materialize(question_weights(asked, nodes, outline, held)))


def _score(base: Column, phrase: Column, all_weights: Column) -> Column:
    return base / (all_weights * 2) + phrase / all_weights * PHRASE


def _sums(asked: DataFrame, held: DataFrame, weights: DataFrame) -> DataFrame:
    """question_id, node_id, score: where all nodes are one outline, a row for each term or pair that a node and a question share, added up."""
    asked_pairs = asked.select("question_id", F.explode(pairs(F.col("seq"))).alias("pair"))
    sums = weights.groupBy("question_id").agg(F.sum("w").alias("all"))
    half = weights.select("term", "w").distinct().select("term", (F.col("w") / 2).alias("half"))
    worth = asked_pairs.select("pair").distinct().select("pair", F.explode(F.split("pair", " ")).alias("term")).join(half, "term").groupBy("pair").agg(F.sum("half").alias("half"))
    none = F.lit(None).cast("double")
    says = weights.select("term", "question_id", "w", none.alias("half")).unionByName(asked_pairs.join(worth, "pair").select(F.col("pair").alias("term"), "question_id", none.alias("w"), "half"))
    met = held.join(_few(says), "term")
    met = met.groupBy("question_id", "node_id").agg(F.sum(F.col("w") * F.col("worth")).alias("base"), F.sum("half").alias("phrase")).where("base is not null")
    return met.join(_few(sums), "question_id").select("question_id", "node_id", _score(F.col("base"), F.coalesce("phrase", F.lit(0.0)), F.col("all")).alias("score"))


def _sums_of_outlines(asked: DataFrame, held: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """by, question_id, node_id, score: each node, one row, meets all questions of its outline at once, and adds up what it shares with each."""
    # sets, as a question may come twice
    of = F.map_from_entries(F.array_sort(F.collect_set(F.struct("term", "w"))))
    asked_pairs = asked.groupBy(*by, "question_id").agg(F.array_distinct(F.flatten(F.collect_list(pairs(F.col("seq"))))).alias("pairs"))
    says = weights.groupBy(*by, "question_id").agg(of.alias("w")).join(_met(asked_pairs), [*by, "question_id"])
    all_weights = F.aggregate(F.map_values("w"), F.lit(0.0), lambda a, w: a + w)
    half = lambda p: F.aggregate(F.split(p, " "), F.lit(0.0), lambda a, t: a + F.try_element_at("w", t) / 2)
    two = F.map_from_entries(F.transform("pairs", lambda p: F.struct(p, half(p))))
    says = says.select(*by, F.struct("question_id", all_weights.alias("all"), F.map_concat("w", two).alias("worth")).alias("q")).groupBy(*by).agg(F.collect_list("q").alias("q"))
    rows = held.join(_met(says), by).select(*by, "node_id", "has", F.inline("q"))
    found = F.filter(F.transform("has", lambda h: F.struct(h.worth.alias("worth"), F.try_element_at("worth", h.term).alias("w"))), lambda h: h.w.isNotNull())
    rows = rows.select(*by, "question_id", "node_id", "all", found.alias("found")).where(F.exists("found", lambda h: h.worth.isNotNull()))
    base = F.aggregate("found", F.lit(0.0), lambda a, h: a + F.coalesce(h.w * h.worth, F.lit(0.0)))
    phrase = F.aggregate("found", F.lit(0.0), lambda a, h: a + F.when(h.worth.isNull(), h.w).otherwise(0.0))
    return rows.select(*by, "question_id", "node_id", _score(base, phrase, F.col("all")).alias("score"))


def rank_nodes(questions: DataFrame, nodes: DataFrame, outline: tuple[str, ...] = (), weighed: Weighed | None = None) -> DataFrame:
    """question_id, node_id, score, rank (and the outline's columns) for questions (question_id, text) and nodes (node_id, title, keys, summary, lo, hi; keys is text).

    Terms weigh more the fewer nodes have them, figures less. With `outline` (columns that both have, such as doc_id) a question is asked of the
    nodes of its own outline only, and terms are weighed there; without, all nodes are one outline. A node has one row. Questions meet nodes through
    equal terms and pairs of terms, never all with all, and what they share is added up in one pass over the nodes. Kept are nodes with LEAST_SHARE
    of the question's best score, told before any are put in order; narrow ones come first, then those that start earlier. weighed: weigh() of the
    same, if something else needs it too.
    """
    by = list(outline)
    # questions of all documents are never broadcast, though the file that they are made of is small
    meet = _met if by else _few
    asked, held, weights_of = weighed or weigh(questions, nodes, outline)
    scored = materialize(_sums_of_outlines(asked, held, weights_of, by) if by else _sums(asked, held, weights_of))
    best = scored.groupBy(*by, "question_id").agg(F.max("score").alias("best")).where("best > 0")
    kept = scored.join(meet(best), [*by, "question_id"]).where(F.col("score") >= F.col("best") * LEAST_SHARE)
    kept = kept.join(nodes.select(*by, "node_id", "lo", "hi"), [*by, "node_id"])
    order = Window.partitionBy(*by, "question_id").orderBy(F.desc(F.round(F.col("score") / F.sqrt(F.col("hi") - F.col("lo") + 1), 9)), "lo", "node_id")
    return kept.select(*by, "question_id", "node_id", F.round("score", 6).alias("score"), F.row_number().over(order).alias("rank"))


def windows_left(pages: DataFrame, done: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """doc_id, first, last: runs of at most `most` pages (doc_id, page) that are not done, in reading order."""
    left = pages.select("doc_id", "page").distinct().join(done.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    order = Window.partitionBy("doc_id").orderBy("page")
    island = left.select("doc_id", "page", (F.col("page") - F.row_number().over(order)).alias("island"))
    turn = F.floor((F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("page")) - 1) / most)
    return island.withColumn("turn", turn).groupBy("doc_id", "island", "turn").agg(F.min("page").alias("first"), F.max("page").alias("last")).select("doc_id", "first", "last")


def front_windows(pages: DataFrame, done: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """doc_id, first, last: from the front, windows of `most` pages whose first page is not done."""
    last = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    firsts = last.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(most).cast("long"))).alias("first"))
    firsts = firsts.join(done.select("doc_id", F.col("page").alias("first")).distinct(), ["doc_id", "first"], "left_anti")
    return firsts.select("doc_id", "first", F.least("n", F.col("first") + most - 1).alias("last"))
