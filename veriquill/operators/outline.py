"""Outlines of documents: trees in JSON, flattened in reading order, pruned, and the newest of several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import materialize

# Fixed value: headings that say nothing about a document.
PLAIN_TITLES = ("preface", "contents", "cover", "untitled", "document")
LONGEST_TITLE, LEAST_TITLE = 200, 3
INTRO = "(intro)"


def newest(trees: DataFrame, key: str = "session_id") -> DataFrame:
    """key, tree of the row (key, created_at, tree) with the greatest created_at as text; the first by tree of equal ones."""
    stamp = F.coalesce("created_at", F.lit(""))
    return trees.groupBy(key).agg(F.max_by("tree", F.struct(stamp, F.coalesce("tree", F.lit("")))).alias("tree"))


def _children(level: DataFrame, nodes: Column) -> DataFrame:
    """A row for each object among the nodes of a level; what is no object has no place."""
    rows = level.select("doc_id", F.col("place").alias("above"), F.col("path").alias("way"), F.posexplode(F.try_variant_get(nodes, "$", "array<variant>")).alias("at", "node"))
    rows = rows.where(F.schema_of_variant("node").startswith("OBJECT"))
    title = F.trim(F.coalesce(F.try_variant_get("node", "$.title", "string"), F.lit("")))
    whole = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get("node", f, "variant")) == "BIGINT", F.lit(False))
    return rows.select(
        "doc_id",
        F.concat("above", F.array(F.col("at"))).alias("place"),
        F.when(title == "", F.col("way")).otherwise(F.concat("way", F.array(title))).alias("path"),
        F.when(title != "", title).alias("title"),
        F.try_variant_get("node", "$.node_id", "string").alias("node_id"),
        F.try_variant_get("node", "$.start_index", "bigint").alias("lo"),
        F.try_variant_get("node", "$.end_index", "bigint").alias("hi"),
        (whole("$.start_index") & whole("$.end_index")).alias("exact"),
        F.try_variant_get("node", "$.summary", "string").alias("summary"),
        F.try_variant_get("node", "$.key_items", "array<string>").alias("keys"),
        F.try_variant_get("node", "$.nodes", "variant").alias("nodes"),
    )


def flatten(trees: DataFrame) -> DataFrame:
    """doc_id, place, depth, path, title, node_id, lo, hi, exact, summary, keys: the nodes of each document's tree (doc_id, tree: JSON).

    place holds a node's numbers among its siblings from the root on, so that order by place is preorder; path the titles on the way, without
    empty ones, an introduction ("X (intro)" under X) without its own; exact whether both ends are whole numbers in JSON. The tree is taken
    apart level by level, for as many levels as the deepest has. Text that is no JSON, or no list, has no nodes; nodes that are no objects
    are left out with what is in them; others stay whatever their range.
    """
    level = trees.select("doc_id", F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("path"), F.try_parse_json("tree").alias("nodes"))
    levels = []
    while not levels or not levels[-1].isEmpty():
        level = materialize(_children(level, F.col("nodes")))
        levels.append(level)
    rows = reduce(DataFrame.unionByName, levels).drop("nodes")
    last, above = F.lower(F.element_at("path", -1)), F.lower(F.get("path", F.size("path") - 2))
    own = (F.size("path") > 1) & F.endswith(last, F.lit(INTRO)) & (F.trim(F.substr(last, F.lit(1), F.length(last) - len(INTRO))) == above)
    path = F.when(own, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path"))
    return rows.withColumn("path", path).withColumn("depth", F.size("place") - 1)


def ranked_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes that questions are asked of, as ranking.rank_nodes() takes them: those with whole numbers 1 <= lo <= hi."""
    kept = nodes.where(F.col("exact") & (F.col("lo") >= 1) & (F.col("hi") >= F.col("lo")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return kept.select("doc_id", F.col("place").alias("node_id"), empty("title").alias("title"), empty(F.array_join("keys", " ")).alias("keys"), empty("summary").alias("summary"), "lo", "hi")


def page_relevance(ranked: DataFrame, nodes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, page, relevance: the score of the best ranked node over each page, as a share of the best one's."""
    best = F.max("score").over(Window.partitionBy(*by))
    shares = ranked.withColumn("share", F.col("score") / best).join(nodes.select("doc_id", "node_id", "lo", "hi"), ["doc_id", "node_id"])
    return shares.select(*by, F.explode(F.sequence("lo", "hi")).alias("page"), "share").groupBy(*by, "page").agg(F.max("share").alias("relevance"))


def prune(nodes: DataFrame) -> DataFrame:
    """doc_id, place, parent, title, node_id, start_index, end_index: a flattened tree with what a reader is shown only; parent is the place one level up."""
    return nodes.select("doc_id", "place", F.slice("place", F.lit(1), F.size("place") - 1).alias("parent"), "title", "node_id", F.col("lo").alias("start_index"), F.col("hi").alias("end_index"))


def document_title(own: Column, file_name: Column, headings: Column) -> Column:
    """A document's own title if it says something, else its file's name without ending, else the first heading that says something."""
    says = lambda t: (F.length(F.trim(t)) >= LEAST_TITLE) & ~F.lower(F.trim(t)).isin(*PLAIN_TITLES)
    base = F.regexp_replace(F.regexp_extract(F.coalesce(file_name, F.lit("")), "([^\\\\/]*)$", 1), "(?<=.)\\.[^.]*$", "")
    stem = F.trim(F.regexp_replace(F.translate(base, "_-", "  "), "\\s+", " "))
    heading = F.get(F.filter(headings, lambda h: (F.trim(h) != "") & ~F.lower(F.trim(h)).isin(*PLAIN_TITLES)), F.lit(0))
    return F.substring(F.coalesce(F.when(says(own), F.trim(own)), F.when(stem != "", stem), F.trim(heading)), 1, LONGEST_TITLE)
