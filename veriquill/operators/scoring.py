"""Scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def verdicts(labels: DataFrame, group: int = 10) -> DataFrame:
    """q, rank, v: labelled documents as ranked verdicts, ten for each question."""
    return labels.select(F.floor(F.col("doc_id") / group).alias("q"), (F.col("doc_id") % group).alias("rank"), F.col("quality").cast("long").alias("v"))


def context_precision(verdicts: DataFrame) -> DataFrame:
    """q, score: average precision over ranked verdicts, 0 if none is true."""
    order = Window.partitionBy("q").orderBy("rank")
    at = verdicts.select("q", "v", F.sum("v").over(order).alias("hits"), F.row_number().over(order).alias("k"))
    return at.groupBy("q").agg(F.round(F.sum(F.col("v") * F.col("hits") / F.col("k")) / (F.sum("v") + 1e-10), 4).alias("score"))


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """q, n, score: share of true verdicts."""
    return verdicts.groupBy("q").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("score"))


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def relevancy(vectors: DataFrame, generated: int = 3) -> DataFrame:
    """q, score: mean cosine of a question and its generated ones, 0 if all of those are noncommittal.

    The vectors of four consecutive ids are a question and three generated; label 0 stands for noncommittal.
    """
    rows = vectors.select(F.floor(F.col("vec_id") / (generated + 1)).alias("q"), (F.col("vec_id") % (generated + 1)).alias("k"), "embedding", (F.col("label") == 0).alias("none"))
    asked = rows.where("k = 0").select("q", F.col("embedding").alias("question"))
    both = rows.where("k > 0").join(asked, "q").select("q", "none", cosine("embedding", "question").alias("c"))
    return both.groupBy("q").agg(F.round(F.avg("c") * F.when(F.min("none"), 0).otherwise(1), 4).alias("score"))


def status(scores: DataFrame, expected: int = 3) -> DataFrame:
    """done if all expected metrics have a value, partial if any has, else failed."""
    n = F.count("score")
    return scores.groupBy("q").agg(n.alias("n_ok"), F.when(n >= expected, "done").when(n > 0, "partial").otherwise("failed").alias("status"))
