"""What is read how often, and how much of it a step carries: plans and counts that keep steps in bounds on large tables."""

import random

import pytest
from pyspark.sql import functions as F

from veriquill.operators import answers, evidence, locate, ranking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_read_once(spark):
    """Terms and pairs of a node come from one reading of its texts, with an outline's columns and without."""
    for by in ((), ("doc_id",)):
        read = spark.sparkContext.accumulator(0)

        def told(text, read=read):
            read.add(1)
            return text

        summary = F.udf(told, "string").asNondeterministic()(F.concat(F.lit("net sales of part "), F.col("id").cast("string")))
        nodes = spark.range(20, 40, numPartitions=2).select(F.lit(1).alias("doc_id"), F.col("id").alias("node_id"), F.lit("Review").alias("title"), F.lit("keys").alias("keys"), summary.alias("summary"), F.lit(1).alias("lo"), F.lit(1).alias("hi"))
        questions = spark.createDataFrame([(1, 1, "net sales of part 27")], "doc_id long, question_id long, text string")
        ranked = ranking.rank_nodes(questions if by else questions.drop("doc_id"), nodes if by else nodes.drop("doc_id"), by).collect()
        assert [r.node_id for r in ranked if r["rank"] == 1] == [27] and len(ranked) == 20
        assert read.value == 20


@pytest.mark.parametrize("few", [0, 500_000])
def test_lost_quotes_are_found_by_shuffle_too(spark, monkeypatch, few):
    """Beyond FEW_GRAMS the k-grams of lost quotes are joined by a shuffle, up to it they are broadcast; both find the same places."""
    monkeypatch.setattr(locate, "FEW_GRAMS", few)
    rng = random.Random(5)
    pages = [(doc, page, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))) for doc in range(4) for page in range(1, 8)]
    cites = [(doc, k, (page + 3) % 7 + 1, " ".join(text.split()[5:15])) for k, (doc, page, text) in enumerate(pages)]
    found = locate.locate(spark.createDataFrame(cites, "doc_id long, cite_id long, page long, quote string"), spark.createDataFrame(pages, "doc_id long, page long, text string")).collect()
    assert sorted((r.doc_id, r.cite_id, r.found_page) for r in found) == [(doc, k, page) for k, (doc, page, _) in enumerate(pages)]
    assert {r.stage for r in found} <= {"near", "document"} and any(r.stage == "document" for r in found)
    far = spark.createDataFrame([(1, 1, "abcdefghijklmnopqrstuvwxyz" * 2)], "row long, doc_id long, q string")
    joined = plan(spark.range(9).select(F.col("id").alias("gram")).join(locate.quote_grams(far), "gram"))
    assert ("BroadcastHashJoin" in joined) == (few > 0)


def test_answers_are_scanned_once(spark):
    """One pass of Python over the answers, though exploding their cites filters them."""
    raw = spark.createDataFrame([(1, 'Sales rose <cite page=1 quote="sales rose"/>.', 3)], "answer_id long, raw string, most_pages long")
    assert plan(answers.cites_of(answers.with_cites(raw))).count("ArrowEvalPython") == 1


def test_words_of_no_quote_are_not_shuffled(spark, monkeypatch):
    """What texts may hold of quotes adds up where the text is; a document that comes twice gives the same windows."""
    kept = []
    monkeypatch.setattr(evidence, "materialize", lambda df: kept.append(df) or df)
    texts = spark.createDataFrame([(1, "filler words then alpha beta gamma delta stand here"), (1, "other filler"), (2, "alpha alone")], "doc_id long, text string")
    quotes = spark.createDataFrame([("q", "alpha beta gamma delta")], "item_id string, text string")
    assert [(r.doc_id, r.pos, r.share) for r in evidence.densest_window(texts, quotes).collect()] == [(1, 6, 1.0)]
    shuffles = [line for df in kept for line in plan(df).splitlines() if "Exchange hashpartitioning" in line and "tok" in line.split("ENSURE")[0]]
    assert len(kept) == 1 and not shuffles
