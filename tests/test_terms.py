"""Terms, statements, display forms and session rules on literal rows."""

import random

from pyspark.sql import functions as F

from veriquill.functions import display as D, terms as W
from veriquill.operators import sessions, spend


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_terms(spark):
    r = one(
        spark,
        W.terms(F.lit("The Group's reductions reduced 1,588 costs, aren't 3.4")),
        W.content_terms(F.lit("What is the total of operating costs?")),
        W.statements(F.lit("- Sales rose to 5. They fell later on. No.\n\n[[c1]] Sales rose to 5. <cite page=1/>")),
        W.statements(F.lit(" Short. ")),
        W.coverage(F.lit("Costs rose to 1,588 in 2024"), F.lit("the cost was 1588")),
    )
    assert list(r.c0) == ["the", "group", "reduc", "reduc", "1588", "cost", "arent", "3.4"]
    assert list(r.c1) == ["total", "oper", "cost"]
    assert list(r.c2) == ["Sales rose to 5.", "They fell later on."] and list(r.c3) == ["Short."] and abs(r.c4 - 2 / 3) < 1e-9


def test_display(spark):
    r = one(spark, D.byte_size(F.lit(1023)), D.byte_size(F.lit(1536)), D.byte_size(F.lit(200 * 2**20)), D.byte_size(F.lit(None).cast("long")), D.duration(F.lit(850.4)), D.duration(F.lit(4200.0)), D.duration(F.lit(65_000.0)), D.clock(F.lit(65)), D.cost(F.lit(0.0043)), D.cost(F.lit(0.0434)), D.slug(F.lit("C:\\a\\Ännual Report (2024).PDF")), D.slug(F.lit("con.pdf")), D.slug(F.lit(None)), D.mib(F.lit("1.5GiB")), D.score(F.lit("1.7")), D.score(F.lit("nan")))
    assert list(r)[:13] == ["1023 B", "1.5 KB", "200 MB", "", "850 ms", "4.2 s", "1 min 05 s", "1:05", "~$0.0043", "~$0.043", "Annual_Report_2024.pdf", "doc_con.pdf", "report.pdf"]
    assert (r.c13, r.c14, r.c15) == (1536.0, 1.0, None)


def test_fixed_rounds_the_exact_double(spark):
    rng = random.Random(5)
    values = [0.25, 0.75, 0.125, 2.675, 1.005, 0.15, 0.35, 1e6 + 0.25, 123456.75, 0.0, 0.00005, *[rng.randrange(1 << 20) / 1024 for _ in range(300)], *[rng.random() * 10 ** rng.randrange(-4, 6) for _ in range(300)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[D.fixed(F.col("v"), p).alias(f"p{p}") for p in (0, 1, 3, 4)])
    assert all(r[f"p{p}"] == f"{r.v:.{p}f}" for r in rows.collect() for p in (0, 1, 3, 4))


def test_byte_size_in_the_largest_unit(spark):
    n = F.lit(3 * 2**30)
    assert list(one(spark, D.byte_size(n), D.byte_size(n, "MB"), D.byte_size(n, "KB"), D.byte_size(F.lit(256), "MB"), D.byte_size(F.lit(1280), "MB"))) == ["3.0 GB", "3072 MB", "3145728 KB", "256 B", "1.2 KB"]


def test_charges_are_not_rounded(spark):
    rows = spark.createDataFrame([(1, k, c) for k, c in enumerate((77.38, 62.2, 10.42, 1.0, 1.0))], "user_id long, at long, cost_usd double")
    spent = spark.createDataFrame([(1, 0.0)], "user_id long, spent_usd double")
    # as doubles the first three are 149.99999999999997
    assert [r.charged for r in spend.charge(spent, rows, 150.0).orderBy("at").collect()] == [True, True, True, True, False]


def test_sessions(spark):
    log = spark.createDataFrame([(1, 1, "create", "a"), (1, 2, "touch", None), (1, 3, "rename", "b"), (2, 4, "rename", "x"), (3, 5, "create", "c")], "session_id long, seq long, kind string, title string")
    assert sorted(map(tuple, sessions.fold_sessions(log).collect())) == [(1, "b", 2), (3, "c", 5)]
    assert sessions.next_seq(log).first()[0] == 6 and sessions.next_seq(log.limit(0)).first()[0] == 1
    r = one(spark, sessions.access(F.lit(None), F.lit("v"), F.lit(False)), sessions.access(F.lit("demo"), F.lit("v"), F.lit(True)), sessions.access(F.lit("demo"), F.lit("v"), F.lit(False)), sessions.access(F.lit("w"), F.lit("v"), F.lit(False)), sessions.access(F.lit("w"), F.lit("v"), F.lit(True), private=False))
    assert list(r) == [404, 403, 200, 404, 200]
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y long")
    assert sorted(map(tuple, sessions.update_fields(rows, "k", rows.where("k = 1").select("k", F.lit("z").alias("x")), ("x", "y")).collect())) == [(1, "z", 1), (2, "b", 2)]
    import pytest

    with pytest.raises(ValueError):
        sessions.update_fields(rows, "k", rows.select("k", F.lit(1).alias("q")), ("x",))


def test_markers(spark):
    from veriquill.functions.text import strip_markers

    cases = {"a [[c1]]. b  [[c2]] [[c3]]": "a. b", "  [[c1]]  [[c2]] x": "  x", "x\n\t[[c1]] y [[c12]]\n": "x\n\ty\n", "[[c1]]": "", "no [[c]] [c1]": "no [[c]] [c1]", "": ""}
    r = one(spark, *[strip_markers(F.lit(k)) for k in cases], strip_markers(F.lit(None).cast("string")))
    assert list(r) == [*cases.values(), None]
