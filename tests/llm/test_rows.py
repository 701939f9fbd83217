"""Rows without an id, and texts of a repeated id, stand or go each for itself."""

import random

import pytest

from veriquill.llm import decontaminate, near_dedup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    return lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_bad_rows_leave_their_namesakes(spark, prose):
    a, b = prose(40), prose(40)
    docs = frame(spark, [(None, "too short"), (None, a), (7, "short too"), (7, b), (8, None), (None, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert left(quality.keep_good(docs, labels)) == sorted([(None, a), (7, b)], key=repr)


def test_contaminated_rows_leave_their_namesakes(spark, prose):
    a, b, item = prose(40), prose(40), prose(12)
    docs = frame(spark, [(None, f"{prose(5)} {item}"), (None, a), (7, f"{item} {prose(5)}"), (7, b), (None, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert left(decontaminate.clean(docs, bench)) == sorted([(None, a), (7, b), (None, None)], key=repr)


def test_near_duplicates_without_ids(spark, prose):
    base = prose(200).split()
    drift = lambda k: " ".join([*["x%d" % i for i in range(k)], *base[k:]])
    # 1 and 3 are linked through the row without an id only
    chain = [(1, drift(0)), (None, drift(20)), (3, drift(40))]
    alone, copied, other, single = prose(50), prose(50), prose(50), prose(50)
    rows = [*chain, (None, alone), (None, alone), (None, alone.upper()), (4, copied), (None, copied), (5, other), (5, single), (6, single), (None, " "), (None, " "), (None, None)]
    got = sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).select("doc_id", "component_id", "kept").collect()), key=repr)
    want = [(1, 1, True), (None, 1, False), (3, 1, False), *[(None, None, True)] * 3, (4, 4, True), (None, 4, False), (5, 5, True), (5, 5, True), (6, 5, False), *[(None, None, True)] * 3]
    assert got == sorted(want, key=repr)
    kept = left(near_dedup.keep_one(frame(spark, rows)))
    assert [r for r in kept if r[1] and r[1].lower() == alone] in ([(None, alone)], [(None, alone.upper())])
    assert [r for r in kept if not r[1] or r[1].lower() != alone] == sorted([(1, drift(0)), (4, copied), (5, other), (5, single), (None, " "), (None, " "), (None, None)], key=repr)


EXTRA = ("gone_id", "gone_th", "gone", "bad_id", "bad_th", "bad_lang", "dirty_id", "row", "row_id", "group", "id", "a", "b", "at", "n", "leaf", "node", "key", "kept", "words", "contaminated", "stratum", "hit_id")


def test_other_columns_stay_whatever_their_names(spark, prose):
    """Stages keep columns that have the names of their own helpers, and empty tables stay empty."""
    from pyspark.sql import functions as F

    from veriquill.llm import line_templates

    item, common = prose(12), prose(60)
    texts = [f"{prose(30)}\n{common}", f"{prose(30)}\n{common}", f"{prose(20)} {item}", "short", prose(40), None]
    docs = frame(spark, list(enumerate(texts))).select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in EXTRA])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    stages = {
        (0, 1, 2, 4): lambda d: quality.keep_good(d, labels),
        (0, 1, 2, 3, 4, 5): line_templates.dedup_lines,
        (0, 1, 3, 4, 5): lambda d: decontaminate.clean(d, bench),
        (0, 1, 2, 3, 4, None): lambda d: near_dedup.keep_one(d.withColumn("doc_id", F.when(F.col("doc_id") < 5, F.col("doc_id")))),
    }
    for ids, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert sorted((r.doc_id for r in rows), key=repr) == sorted(ids, key=repr)
        assert all(r[c] == f"{c} {5 if r.doc_id is None else r.doc_id}" for r in rows for c in EXTRA)
        assert stage(docs.limit(0)).count() == 0


def test_shared_folder_is_needed_on_a_cluster():
    from veriquill.llm.spark_io import shared_dir

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
