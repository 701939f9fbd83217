"""Written tables, unique names, imports and statistics against plain Python."""

import base64
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from veriquill.functions import display as D
from veriquill.operators import imports, naming, statistics, stored


def test_stored_table(spark, tmp_path):
    """A write that comes again changes nothing, one that breaks off counts for nothing, two rows of one key are refused."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, x string")
    table = stored.StoredTable(spark, str(tmp_path / "t"), rows.schema, ["k"])
    left = lambda version=None: sorted(map(tuple, table.read(version).collect()), key=repr)
    assert left() == [] and table.upsert(rows, "w1") == 1 and table.upsert(rows.withColumn("x", F.lit("z")), "w1") == 1
    assert left() == [(1, "a"), (2, "b"), (None, "n")]
    assert table.upsert(spark.createDataFrame([(2, "c"), (2, "d"), (3, "e"), (None, "m")], rows.schema), "w2") == 2
    assert left() == [(1, "a"), (2, "d"), (3, "e"), (None, "m")] and left(1) == [(1, "a"), (2, "b"), (None, "n")]
    with pytest.raises(ValueError, match="one key"):
        table.commit(rows.unionByName(rows))
    rows.write.parquet(f"{tmp_path}/t/data/left-behind")
    assert len(table.versions()) == 2 and len(left()) == 4
    table.delete(rows.where("k = 1"), ["k"])
    assert left() == [(2, "d"), (3, "e"), (None, "m")]


def test_stream_into_a_stored_table(spark, tmp_path):
    schema = "k long, x string"
    table = stored.StoredTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["k"])
    for turn, part in enumerate([[(1, "a"), (2, "b")], [(2, "c")], [(3, "d")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # each call goes on from the checkpoint
        stored.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "cp")).awaitTermination(120)
        assert len(table.versions()) == turn + 1
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]


def plain_names(files, taken):
    used, out = {t.lower() for t in taken}, {}
    for i, name in sorted(files):
        base = (name or "").replace("\\", "/").rsplit("/", 1)[-1]
        base = base[:-4] if base.lower().endswith(".pdf") else base
        text = unicodedata.normalize("NFKD", base).encode("ascii", "ignore").decode()
        stem = ""
        for c in text:
            stem += c if c.isascii() and (c.isalnum() or c in "_-") else "" if stem.endswith("\0") else "\0"
        stem = stem.replace("\0", "_").strip("_-")[:76].strip("_-") or "report"
        if stem.lower() in D.RESERVED:
            stem = f"doc_{stem}"
        k, found = 1, f"{stem}.pdf"
        while found.lower() in used:
            k += 1
            found = f"{stem[: 76 - len(f'_{k}')]}_{k}.pdf"
        used.add(found.lower())
        out[i] = found
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    bag = ["a.pdf", "A.PDF", "a_2.pdf", "a_2_2", "a_3", "á", "b/c\\a.pdf", "", None, "con.pdf", "x" * 90, "X" * 74 + "_2", "Résumé année.pdf", "report_2"]
    files = [(i, rng.choice(bag[: 6 + seed * 2])) for i in rng.sample(range(1000), 60)]
    if not seed:
        files = [(1, "a.pdf"), (2, "a.pdf"), (3, "a_2.pdf")]
    taken = ["A_4.pdf", "resume_annee.pdf"] if seed % 2 else []
    df = spark.createDataFrame(files, "id long, name string")
    got = naming.unique_names(df, spark.createDataFrame([(t,) for t in taken], "name string") if taken else None)
    want = plain_names(files, taken)
    assert {r.id: r.storage_name for r in got.collect()} == want and len({v.lower() for v in want.values()}) == len(files)
    if not seed:
        assert list(want.values()) == ["a.pdf", "a_2.pdf", "a_2_2.pdf"]
        assert naming.unique_names(df.limit(0)).count() == 0


def test_queried_names(spark):
    from veriquill.plans.queries import QUERIES

    rows = QUERIES["storage_names"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.storage_name.lower() for r in rows}) == len(rows) > 1000


def test_tool_results_and_choices(spark):
    item = lambda x: {"type": "text", "text": x}
    cases = [('{"a": 1}', None), (json.dumps('{"a": 1}'), {"a": 1}), (json.dumps(item('{"a": 2}')), {"a": 2}), (json.dumps([item('{"a":'), "3}", 7]), {"a": 3}), (json.dumps([[1]]), None), ("no json", None), (None, None), (json.dumps(item("[1]")), None)]
    df = spark.createDataFrame([(i, o) for i, (o, _) in enumerate(cases)], "i int, o string").select("i", F.to_json(imports.tool_result(F.col("o"))).alias("v"))
    assert {r.i: r.v and json.loads(r.v) for r in df.collect()} == {i: w for i, (_, w) in enumerate(cases)}
    code = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    heads = [(None, None), ("", None), (code({"provider": "openai", "api_key": "a b"}), ("bad key", None, None)), (code({"provider": "GROQ", "api_key": "ké", "chat_model": "m"}), ("bad key", None, None)), (code({"provider": "xai", "api_key": "k" * 600}), ("bad key", None, None)), ("é*", ("not readable", None, None)), ("x" * 5000, ("too long", None, None)), (code([1]), ("not readable", None, None)), (code({"provider": "custom", "chat_model": " m "}), (None, "custom", "m")), (code({}), ("unknown provider", None, None))]
    got = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(heads)], "i int, h string").select("i", imports.model_choice(F.col("h")).alias("c")).collect()
    assert {r.i: r.c and tuple(r.c) for r in got} == {i: w for i, (_, w) in enumerate(heads)}


def test_statistics(spark):
    nan = float("nan")
    steps = spark.createDataFrame([("a", 0.0, 10.0), ("b", 5.0, 5.0), ("c", 9.0, 3.0), ("d", None, 3.0), ("e", 100.0, 200.0), ("f", -50.0, 500.0)], "step string, lo double, hi double")
    samples = spark.createDataFrame([(0.0, 1, 4.0), (5.0, 2, nan), (5.0, 3, 2.0), (10.0, 4, 9.0), (10.5, 5, 99.0), (None, 6, 1.0)], "t double, id int, value double")
    got = {r.step: r for r in statistics.interval_statistics(steps, samples).collect()}
    assert (got["a"].peak, got["a"].last, got["a"].n) == (9.0, 9.0, 4) and got["a"].mean != got["a"].mean
    assert (got["b"].peak, got["b"].last, got["b"].n) == (2.0, 2.0, 2) and [got[s].n for s in "cde"] == [0, 0, 0] and got["f"].n == 5 and got["e"].peak is None
    rng = random.Random(1)
    values = [rng.choice([1.0, 2.0, rng.random()]) for _ in range(501)]
    out = statistics.order_statistics(spark.createDataFrame([(v,) for v in [*values, None]], "value double").repartition(4), (0, 0.05, 0.5, 0.95, 1))
    assert {r.share: (r.n, r.value) for r in out.collect()} == {s: (501, sorted(values)[min(500, int(s * 501))]) for s in (0, 0.05, 0.5, 0.95, 1)}
    assert statistics.order_statistics(spark.createDataFrame([], "value double"), (0.5,)).count() == 0


def test_intervals_against_plain_python(spark):
    rng = random.Random(7)
    steps = [(k, lo, lo + rng.choice([0, 1, 2, 3, 7, 8, 9, 64, 1000, 2**20])) for k in range(200) for lo in [rng.randrange(-50, 400)]]
    samples = [(rng.randrange(-60, 420), k, rng.choice([None, *[rng.randrange(100) / 4] * 9])) for k in range(900)]
    got = {r.step: r for r in statistics.interval_statistics(spark.createDataFrame(steps, "step int, lo long, hi long"), spark.createDataFrame(samples, "t long, id int, value double")).collect()}
    for step, lo, hi in steps:
        inside = sorted((t, k, v) for t, k, v in samples if lo <= t <= hi)
        told = [v for *_, v in inside if v is not None]
        r = got[step]
        assert (r.n, r.peak, r.last) == (len(inside), max(told, default=None), inside[-1][2] if inside else None)
        assert r.mean == pytest.approx(sum(told) / len(told)) if told else r.mean is None


def test_steps_do_not_meet_many_samples(spark):
    """Only steps with few samples around meet them one by one; the others are read at their ends."""
    spread = spark.createDataFrame([(1, 8.0, 0), (1, 8.0, 1), (2, 8.0, 1), (3, 8.0, 2)], "step int, width double, bin long")
    bins = spark.createDataFrame([(8.0, 0, 1), (8.0, 1, statistics.FEW)], "width double, bin long, n long")
    assert [r.step for r in statistics.few_near(spread, bins).collect()] == [2]
    steps, samples = spark.range(300).selectExpr("id AS step", "0L AS lo", "1000L AS hi"), spark.range(20000).selectExpr("id % 1000 AS t", "id", "1.0D AS value")
    assert {(r.n, r.mean, r.peak) for r in statistics.interval_statistics(steps, samples).collect()} == {(20000, 1.0, 1.0)}
