"""The limiter and its operations against a plain list of events, over tables and as a stream."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from veriquill.plans.queries import QUERIES
from veriquill.sources import tables as S
from veriquill.streaming import limits

SF = "/root/testdata/sf0.001"
DAY = 86_400


def replay(rows, limit=3, seconds=DAY):
    """(event_id, allowed, retry_after) of operations (event_id, user_id, at, op, n): every event is kept and counted anew each time."""
    kept, out = defaultdict(list), []
    for i, user, at, op, n in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        live = sorted(t for t in kept[user] if at - t < seconds * 10**6)
        wait = lambda t: max(1, math.ceil((t + seconds * 10**6 - at) / 10**6))  # noqa: B023, E731
        later = 0
        if op == "refund":
            live = live[: max(0, len(live) - n)]
        elif op == "record":
            live.append(at)
        elif op == "ask":
            later = wait(live[0]) if len(live) >= limit else 0
        elif len(live) + n <= limit:
            live += [at] * n
        else:
            later = seconds if n > limit else wait(live[len(live) + n - limit - 1])
        kept[user] = live
        out.append((i, later == 0, later))
    return sorted(out)


def test_limiter(spark):
    ops = [tuple(r) for r in S.limiter_operations(spark, SF).collect()]
    assert sorted(map(tuple, QUERIES["limiter_operations"](spark, SF).collect())) == replay(ops)
    hits = [(i, u, at, "hit", 1) for i, u, at, *_ in ops]
    assert sorted(map(tuple, QUERIES["rate_limiter"](spark, SF).collect())) == replay(hits)
    assert any(not r[1] for r in replay(ops)) and any(not r[1] for r in replay(hits))


def test_allowance():
    a = limits.Allowance(3, 10)
    s = 10**6
    assert a.use("hit", 0, 2) == 0 and a.use("hit", s, 2) == 9 and a.use("hit", s, 4) == 10 and a.use("ask", s) == 0
    assert a.use("record", 2 * s) == 0 and a.use("ask", 2 * s) == 8 and a.use("record", 3 * s) == 0 and a.use("hit", 3 * s) == 7
    assert a.use("refund", 4 * s, 2) == 0 and a.use("hit", 4 * s) == 0 and a.use("reset", 5 * s) == 0 and a.use("hit", 5 * s, 3) == 0
    assert limits.Allowance(0, 10).use("hit", 0, 99) == 0


def test_limits_as_a_stream(spark, tmp_path):
    ops = S.limiter_operations(spark, SF)
    cuts = sorted(r.at for r in ops.select("at").collect())
    for k, (lo, hi) in enumerate(zip([0, *cuts[333::333]], [*cuts[333::333], cuts[-1] + 1])):
        part = ops.where((F.col("at") >= lo) & (F.col("at") < hi)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limits.limit_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(180)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == replay([tuple(r) for r in ops.collect()])
