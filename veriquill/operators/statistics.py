"""Statistics over intervals, and exact order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import materialize

#: Up to so many samples in its bins, a step's mean is added up sample by sample.
FEW = 4096


def few_near(spread: DataFrame, bins: DataFrame) -> DataFrame:
    """spread (step, width, bin) of the steps whose bins (width, bin, n) hold FEW samples together at most."""
    near = spread.join(bins.select("width", "bin", "n"), ["width", "bin"]).groupBy("step").agg(F.sum("n").alias("near"))
    return spread.join(near.where(F.col("near") <= FEW).select("step"), "step")


def interval_statistics(steps: DataFrame, samples: DataFrame, width: float | None = None) -> DataFrame:
    """step, peak, mean, last, n for steps (step, lo, hi) and samples (t, id, value; t, lo and hi as numbers): what was sampled in each, both ends included.

    A step is read at its two ends, not at each sample in it. Its bins are as wide as the greatest power of two up to its length (or `width`, if
    that is less), so it takes the rest of its first bin, the beginning of its last one and the whole bins between: running sums within bins, and
    sums of bins. Samples of equal times are summed first and come once for each width that steps have. NaN takes no part in the peak but in
    the mean; last is the latest sample of an interval, by id of equal times. Steps without a sample have n = 0; steps that end before they
    begin, or without an end, too. Where a step's bins hold FEW samples at most, its mean is the plain one, added up by time and id.
    """
    size = F.col("hi").cast("double") - F.col("lo")
    power = F.pow(F.lit(2.0), F.floor(F.log2(size)))
    # a logarithm may be rounded across a whole number
    power = F.when(power > size, power / 2).when(power * 2 <= size, power * 2).otherwise(power)
    wide = power if width is None else F.least(power, F.lit(float(width)))
    whole = materialize(steps.where("lo <= hi").select("step", "lo", "hi", F.when(size > 0, wide).otherwise(0.0).alias("width")))
    known = F.max(F.when(~F.isnan("value"), F.col("value"))).alias("peak")
    sums = [known, F.sum("value").alias("sum"), F.count("value").alias("told"), F.max_by("value", "id").alias("last"), F.count("*").alias("n")]
    times = materialize(samples.where("t is not null").groupBy("t").agg(*sums))
    parts = ["step", "t", "peak", "sum", "told", "last", "n"]
    # a step without length is one time
    found = whole.where("width = 0").join(times, F.col("lo") == F.col("t")).select(*parts)
    long = whole.where("width > 0")
    bin_of = lambda c: F.floor(F.col(c) / F.col("width"))
    by_width = lambda rows: rows.crossJoin(F.broadcast(long.select("width").distinct())).withColumn("bin", bin_of("t"))
    held = by_width(times)
    for end in ("lo", "hi"):
        # ends lie among the samples of their bin, lo before equal times and hi behind them; sums run up to them from the bin's other side
        marks = long.select("width", bin_of(end).alias("bin"), F.col(end).alias("at"), F.lit(-1 if end == "lo" else 1).alias("kind"), "step")
        rows = held.withColumn("at", F.col("t")).withColumn("kind", F.lit(0)).unionByName(marks, allowMissingColumns=True)
        order = [F.desc("at"), F.desc("kind")] if end == "lo" else ["at", "kind"]
        upto = Window.partitionBy("width", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        latest = (F.first if end == "lo" else F.last)(F.when(F.col("kind") == 0, F.struct("t", "last")), ignorenulls=True).over(upto)
        run = rows.select("step", F.max("peak").over(upto).alias("peak"), *[F.sum(c).over(upto).alias(c) for c in ("sum", "told", "n")], latest.alias("latest"))
        found = found.unionByName(run.where("step is not null").select("step", "latest.t", "peak", "sum", "told", "latest.last", "n"))
    bins = held.groupBy("width", "bin").agg(F.max("t").alias("t"), F.max("peak").alias("peak"), F.sum("sum").alias("sum"), F.sum("told").alias("told"), F.max_by("last", "t").alias("last"), F.sum("n").alias("n"))
    between = long.where(bin_of("hi") - bin_of("lo") > 1).select("step", "width", F.explode(F.sequence(bin_of("lo") + 1, bin_of("hi") - 1)).alias("bin"))
    found = found.unionByName(between.join(bins, ["width", "bin"]).select(*parts))
    mean = F.when(F.sum("told") > 0, F.sum("sum") / F.sum("told"))
    found = found.groupBy("step").agg(F.max("peak").alias("peak"), mean.alias("mean"), F.max_by("last", "t").alias("last"), F.sum("n").alias("n"))
    few = few_near(long.select("step", "lo", "hi", "width", F.explode(F.sequence(bin_of("lo"), bin_of("hi"))).alias("bin")), bins)
    inside = by_width(samples.where("t is not null and value is not null").select("t", "id", "value")).join(few, ["width", "bin"]).where(F.col("t").between(F.col("lo"), F.col("hi")))
    plain = inside.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("t", "id", "value"))).alias("v"))
    plain = plain.select("step", (F.aggregate("v", F.lit(0.0), lambda a, x: a + x.value) / F.size("v")).alias("plain"))
    found = found.join(plain, "step", "left").withColumn("mean", F.coalesce("plain", "mean")).drop("plain")
    return steps.select("step").join(found, "step", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def order_statistics(values: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, n, value: the value at place int(share * n) of all values (value) in order, the last for a share of 1. Nulls take no part.

    Values are counted, dealt out by ranges and added up range by range, so no task has them all; only the ranges' totals are in one place.
    """
    counts = values.where("value is not null").groupBy("value").agg(F.count("*").alias("c"))
    ranged = materialize(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("c").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"), F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("value")) + F.col("before")
    placed = ranged.join(F.broadcast(totals), "part").withColumn("upto", upto)
    at = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.least(F.floor(F.lit(float(s)) * F.col("n")), F.col("n") - 1).alias("place")) for s in shares])
    return placed.select("value", "c", "upto", "n", F.inline(at)).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place"))).select("share", "n", "value")
