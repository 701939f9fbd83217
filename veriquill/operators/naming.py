"""Names of files that no two of a table share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.display import LONGEST_NAME, stem_of
from ..sources.shared import drop_table, materialize

ENDING = ".pdf"


def unique_names(files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """id, storage_name for files (id, name) in order of id: the name's stem and .pdf, with _2, _3, ... if an earlier file has it in any capitals.

    taken: name of names that are in use already. Files of one stem take numbers in order, so only names of different stems can meet (a_2 and the
    second a); then the earlier file keeps the name, and the other stem's files, from the one that lost it on, skip that number. That is done in
    rounds until no two meet; a name once lost stays lost, so the rounds end with what handing out names one by one gives. Null names are those of no text; files of
    one id are told apart by nothing: ids have to be unique.
    """
    stems = files.select("id", stem_of(F.col("name")).alias("stem")).withColumn("group", F.lower("stem"))
    # a stem's files are counted by ranges of ids, so that a common one is not counted in one task
    ranged = stems.repartitionByRange("group", "id").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part", "group").orderBy("id"))))
    sizes = ranged.groupBy("group", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = materialize(ranged.join(before.drop("n"), ["group", "part"]).select("id", "stem", "group", (F.col("rank") + F.col("before")).alias("place")))
    held = None if taken is None else taken.select(F.lower("name").alias("known")).distinct()
    lost = None if held is None else materialize(_numbers_taken(held, rows.select("group").distinct()))
    while True:
        numbered, k = rows, F.col("place")
        if lost is not None:
            # a number is skipped if the file that would have it is not before the first that lost it
            skips = lost.groupBy("group", "k").agg(F.min("first").alias("first")).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("k", "first"))).alias("skips"))
            numbered = rows.join(skips, "group", "left")
            passed = lambda n, s: F.when((s.k - n >= s.first) & (F.col("place") >= s.k - n), n + 1).otherwise(n)
            k = F.col("place") + F.aggregate(F.coalesce("skips", F.array().cast("array<struct<k: bigint, first: bigint>>")), F.lit(0).cast("long"), passed)
        suffix = F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise("")
        name = F.concat(F.substr("stem", F.lit(1), F.when(k > 1, F.lit(LONGEST_NAME - len(ENDING)) - F.length(suffix)).otherwise(F.lit(LONGEST_NAME))), suffix, F.lit(ENDING))
        named = materialize(numbered.select("id", "group", F.col("place").cast("long").alias("place"), k.alias("k"), name.alias("storage_name")))
        owners = named.groupBy(F.lower("storage_name").alias("known")).agg(F.min("id").alias("owner"), F.count("*").alias("claims"))
        meets = owners.where("claims > 1").select("known", "owner")
        if held is not None:
            meets = meets.join(held, "known", "left_anti").unionByName(held.select("known", F.lit(None).cast(named.schema["id"].dataType).alias("owner")))
        losers = named.join(meets, F.lower("storage_name") == F.col("known")).where(F.col("owner").isNull() | (F.col("id") != F.col("owner")))
        new = materialize(losers.select("group", F.col("k").cast("long").alias("k"), F.when(F.col("owner").isNull(), F.lit(0)).otherwise(F.col("place")).cast("long").alias("first")))
        if new.isEmpty():
            return named.select("id", "storage_name")
        drop_table(named)
        lost = new if lost is None else lost.unionByName(new)


def _numbers_taken(held: DataFrame, groups: DataFrame) -> DataFrame:
    """group, k, first (0: for all its files): numbers of stems that names in use have; of stems that are cut for their number, the rounds find out."""
    stem = F.regexp_replace("known", "\\.pdf$", "")
    own = held.select(stem.alias("group"), F.lit(1).cast("long").alias("k"))
    tail = F.regexp_extract(stem, "_([1-9][0-9]{0,8})$", 1)
    numbered = held.where((tail != "") & (tail != "1")).select(F.regexp_replace(stem, "_[0-9]+$", "").alias("group"), tail.cast("long").alias("k"))
    return own.unionByName(numbered).join(groups, "group", "left_semi").select("group", "k", F.lit(0).cast("long").alias("first"))
