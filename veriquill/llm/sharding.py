"""Sharding with a hierarchical weighted hash tree, in DataFrame operations.

A document goes down a tree of regions, racks and shards. At each node every child draws a waiting time, exponential with the child's weight as
its rate, from a hash of the document's key and the child's name; the shortest wins. A node's weight is the sum of its shards'. Draws of
children whose weight stays do not change, so a new weight moves documents only into or out of the subtrees that have it: the shares of
others stay with each other. `layout` gives each shard beyond the first BASE a region of its own, so that one more shard takes documents into
itself and moves none between the others.

`write_shards` writes whole rows, sorted by shard and id, as one folder a shard; a row's slot is its place in its shard and follows from the
file it is in and its number there, so no rows are numbered in one task.

Defined results: a document's key is its id, so copies of a text with different ids fall apart and rows of one id stay together; a row without
an id has its text as key. Null texts are empty. Rows of one id and shard are ordered by a hash of their text; equal rows have slots of their
own. No documents give no rows. All columns of docs are kept, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .spark_io import materialize, shared_dir

BASE = 8
#: Files of all shards up to which their offsets are broadcast; beyond, narrow rows are joined by a shuffle.
FEW_FILES = 100_000
_HEX, _STEPS = 12, float(1 << 48)


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(n: int, base: int = BASE) -> list[Shard]:
    """n shards of equal weight: two regions of two racks for the first `base`, a region of its own for each further one."""
    if n < base:
        raise ValueError(f"{n} shards, {base} at least")
    first = [Shard(f"r{s % 2}", f"k{s // 2 % 2}", s) for s in range(base)]
    return first + [Shard(f"r{s}", "k0", s) for s in range(base, n)]


def _children(shards: list[Shard]) -> list[dict[str, dict[str, float]]]:
    """For each level: the children of every node, by full name, with their weights."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in shards:
        names = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
        if not s.weight > 0:
            raise ValueError(f"no weight: {s}")
        for level, (parent, child) in enumerate(zip(names[:-1], names[1:], strict=True)):
            kids = levels[level].setdefault(parent, {})
            kids[child] = kids.get(child, 0.0) + s.weight
    return levels


def waiting_time(key: Column, child: Column, weight: Column) -> Column:
    """Exponential with rate `weight`; the hash of key and child is the source of chance."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit("@"), child)), 1, _HEX), 16, 10).cast("double")
    return -F.log((digits + 0.5) / _STEPS) / weight


def _shortest(key: Column, node: Column, level: dict[str, dict[str, float]]) -> Column:
    """The child of `node` with the shortest waiting time."""
    kids = F.create_map(*[x for parent, of in level.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in of.items()]))])
    drawn = lambda c: F.struct(waiting_time(key, c["name"], c["weight"]).alias("t"), c["name"].alias("name"))
    # an array of one, so that the parent is worked out once
    draws = F.transform(F.array(node), lambda parent: F.transform(F.element_at(kids, parent), drawn))
    return F.array_min(F.flatten(draws))["name"]


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The shard that a key (text) falls to."""
    node = F.lit("")
    for level in _children(shards):
        node = _shortest(key, node, level)
    return F.substring_index(node, "/", -1).cast("int")


def write_shards(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None) -> str:
    """Write the rows of docs (doc_id, text and others) to a new folder in the shared one, and say where; grown_shard is the shard in a grown tree."""
    names = docs.columns
    text, id_ = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    key = F.when(id_.isNull(), F.concat(F.lit("text "), F.md5(text))).otherwise(F.concat(F.lit("id "), id_))
    later = shard_of(key, grown) if grown else F.lit(None).cast("int")
    rows = docs.select(F.struct(*names).alias("doc"), later.alias("grown_shard"), shard_of(key, shards).alias("shard"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("salt"))
    path = shared_dir(docs.sparkSession)
    rows.orderBy("shard", "doc.doc_id", "th", "salt").select("doc", "grown_shard", "shard").write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """doc (a struct with the columns of the documents' schema), grown_shard, shard and slot of what write_shards() wrote."""
    stored = StructType([StructField("doc", schema), StructField("grown_shard", IntegerType()), StructField("shard", IntegerType())])
    rows = spark.read.schema(stored).parquet(path).select("doc", "grown_shard", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    task = F.regexp_extract("file", "part-([0-9]+)-", 1).cast("long")
    sizes = materialize(rows.groupBy("shard", "file").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("shard").orderBy(task, "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    starts = F.broadcast(starts) if sizes.count() <= FEW_FILES else starts
    return rows.join(starts, "file").select("doc", "grown_shard", "shard", (F.col("before") + F.col("place")).alias("slot"))


def shard_documents(docs: DataFrame, n: int = BASE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs in n shards, read back from their files."""
    path = write_shards(docs, layout(n), layout(n + 1))
    rows = read_shards(docs.sparkSession, path, docs.schema)
    data = F.encode(F.coalesce("doc.text", F.lit("")), "UTF-8")
    return rows.select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
