"""Tables that are written: each write is a version of its own, which counts once a manifest, a Parquet table that Spark commits, names it."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, write_id string, path string, n_rows long"


class StoredTable:
    """A table in a folder that driver and executors share, for one writer at a time.

    A write that a lost task or driver breaks off leaves data that no manifest names. A write with the id of one before it is that write and is
    not done again, so a batch that is repeated changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: list[str]):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException:
            # there was no write yet
            return self.spark.createDataFrame([], MANIFEST)

    def versions(self) -> list:
        return self._manifest().orderBy("version").collect()

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or one before it; no rows before the first write."""
        known = [v for v in self.versions() if version is None or v.version <= version]
        return self.spark.read.schema(self.schema).parquet(known[-1].path) if known else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, write_id: str | None = None) -> int:
        """Write rows as the next version, read them back, and name them; the version's number."""
        known, write_id = self.versions(), write_id or uuid.uuid4().hex
        done = [v.version for v in known if v.write_id == write_id]
        if done:
            return done[0]
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(path)
        back = self.spark.read.schema(self.schema).parquet(path)
        twice = back.groupBy(*self.key).count().where("count > 1").limit(1).count()
        if twice:
            raise ValueError(f"two rows of one key ({', '.join(self.key)})")
        version = known[-1].version + 1 if known else 1
        self.spark.createDataFrame([(version, write_id, path, back.count())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return version

    def upsert(self, rows: DataFrame, write_id: str | None = None) -> int:
        """Rows in place of those with their key, and new ones; the last by the columns' order of several with one key."""
        last = Window.partitionBy(*self.key).orderBy(*[F.desc(c) for c in self.schema.names])
        new = rows.select(*self.schema.names).withColumn("_turn", F.row_number().over(last)).where("_turn = 1").drop("_turn")
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in self.key]
        old = self.read()
        keys = new.select(*self.key)
        return self.commit(old.join(keys, same(old, keys), "left_anti").unionByName(new), write_id)

    def delete(self, keys: DataFrame, on: list[str], write_id: str | None = None) -> int:
        """Rows go whose columns `on` are among keys: whole sessions by their id, for example."""
        return self.commit(self.read().join(keys.select(*on).distinct(), on, "left_anti"), write_id)


def upsert_stream(stream: DataFrame, table: StoredTable, checkpoint: str):
    """Upsert each batch of a stream, once each: a batch that comes again after a failure has the same id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, f"{checkpoint}#{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
