"""A stored table cut into buckets by key hash, of which a micro-batch reads and
rewrites only those that it touches.

``<base>/data/batch=<id>/bucket=<b>`` holds a bucket's rows as of a batch,
``<base>/batches/batch=<id>`` lists the buckets that the batch wrote.  A bucket's
newest batch counts.  A batch that runs again overwrites its own folders and reads
those of earlier batches, which stay until the batch after has begun; then files
that newer ones replace are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

_LISTED = StructType([StructField("bucket", IntegerType()), StructField("n", LongType()), StructField("batch", LongType())])


class BucketStore:
    """``buckets``: choose them so that one is some hundred megabytes; fixed for a store's life."""

    def __init__(self, spark: SparkSession, base: str, key: str, buckets: int = 64):
        self.spark, self.base, self.key, self.buckets = spark, base, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        """Buckets of some rows (``buckets`` numbers at most)."""
        return sorted(r[0] for r in df.select(self.bucket().alias("b")).distinct().collect())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def _folders(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, *parts: str) -> None:
        path = self._path(*parts)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def current(self, before: int | None = None) -> dict[int, tuple[int, int]]:
        """Per bucket its newest batch (below ``before``) and its number of rows."""
        listed = [x for x in self._folders("batches") if x.startswith("batch=")]
        if not listed:
            return {}
        rows = self.spark.read.schema(_LISTED).parquet(f"{self.base}/batches")
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        newest = rows.groupBy("bucket").agg(F.max(F.struct("batch", "n")).alias("x")).select("bucket", "x.*")
        return {r["bucket"]: (r["batch"], r["n"]) for r in newest.collect()}

    def read(self, schema: StructType, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of the given buckets (else of all) as the last batch (below ``before``) left
        them; no other bucket's files are opened."""
        now = {b: x for b, x in self.current(before).items() if buckets is None or b in set(buckets)}
        paths = [f"{self.base}/data/batch={batch}/bucket={b}" for b, (batch, n) in sorted(now.items()) if n]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def replace(self, df: DataFrame, buckets: list[int], batch_id: int) -> DataFrame:
        """Makes ``df`` the rows of ``buckets``; the rows as stored.  A bucket that has
        outgrown a task is written by several."""
        at = f"{self.base}/data/batch={batch_id}"
        rows = df.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(at)
        stored = StructType([*df.schema.fields, StructField("bucket", IntegerType())])
        counts = self.spark.read.schema(stored).parquet(at).groupBy("bucket").agg(F.count("*").alias("n"))
        all_ = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        listed = all_.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/batches/batch={batch_id}")
        return self.read(df.schema, buckets, batch_id + 1)

    def clean(self, batch_id: int) -> None:
        """Deletes what batches below ``batch_id`` have replaced (call it as the batch begins:
        the ones before are then done)."""
        now = self.current(batch_id)
        keeps = {batch for batch, _ in now.values()}
        for folder in self._folders("data"):
            batch = int(folder.partition("=")[2]) if folder.startswith("batch=") else batch_id
            if batch >= batch_id:
                continue
            if batch not in keeps:
                self._delete("data", folder)
                self._delete("batches", folder)
                continue
            for part in self._folders("data", folder):
                bucket = int(part.partition("=")[2]) if part.startswith("bucket=") else None
                if bucket is not None and now[bucket][0] != batch:
                    self._delete("data", folder, part)


def rebuild(
    batch: DataFrame, batch_id: int, base: str, key: str, seq: str, build: Callable[[DataFrame], DataFrame], buckets: int = 64
) -> DataFrame | None:
    """One micro-batch of a table that ``build`` derives from all changes of a key.

    New changes, those whose (key, seq) is not stored yet, so that replays add nothing,
    join the change log ``<base>/log``; ``build`` then runs over the log of the buckets
    that got any, so a change that comes late takes its place in time, and its result
    replaces their rows in ``<base>/rows``.  None if all changes were known."""
    spark = batch.sparkSession
    log, rows = (BucketStore(spark, f"{base}/{name}", key, buckets) for name in ("log", "rows"))
    log.clean(batch_id)
    rows.clean(batch_id)
    once = batch.dropDuplicates([key, seq])
    prior = log.read(batch.schema, log.touched(once), batch_id)
    at = f"{base}/new"
    once.join(prior.select(key, seq), [key, seq], "left_anti").select(*batch.columns).write.mode("overwrite").parquet(at)
    new = spark.read.schema(batch.schema).parquet(at)
    some = log.touched(new)
    if not some:
        return None
    whole = log.replace(log.read(batch.schema, some, batch_id).unionByName(new), some, batch_id)
    return rows.replace(build(whole), some, batch_id)
