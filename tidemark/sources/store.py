"""A store of versioned rows in hash buckets, of which an upsert or a delete rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranges import stored

BUCKETS = 64


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row of the highest version; of equal versions a delete, then the largest row."""
    rest = [c for c in rows.columns if c != key]
    best = F.max(F.struct("version", "deleted", *(c for c in rest if c not in ("version", "deleted")))).alias("x")
    return rows.groupBy(key).agg(best).select(key, *(F.col(f"x.{c}").alias(c) for c in rest))


def put(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Merges ``rows`` (the key, version, and others, with the same columns each time) into the store and returns how many buckets were rewritten.

    A bucket is read, merged and written as a whole, and replaced once it is written; the others aren't opened. Older versions than those held change nothing,
    and rows of one batch may come in any order. A null key is a key as others are.
    """
    spark = rows.sparkSession
    fresh = rows if "deleted" in rows.columns else rows.withColumn("deleted", F.lit(False))
    fresh = stored(_latest(fresh, key).withColumn("bucket", bucket(key, buckets)))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # as many as there are buckets at most
    if not touched:
        return 0
    both = fresh
    if exists(spark, path):
        both = fresh.unionByName(spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*fresh.columns))
    merged = stored(_latest(both.drop("bucket"), key).withColumn("bucket", bucket(key, buckets)))
    merged.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
    return len(touched)


def delete(keys: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Marks ``keys`` (the key, version) as deleted; their rows stay as marks, so that an older version that comes late doesn't bring them back."""
    spark = keys.sparkSession
    held = spark.read.parquet(path).drop("bucket", "deleted")
    empty = [F.lit(None).cast(t).alias(c) for c, t in held.dtypes if c not in (key, "version")]
    return put(keys.select(key, "version", *empty, F.lit(True).alias("deleted")), path, key, buckets)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The live rows of the store."""
    return spark.read.parquet(path).where("not deleted").drop("bucket", "deleted")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
