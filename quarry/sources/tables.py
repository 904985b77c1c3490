"""Reading of the input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer files than there are cores, dealt out by a key, so that its rows aren't all worked on in one task.

    Tables of many files stay as they are; what groups by the key later needs no other exchange then.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if len(df.inputFiles()) < n else df


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, p_idx, text): the lines of documents that aren't blank; p_idx counts all lines."""
    return dealt(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p_idx", "text")).where(F.trim("text") != "")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster shares for such tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """df, written down and read again: what uses it several times doesn't make it several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds place, a row's number from 0 in an order of all rows, without one task that has them all.

    Rows are dealt out by ranges of the order, sorted within and written down; a place is the number in the range and the
    sizes of the ranges before, of which there are as many as partitions.
    """
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), nth.alias("_nth"))
    own = scratch_table(own, "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as partitions
    ahead = own.groupBy("_part").agg(F.count("*").alias("_k")).select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_ahead"))
    return own.join(F.broadcast(ahead), "_part").withColumn("place", F.col("_ahead") + F.col("_nth")).drop("_part", "_nth", "_ahead")


def small(df: DataFrame, rows: int = 100_000, chars: int = 64_000_000) -> DataFrame:
    """A side to broadcast if it has at most so many rows and characters; else as it is, and Spark joins it in another way."""
    some = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("c")).first()
    return F.broadcast(df) if some.n <= rows and some.c <= chars else df


def against(rows: DataFrame, queries: DataFrame, key: str, condition=None, block: int = 10_000) -> DataFrame:
    """All rows with each of a set of queries, a broadcast block of about `block` queries at a time."""
    n = max(1, -(-queries.count() // block))
    out = None
    for k in range(n):
        own = F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else queries)
        pairs = rows.crossJoin(own) if condition is None else rows.join(own, condition)
        out = pairs if out is None else out.unionByName(pairs)
    return out
