"""Stored tables that are changed by key: laid out by buckets of the key, so that a change rewrites few of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.sources.tables import scratch_table


class StoredTable:
    """A table under a path, in a folder for each bucket of its key; other files there are left alone.

    Rows are inserted or ignored (the first row of a key stays), inserted or replaced (the last one counts), and deleted by
    key. An insert that brings nothing new writes nothing; one that ignores only adds files; what replaces or deletes
    rewrites the buckets of its keys and no others. What is to be rewritten is written aside first, so a job that is
    lost can be run again. Null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: Iterable[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), tuple(key), buckets
        self.schema = spark.createDataFrame([], schema).schema

    # --- files ---------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self) -> list[str]:
        """The buckets' folders; there are as many as buckets at most."""
        fs, p = self._fs(self.path)
        return [str(x.getPath().toString()) for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket=")] if fs.exists(p) else []

    def _remove(self, folder: str) -> None:
        fs, p = self._fs(folder)
        fs.delete(p, True)

    # --- rows ----------------------------------------------------------------------------------------------------

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        if not self._folders():
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*self._folders())

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _one(self, rows: DataFrame, order: tuple, last: bool) -> DataFrame:
        """One row of each key: the first or the last by the order, ties by the row's hash."""
        by = [F.col(c).desc() if last else F.col(c).asc() for c in order] + [F.xxhash64(*self.schema.names)]
        n = F.row_number().over(Window.partitionBy(*self.key).orderBy(*by))
        return self._with_bucket(rows.withColumn("_n", n).where("_n = 1").select(*self.schema.names))

    def _same_key(self, a: str, b: str):
        on = F.lit(True)
        for k in self.key:
            on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return on & (F.col(f"{a}.bucket") == F.col(f"{b}.bucket"))

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        return rows.alias("a").join(keys.alias("b"), self._same_key("a", "b"), "left_anti")

    def _rewrite(self, rows: DataFrame, buckets: list[int]) -> None:
        """These rows in place of what the buckets hold."""
        aside = scratch_table(rows.select(*self.schema.names, "bucket"), "rewritten")
        left = {r.bucket for r in aside.select("bucket").distinct().collect()}
        aside.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in set(buckets) - left:
            self._remove(f"{self.path}/bucket={b}")

    def insert_or_ignore(self, rows: DataFrame, *order: str) -> None:
        fresh = scratch_table(self._without(self._one(rows, order, False), self._stored().select(*self.key, "bucket")), "fresh")
        if not fresh.isEmpty():
            fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def insert_or_replace(self, rows: DataFrame, *order: str) -> None:
        new, old = self._one(rows, order, True), self._stored()
        names = self.schema.names
        same = self._same_key("a", "b")
        for c in names:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        changed = scratch_table(new.alias("a").join(old.alias("b"), same, "left_anti"), "changed")
        buckets = [r.bucket for r in changed.select("bucket").distinct().collect()]
        if buckets:
            touched = self._stored().where(F.col("bucket").isin(buckets))
            self._rewrite(self._without(touched, changed.select(*self.key, "bucket")).unionByName(changed), buckets)

    def delete(self, keys: DataFrame) -> None:
        """Removes the rows whose keys are given."""
        gone = scratch_table(self._with_bucket(keys.select(*self.key).distinct()), "gone")
        buckets = [r.bucket for r in gone.select("bucket").distinct().collect()]
        if buckets:
            self._rewrite(self._without(self._stored().where(F.col("bucket").isin(buckets)), gone), buckets)

    def clear(self) -> None:
        """Removes all rows; files that aren't the table's stay."""
        for folder in self._folders():
            self._remove(folder)
