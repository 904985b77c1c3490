"""Writers and readers of other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import scratch_path

#: Options under which a format gives back what was written, line ends and quotes within fields too.
OPTIONS = {
    "csv": {"header": "true", "multiLine": "true", "escape": '"', "quoteAll": "true", "emptyValue": "", "nullValue": "\\N"},
    "json": {"ignoreNullFields": "false"},
}


def write(df: DataFrame, path: str, kind: str) -> None:
    df.write.mode("overwrite").format(kind).options(**OPTIONS.get(kind, {})).save(path)


def read(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    """Reads with a schema that is given, never guessed; lines that can't be read are dropped from text formats."""
    options = OPTIONS.get(kind, {}) | ({"mode": "DROPMALFORMED"} if kind in ("csv", "json") else {})
    return spark.read.schema(schema).format(kind).options(**options).load(path)


def round_trip(spark: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back."""
    path = scratch_path(spark, kind)
    write(df, path, kind)
    return read(spark, path, kind, df.schema)
