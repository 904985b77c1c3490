"""Scans of files as data sets come in them, and sinks. Schemas are given, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line; blank lines and lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_whole(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Files that hold one array of objects, or a single object: a row an object."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def json_keyed(spark: SparkSession, path: str, value: str | DataType) -> DataFrame:
    """(key, value) of files that hold one object of objects each; of a key in several files the last by name counts."""
    kind = value if isinstance(value, str) else value.simpleString()
    text = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.from_json("value", f"map<string,{kind}>").alias("m"))
    rows = text.select("file", F.explode("m").alias("key", "value"))
    last = Window.partitionBy("key").orderBy(F.desc("file"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").select("key", "value")


def csv_rows(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A file or a folder of CSV files with a header; quoted fields may hold line ends. original_split is the file's name."""
    rows = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return rows.withColumn("original_split", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.csv(?:/[^/]*)?$", 1))


def first_per_id(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each id, by the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def last_per_id(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each id: replaced on insertion."""
    return first_per_id(rows, key, *(F.desc(c) for c in order))


def event_log(spark: SparkSession, path: str, schema: str | StructType, ids: DataFrame | None = None) -> DataFrame:
    """Events of a log of JSON lines; those that can't be read, or lack a query_id, are left out, and others than ids' too."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    rows = spark.read.text(path).select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("e")).where("e.query_id is not null").select("e.*")
    return rows if ids is None else rows.join(ids.select("query_id").distinct(), "query_id", "left_semi")


def results(spark: SparkSession, path: str, result: str) -> DataFrame:
    """Rows of the list `results` of result files, one a question (the last by position)."""
    rows = json_whole(spark, path, f"results array<{result}>").select(F.posexplode("results").alias("place", "r")).select("place", "r.*")
    return last_per_id(rows, "question", "place").drop("place")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a path, whose contents aren't read; a file that Spark wrote as a folder counts as one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    whole = F.regexp_replace(F.regexp_replace("path", r"/part-[^/]*$", ""), r"/file=([^/]*)$", "/$1")
    return files.groupBy(whole.alias("path")).agg(F.sum("length").alias("length"))


def inventory(names: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_name, path, kind) of wanted names: the Markdown file if there is one, else the PDF, else null ("missing").

    files: (path) of what a listing gives, as spark.read.format("binaryFile") does.
    """
    f = files.select("path", F.regexp_extract("path", r"([^/]+)\.(md|pdf)$", 1).alias("doc_name"), F.regexp_extract("path", r"\.(md|pdf)$", 1).alias("kind")).where("kind <> ''")
    of = lambda k: f.where(F.col("kind") == k).groupBy("doc_name").agg(F.min("path").alias(k))
    both = names.select("doc_name").distinct().join(of("md"), "doc_name", "left").join(of("pdf"), "doc_name", "left")
    return both.select("doc_name", F.coalesce("md", "pdf").alias("path"), F.when(F.col("md").isNotNull(), "md").when(F.col("pdf").isNotNull(), "pdf").otherwise("missing").alias("kind"))


def corpus_nodes(corpora: DataFrame) -> DataFrame:
    """(doc_id, doc_name, node_id, title, paragraphs, seq) of corpora (doc_id, source_name, nodes array<struct<id, title, paragraphs>>).

    A corpus without nodes is an error when it is met.
    """
    full = F.when(F.size(F.coalesce("nodes", F.array())) > 0, F.col("nodes")).otherwise(F.raise_error(F.concat(F.lit("no nodes in document "), F.col("doc_id").cast("string"))))
    rows = corpora.select("doc_id", F.col("source_name").alias("doc_name"), F.posexplode(full).alias("seq", "n"))
    return rows.select("doc_id", "doc_name", F.col("n.id").alias("node_id"), F.col("n.title").alias("title"), F.col("n.paragraphs").alias("paragraphs"), "seq")


def with_vectors(paragraphs: DataFrame, id_map: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds embedding (null without one) to paragraphs (doc_id, node_id, p_idx), by an id-map (doc_id, node_id, p_idx, row)."""
    return paragraphs.join(id_map.join(vectors, "row").drop("row"), ["doc_id", "node_id", "p_idx"], "left")


def spans(pointers: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds span, the characters from start to end (exclusive) of the text file (path, text) that a row points at."""
    return pointers.join(texts.select("path", "text"), "path", "left").withColumn("span", F.substr("text", F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0)))).drop("text")


def write_splits(docs: DataFrame, questions: DataFrame, assignment: DataFrame, path: str) -> None:
    """Writes each document once a split that has questions of it, with these questions alone, in a folder a split.

    docs: (doc_id, ...), questions: (doc_id, case_id, ...), assignment: (case_id, split).
    """
    q = questions.join(assignment, "case_id").groupBy("split", "doc_id").agg(F.array_sort(F.collect_list(F.struct("case_id", *[c for c in questions.columns if c not in ("case_id", "doc_id")]))).alias("qa"))
    q.join(docs, "doc_id").write.mode("overwrite").partitionBy("split").json(path)


def upserted(report: DataFrame, news: DataFrame) -> DataFrame:
    """A long report (section, metric, value) with new values in place of old ones."""
    both = report.select("section", "metric", "value", F.lit(0).alias("age")).unionByName(news.select("section", "metric", "value", F.lit(1).alias("age")))
    return both.groupBy("section", "metric").agg(F.max_by("value", "age").alias("value"))


def merged_shards(spark: SparkSession, glob: str, schema: str | StructType) -> DataFrame:
    """Answers of all shards that a pattern of paths names; rows without an answer are left out, the first of a global_index stays."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob).where("answer is not null").withColumn("shard", F.input_file_name())
    return first_per_id(rows, "global_index", "shard").drop("shard")


def non_blank(texts: Column) -> Column:
    return F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
