"""The corpus pipeline: five stages, each one operator of this subpackage, each written and read again before the next.

What holds for every stage: a null or empty text is a document like any other, without anything to find in it; texts of
any length are worked on whole; rows that repeat a doc_id, or whose doc_id is null, are documents of their own; no
documents give no rows; and all columns come back as they were, whatever their names, unless the stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, column, read_table, spare
from quarry.llm.decontaminate import contaminated
from quarry.llm.line_dedup import drop_repeated_lines
from quarry.llm.ngram_join import jaccard_components
from quarry.llm.pieces import piece_digests
from quarry.llm.toxicity import score_toxicity


def _aside(docs: DataFrame, *made: str) -> tuple[DataFrame, dict[str, str]]:
    """Documents whose columns of the names that an operator makes have others, and the present name of each column."""
    names = {c: spare(docs, f"_{c}") if c.lower() in made else c for c in docs.columns}
    return docs.select(*(column(c).alias(n) for c, n in names.items())), names


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*map(column, docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A document without words is never rejected, and without labels of both kinds none is. The score is the text's alone,
    so rows with the same text stay or go together. Columns of docs named held_out, score or predicted stay as they were.
    """
    plain, names = _aside(docs, "held_out", "score", "predicted")
    kept = score_toxicity(spark, plain, read_table(spark, sf_dir, "labels")).where("predicted = 0")
    return kept.select(*(column(n).alias(c) for c, n in names.items()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for the largest doc_id that holds them; n_chars, if there is one, is counted again.

    A document that loses all its text goes. One that loses nothing stays as it is, null or empty too. Rows that repeat a
    doc_id count as one document and lose the same lines; a row without a doc_id neither counts nor loses any.
    """
    plain, names = _aside(docs, "n_lines", "n_dropped", "kept")
    out, gone = drop_repeated_lines(spark, plain), F.col("n_dropped") > 0
    out = out.where(~gone | (F.trim("kept") != ""))
    new = {"text": F.when(gone, F.col("kept")), "n_chars": F.when(gone, F.length("kept"))}
    return out.select(*((F.coalesce(new[c].cast(kind), column(c)) if c in new else column(names[c])).alias(c) for c, kind in docs.dtypes))


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """Documents with a key of each row, written down so that it stays, and the key's name."""
    key = spare(docs, "_row")
    return scratch.save(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _rows(keyed: DataFrame, key: str) -> DataFrame:
    return keyed.select(F.col(key).alias("doc_id"), "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at five-word shingles and similarity 0.8 one stays: the smallest doc_id, a null after all others.

    Of rows that tie, as those that repeat a doc_id and its text, one stays. Rows that repeat a doc_id with unlike texts
    all stay. Texts without words are linked with nothing and stay.
    """
    scratch = Scratch(spark, "near-duplicates")
    keyed, key = _keyed(docs, scratch)
    linked = jaccard_components(spark, _rows(keyed, key), words=5, num=80, den=100).select(F.col("doc_id").alias(key), "component_id")
    linked = scratch.save(linked, "linked")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)
    best = linked.join(keyed.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(first).alias("f")).select(F.col(f"f.{key}").alias(key))
    away = scratch.save(linked.select(key).join(best, key, "left_anti"), "away")
    return _like(docs, keyed.join(away.hint("shuffle_hash"), key, "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of the benchmark go, each by its own text; blank texts and blank items match nothing."""
    scratch = Scratch(spark, "contaminated")
    keyed, key = _keyed(docs, scratch)
    hits = contaminated(spark, _rows(keyed, key), read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    hits = scratch.save(hits, "hits")
    return _like(docs, keyed.join(hits.hint("shuffle_hash"), key, "left_anti"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the sampled segmentation of each document that is left in figures, and whether its decoding is lossless.

    Rows with the same doc_id and text draw alike; a null doc_id draws as 0 and comes back as null.
    """
    return piece_digests(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: None: no stage but line dedup can be expressed in SQL; tests/llm holds the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
