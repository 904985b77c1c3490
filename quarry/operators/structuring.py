"""Documents into sections and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.chunking import chunk_policy, chunks, recursive_chunks, sentence_chunks  # noqa: F401


def conversation_markdown(turns: DataFrame) -> DataFrame:
    """(conv_id, n, markdown): one Markdown text of each conversation (conv_id, turn, role, text)."""
    line = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n**"), F.col("role"), F.lit("**: "), F.col("text"), F.lit(" ["), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit("]"))
    g = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return g.select("conv_id", "n", F.concat(F.lit("# Chat History\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("markdown"))


def markdown_nodes(docs: DataFrame, front: str | None = None, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, level, title, parent_id): headings of Markdown texts; levels start at 1 in each document.

    With `front`, text before the first heading is a section of that title, the first. A level deeper than its parent's
    by more than one is taken as one deeper.
    """
    heading = r"^\s*(#{1,6})\s+(.*)$"
    if front is None:
        every = docs.select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("seq", "line"))
        heads = every.select("doc_id", "seq", F.length(F.regexp_extract("line", heading, 1)).alias("level"), F.trim(F.regexp_extract("line", heading, 2)).alias("title")).where("level > 0")
    else:
        from quarry.operators.markdown import markdown_lines

        own = markdown_lines(docs) if lines is None else lines
        heads = own.where("kind = 'heading'").select("doc_id", "seq", F.length(F.regexp_extract("line", heading, 1)).alias("level"), F.trim(F.regexp_extract("line", heading, 2)).alias("title"))
        first = own.where("section = 0 and kind <> 'blank'").select("doc_id", F.lit(-1).alias("seq"), F.lit(0).alias("level"), F.lit(front).alias("title")).distinct()
        heads = heads.unionByName(first)
    least = F.min(F.when(F.col("level") > 0, F.col("level"))).over(Window.partitionBy("doc_id"))
    heads = heads.withColumn("level", F.when(F.col("level") == 0, 1).otherwise(F.col("level") - least + 1))

    # a level is at most one deeper than the one before, so it is the least of what the headings up to it allow
    w = Window.partitionBy("doc_id").orderBy("seq")
    heads = heads.withColumn("node_id", F.row_number().over(w))
    room = F.min(F.col("level") - F.col("node_id")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    heads = heads.withColumn("level", F.col("node_id") + F.least(F.lit(0), room))
    before, n = w.rowsBetween(Window.unboundedPreceding, -1), F.col("node_id")
    parent = F.coalesce(*(F.when(F.col("level") == k, F.last(F.when(F.col("level") == k - 1, n), ignorenulls=True).over(before)) for k in range(2, 7)))
    return heads.select(F.col("doc_id").cast("long").alias("doc_id"), "node_id", "level", "title", parent.alias("parent_id"))


def markdown_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, n_lines, text): paragraphs of Markdown texts, headings not among them."""
    from quarry.operators.markdown import markdown_lines

    lines = markdown_lines(docs).where("kind not in ('blank', 'heading')")
    g = lines.groupBy("doc_id", "block", "kind").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return g.select("doc_id", "block", "kind", "n_lines", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
