"""Question data sets as linked tables: parents, their parts and chunks, with keys that stay the same at every ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunking import chunk_policy, sentence_chunks
from quarry.sources.stored import StoredTable

#: How many sessions of a conversation are read, of some by name; the schema of conversations in files.
MOST_SESSIONS = 50
SESSIONS = {"conv-26": 19, "conv-30": 19, "conv-41": 32, "conv-42": 29, "conv-43": 29, "conv-44": 28, "conv-47": 31, "conv-48": 30, "conv-49": 25, "conv-50": 30}
CONVERSATION = "sample_id string, conversation map<string,string>, session_summary map<string,string>, observation map<string,map<string,array<array<string>>>>"
_TURNS = "array<struct<speaker:string,dia_id:string,id:string,text:string>>"

#: Keys of each table, and whether a second row of a key is ignored or replaces the first.
KEYS = {
    "conversations": (("sample_id", "session_id", "turn_number"), "ignore"), "session_summaries": (("sample_id", "session_id"), "ignore"), "observations": (("sample_id", "session_id", "speaker", "place"), "ignore"),
    "articles": (("sample_id", "title", "place"), "ignore"), "article_chunks": (("sample_id", "title", "place", "chunk_index"), "ignore"),
    "papers": (("paper_id",), "ignore"), "sections": (("paper_id", "section_index"), "ignore"), "section_chunks": (("paper_id", "section_index", "chunk_index"), "ignore"),
    "syllabi": (("syllabus_name",), "ignore"), "syllabus_chunks": (("syllabus_name", "chunk_index"), "ignore"), "passages": (("qa_id", "place"), "ignore"), "passage_chunks": (("qa_id", "place", "chunk_index"), "ignore"),
    "filings": (("doc_name",), "ignore"), "filing_chunks": (("doc_name", "chunk_index"), "ignore"), "documents": (("doc_id",), "replace"), "document_chunks": (("doc_id", "chunk_index"), "replace"),
}


def sessions(samples: DataFrame) -> DataFrame:
    """(sample_id, session_id, date, summary, turns) of conversations as they come in files; sessions that aren't lists are left out."""
    s = samples.select("sample_id", "conversation", "session_summary", F.explode("conversation").alias("name", "raw"))
    s = s.withColumn("session_id", F.regexp_extract("name", "^session_([0-9]+)$", 1).try_cast("int")).where("session_id is not null and raw like '[%'")
    part = lambda column, end: F.try_element_at(column, F.concat("name", F.lit(end)))
    return s.select("sample_id", "session_id", part(F.col("conversation"), "_date_time").alias("date"), part(F.col("session_summary"), "_summary").alias("summary"), F.from_json("raw", _TURNS).alias("turns")).where("turns is not null")


def _within(sample: str | Column, session: str | Column) -> Column:
    most = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in SESSIONS.items() for x in (k, v))), sample), F.lit(MOST_SESSIONS))
    return F.col(session).between(F.lit(1), most) if isinstance(session, str) else session.between(F.lit(1), most)


def conversation_tables(samples: DataFrame) -> dict[str, DataFrame]:
    """conversations, session_summaries and observations of samples (sample_id, conversation, session_summary, observation)."""
    own = sessions(samples).where(_within(F.col("sample_id"), "session_id"))
    turns = own.select("sample_id", "session_id", F.coalesce("date", F.lit("")).alias("session_date"), F.posexplode("turns").alias("p", "t"))
    turns = turns.select("sample_id", "session_id", "session_date", (F.col("p") + 1).alias("turn_number"), F.coalesce("t.dia_id", F.lit("")).alias("dia_id"), "t.speaker", F.coalesce("t.text", F.lit("")).alias("text"))
    number = lambda end: F.regexp_extract("name", f"^session_([0-9]+)_{end}$", 1).try_cast("int")
    said = samples.select("sample_id", F.explode("session_summary").alias("name", "summary")).select("sample_id", number("summary").alias("session_id"), "summary")
    seen = samples.select("sample_id", F.explode("observation").alias("name", "by")).select("sample_id", number("observation").alias("session_id"), F.explode("by").alias("speaker", "items"))
    seen = seen.select("sample_id", "session_id", "speaker", F.posexplode("items").alias("place", "x")).where(F.size("x") >= 2)
    named = F.col("x")[1]
    place = F.when(named.startswith("["), F.array_join(F.from_json(named, "array<string>"), ", ")).otherwise(named)
    return {
        "conversations": turns, "session_summaries": said.where(_within(F.col("sample_id"), "session_id") & (F.col("summary") != "")),
        "observations": seen.where(_within(F.col("sample_id"), "session_id")).select("sample_id", "session_id", "speaker", "place", F.col("x")[0].alias("observation"), place.alias("dia_id")),
    }


def _chunks(spark: SparkSession, rows: DataFrame, *key: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """(key..., chunk_index, content) of the contents of rows."""
    own = rows.select(F.struct(*key).alias("doc_id"), F.col("content").alias("text"))
    return sentence_chunks(spark, own, size, overlap).select(*(F.col(f"doc_id.{k}").alias(k) for k in key), F.col("n").alias("chunk_index"), F.col("chunk").alias("content"))


def article_tables(spark: SparkSession, rows: DataFrame) -> dict[str, DataFrame]:
    """articles and article_chunks of multi-hop questions (id, context); a title without text has no article."""
    a = rows.select(F.col("id").alias("sample_id"), F.posexplode(F.arrays_zip("context.title", "context.sentences")).alias("place", "c"))
    trimmed = F.filter(F.transform(F.coalesce("c.sentences", F.array()), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    a = a.select("sample_id", "place", F.col("c.title").alias("title"), F.array_join(trimmed, " ").alias("content")).where("title is not null and content <> ''")
    return {"articles": a, "article_chunks": _chunks(spark, a, "sample_id", "title", "place")}


def paper_tables(spark: SparkSession, keyed: DataFrame) -> dict[str, DataFrame]:
    """papers, sections and section_chunks of papers (key, value)."""
    v, empty = F.col("value"), F.lit("")
    papers = keyed.select(F.col("key").alias("paper_id"), F.coalesce(v["title"], empty).alias("title"), F.coalesce(v["abstract"], empty).alias("abstract"))
    s = keyed.select(F.col("key").alias("paper_id"), F.posexplode("value.full_text").alias("section_index", "s"))
    s = s.select("paper_id", "section_index", F.coalesce("s.section_name", empty).alias("section_name"), F.array_join(F.coalesce("s.paragraphs", F.array()), "\n").alias("content"))
    return {"papers": papers, "sections": s, "section_chunks": _chunks(spark, s, "paper_id", "section_index")}


def syllabus_tables(spark: SparkSession, docs: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """syllabi and syllabus_chunks of documents (syllabus_name, content), with what meta (name, course, major, area, university, num_pages) says."""
    said = meta.select(F.col("name").alias("syllabus_name"), "course", "major", "area", "university", F.col("num_pages").try_cast("int").alias("num_pages"))
    out = docs.select("syllabus_name", "content").join(said, "syllabus_name", "left").fillna("", ["course", "major", "area", "university"]).fillna(0, ["num_pages"])
    return {"syllabi": out, "syllabus_chunks": _chunks(spark, out, "syllabus_name")}


def passage_tables(spark: SparkSession, rows: DataFrame) -> dict[str, DataFrame]:
    """passages and passage_chunks of open questions (id, passages)."""
    p = rows.select(F.col("id").alias("qa_id"), F.posexplode("passages").alias("place", "p")).select("qa_id", "place", F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.text", F.lit("")).alias("content"))
    return {"passages": p, "passage_chunks": _chunks(spark, p, "qa_id", "place").join(p.select("qa_id", "place", "title"), ["qa_id", "place"])}


def filing_tables(spark: SparkSession, docs: DataFrame, info: DataFrame) -> dict[str, DataFrame]:
    """filings and filing_chunks of documents (doc_name, content), with what info (doc_name, company, gics_sector, doc_type, doc_period) says."""
    out = docs.select("doc_name", "content").join(info.select("doc_name", "company", "gics_sector", "doc_type", "doc_period"), "doc_name", "left").fillna("", ["company", "gics_sector", "doc_type"]).fillna(0, ["doc_period"])
    size, overlap = chunk_policy(800, 100, finance=True)
    return {"filings": out.withColumn("num_pages", F.lit(0)), "filing_chunks": _chunks(spark, out, "doc_name", size=size, overlap=overlap).withColumn("page_num", F.lit(0))}


def document_tables(spark: SparkSession, docs: DataFrame) -> dict[str, DataFrame]:
    """documents and document_chunks of documents (doc_id, content); those without content are left out."""
    out = docs.select("doc_id", "content").where("content <> ''")
    return {"documents": out, "document_chunks": _chunks(spark, out, "doc_id")}


def ingest(spark: SparkSession, tables: dict[str, DataFrame], path: str, order: str | None = None) -> dict[str, StoredTable]:
    """Puts the rows of these tables into the stored ones under a path, and gives these.

    Each row has an id, a hash of its key, so the same row has it at every ingest. order: a column by which rows of one
    key come; it isn't stored.
    """
    out = {}
    for name, rows in tables.items():
        key, second = KEYS[name]
        kept = [c for c in rows.columns if c != order]
        own = rows.select(F.xxhash64(F.lit(name), *key).alias("id"), *kept, *([F.col(order).alias("_order")] if order in rows.columns else []))
        stored = StoredTable(spark, f"{path}/{name}", own.drop("_order").schema, key, 16)
        put = stored.insert_or_replace if second == "replace" else stored.insert_or_ignore
        put(own, *(["_order"] if "_order" in own.columns else []))
        out[name] = stored
    return out


def keyword_hits(tables: dict[str, DataFrame], word: str) -> DataFrame:
    """(kind, id, key) of the rows of any of the tables, parents and chunks alike, one of whose texts holds the word, in any case."""
    pattern = "%" + word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    out = None
    for name, rows in tables.items():
        texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
        held = F.lit(False)
        for c in texts:
            held = held | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
        hits = rows.where(held).select(F.lit(name).alias("kind"), "id", F.concat_ws("/", *(F.col(k).cast("string") for k in KEYS[name][0])).alias("key"))
        out = hits if out is None else out.unionByName(hits)
    return out


def session_markdown(samples: DataFrame) -> DataFrame:
    """(sample_id, markdown) of conversations as they come in files, with each session's date and summary, up to the first gap."""
    from pyspark.sql import Window

    s = sessions(samples)
    run = s.withColumn("n", F.row_number().over(Window.partitionBy("sample_id").orderBy("session_id"))).where("n = session_id")
    some = lambda c, label: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    name = lambda t: F.coalesce(F.nullif(t["dia_id"], F.lit("")), F.nullif(t["id"], F.lit("")))
    turn = lambda t: F.concat(F.lit("**"), F.coalesce(t["speaker"], F.lit("Unknown")), F.lit("**: "), F.coalesce(t["text"], F.lit("")), F.coalesce(F.concat(F.lit(" ["), name(t), F.lit("]")), F.lit("")))
    lines = F.concat(F.array_compact(F.array(F.concat(F.lit("\n## Session "), F.col("session_id").cast("string")), some("date", "DATE"), some("summary", "SUMMARY"))), F.transform("turns", turn))
    g = run.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("session_id", F.array_join(lines, "\n").alias("body")))).alias("l"))
    out = samples.select("sample_id").join(g, "sample_id", "left")
    bodies = F.transform(F.coalesce("l", F.array()), lambda x: x["body"])
    return out.select("sample_id", F.array_join(F.concat(F.array(F.concat(F.lit("# Chat History: "), "sample_id")), bodies), "\n").alias("markdown"))
