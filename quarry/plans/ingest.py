"""Queries that put the given tables into linked and stored tables, change these by key, and look words up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.chunking import packed
from quarry.plans.register import query
from quarry.sources import datasets, relational
from quarry.sources.stored import StoredTable
from quarry.sources.tables import dealt, scratch_path, table


def _conversation_files(spark, d) -> DataFrame:
    """Conversations as arrays of objects in files, with sessions of four turns; every fifth conversation has no second one."""
    c = table(spark, d, "conversations")
    turn, s, conv = F.col("turn"), F.expr("cast(turn div 4 + 1 as int)"), F.col("conv_id").cast("string")
    n = F.col("s").cast("string")
    c = c.select("conv_id", "turn", "role", "text", s.alias("s")).withColumn("dia_id", F.concat(F.lit("D"), n, F.lit(":"), turn.cast("string")))
    turns = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("speaker"), "dia_id", "text").alias("t")))), lambda x: x["t"]))
    per = c.groupBy("conv_id", "s").agg(turns.alias("turns"))
    said = F.to_json(F.array("text"))
    item = F.when(turn % 4 == 1, F.to_json(F.array("text", "dia_id"))).when(turn % 4 == 2, F.concat(F.regexp_replace(said, r"\]$", ""), F.lit(',["D1","D2"]]'))).otherwise(said)
    seen = c.where("turn % 4 <> 0").groupBy("conv_id", "s", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]), ",").alias("items"))
    seen = seen.groupBy("conv_id", "s").agg(F.array_join(F.collect_list(F.concat(F.lit('"'), "role", F.lit('":['), "items", F.lit("]"))), ",").alias("seen"))
    entry = lambda end, value: F.concat(F.lit('"session_'), n, F.lit(f'{end}":'), value)
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    own = F.when((F.col("conv_id") % 5 == 0) & (F.col("s") == 2), entry("", F.lit('"lost"'))).otherwise(entry("", F.col("turns")))
    date = F.when(F.col("s") % 2 == 1, F.concat(F.lit(","), entry("_date_time", text(F.concat(F.lit("day "), n))))).otherwise("")
    per = per.join(seen, ["conv_id", "s"], "left").select(
        "conv_id", F.concat(own, date).alias("a"), entry("_summary", text(F.when(F.col("s") % 3 == 2, "").otherwise(F.concat(F.lit("sum "), n)))).alias("b"),
        entry("_observation", F.concat(F.lit("{"), F.coalesce("seen", F.lit("")), F.lit("}"))).alias("o"),
    )
    held = lambda c: F.concat(F.lit("{"), F.array_join(F.collect_list(c), ","), F.lit("}"))
    objects = per.groupBy("conv_id").agg(F.concat(F.lit('{"sample_id":"'), F.first(conv), F.lit('","conversation":'), held("a"), F.lit(',"session_summary":'), held("b"), F.lit(',"observation":'), held("o"), F.lit("}")).alias("object"))
    files = objects.groupBy(F.floor(F.col("conv_id") / 100).alias("f")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("object"), ","), F.lit("]")).alias("value"))
    path = scratch_path(spark, "conversations")
    files.repartition("f").write.partitionBy("f").text(path)
    return datasets.json_whole(spark, path, relational.CONVERSATION)


SESSIONS = """cs AS (SELECT conv_id, conv_id::VARCHAR AS sample_id, turn, role, text, (turn // 4 + 1)::INT AS s, 'D' || (turn // 4 + 1) || ':' || turn AS dia_id FROM conversations),
tn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY turn) AS turn_number, CASE WHEN s % 2 = 1 THEN 'day ' || s ELSE '' END AS date FROM cs WHERE NOT (conv_id % 5 = 0 AND s = 2)),
ob AS (SELECT *, row_number() OVER (PARTITION BY conv_id, s, role ORDER BY turn) - 1 AS place FROM cs WHERE turn % 4 <> 0)"""


@query(
    "s18_conversations", "S2 S18",
    f"""WITH {SESSIONS} SELECT 'turn' AS kind, sample_id, s AS session_id, turn_number::INT AS place, role || '|' || dia_id || '|' || date AS said, md5(text) AS body FROM tn
UNION ALL SELECT DISTINCT 'summary', sample_id, s, 0, 'sum ' || s, '' FROM cs WHERE s % 3 <> 2
UNION ALL SELECT 'observation', sample_id, s, place::INT, role || '|' || CASE WHEN turn % 4 = 1 THEN dia_id ELSE 'D1, D2' END, md5(text) FROM ob WHERE turn % 4 <> 3""",
)
def s18_conversations(spark, d):
    """Turns, summaries and observations, put in twice: the second time changes nothing."""
    tables, path = relational.conversation_tables(_conversation_files(spark, d)), scratch_path(spark, "tables")
    relational.ingest(spark, tables, path)
    t = {k: x.read() for k, x in relational.ingest(spark, tables, path).items()}
    row = lambda df, kind, place, said, body: df.select(F.lit(kind).alias("kind"), "sample_id", "session_id", place.alias("place"), said.alias("said"), body.alias("body"))
    a = row(t["conversations"], "turn", F.col("turn_number"), F.concat_ws("|", "speaker", "dia_id", "session_date"), F.md5("text"))
    b = row(t["session_summaries"], "summary", F.lit(0), F.col("summary"), F.lit(""))
    return a.unionByName(b).unionByName(row(t["observations"], "observation", F.col("place"), F.concat_ws("|", "speaker", "dia_id"), F.md5("observation")))


@query(
    "d20_session_markdown", "D20",
    f"""WITH {SESSIONS}, b AS (SELECT sample_id, s, chr(10) || '## Session ' || s || chr(10) || CASE WHEN s % 2 = 1 THEN 'DATE: day ' || s || chr(10) ELSE '' END || CASE WHEN s % 3 <> 2 THEN 'SUMMARY: sum ' || s || chr(10) ELSE '' END
 || string_agg('**' || role || '**: ' || text || ' [' || dia_id || ']', chr(10) ORDER BY turn) AS body FROM tn GROUP BY sample_id, s),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s) AS n FROM b)
SELECT i.sample_id, md5('# Chat History: ' || i.sample_id || coalesce(chr(10) || string_agg(body, chr(10) ORDER BY s), '')) AS markdown FROM (SELECT DISTINCT sample_id FROM cs) i LEFT JOIN (SELECT * FROM r WHERE n = s) r USING (sample_id) GROUP BY i.sample_id""",
)
def d20_sessions(spark, d):
    """Up to the first session that is missing."""
    return relational.session_markdown(_conversation_files(spark, d)).select("sample_id", F.md5("markdown").alias("markdown"))


def _family(spark, tables: dict[str, DataFrame], parent: str, chunks: str, name, body, path: str | None = None) -> DataFrame:
    """(kind, name, n, body) of a parent table's rows and of its chunks."""
    t = {k: x.read() for k, x in relational.ingest(spark, tables, path or scratch_path(spark, "tables")).items()}
    a = t[parent].select(F.lit(parent).alias("kind"), name.alias("name"), F.lit(0).alias("n"), F.md5(body).alias("body"))
    return a.unionByName(t[chunks].select(F.lit(chunks).alias("kind"), name.alias("name"), F.col("chunk_index").alias("n"), F.md5("content").alias("body")))


def _documents(spark, d):
    return dealt(table(spark, d, "documents").where("text is not null").select("doc_id", "text", "source", "lang"), "doc_id")


def _family_sql(source: str, parent: str, chunks: str, body: str, **sizes: int) -> str:
    """source: SELECT of (doc_id, text, ...); body: what a parent row says."""
    return f"WITH RECURSIVE src AS ({source}), {packed('src', **sizes)} SELECT '{parent}' AS kind, doc_id AS name, 0 AS n, md5({body}) AS body FROM src UNION ALL SELECT '{chunks}', doc_id, n, md5(chunk) FROM chunked"


@query("s18_articles", "S4 S18", _family_sql("SELECT conv_id || '/' || role AS doc_id, string_agg(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), ' ' ORDER BY turn) AS text FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY conv_id, role", "articles", "article_chunks", "text"))
def s18_articles(spark, d):
    """Conversations as contexts: what each role says is an article."""
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit(" "), "text", F.lit(" ")).alias("t")))), lambda x: x["t"]).alias("s"))
    c = c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("role", "s"))).alias("l"))
    rows = c.select("id", F.struct(F.transform("l", lambda x: x["role"]).alias("title"), F.transform("l", lambda x: x["s"]).alias("sentences")).alias("context"))
    return _family(spark, relational.article_tables(spark, rows), "articles", "article_chunks", F.concat_ws("/", "sample_id", "title"), F.col("content"))


@query("s18_papers", "S18", _family_sql("SELECT doc_id || '/' || (i // 10) AS doc_id, string_agg(t, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY doc_id, i // 10", "sections", "section_chunks", "text"))
def s18_papers(spark, d):
    """Documents as papers with a section every ten lines; papers that come again are ignored."""
    lines = F.split("text", "\n")
    section = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10).cast("int")), lambda i: F.struct(F.concat(F.lit("S"), i.cast("string")).alias("section_name"), F.slice(lines, i * 10 + 1, 10).alias("paragraphs")))
    keyed = _documents(spark, d).select(F.col("doc_id").cast("string").alias("key"), F.struct(F.col("source").alias("title"), F.lit("").alias("abstract"), section.alias("full_text")).alias("value"))
    path = scratch_path(spark, "tables")
    relational.ingest(spark, relational.paper_tables(spark, keyed), path)
    again = keyed.withColumn("value", F.col("value").withField("title", F.lit("later")))
    out = _family(spark, relational.paper_tables(spark, again), "sections", "section_chunks", F.concat_ws("/", "paper_id", "section_index"), F.col("content"), path)
    late = StoredTable(spark, f"{path}/papers", "id long, paper_id string, title string, abstract string", ("paper_id",), 16).read().where("title = 'later'")
    return out.unionByName(late.select(F.lit("replaced").alias("kind"), F.col("paper_id").alias("name"), F.lit(0).alias("n"), F.lit("").alias("body")))


@query("s18_syllabi", "S18", _family_sql("SELECT 's' || doc_id AS doc_id, text, coalesce(regexp_extract(url, '//([^/]+)', 1), '') || '|' || coalesce(page_id, 0) AS said FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id WHERE text IS NOT NULL", "syllabi", "syllabus_chunks", "said || '|' || text"))
def s18_syllabi(spark, d):
    """Documents as syllabi; what is said of them comes from the pages of their ids."""
    docs = _documents(spark, d).select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("syllabus_name"), F.col("text").alias("content"))
    none = F.lit("").alias
    meta = table(spark, d, "pages").select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("name"), F.regexp_extract("url", "//([^/]+)", 1).alias("course"), none("major"), none("area"), none("university"), F.col("page_id").cast("string").alias("num_pages"))
    return _family(spark, relational.syllabus_tables(spark, docs, meta), "syllabi", "syllabus_chunks", F.col("syllabus_name"), F.concat_ws("|", "course", "num_pages", "content"))


@query("s18_passages", "S18", _family_sql("SELECT doc_id || '/' || k AS doc_id, CASE WHEN k = 0 THEN text ELSE source END AS text, source FROM documents, (VALUES (0), (1)) v(k) WHERE text IS NOT NULL", "passages", "passage_chunks", "source || '|' || text"))
def s18_passages(spark, d):
    """Documents as questions with two passages: their text and their source's name."""
    p = lambda c: F.struct(F.col("source").alias("title"), F.col(c).alias("text"))
    rows = _documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.array(p("text"), p("source")).alias("passages"))
    return _family(spark, relational.passage_tables(spark, rows), "passages", "passage_chunks", F.concat_ws("/", "qa_id", "place"), F.concat_ws("|", "title", "content"))


FILINGS = "SELECT 'F' || doc_id AS doc_id, text, coalesce(source, '') || '|' || coalesce(length(lang), 0) AS said FROM documents WHERE text IS NOT NULL"


def _filing_tables(spark, d):
    name = F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("doc_name")
    docs = _documents(spark, d)
    info = docs.select(name, F.col("source").alias("company"), F.lit("x").alias("gics_sector"), F.col("lang").alias("doc_type"), F.length("lang").alias("doc_period"))
    return relational.filing_tables(spark, docs.select(name, F.col("text").alias("content")), info)


@query("s18_filings", "D16 S18", _family_sql(FILINGS, "filings", "filing_chunks", "said || '|' || text", size=1000, lap=150))
def s18_filings(spark, d):
    """Documents as filings, whose chunks are larger."""
    return _family(spark, _filing_tables(spark, d), "filings", "filing_chunks", F.col("doc_name"), F.concat_ws("|", "company", "doc_period", "content"))


@query("s18_documents", "S18", _family_sql("SELECT doc_id::VARCHAR AS doc_id, text FROM documents WHERE text <> ''", "documents", "document_chunks", "text"))
def s18_documents(spark, d):
    """Documents that replace a first version of theirs."""
    path = scratch_path(spark, "tables")
    docs = _documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    relational.ingest(spark, relational.document_tables(spark, docs.withColumn("content", F.when(F.col("content") != "", "first"))), path)
    return _family(spark, relational.document_tables(spark, docs), "documents", "document_chunks", F.col("doc_id"), F.col("content"), path)


@query(
    "r21_table_lookup", "R21",
    f"WITH RECURSIVE src AS ({FILINGS}), {packed('src', size=1000, lap=150)} SELECT 'filings' AS kind, doc_id AS key FROM src WHERE text ILIKE '%tion the%' OR split_part(said, '|', 1) ILIKE '%tion the%' UNION ALL SELECT 'filing_chunks', doc_id || '/' || n FROM chunked WHERE chunk ILIKE '%tion the%'",
)
def r21_tables(spark, d):
    """A word looked up in the stored filings and their chunks."""
    t = relational.ingest(spark, _filing_tables(spark, d), scratch_path(spark, "tables"))
    return relational.keyword_hits({k: x.read() for k, x in t.items()}, "tion the").select("kind", "key")


# --- stored tables that change -----------------------------------------------------------------------------------------


def _stored(spark, d, buckets=16):
    docs = StoredTable(spark, scratch_path(spark, "stored"), "doc_id long, source string, text_md5 string", ("doc_id",), buckets)
    docs.insert_or_ignore(table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("text_md5")))
    return docs


@query("s19_stored_delete", "S19 J4", "SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s19_delete(spark, d):
    """Toxic documents are deleted from a stored table; only the buckets of their ids are rewritten."""
    docs = _stored(spark, d)
    docs.delete(table(spark, d, "labels").where("toxic = 1").select("doc_id"))
    return docs.read()


@query("s19_clear", "S19", "SELECT source, count(*)::BIGINT AS n, 'kept' AS notes FROM documents GROUP BY source")
def s19_clear(spark, d):
    """A table is cleared and filled with one row a source; a file beside its rows stays."""
    docs = _stored(spark, d)
    notes = f"{docs.path}/notes"
    spark.range(1).select(F.lit("kept").alias("value")).write.text(notes)
    docs.clear()
    docs.insert_or_ignore(table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "source", F.col("n").cast("string").alias("text_md5")))
    return docs.read().select("source", F.col("text_md5").cast("long").alias("n")).crossJoin(F.broadcast(spark.read.text(notes).select(F.col("value").alias("notes"))))


@query("s17_stored_report", "S17", "SELECT source AS section, m AS metric, CASE WHEN m = 'n' THEN count(*) * 10 WHEN m = 'chars' THEN sum(n_chars) ELSE 1 END::BIGINT AS value FROM documents, (VALUES ('n'), ('chars'), ('new')) v(m) GROUP BY source, m")
def s17_stored(spark, d):
    """A stored report takes over new values; what they don't name stays."""
    g = table(spark, d, "documents").groupBy(F.col("source").alias("section")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    long = lambda **m: g.select("section", F.explode(F.create_map(*(x for k, v in m.items() for x in (F.lit(k), v.cast("long"))))).alias("metric", "value"))
    report = StoredTable(spark, scratch_path(spark, "report"), "section string, metric string, value long", ("section", "metric"), 4)
    report.insert_or_replace(long(n=F.col("n"), chars=F.col("chars")))
    report.insert_or_replace(long(n=F.col("n") * 10, new=F.lit(1)))
    return report.read()


@query("s14_file_inventory", "S14", "SELECT source AS doc_name, CASE WHEN length(source) % 2 = 0 THEN 'md' ELSE 'pdf' END AS kind FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT DISTINCT 'none-' || source, 'missing' FROM documents")
def s14_files(spark, d):
    """A listing of files that the query writes, a folder for each source's; as many names again have no file."""
    path = scratch_path(spark, "files")
    docs = table(spark, d, "documents").select("source", "text")
    ends = F.when(F.length("source") % 2 == 0, F.array(F.lit(".md"), F.lit(".pdf"))).otherwise(F.array(F.lit(".pdf")))
    files = docs.groupBy("source").agg(F.count("*").cast("string").alias("value")).select("value", F.explode(ends).alias("end"), "source")
    files.select("value", F.concat("source", "end").alias("file")).write.partitionBy("file").text(path)
    names = docs.select(F.explode(F.array("source", F.concat(F.lit("none-"), "source"))).alias("doc_name"))
    return datasets.inventory(names, datasets.listed(spark, path)).select("doc_name", "kind")
