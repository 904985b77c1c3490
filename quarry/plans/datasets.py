"""Queries that write the given tables as files of data sets come in, scan them back, and bring them into one shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.register import query
from quarry.sources import adapters, datasets
from quarry.sources.tables import scratch_path, table


def _text(df, *columns):
    """Rows as lines of JSON."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def _lines(spark, df, name):
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


ORDERS = "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders"


@query(
    "s01_finance_jsonl", "S1 A1 A8",
    """SELECT 'f' || o_orderkey AS case_id, 'doc' || o_custkey AS source_id, 'What is order ' || o_orderkey || '?' AS question, o_orderstatus AS gold,
CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END || '|' || o_orderstatus AS excerpts, o_orderpriority AS category FROM orders""",
)
def s01_finance(spark, d):
    """Orders as questions on filings, a line each with a blank line behind."""
    k, o = F.col("o_orderkey").cast("string"), table(spark, d, "orders")
    said = lambda t: F.struct(t.alias("evidence_text"), F.lit("x").alias("doc_name"))
    rows = o.select(
        F.concat(F.lit("f"), k).alias("financebench_id"), F.concat(F.lit("doc"), F.col("o_custkey").cast("string")).alias("doc_name"), F.lit("c").alias("company"), F.concat(F.lit("What is order "), k, F.lit("?")).alias("question"), F.col("o_orderstatus").alias("answer"),
        F.col("o_orderpriority").alias("question_type"), F.lit("r").alias("question_reasoning"), F.lit("j").alias("justification"), F.array(said(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority"))), said(F.col("o_orderstatus")), said(F.lit("more"))).alias("evidence"),
    )
    path = _lines(spark, _text(rows, "*").select(F.concat("value", F.lit("\n")).alias("value")), "finance")
    s = adapters.finance(datasets.json_lines(spark, path, adapters.FINANCE))
    out = adapters.canonical_cases(s, s["metadata"]["financebench_id"])
    first = F.when(F.size("excerpts") < 2, F.lit("")).otherwise(F.col("excerpts")[0])
    kept = F.when(F.col("excerpts")[1] == "more", F.concat_ws("|", F.lit(""), F.col("excerpts")[0])).otherwise(F.concat_ws("|", first, F.col("excerpts")[1]))
    return out.select("case_id", "source_id", "question", "gold", kept.alias("excerpts"), "category")


@query(
    "s02_conversation_qa", "S2 A2 J2",
    """WITH t AS (SELECT conv_id, turn, role || ': ' || text AS said FROM conversations)
SELECT c.conv_id::VARCHAR AS sample_id, c.turn::INT AS place, md5(c.text) AS gold, md5(coalesce(t.said, (c.turn + 1)::VARCHAR) || '|none') AS evidence FROM conversations c LEFT JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn + 1 WHERE c.turn % 6 <> 5""",
)
def s02(spark, d):
    """Each conversation is a JSON file's object: its turns, and a question on each with the next turn as evidence."""
    c = table(spark, d, "conversations")
    turn = F.col("turn")
    obj = c.groupBy(F.col("conv_id").cast("string").alias("sample_id")).agg(
        F.collect_list(F.struct(F.col("role").alias("speaker"), turn.cast("string").alias("dia_id"), "text")).alias("turns"),
        F.collect_list(F.struct(turn.cast("int").alias("place"), F.lit("?").alias("question"), F.col("text").alias("answer"), F.array(F.concat((turn + 1).cast("string"), F.lit(" ; none"))).alias("evidence"), (turn % 6).cast("int").alias("category"))).alias("qa"),
    )
    path = _lines(spark, _text(obj, "*"), "conversations")
    rows = datasets.json_lines(spark, path, "sample_id string, turns array<struct<speaker:string,dia_id:string,text:string>>, qa array<struct<place:int,question:string,answer:string,evidence:array<string>,category:int>>")
    qa, turns = (rows.select("sample_id", F.explode(c).alias("x")).select("sample_id", "x.*") for c in ("qa", "turns"))
    out = adapters.conversation_qa(qa, turns)
    return out.select("sample_id", "place", F.md5(F.col("golds")[0]).alias("gold"), F.md5(F.array_join("evidence", "|")).alias("evidence"))


def _papers(spark, d):
    """Documents as papers in files of keyed objects, about fifty in each; every tenth is in an earlier file too."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "source")
    i = F.col("doc_id")
    answer = lambda un, spans, free, ev: F.struct(F.struct(un.alias("unanswerable"), spans.alias("extractive_spans"), free.alias("free_form_answer"), F.lit(None).cast("boolean").alias("yes_no"), ev.alias("evidence")).alias("answer"))
    none = F.array().cast("array<string>")
    answers = F.array(
        answer(i % 4 == 0, none, F.lit(""), none), answer(F.lit(False) & (i > 0) | (i % 8 == 0), F.when(i % 3 == 0, F.array("source", F.lit("b"))).otherwise(none), F.when(i % 8 == 0, F.lit("")).otherwise(F.lit("free")), F.array("source", F.lit(" "))),
    )
    paper = lambda title: F.struct(title.alias("title"), F.lit("").alias("abstract"), F.array(F.struct(F.lit("S").alias("section_name"), F.array("text").alias("paragraphs"))).alias("full_text"), F.array().cast("array<struct<caption:string,file:string>>").alias("figures_and_tables"), F.array(F.struct(F.lit("why?").alias("question"), F.concat(F.lit("q"), i.cast("string")).alias("question_id"), answers.alias("answers"))).alias("qas"))
    new = docs.select((F.floor(i / 50) * 2 + 1).alias("file"), i.cast("string").alias("key"), paper(F.col("source")).alias("value"))
    old = docs.where("doc_id % 10 = 0").select((F.floor(i / 50) * 2).alias("file"), i.cast("string").alias("key"), paper(F.lit("old")).alias("value"))
    objects = new.unionByName(old).groupBy(F.lpad(F.col("file").cast("string"), 8, "0").alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("value"))
    path = scratch_path(spark, "papers")
    objects.write.partitionBy("file").text(path)
    return datasets.json_keyed(spark, path, adapters.PAPER)


@query(
    "s03_keyed_papers", "S3 A3",
    """SELECT doc_id::VARCHAR AS sample_id, source || ': why?' AS question, CASE WHEN doc_id % 4 = 0 THEN 'Not mentioned|' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN source || '; b' ELSE 'free' END AS golds, source AS evidence FROM documents WHERE text IS NOT NULL AND doc_id % 8 <> 0""",
)
def s03(spark, d):
    out = adapters.papers(_papers(spark, d))
    golds = F.filter("golds", lambda x: x != "")
    return out.select("sample_id", "question", F.array_join(golds, "|").alias("golds"), F.array_join("evidence", "|").alias("evidence"))


@query("d21_paper_markdown", "D21", "SELECT doc_id::VARCHAR AS sample_id, md5('# ' || source || chr(10) || chr(10) || 'Paper ID: ' || doc_id || chr(10) || chr(10) || '## S' || CASE WHEN trim(text, ' ') = '' THEN '' ELSE chr(10) || chr(10) || text END) AS body FROM documents WHERE text IS NOT NULL")
def d21(spark, d):
    out = adapters.paper_markdown(_papers(spark, d))
    return out.select("sample_id", F.md5(F.regexp_replace("markdown", "\n\n$", "")).alias("body"))


@query(
    "s04_multi_hop", "S4 A4 J8",
    """WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS sample_id, md5(t[1] || CASE WHEN len(t) > 1 THEN '|' || t[2] ELSE '' END) AS evidence FROM c""",
)
def s04(spark, d):
    """Conversations as contexts of one sentence list; facts point at its first two sentences and at one that isn't there."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    rows = c.select(
        F.col("conv_id").cast("string").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("k").alias("type"), F.lit("l").alias("level"), F.struct(F.array(F.lit("A")).alias("title"), F.array("t").alias("sentences")).alias("context"),
        F.struct(F.array(*[F.lit(x) for x in "AAAZ"]).alias("title"), F.array(*[F.lit(x) for x in (0, 1, 9999, 0)]).alias("sent_id")).alias("supporting_facts"),
    )
    out = adapters.multi_hop(datasets.json_lines(spark, _lines(spark, _text(rows, "*"), "hops"), adapters.MULTI_HOP))
    return out.select("sample_id", F.md5(F.array_join("evidence", "|")).alias("evidence"))


@query("d22_article_markdown", "D22", "SELECT conv_id::VARCHAR AS title, md5('# ' || conv_id || chr(10) || chr(10) || string_agg(trim(text, ' ') || ' end.', chr(10) || chr(10) ORDER BY turn)) AS body FROM conversations GROUP BY conv_id")
def d22(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("title")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.array(F.trim(x["text"]), F.lit("end."))).alias("text"))
    return adapters.article_markdown(c).select("title", F.md5("markdown").alias("body"))


@query(
    "s06_syllabus_csv", "S5 S6 A5",
    """SELECT conv_id || '-' || turn AS case_id, conv_id::VARCHAR AS sample_id, md5(text || CASE WHEN turn % 2 = 0 THEN '|step' ELSE '' END) AS evidence, CASE WHEN conv_id % 3 = 0 THEN 'train' ELSE 'test' END AS original_split FROM conversations WHERE turn % 4 <> 3""",
)
def s06(spark, d):
    """Turns as rows of two CSV files; one in four has no answer."""
    c, turn = table(spark, d, "conversations"), F.col("turn")
    none = F.lit(None).cast("string")
    rows = c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("id"), F.col("conv_id").cast("string").alias("syllabus_name"), F.when(turn % 4 == 3, "no answer").otherwise("multi").alias("question_type"), F.lit("q").alias("question"), F.lit("a").alias("answer"),
        F.col("text").alias("answer_span_1"), *(none.alias(f"answer_span_{i}") for i in range(2, 6)), F.when(turn % 2 == 0, "step").alias("reasoning_step_1"), F.col("text").alias("reasoning_step_2"), *(none.alias(f"reasoning_step_{i}") for i in range(3, 6)), "conv_id",
    )
    path = scratch_path(spark, "syllabus")
    for name, which in (("train", "conv_id % 3 = 0"), ("test", "conv_id % 3 <> 0")):
        rows.where(which).drop("conv_id").write.option("header", "true").option("quoteAll", "true").option("escape", '"').option("emptyValue", "").csv(f"{path}/{name}.csv")
    back = datasets.csv_rows(spark, f"{path}/*.csv", adapters.SYLLABUS)
    out = adapters.syllabus(back).join(back.select(F.col("id").alias("case_id"), "original_split"), "case_id")
    return out.select("case_id", "sample_id", F.md5(F.array_join("evidence", "|")).alias("evidence"), "original_split")


@query(
    "s07_open_domain", "S7 A6",
    "SELECT doc_id::VARCHAR AS sample_id, md5(text) AS evidence, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS golds, source AS title FROM documents WHERE text IS NOT NULL",
)
def s07_open(spark, d):
    """A line a document, some twice, and lines that are cut off."""
    docs = table(spark, d, "documents").where("text is not null")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("input"), F.array(F.struct(F.col("source").alias("title"), F.lit("t").alias("text"))).alias("passages"),
        F.array(F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ").alias("answer"), F.array("text").alias("selected_sentences"))).alias("output"),
    )
    lines = _text(rows, "*")
    path = _lines(spark, lines.unionByName(lines.where(F.crc32("value") % 5 == 0)).unionByName(docs.select(F.lit('{"id": "cut').alias("value"))), "open")
    out = adapters.open_domain(datasets.first_per_id(datasets.json_lines(spark, path, adapters.OPEN_DOMAIN).where("id is not null"), "id", "input"))
    return out.select("sample_id", F.md5(F.array_join("evidence", "")).alias("evidence"), F.array_join("golds", "|").alias("golds"), "title")


@query("s09_legal_spans", "S9 A7", "SELECT 'f' || doc_id AS sample_id, substr(text, 4, 7) AS evidence, CASE WHEN doc_id % 2 = 0 THEN 'maud' ELSE 'cuad' END AS category FROM documents WHERE length(text) > 12")
def s09_legal(spark, d):
    docs = table(spark, d, "documents").where("length(text) > 12")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    snippet = F.struct(name.alias("file_path"), F.array(F.lit(3), F.lit(10)).alias("span"), F.lit("?").alias("answer"))
    files = docs.select(F.when(F.col("doc_id") % 2 == 0, "maud").otherwise("cuad").alias("subset"), F.array(F.struct(F.lit("q").alias("query"), F.array(snippet).alias("snippets"))).alias("tests"), F.monotonically_increasing_id().alias("n"))
    # each document is a test file of its own, so its place is told apart by the file
    t = files.select(F.concat_ws("/", "subset", F.col("n").cast("string")).alias("subset"), "tests")
    out = adapters.legal(t, docs.select(name.alias("path"), "text"))
    return out.select("sample_id", F.col("evidence")[0].alias("evidence"), F.substring_index("category", "/", 1).alias("category"))


@query("s10_corpus_nodes", "S10 S11", "SELECT conv_id AS doc_id, turn::INT AS seq, conv_id % 500 IN (SELECT vec_id FROM embeddings) AND turn = 0 AS has_vector FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)")
def s10_nodes(spark, d):
    """Conversations as corpora of a node a turn, written as JSON and read back; the first node has a vector by an id-map."""
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("turn").cast("string").alias("id"), F.col("role").alias("title"), F.array("text").alias("paragraphs")))).alias("nodes"))
    c = c.select("doc_id", F.lit("s").alias("source_name"), F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), n["title"].alias("title"), n["paragraphs"].alias("paragraphs"))).alias("nodes"))
    back = datasets.json_lines(spark, _lines(spark, _text(c, "*"), "corpora"), "doc_id long, source_name string, nodes array<struct<id:string,title:string,paragraphs:array<string>>>")
    nodes = datasets.corpus_nodes(back).select("doc_id", F.lit("n").alias("node_id"), F.col("seq").alias("p_idx"))
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding")
    ids = nodes.where("p_idx = 0").select("doc_id", "node_id", "p_idx", (F.col("doc_id") % 500).alias("row"))
    return datasets.with_vectors(nodes, ids, vec).select("doc_id", F.col("p_idx").alias("seq"), F.col("embedding").isNotNull().alias("has_vector"))


@query("s12_event_log", "S12", "SELECT event_id, user_id::VARCHAR AS query_id, event_type AS event FROM events WHERE user_id IN (SELECT item_id FROM benchmark)")
def s12(spark, d):
    """Events as a log of JSON lines, with lines that can't be read between them; only queries of the benchmark's ids."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("event"))
    path = _lines(spark, _text(e, "*").unionByName(e.select(F.lit("{not json").alias("value"))).unionByName(e.select(F.lit('{"event": "x"}').alias("value"))), "log")
    return datasets.event_log(spark, path, "event_id long, query_id string, event string", table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id")))


@query("s13_results", "S13", "SELECT doc_id::VARCHAR AS question, (doc_id * 3)::VARCHAR AS answer FROM documents")
def s13(spark, d):
    """Results in files of about a hundred, each question answered twice; the second answer counts."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(F.floor(i / 100).alias("file"), i.cast("string").alias("question"), F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit("first").alias("answer")), F.struct(F.lit(2).alias("k"), (i * 3).cast("string").alias("answer")))).alias("x"))
    files = docs.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("x.k", "question", "x.answer"))), lambda r: F.struct(r["question"].alias("question"), r["answer"].alias("answer"))).alias("results"))
    path = _lines(spark, _text(files.repartition(8, "file"), "results"), "results")
    rows = datasets.json_lines(spark, path, "results array<struct<question:string,answer:string>>").select(F.posexplode("results").alias("place", "r")).select("place", "r.*")
    return datasets.last_per_id(rows, "question", "place").select("question", "answer")


@query("s14_document_inventory", "S14", "SELECT kind, count(*)::BIGINT AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'md' WHEN doc_id % 3 = 1 THEN 'pdf' ELSE 'missing' END AS kind FROM documents) GROUP BY kind")
def s14(spark, d):
    """A listing with Markdown for a third of the documents, PDF for two thirds, and neither for the rest."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_name"))
    of = lambda which, end: docs.where(which).select(F.concat(F.lit("/docs/"), "doc_name", F.lit(end)).alias("path"))
    files = of("doc_id % 3 = 0", ".md").unionByName(of("doc_id % 3 < 2", ".pdf")).unionByName(of("doc_id % 3 = 2", ".txt"))
    return datasets.inventory(docs, files).groupBy("kind").agg(F.count("*").alias("n"))


@query("s16_split_files", "S15 S16", "SELECT split, conv_id AS doc_id, count(*)::BIGINT AS n FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'train' ELSE 'dev' END AS split FROM conversations) GROUP BY ALL")
def s16(spark, d):
    """Conversations with the turns of a split alone, written in a folder a split and read back."""
    c = table(spark, d, "conversations")
    q = c.select(F.col("conv_id").alias("doc_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), "text")
    split = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), F.when(F.col("turn") % 2 == 0, "train").otherwise("dev").alias("split"))
    path = scratch_path(spark, "splits")
    datasets.write_splits(c.select(F.col("conv_id").alias("doc_id")).distinct().withColumn("title", F.lit("t")), q, split, path)
    back = spark.read.schema("doc_id long, title string, qa array<struct<case_id:string,text:string>>, split string").json(path)
    return back.select("split", "doc_id", F.size("qa").cast("long").alias("n"))


@query("s17_report_upsert", "S17", "SELECT source AS section, m AS metric, CASE WHEN m = 'n' THEN count(*) * 10 ELSE sum(n_chars) END::BIGINT AS value FROM documents, (VALUES ('n'), ('chars')) v(m) GROUP BY source, m")
def s17(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    old = g.select(F.col("source").alias("section"), F.explode(F.create_map(F.lit("n"), "n", F.lit("chars"), "chars")).alias("metric", "value"))
    return datasets.upserted(old, g.select(F.col("source").alias("section"), F.lit("n").alias("metric"), (F.col("n") * 10).alias("value")))


@query("s18_ingest", "S18", "SELECT source, min(doc_id) AS ignored, max(doc_id) AS replaced FROM documents GROUP BY source")
def s18(spark, d):
    """Insert or ignore keeps the first row of a key, insert or replace the last."""
    docs = table(spark, d, "documents").select("source", "doc_id")
    first = datasets.first_per_id(docs, "source", "doc_id").withColumnRenamed("doc_id", "ignored")
    return first.join(datasets.last_per_id(docs, "source", "doc_id").withColumnRenamed("doc_id", "replaced"), "source")


@query("s20_merged_shards", "S20", "SELECT doc_id AS global_index, doc_id::VARCHAR AS answer FROM documents WHERE doc_id % 7 <> 0")
def s20(spark, d):
    """Three shards that overlap, under one folder; rows without an answer are left out."""
    docs, path = table(spark, d, "documents").select("doc_id"), scratch_path(spark, "shards")
    for k in range(3):
        own = docs.where(f"doc_id % 3 = {k} or doc_id % 5 = 0")
        _text(own.select(F.col("doc_id").alias("global_index"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("answer")), "*").write.text(f"{path}/part{k}")
    return datasets.merged_shards(spark, f"{path}/part*", "global_index long, answer string")


@query("a09_subset", "A9 A11", "SELECT conv_id AS doc_id, count(*)::BIGINT AS n FROM conversations WHERE turn % 5 = 1 GROUP BY conv_id")
def a09(spark, d):
    """Conversations with every fifth turn alone; those without one go."""
    c = table(spark, d, "conversations")
    case = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.collect_list(F.struct(case.alias("case_id"))).alias("qa"))
    kept = adapters.subset(docs, c.where("turn % 5 = 1").select(case.alias("case_id")))
    there, _ = adapters.required_documents(c.where("turn % 5 = 1").select(F.col("conv_id").alias("title")), docs.select(F.col("doc_id").alias("title")).distinct())
    return kept.join(there.select(F.col("title").alias("doc_id")), "doc_id").select("doc_id", F.size("qa").cast("long").alias("n"))


@query("a12_plain_answers", "A12", r"SELECT conv_id, turn, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS answer FROM conversations")
def a12(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(adapters.plain_answer(F.concat(F.lit(" \n"), "text", F.lit("\t")))).alias("answer"))


@query(
    "d19_contract_markdown", "D19",
    r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS l, source FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, source, array_to_string(list_transform(l, lambda x: CASE WHEN x = '' THEN x WHEN length(x) > 3 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') THEN '## ' || x WHEN regexp_matches(x, '(?i)^(article|section)\s+\S+') THEN '### ' || x
 WHEN regexp_matches(x, '^\d+(\.\d+)*\.?\s+\S') THEN '### ' || x WHEN regexp_matches(x, '^\([a-z0-9]+\)\s') THEN '- ' || x ELSE x END), chr(10)) AS b FROM l)
SELECT doc_id, md5('# ' || source || chr(10) || chr(10) || trim(regexp_replace(b, '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS body FROM m""",
)
def d19(spark, d):
    return adapters.contract_markdown(table(spark, d, "documents").where("text is not null").select("doc_id", F.col("source").alias("title"), "text")).select("doc_id", F.md5("markdown").alias("body"))


@query(
    "d18_wiki_contents", "D18",
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(source || ' Contents (  hide ) ' || text || ' ## more', '\s+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, regexp_replace(regexp_replace(t, 'Contents\s*\(\s*hide\s*\)', '## Contents ( hide )' || chr(10), 'g'), '\s*## ', chr(10) || chr(10) || '## ', 'g') AS t FROM t)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10)) AS body FROM u""",
)
def d18_contents(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(adapters.wiki_markdown(F.concat("source", F.lit(" Contents (  hide ) "), "text", F.lit(" ## more")))).alias("body"))


# --- canonical cases of the other sets --------------------------------------------------------------------------------


@query(
    "a08_canonical_cases", "A8",
    """WITH t AS (SELECT conv_id, turn, role || ': ' || text AS said FROM conversations), c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT 'conversation' AS kind, c.conv_id || '#' || c.turn AS case_id, c.conv_id::VARCHAR AS source_id, md5(c.text) AS gold, md5(coalesce(t.said, (c.turn + 1)::VARCHAR) || '|none') AS excerpts, (c.turn % 6)::VARCHAR AS category FROM conversations c LEFT JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn + 1 WHERE c.turn % 6 <> 5
UNION ALL SELECT 'papers', 'q' || doc_id, doc_id::VARCHAR, md5(CASE WHEN doc_id % 4 = 0 THEN 'Not mentioned；' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN source || '; b' ELSE 'free' END), md5(source), 'x' FROM documents WHERE text IS NOT NULL AND doc_id % 8 <> 0
UNION ALL SELECT 'hops', conv_id::VARCHAR, conv_id::VARCHAR, md5('a'), md5(t[1] || CASE WHEN len(t) > 1 THEN '|' || t[2] ELSE '' END), 'k' FROM c
UNION ALL SELECT 'syllabus', conv_id || '-' || turn, conv_id::VARCHAR, md5('a'), md5(text || CASE WHEN turn % 2 = 0 THEN '|step' ELSE '' END), 'multi' FROM conversations WHERE turn % 4 <> 3
UNION ALL SELECT 'open', doc_id::VARCHAR, doc_id::VARCHAR, md5(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END), md5(text), 'x' FROM documents WHERE text IS NOT NULL""",
)
def a08(spark, d):
    """Conversations, papers, multi-hop, syllabus and open questions as rows of one shape."""
    c, turn, docs = table(spark, d, "conversations"), F.col("turn"), table(spark, d, "documents").where("text is not null")
    sample, none = F.col("conv_id").cast("string").alias("sample_id"), F.lit(None).cast("string")
    qa = c.select(sample, turn.cast("int").alias("place"), F.lit("?").alias("question"), F.col("text").alias("answer"), F.array(F.concat((turn + 1).cast("string"), F.lit(" ; none"))).alias("evidence"), (turn % 6).cast("int").alias("category"))
    sets = {"conversation": (adapters.conversation_qa(qa, c.select(sample, turn.cast("string").alias("dia_id"), F.col("role").alias("speaker"), "text")), None)}
    sets["papers"] = (adapters.papers(_papers(spark, d)).withColumn("category", F.lit("x")), F.col("question_id"))
    hops = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t")).select(
        F.col("conv_id").cast("string").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("k").alias("type"), F.lit("l").alias("level"), F.struct(F.array(F.lit("A")).alias("title"), F.array("t").alias("sentences")).alias("context"),
        F.struct(F.array(F.lit("A"), F.lit("A")).alias("title"), F.array(F.lit(0), F.lit(1)).alias("sent_id")).alias("supporting_facts"),
    )
    sets["hops"] = (adapters.multi_hop(hops), F.col("sample_id"))
    rows = c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("id"), F.col("conv_id").cast("string").alias("syllabus_name"), F.when(turn % 4 == 3, "no answer").otherwise("multi").alias("question_type"), F.lit("q").alias("question"), F.lit("a").alias("answer"),
        F.col("text").alias("answer_span_1"), *(none.alias(f"answer_span_{i}") for i in range(2, 6)), F.when(turn % 2 == 0, "step").alias("reasoning_step_1"), *(none.alias(f"reasoning_step_{i}") for i in range(2, 6)),
    )
    sets["syllabus"] = (adapters.syllabus(rows), F.col("case_id"))
    said = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("input"), F.array(F.struct(F.col("source").alias("title"), F.lit("t").alias("text"))).alias("passages"),
                       F.array(F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ").alias("answer"), F.array("text").alias("selected_sentences"))).alias("output"))
    sets["open"] = (adapters.open_domain(said).withColumn("category", F.lit("x")), F.col("sample_id"))
    out = None
    for kind, (samples, own) in sets.items():
        rows = adapters.canonical_cases(samples, own).select(F.lit(kind).alias("kind"), "case_id", "source_id", F.md5("gold").alias("gold"), F.md5(F.array_join("excerpts", "|")).alias("excerpts"), "category")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s04_multi_hop_joined", "S4", "SELECT conv_id::VARCHAR AS sample_id, role AS title, (n - 1)::INT AS sent_id, md5(text) AS sentence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n <= 2")
def s04_joined(spark, d):
    """Facts looked up in the contexts as a table of their own: what each role says is an article, its first two sentences are facts."""
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    c = c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("role", "t"))).alias("l"))
    names = F.transform("l", lambda x: x["role"])
    facts = F.struct(F.concat(names, names, names).alias("title"), F.flatten(F.array(*(F.array_repeat(F.lit(k), F.size("l")) for k in (0, 1, 9999)))).alias("sent_id"))
    rows = c.select("id", F.struct(names.alias("title"), F.transform("l", lambda x: x["t"]).alias("sentences")).alias("context"), facts.alias("supporting_facts"))
    path = scratch_path(spark, "hops")
    _text(rows, "*").write.text(path)
    back = datasets.json_lines(spark, path, "id string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>")
    return adapters.multi_hop_joined(back).withColumn("sentence", F.md5("sentence"))


@query("s13_result_files", "S13", "SELECT doc_id::VARCHAR AS question, (doc_id * 3)::VARCHAR AS answer FROM documents")
def s13_files(spark, d):
    """Result files of one object each, whose list `results` answers each question twice; the second answer counts."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(F.floor(i / 2000).alias("file"), i.cast("string").alias("question"), F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit("first").alias("answer")), F.struct(F.lit(2).alias("k"), (i * 3).cast("string").alias("answer")))).alias("x"))
    files = docs.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("x.k", "question", "x.answer"))), lambda r: F.struct(r["question"].alias("question"), r["answer"].alias("answer"))).alias("results"))
    path = scratch_path(spark, "results")
    files.select("file", F.concat(F.lit("{\n"), F.substr(F.to_json(F.struct("results")), F.lit(2))).alias("value")).write.partitionBy("file").text(path)
    return datasets.results(spark, path, "struct<question:string,answer:string>").select("question", "answer")
