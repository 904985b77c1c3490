"""Queries over column functions and document structuring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.text import answer_tokens, bounded_top_k, chunk_id, clip, content_tokens, is_refusal, json_object, judge_score, literal_key, request_key, title_parts, tokens
from quarry.operators.structuring import conversation_markdown, markdown_nodes, markdown_paragraphs
from quarry.plans.documents import LINES, MADE
from quarry.plans.register import query
from quarry.plans.retrieval import PAGE, PAR, TOK, _pages, _par
from quarry.sources.tables import table


DOCUMENT_LINES = LINES.replace(MADE, "md AS (SELECT doc_id, text FROM documents)")


@query("d12_paragraphs", "D12 D13 F1 F2", f"WITH {PAR} SELECT doc_id, p_idx::INT AS p_idx, len({TOK.format('text')})::INT AS n_tokens, md5(trim(text, ' ')) AS text_md5 FROM par")
def d12(spark, d):
    return _par(spark, d).select("doc_id", "p_idx", F.size(tokens("text")).alias("n_tokens"), F.md5(F.trim("text")).alias("text_md5"))


@query(
    "d10_outline_census", "D10 D26 D27 D31",
    f"""WITH {PAR} SELECT coalesce(source, '*') AS source, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_paragraphs, sum(len({TOK.format('par.text')}))::BIGINT AS n_tokens
FROM par JOIN documents USING (doc_id) GROUP BY ROLLUP (source)""",
)
def d10(spark, d):
    par = _par(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return par.withColumn("n", F.size(tokens("text"))).rollup("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_paragraphs"), F.sum("n").alias("n_tokens")).select(F.coalesce("source", F.lit("*")).alias("source"), "n_docs", "n_paragraphs", "n_tokens")


@query("d31_vector_census", "D31 S11", "SELECT label, count(*)::BIGINT AS n_rows, sum(len(embedding) * 4)::BIGINT AS n_bytes FROM embeddings GROUP BY label")
def d31(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n_rows"), F.sum(F.size("embedding") * 4).alias("n_bytes"))


@query("d11_unambiguous_lines", "D11", f"WITH {PAR} SELECT md5(text) AS k, min(doc_id) AS doc_id FROM par GROUP BY text HAVING count(DISTINCT doc_id) = 1")
def d11(spark, d):
    g = _par(spark, d).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    return g.where("doc_id = last").select(F.md5("text").alias("k"), "doc_id")


@query("d24_first_of_equal", "D24 J4", "SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def d24(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(
    "d18_wiki_to_markdown", "",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g'), '\. ', '.' || chr(10) || chr(10) || '## ', 'g')) AS md FROM documents""",
)
def d18(spark, d):
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"\n+", "\n"), r"\. ", ".\n\n## ")
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("md"))


@query(
    "d20_conversation_markdown", "D20",
    "SELECT conv_id, count(*)::BIGINT AS n, md5('# Chat History' || chr(10) || string_agg('## Turn ' || turn || chr(10) || '**' || role || '**: ' || text || ' [' || conv_id || ':' || turn || ']', chr(10) ORDER BY turn)) AS md FROM conversations GROUP BY conv_id",
)
def d20(spark, d):
    return conversation_markdown(table(spark, d, "conversations")).select("conv_id", "n", F.md5("markdown").alias("md"))


@query(
    "d01_parse_markdown", "D1 D2 D4",
    "SELECT conv_id, count(*)::BIGINT + 1 AS n_nodes, count(*)::BIGINT AS n_children, min(turn)::BIGINT AS first_turn FROM conversations GROUP BY conv_id",
)
def d01(spark, d):
    """Parses the Markdown of each conversation back: a node for the title and one below it for each turn."""
    nodes = markdown_nodes(conversation_markdown(table(spark, d, "conversations")).select(F.col("conv_id").alias("doc_id"), F.col("markdown").alias("text")))
    turn = F.min(F.regexp_extract("title", "Turn ([0-9]+)", 1).try_cast("long"))
    return nodes.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("parent_id").isNotNull()).alias("n_children"), turn.alias("first_turn"))


@query(
    "d05_markdown_paragraphs", "D5 D6",
    rf"""WITH {DOCUMENT_LINES} SELECT doc_id, kind, count(DISTINCT block)::BIGINT AS n_blocks, count(*)::BIGINT AS n_lines FROM n WHERE kind NOT IN ('blank', 'heading') GROUP BY ALL""",
)
def d05(spark, d):
    p = markdown_paragraphs(table(spark, d, "documents"))
    return p.groupBy("doc_id", "kind").agg(F.count("*").alias("n_blocks"), F.sum("n_lines").alias("n_lines"))


@query(
    "d23_safe_names", "D23 D25",
    rf"WITH {PAGE} SELECT regexp_replace(lower(title), '[^a-z]+', '_', 'g') AS name, count(*)::BIGINT AS n, left(sha1(array_to_string(list_sort(list(page_id::VARCHAR)), '|')), 16) AS key FROM pg GROUP BY 1 HAVING count(*) > 1",
)
def d23(spark, d):
    name = F.regexp_replace(F.lower("title"), "[^a-z]+", "_")
    g = _pages(spark, d).groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col("page_id").cast("string"))).alias("ids"))
    return g.where("n > 1").select("name", "n", F.left(F.sha1(F.array_join("ids", "|").cast("binary")), F.lit(16)).alias("key"))


ANSWER_TOKENS = r"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(translate(lower(replace(text, ',', '')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the', 'and')), ' ') AS answer,
len(regexp_extract_all(lower(text), '[a-z]+|[0-9]+'))::INT AS n_parts FROM documents"""


@query("f04_answer_tokens", "F3 F4", ANSWER_TOKENS)
def f04(spark, d):
    head = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(answer_tokens(head), " ").alias("answer"), F.size(title_parts(head)).alias("n_parts"))


@query("f04_whole_answer_tokens", "F4", ANSWER_TOKENS)
def f04_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(answer_tokens("text"), " ").alias("answer"), F.size(title_parts("text")).alias("n_parts"))


@query(
    "f05_f08_scalars", "F5 F7 F8",
    r"""SELECT conv_id, turn, regexp_matches(lower(text), 'not mentioned|no information|cannot be answered|none|unknown|don''t know') AS refusal,
CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) > 60 THEN left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 59) || '…' ELSE trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') END AS clipped,
left(sha1(text), 16) AS key, sha256(text) AS digest, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS literal FROM conversations""",
)
def f05(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", is_refusal("text").alias("refusal"), clip("text", 60).alias("clipped"), F.left(F.sha1(F.col("text").cast("binary")), F.lit(16)).alias("key"), F.sha2("text", 256).alias("digest"), F.md5(literal_key("text")).alias("literal"))


@query(
    "f09_request_keys", "F9 F10 F11",
    r"""SELECT event_id, event_type || '|doc=' || (user_id % 7) || '|query=' || lower(event_type || ' ' || regexp_extract(props, '[0-9]+')) AS key,
(user_id % 7) || '/' || event_type || '/' || regexp_extract(props, '[0-9]+') AS chunk, greatest(1, least(coalesce(TRY_CAST(regexp_extract(props, '[0-9]+') AS INT), 2), 10))::INT AS top_k FROM events""",
)
def f09(spark, d):
    k = F.regexp_extract("props", "[0-9]+", 0)
    doc = (F.col("user_id") % 7).cast("string")
    args = F.create_map(F.lit("query"), F.concat(F.lit("  "), F.upper("event_type"), F.lit("   "), k), F.lit("doc"), doc, F.lit("top_k"), k)
    return table(spark, d, "events").select("event_id", request_key(F.col("event_type"), args).alias("key"), chunk_id(doc, F.col("event_type"), k, F.lit("0")).alias("chunk"), bounded_top_k(k, 2, 10).alias("top_k"))


@query(
    "f13_judge_parse", "F13 F14",
    r"""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Fine. {"score": ' || (doc_id % 7) || '}' WHEN 1 THEN 'the score is ' || (doc_id % 6) || ' of 4' WHEN 2 THEN 'no verdict' ELSE '{"score": "' || (doc_id % 7) || '"}' END AS reply FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 4 = 3 THEN least(4, doc_id % 7) ELSE coalesce(TRY_CAST(nullif(regexp_extract(reply, '"score"\s*:\s*([0-4])', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(reply, '\b([0-4])\b', 1), '') AS INT), 0) END::INT AS score FROM r)
SELECT doc_id, score, CASE WHEN score = 4 THEN 4 ELSE 0 END AS two_way, CASE WHEN doc_id % 4 IN (0, 3) THEN regexp_extract(reply, '\{.*\}') ELSE '' END AS object FROM s""",
)
def f13(spark, d):
    i = F.col("doc_id")
    reply = F.when(i % 4 == 0, F.concat(F.lit('Fine. {"score": '), i % 7, F.lit("}"))).when(i % 4 == 1, F.concat(F.lit("the score is "), i % 6, F.lit(" of 4"))).when(i % 4 == 2, "no verdict").otherwise(F.concat(F.lit('{"score": "'), i % 7, F.lit('"}')))
    r = table(spark, d, "documents").select("doc_id", reply.alias("reply"))
    return r.select("doc_id", judge_score("reply").alias("score"), judge_score("reply", two_way=True).alias("two_way"), F.coalesce(json_object("reply"), F.lit("")).alias("object"))


@query(
    "f16_periods", "",
    r"""SELECT o_orderkey, year(o_orderdate)::INT AS y, 'Q' || quarter(o_orderdate) AS q, CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' WHEN o_orderpriority LIKE '2%' THEN '10-Q' ELSE '8-K' END AS form, month(o_orderdate)::INT AS m, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE day(o_orderdate) END::INT AS day, o_orderkey % 3 = 0 OR day(o_orderdate) = 15 AS on_15th FROM orders""",
)
def f16(spark, d):
    """Facets are parsed back from a made-up file name that each order gives."""
    o, date = table(spark, d, "orders"), F.col("o_orderdate")
    form = F.when(F.col("o_orderpriority").startswith("1"), "10K").when(F.col("o_orderpriority").startswith("2"), "10Q").otherwise("8K")
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(date, "yyyy-MM")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    named = o.select("o_orderkey", F.concat(F.lit("ACME_"), F.year(date), F.lit("Q"), F.quarter(date), F.lit("_"), form, F.lit("_dated-"), day).alias("name"))
    got = lambda p, g=1: F.regexp_extract("name", p, g)
    parsed = named.select("o_orderkey", got("_(20[0-9]{2}|19[0-9]{2})Q").cast("int").alias("y"), got("(Q[1-4])").alias("q"), F.when(F.col("name").rlike("10K"), "10-K").when(F.col("name").rlike("10Q"), "10-Q").otherwise("8-K").alias("form"),
                          got("dated-[0-9]{4}-([0-9]{2})").cast("int").alias("m"), F.coalesce(F.nullif(got("dated-[0-9]{4}-[0-9]{2}-([0-9]{2})"), F.lit("")).cast("int"), F.lit(0)).alias("day"))
    return parsed.withColumn("on_15th", F.col("day").isin(0, 15))


@query(
    "f22_content_tokens", "",
    r"""SELECT item_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS n_words, regexp_matches(lower(text), 'tion') AS tag_tion, regexp_matches(text, '[0-9]') AS tag_number, len(list_filter(regexp_split_to_array(text, '\.\s+'), lambda x: x <> ''))::INT AS n_steps FROM benchmark""",
)
def f22(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("n_words"), F.lower("text").rlike("tion").alias("tag_tion"), F.col("text").rlike("[0-9]").alias("tag_number"), F.size(F.filter(F.split("text", r"\.\s+"), lambda x: x != "")).alias("n_steps"))


@query("f22_stems", "F22")
def f22b(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(content_tokens("text"), " ").alias("stems"))


@query(
    "a02_resolve_evidence", "J2",
    """WITH e AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) || '; ' || conv_id || ':' || (turn + 50) AS ev FROM conversations WHERE turn > 0),
x AS (SELECT conv_id, turn, unnest(string_split(ev, '; ')) AS id, unnest([0, 1]) AS pos FROM e)
SELECT x.conv_id, x.turn, md5(string_agg(coalesce(c.role || ': ' || c.text, x.id), chr(10) ORDER BY pos)) AS evidence FROM x LEFT JOIN conversations c ON x.id = c.conv_id || ':' || c.turn GROUP BY ALL""",
)
def a02(spark, d):
    """Evidence written as turn ids is looked up; an id that isn't there stays."""
    c = table(spark, d, "conversations")
    key = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    e = c.where("turn > 0").select("conv_id", "turn", F.concat_ws("; ", key(F.col("turn") - 1), key(F.col("turn") + 50)).alias("ev"))
    x = e.select("conv_id", "turn", F.posexplode(F.split("ev", r"\s*;\s*")).alias("pos", "id"))
    said = c.select(key(F.col("turn")).alias("id"), F.concat_ws(": ", "role", "text").alias("said"))
    got = x.join(said, "id", "left").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("said", "id").alias("t")))).alias("e"))
    return got.select("conv_id", "turn", F.md5(F.array_join(F.transform("e", lambda x: x["t"]), "\n")).alias("evidence"))


@query(
    "a05_gold_evidence", "",
    """SELECT o_orderkey AS case_id, count(*)::BIGINT AS n_lines, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), '; ') AS gold, count(DISTINCT l_partkey)::BIGINT AS n_evidence
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING NOT bool_and(l_returnflag = 'N')""",
)
def a05(spark, d):
    """Orders as questions: lines as answers, those without any flag as unanswerable, which are dropped when all are."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_returnflag", "l_linestatus", "l_partkey")).alias("lines"))  # noqa: E741
    c = table(spark, d, "orders").select("o_orderkey").join(l, "o_orderkey").where(~F.forall("lines", lambda x: x["l_returnflag"] == "N"))
    gold = F.array_sort(F.array_distinct(F.transform("lines", lambda x: F.concat(x["l_returnflag"], x["l_linestatus"]))))
    return c.select(F.col("o_orderkey").alias("case_id"), F.size("lines").cast("long").alias("n_lines"), F.array_join(gold, "; ").alias("gold"), F.size(F.array_distinct(F.transform("lines", lambda x: x["l_partkey"]))).cast("long").alias("n_evidence"))


@query(
    "a10_prompts", "A10",
    f"""WITH {PAR}, h AS (SELECT item_id, p_idx, left(par.text, 2000) AS t FROM benchmark JOIN par ON par.doc_id = item_id WHERE p_idx < 3)
SELECT item_id, count(t)::BIGINT AS n_blocks, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY p_idx), '') || chr(10) || 'Question: ' || any_value(b.text)) AS prompt FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY item_id""",
)
def a10(spark, d):
    b = table(spark, d, "benchmark")
    h = _par(spark, d).where("p_idx < 3").select(F.col("doc_id").alias("item_id"), F.struct("p_idx", F.left("text", F.lit(2000)).alias("t")).alias("block"))
    g = h.groupBy("item_id").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    blocks = F.coalesce(F.transform("blocks", lambda x: x["t"]), F.array().cast("array<string>"))
    return b.join(g, "item_id", "left").select("item_id", F.size(blocks).cast("long").alias("n_blocks"), F.md5(F.concat(F.array_join(blocks, "\n\n"), F.lit("\nQuestion: "), F.col("text"))).alias("prompt"))


#: How questions are asked, what to say without an answer, and what is added to those of a category.
MISSING_RULE = "If no information is available to answer the question, write 'Not mentioned'."
SHORT_ANSWER = "Based on the above context, write an answer in the form of a short phrase for the following question. Answer with exact words from the context whenever possible.\n\nQuestion: {} Short answer:\n"
BY_CATEGORY = {"2": " Use DATE of CONVERSATION to answer with an approximate date."}
_SQL_TEXT = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_ASK = SHORT_ANSWER.split("{}")


@query(
    "a10_category_prompts", "A10",
    f"""WITH {PAR}, h AS (SELECT item_id, p_idx, left(par.text, 2000) AS t FROM benchmark JOIN par ON par.doc_id = item_id WHERE p_idx < 3),
p AS (SELECT item_id, any_value(b.text) AS q, string_agg(t, chr(10) || chr(10) ORDER BY p_idx) AS c FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY item_id)
SELECT item_id, md5(coalesce(c, '') || chr(10) || chr(10) || {_SQL_TEXT(MISSING_RULE)} || chr(10) || chr(10) || {_SQL_TEXT(_ASK[0])} || q || CASE WHEN item_id % 5 = 2 THEN {_SQL_TEXT(BY_CATEGORY["2"])} ELSE '' END || {_SQL_TEXT(_ASK[1])}) AS prompt FROM p""",
)
def a10_category(spark, d):
    """Context, what to say without an answer, and the question with its category's instruction."""
    b = table(spark, d, "benchmark").withColumn("category", (F.col("item_id") % 5).cast("string"))
    rules = spark.createDataFrame(list(BY_CATEGORY.items()), "category string, more string")
    h = _par(spark, d).where("p_idx < 3").select(F.col("doc_id").alias("item_id"), F.struct("p_idx", F.left("text", F.lit(2000)).alias("t")).alias("block"))
    g = h.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("block")), lambda x: x["t"]), "\n\n").alias("context"))
    asked = F.concat(F.lit(_ASK[0]), "text", F.coalesce("more", F.lit("")), F.lit(_ASK[1]))
    out = b.join(g, "item_id", "left").join(F.broadcast(rules), "category", "left")
    return out.select("item_id", F.md5(F.concat(F.coalesce("context", F.lit("")), F.lit(f"\n\n{MISSING_RULE}\n\n"), asked)).alias("prompt"))
