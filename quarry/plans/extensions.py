"""Queries over tool calls, registered functions, and the census of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import compact_result, instructions, leak_terms, truncated
from quarry.operators.rankers import gate_with, rank_with, register_gate, register_ranker, register_tool, search_with
from quarry.operators.retrieval import Weighed
from quarry.operators.tools import mine_tool_calls
from quarry.plans.register import query
from quarry.plans.retrieval import BM25, RANK, _pages, _par, _queries
from quarry.sources.tables import scratch_table, small, table


@query(
    "f15_tool_calls", "F15",
    "SELECT conv_id * 100 + turn AS id, 0 AS n, role AS tool, '{\"turn\": ' || turn || '}' AS args FROM conversations",
)
def f15(spark, d):
    """Calls are written into the turns and mined back."""
    c = table(spark, d, "conversations")
    call = F.concat("text", F.lit(" "), "role", F.lit('({"turn": '), F.col("turn").cast("string"), F.lit("})"))
    return mine_tool_calls(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), call.alias("text")), "id")


@query("f28_compact_results", "", "SELECT event_id, event_type AS tool, left(props, 300) AS result, left(regexp_extract(props, '[0-9]+'), 500) AS hit FROM events")
def f28(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("tool"), F.left("props", F.lit(300)).alias("result"), F.left(F.regexp_extract("props", "[0-9]+", 0), F.lit(500)).alias("hit"))


@query(
    "e21_routing_accuracy", "E21",
    f"""WITH {BM25}, dd AS (SELECT query_id, doc_id, max(score) AS score FROM bm GROUP BY ALL), r AS (SELECT *, {RANK.format('doc_id')} FROM dd),
g AS (SELECT item_id AS query_id, min(doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)
SELECT count(*)::BIGINT AS n, count(*) FILTER (rank = 1)::BIGINT AS top1, count(*) FILTER (rank <= 5)::BIGINT AS top5, round(avg(coalesce(1.0 / rank, 0)), 4)::DOUBLE AS mrr FROM g LEFT JOIN r ON g.query_id = r.query_id AND g.gold = r.doc_id""",
)
def e21(spark, d):
    from quarry.plans.sampling import p15

    par = _par(spark, d)
    gold = scratch_table(p15(spark, d).groupBy(F.col("item_id").alias("query_id")).agg(F.min("doc_id").alias("doc_id")), "gold")
    r = Weighed(par, _queries(spark, d)).places(gold, par.join(small(gold.select("doc_id").distinct()), "doc_id", "left_semi"))
    r = gold.join(r, "query_id", "left")
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank") <= 5).alias("top5"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))


@query("d28_tree_profile", "", "SELECT page_id, '- ' || regexp_extract(html, '<title>([^<]*)', 1) || ': ' || CASE WHEN length(url) > 30 THEN left(url, 30) || '...' ELSE url END AS line FROM pages")
def d28(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    short = F.when(F.length("url") > 30, F.concat(F.left("url", F.lit(30)), F.lit("..."))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("- "), title, F.lit(": "), short).alias("line"))


@query("u01_registered_ranker", "U1")
def u01(spark, d):
    register_ranker("shared_words", lambda q, name: len(set(q.lower().split()) & set(name.lower().split())))
    docs = _pages(spark, d).select(F.col("page_id").alias("doc_id"), F.col("title").alias("name"))
    return rank_with("shared_words", _queries(spark, d), docs, 3)


@query("u03_registered_gate", "U3", "SELECT item_id AS query_id, length(text) % 2 = 0 AND length(text) > 0 AS use_tool FROM benchmark")
def u03(spark, d):
    register_gate("even_length", lambda q, n: float(n % 2 == 0))
    return gate_with("even_length", _queries(spark, d).withColumn("n_results", F.length("query"))).select("query_id", "use_tool")


@query("u02_registered_tool", "U2", r"""WITH q AS (SELECT item_id AS query_id, item_id % 2 = 0 AS long FROM benchmark), p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS name FROM pages),
s AS (SELECT query_id, page_id, name, CASE WHEN long THEN length(name) ELSE greatest(0, 30 - length(name)) END::DOUBLE AS score FROM q, p)
SELECT query_id, page_id AS doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, page_id) AS rank FROM s WHERE score > 0) WHERE rank <= 3""")
def u02(spark, d):
    """A tool that ranks by length, or by brevity, as the query's capability asks."""
    register_tool("by_length", lambda q, name, capability: float(len(name) if capability == "long" else max(0, 30 - len(name))))
    docs = _pages(spark, d).select(F.col("page_id").alias("doc_id"), F.col("title").alias("name"))
    q = _queries(spark, d).withColumn("capability", F.when(F.col("query_id") % 2 == 0, "long").otherwise("short"))
    return search_with("by_length", q, docs, 3).select("query_id", "doc_id", "score", "rank")


@query("f28_compacted", "F28", r"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 299) END AS query, CASE WHEN turn % 3 = 0 THEN 0 WHEN turn % 3 = 1 THEN 3 ELSE -1 END::INT AS n_results, turn % 3 = 0 AS has_preview FROM conversations""")
def f28_compacted(spark, d):
    """Results with a query and four hits, with a query alone, and none that can be read."""
    hit = F.struct(F.lit(0.5).alias("score"), "text")
    turn, c = F.col("turn"), table(spark, d, "conversations")
    made = F.when(turn % 3 == 0, F.concat(F.lit("no json "), "text")).when(turn % 3 == 1, F.to_json(F.struct(F.lit(True).alias("ok"), F.col("text").alias("query"), F.array(hit, hit, hit, hit).alias("results")))).otherwise(F.to_json(F.struct(F.lit(True).alias("ok"), F.col("text").alias("query"))))
    r = c.select("conv_id", "turn", compact_result(made).alias("r"))
    return r.select("conv_id", "turn", F.left("r.query", F.lit(299)).alias("query"), F.when(turn % 3 == 0, 0).otherwise(F.coalesce(F.size("r.results"), F.lit(-1))).alias("n_results"), F.col("r.preview").isNotNull().alias("has_preview"))


@query("f24_truncated_vectors", "F24", "SELECT vec_id, 16 AS dims, round(e[1] / sqrt(list_inner_product(e, e)), 5) AS first FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS e FROM embeddings)")
def f24(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", truncated(F.col("embedding"), 16).alias("e"))
    return e.select("vec_id", F.size("e").alias("dims"), F.round(F.col("e")[0], 5).alias("first"))


@query("f25_leak_terms", "F25", "SELECT conv_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(string_agg(text, ' ' ORDER BY turn), ' '), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: length(x) >= 3 AND x <> 'block'))), ' ') AS terms FROM conversations GROUP BY conv_id")
def f25(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("t"))
    return g.select("conv_id", F.array_join(leak_terms(F.split("t", " ")), " ").alias("terms"))


@query("f26_instructions", "F26", "SELECT conv_id, count(*)::BIGINT AS n, md5(string_agg(trim(text, ' '), '|' ORDER BY turn)) AS parts FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id")
def f26(spark, d):
    """Turns written as a numbered list and split again."""
    c = table(spark, d, "conversations").where("trim(text) <> ''")
    item = F.concat(F.col("turn").cast("string"), F.lit(". "), "text")
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    parts = instructions("t")
    return g.select("conv_id", F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|")).alias("parts"))
