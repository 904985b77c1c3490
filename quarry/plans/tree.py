"""Queries over the sections of the documents' Markdown as a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import tree
from quarry.operators.markdown import FRONT, embedding_inputs, markdown_corpus, markdown_lines, unambiguous
from quarry.operators.retrieval import Weighed
from quarry.operators.routing import search_headings
from quarry.operators.sampling import verbatim
from quarry.operators.structuring import markdown_nodes
from quarry.plans.documents import LINES, _made
from quarry.plans.register import query
from quarry.plans.retrieval import BM25, HEADING, PARTS, RANK, _par, _queries
from quarry.sources.tables import scratch_table, table

SECTIONS = rf"""{LINES}, fr AS (SELECT doc_id, max((section = 0)::INT)::BIGINT AS f FROM n WHERE kind <> 'blank' GROUP BY doc_id),
hd AS (SELECT doc_id, (section + f)::INT AS node_id, CASE WHEN regexp_matches(t, '^\s*###') THEN 2 ELSE 1 END AS lv, trim(regexp_replace(t, '^\s*#+\s+', ''), ' ') AS title FROM n JOIN fr USING (doc_id) WHERE kind = 'heading'
 UNION ALL SELECT doc_id, 1, 1, '前言' FROM fr WHERE f = 1),
tr AS (SELECT *, node_id AS enter, coalesce(CASE WHEN lv = 1 THEN min(CASE WHEN lv = 1 THEN node_id END) OVER w ELSE min(node_id) OVER w END - 1, max(node_id) OVER (PARTITION BY doc_id)) AS leave,
 CASE WHEN lv = 2 THEN max(CASE WHEN lv = 1 THEN node_id END) OVER (PARTITION BY doc_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY node_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
pb AS (SELECT doc_id, section, block, any_value(kind) AS kind, string_agg(t, chr(10) ORDER BY i) AS x FROM n WHERE kind NOT IN ('blank', 'heading') GROUP BY doc_id, section, block),
pp AS (SELECT doc_id, (section + f)::INT AS node_id, (row_number() OVER (PARTITION BY doc_id, section ORDER BY block) - 1)::INT AS p_idx, kind,
 CASE WHEN kind = 'image' THEN trim(regexp_extract(x, '!\[([^\]]*)\]\(([^)]+)\)', 1), ' ') ELSE x END AS x FROM pb JOIN fr USING (doc_id)),
bd AS (SELECT doc_id, (section + f)::INT AS node_id, string_agg(t, chr(10) ORDER BY i) AS body FROM n JOIN fr USING (doc_id) WHERE section > 0 OR f = 1 GROUP BY doc_id, section, f)"""


def _tree(spark, d):
    """(nodes, corpus, bodies) of the documents' Markdown; its lines are made once."""
    docs = _made(spark, d)
    lines = scratch_table(markdown_lines(docs), "lines")
    corpus = scratch_table(markdown_corpus(docs, lines), "corpus")
    counts = corpus.groupBy("doc_id", "node_id").agg(F.count("*").cast("int").alias("n_paragraphs"))
    nodes = markdown_nodes(docs, front=FRONT, lines=lines).join(counts, ["doc_id", "node_id"], "left").fillna(0, ["n_paragraphs"])
    front = lines.where("section = 0 and kind <> 'blank'").select("doc_id").distinct().withColumn("f", F.lit(1))
    own = lines.join(front, "doc_id", "left").where("section > 0 or f = 1").groupBy("doc_id", (F.col("section") + F.coalesce("f", F.lit(0))).cast("int").alias("node_id"))
    bodies = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return scratch_table(tree.numbered(nodes), "nodes"), corpus.withColumn("node_id", F.col("node_id").cast("int")), bodies


@query(
    "r10_node_sections", "R10 J6",
    f"""WITH {SECTIONS}, ct AS (SELECT doc_id, node_id, count(*) AS k FROM pp GROUP BY ALL),
rq AS (SELECT tr.doc_id, tr.node_id, coalesce(k, 0) AS k, node_id % 4 - 1 AS s, CASE WHEN node_id % 3 = 0 THEN -1 ELSE node_id % 4 + 2 END AS e FROM tr LEFT JOIN ct USING (doc_id, node_id)),
ab AS (SELECT *, greatest(0, least(s, k)) AS a, least(CASE WHEN e = -1 THEN k ELSE e END, k) AS b FROM rq),
hh AS (SELECT ab.doc_id, ab.node_id, p_idx, CASE WHEN kind = 'image' THEN '[image_ocr]' || x || '[/image_ocr]' ELSE x END AS x FROM ab JOIN pp USING (doc_id, node_id) WHERE p_idx >= a AND p_idx < b AND trim(x, ' ') <> '')
SELECT rq.doc_id, rq.node_id, count(p_idx)::BIGINT AS n, md5(coalesce(string_agg(x, chr(10) ORDER BY p_idx), '')) AS body, true AS ok FROM rq LEFT JOIN hh USING (doc_id, node_id) GROUP BY rq.doc_id, rq.node_id
UNION ALL SELECT DISTINCT doc_id, -1, 0, md5(''), false FROM tr""",
)
def r10_nodes(spark, d):
    """A slice of every section, beyond its ends for some, and of one in each document that isn't there."""
    nodes, corpus, _ = _tree(spark, d)
    i = F.col("node_id")
    own = nodes.select("doc_id", "node_id").unionByName(nodes.select("doc_id").distinct().withColumn("node_id", F.lit(-1)))
    requests = own.select(F.struct("doc_id", "node_id").alias("request_id"), "doc_id", "node_id", (i % 4 - 1).alias("start"), F.when(i % 3 == 0, -1).otherwise(i % 4 + 2).alias("end"))
    hits = tree.read_sections(requests, nodes, corpus)
    parts = F.array_sort(F.collect_list(F.when(F.col("p_idx").isNotNull(), F.struct("p_idx", "text"))))
    return hits.groupBy("doc_id", "node_id", "ok").agg(F.count("p_idx").alias("n"), F.md5(F.array_join(F.transform(parts, lambda x: x["text"]), "\n")).alias("body"))


@query(
    "r11_node_neighbors", "R11",
    f"""WITH {SECTIONS} SELECT doc_id, node_id, p_idx, array_to_string(list(p_idx) OVER w, ',') AS places, md5(array_to_string(list(x) OVER w, chr(10))) AS context
FROM pp WINDOW w AS (PARTITION BY doc_id, node_id ORDER BY p_idx RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING)""",
)
def r11_nodes(spark, d):
    _, corpus, _ = _tree(spark, d)
    return tree.neighbors_in_section(corpus, 2, 1).select("doc_id", "node_id", "p_idx", F.array_join("paragraph_indexes", ",").alias("places"), F.md5("context").alias("context"))


def _heading_sql(asked: str) -> str:
    """asked: SELECT of (query_id, doc_id, q): the parts of a question; gives sc (query_id, doc_id, node_id, title, score)."""
    return f"""q9 AS ({asked}), j9 AS (SELECT query_id, doc_id, node_id, title, q, array_to_string(q, '') AS qc, list_distinct({PARTS.format('title')}) AS t, array_to_string({PARTS.format('title')}, '') AS tc FROM q9 JOIN tr USING (doc_id)),
m9 AS (SELECT *, list_filter(t, lambda x: NOT list_contains({HEADING}, x) AND (list_contains(q, x) OR length(x) >= 4 AND contains(qc, x))) AS mm FROM j9 WHERE qc <> '' AND tc <> ''),
s9 AS (SELECT query_id, doc_id, node_id, title, coalesce(list_sum(list_transform(mm, lambda x: CASE WHEN length(x) >= 6 THEN 2 ELSE 1 END)), 0) + CASE WHEN contains(qc, tc) OR contains(tc, qc) THEN 4 ELSE 0 END AS score FROM m9),
sc AS (SELECT query_id, doc_id, node_id, score FROM (SELECT *, {RANK.format('title, node_id')} FROM s9 WHERE score > 0) WHERE rank <= 3)"""


@query(
    "r18_tree_context", "R18",
    f"""WITH {SECTIONS}, {_heading_sql(f"SELECT item_id || '-' || doc_id AS query_id, doc_id, {PARTS.format('b.text')} AS q FROM benchmark b JOIN documents d ON contains(d.text, b.text)")},
x AS (SELECT query_id, doc_id, node_id, score, 0 AS distance FROM sc UNION ALL SELECT query_id, sc.doc_id, tr.parent, score, -1 FROM sc JOIN tr USING (doc_id, node_id) WHERE tr.parent IS NOT NULL
 UNION ALL SELECT query_id, sc.doc_id, tr.node_id, score, 1 FROM sc JOIN tr ON tr.doc_id = sc.doc_id AND tr.parent = sc.node_id)
SELECT query_id, doc_id, node_id::INT AS node_id, score::DOUBLE AS score, distance::INT AS distance FROM x QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, node_id ORDER BY score DESC, abs(distance), distance DESC) = 1""",
)
def r18_context(spark, d):
    """The sections whose headings fit an item, in the documents that hold it, with two levels above and below."""
    nodes, _, _ = _tree(spark, d)
    docs, b = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    q = verbatim(docs, b).join(b, "item_id").select(F.concat_ws("-", "item_id", "doc_id").alias("query_id"), "doc_id", F.col("text").alias("query"))
    hits = search_headings(q, nodes, 3).where("rank is not null")
    return tree.with_context(hits, nodes, 2, 2)


@query(
    "r20_node_bodies", "R20",
    f"""WITH {BM25}, {SECTIONS}, ql AS (SELECT query_id, query FROM q UNION ALL SELECT query_id + 1000000, '~~ ~~~' FROM q),
dd AS (SELECT query_id, doc_id, max(score) AS score FROM bm GROUP BY ALL UNION ALL SELECT ql.query_id, o.doc_id, 0.5 FROM ql, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3) o WHERE ql.query_id NOT IN (SELECT query_id FROM bm)),
tp AS (SELECT * FROM (SELECT *, {RANK.format('doc_id')} FROM dd) WHERE rank <= 3),
{_heading_sql(f"SELECT tp.query_id || '-' || doc_id AS query_id, doc_id, {PARTS.format('query')} AS q FROM tp JOIN ql USING (query_id)")},
ch AS (SELECT tp.query_id, tp.doc_id, tp.rank, tp.score, coalesce(sc.node_id, 1) AS node_id FROM tp LEFT JOIN sc ON sc.query_id = tp.query_id || '-' || tp.doc_id),
sb AS (SELECT u.doc_id, u.node_id, string_agg(bd.body, chr(10) ORDER BY bd.node_id) AS body FROM (SELECT DISTINCT doc_id, node_id FROM ch) u JOIN tr USING (doc_id, node_id) JOIN bd ON bd.doc_id = u.doc_id AND bd.node_id BETWEEN tr.enter AND tr.leave GROUP BY ALL)
SELECT query_id, doc_id, rank::INT AS rank, round(score, 6)::DOUBLE AS score, node_id::INT AS node_id, md5(body) AS body FROM ch JOIN sb USING (doc_id, node_id) WHERE trim(body, ' ') <> ''""",
)
def r20_nodes(spark, d):
    """Three documents for each item, then the sections whose headings fit it, with all below them; as many queries find no document."""
    nodes, _, bodies = _tree(spark, d)
    q = _queries(spark, d)
    scored = scratch_table(Weighed(_par(spark, d), q).best(3, documents=True).select("query_id", "doc_id", "score"), "scored")  # all that can be among three
    every = q.unionByName(q.select((F.col("query_id") + 1_000_000).alias("query_id"), F.lit("~~ ~~~").alias("query")))

    def search(asked):
        found = search_headings(asked.select(F.col("asked").alias("query_id"), "doc_id", "query"), nodes, 3)
        return found.where("rank is not null").select(F.col("query_id").alias("asked"), "node_id")

    chosen = scratch_table(tree.two_level(every, scored, table(spark, d, "documents"), 3, search), "chosen")
    out = chosen.join(tree.subtree_bodies(chosen, nodes, bodies), ["doc_id", "node_id"]).where("trim(body) <> ''")
    return out.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), "node_id", F.md5("body").alias("body"))


@query("d11_unambiguous_nodes", "D11", f"WITH {SECTIONS} SELECT md5(title) AS title, min(doc_id) AS doc_id FROM tr GROUP BY title HAVING count(DISTINCT doc_id) = 1")
def d11_nodes(spark, d):
    """Headings that tell their document."""
    nodes, _, _ = _tree(spark, d)
    return unambiguous(nodes, "title").select(F.md5("title").alias("title"), "doc_id")


@query(
    "d13_embedding_inputs", "D13",
    rf"""WITH {SECTIONS}, tx AS (SELECT doc_id, node_id, p_idx, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM pp)
SELECT (row_number() OVER (ORDER BY doc_id, node_id, p_idx) - 1)::BIGINT AS "row", doc_id, node_id, p_idx, md5(x) AS text FROM tx WHERE x <> ''""",
)
def d13_inputs(spark, d):
    _, corpus, _ = _tree(spark, d)
    return embedding_inputs(corpus).withColumn("text", F.md5("text"))


@query(
    "d31_corpus_census", "D31",
    f"""WITH {SECTIONS}, nn AS (SELECT doc_id, count(*) AS n FROM tr GROUP BY doc_id), np AS (SELECT doc_id, count(*) AS n FROM pp GROUP BY doc_id)
SELECT coalesce(source, '*') AS source, count(*)::BIGINT AS n_docs, sum(coalesce(nn.n, 0))::BIGINT AS n_nodes, sum(coalesce(np.n, 0))::BIGINT AS n_paragraphs, sum(coalesce(len(embedding) * 4, 0))::BIGINT AS n_bytes, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::BIGINT AS n_same_name
FROM (SELECT *, count(*) OVER (PARTITION BY source, n_chars) AS k FROM documents) dc LEFT JOIN nn ON nn.doc_id = dc.doc_id LEFT JOIN np ON np.doc_id = dc.doc_id LEFT JOIN embeddings ON vec_id = dc.doc_id GROUP BY ROLLUP (source)""",
)
def d31_census(spark, d):
    """Sections, paragraphs and bytes of vectors of each source and of all; a file is named by source and length, and some names come twice."""
    nodes, corpus, _ = _tree(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    names = docs.groupBy("source", "n_chars").agg(F.count("*").alias("k"))
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.size("embedding") * 4).alias("n_bytes"))
    own = docs.join(n(nodes, "n_nodes"), "doc_id", "left").join(n(corpus, "n_paragraphs"), "doc_id", "left").join(vec, "doc_id", "left").join(names, ["source", "n_chars"])
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    out = own.rollup("source").agg(F.count("*").alias("n_docs"), total("n_nodes"), total("n_paragraphs"), total("n_bytes"), F.count_if(F.col("k") > 1).alias("n_same_name"))
    return out.withColumn("source", F.coalesce("source", F.lit("*")))
