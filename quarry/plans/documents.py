"""Queries over Markdown that Spark makes of the documents' lines: headings, tables, images and text in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.markdown import descendants, inventory, markdown_corpus, markdown_lines, outline, section_bodies, tree_profile, with_source_header
from quarry.plans.register import query
from quarry.sources.tables import dealt, table

MADE = """md AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE i % 13 WHEN 2 THEN '## ' || x WHEN 3 THEN '|' || x || '|' WHEN 4 THEN '|--|--|' WHEN 6 THEN '### ' || x
 WHEN 7 THEN '![' || left(x, 3) || '](img/' || i || '.png) ' WHEN 8 THEN '<table>' || x WHEN 10 THEN '</table>' WHEN 12 THEN '--|--' ELSE x END), chr(10)) AS text FROM documents)"""
LINES = rf"""{MADE}, a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM md),
b AS (SELECT *, regexp_matches(t, '^\s*#{{1,6}}\s+') AS h, contains(lower(t), '<table') AS o, CASE WHEN contains(lower(t), '</table>') THEN 'close' WHEN contains(lower(t), '<table') AND NOT regexp_matches(t, '^\s*#{{1,6}}\s+') THEN 'open' END AS ev FROM a),
c AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'open', false) AS inside FROM b),
e AS (SELECT *, NOT inside AND NOT h AND NOT o AND regexp_matches(t, '^\s*\|.*\|\s*$') AS pipes, NOT inside AND NOT h AND NOT o AND (regexp_matches(t, '^\s*\|.*\|\s*$') OR regexp_matches(t, '^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$')) AS ruled FROM c),
f AS (SELECT *, sum((NOT ruled)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e), g AS (SELECT *, max(pipes::INT) OVER (PARTITION BY doc_id, run ORDER BY i) = 1 AS begun FROM f),
k AS (SELECT *, CASE WHEN inside THEN 'html' WHEN h THEN 'heading' WHEN o THEN 'html' WHEN ruled AND begun THEN 'table' WHEN regexp_matches(t, '!\[([^\]]*)\]\(([^)]+)\)') THEN 'image' WHEN trim(t, ' ') = '' THEN 'blank' ELSE 'text' END AS kind FROM g),
m AS (SELECT *, CASE WHEN kind IN ('heading', 'image') OR kind = 'html' AND NOT inside OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i), '') <> kind THEN 1 ELSE 0 END AS edge FROM k),
n AS (SELECT doc_id, i, t, kind, sum(edge) OVER (PARTITION BY doc_id ORDER BY i) AS block, sum((kind = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM m)"""


def _made(spark, d):
    i = lambda k: k % 13 + 0

    def line(x, k):
        k = k + 1
        at = lambda n, c: (i(k) == n, c)
        out = None
        for cond, value in (
            at(2, F.concat(F.lit("## "), x)), at(3, F.concat(F.lit("|"), x, F.lit("|"))), at(4, F.lit("|--|--|")), at(6, F.concat(F.lit("### "), x)),
            at(7, F.concat(F.lit("!["), F.left(x, F.lit(3)), F.lit("](img/"), k.cast("string"), F.lit(".png) "))), at(8, F.concat(F.lit("<table>"), x)), at(10, F.lit("</table>")), at(12, F.lit("--|--")),
        ):
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out.otherwise(x)

    return dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query("d03_markdown_sections", "D3 D5 D6 D7", f"WITH {LINES} SELECT doc_id, section::BIGINT AS section, kind, count(DISTINCT block)::BIGINT AS n_blocks, count(*)::BIGINT AS n_lines FROM n WHERE kind <> 'blank' GROUP BY ALL")
def d03(spark, d):
    g = markdown_lines(_made(spark, d)).where("kind <> 'blank'").groupBy("doc_id", "section", "kind")
    return g.agg(F.countDistinct("block").alias("n_blocks"), F.count("*").alias("n_lines"))


@query(
    "d08_markdown_images", "D8 D12",
    rf"""WITH {LINES} SELECT doc_id, count(*)::BIGINT AS n, string_agg(trim(regexp_extract(t, '!\[([^\]]*)\]\(([^)]+)\)', 1)), '|' ORDER BY i) AS alt, string_agg('docs/' || doc_id || '/' || trim(regexp_extract(t, '!\[([^\]]*)\]\(([^)]+)\)', 2)), '|' ORDER BY i) AS paths FROM n WHERE kind = 'image' GROUP BY doc_id""",
)
def d08(spark, d):
    docs = _made(spark, d).withColumn("folder", F.concat(F.lit("docs/x/../"), F.col("doc_id").cast("string")))
    g = markdown_corpus(docs).where("kind = 'image'").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("node_id", "p_idx", "text", "image_path"))).alias("l"))
    joined = lambda c: F.array_join(F.transform("l", lambda x: x[c]), "|")
    return g.select("doc_id", "n", joined("text").alias("alt"), joined("image_path").alias("paths"))


@query(
    "d09_source_headers", "D9",
    "SELECT doc_id, CASE WHEN trim(source) = '' THEN md5(text) ELSE md5('# Source Document: ' || source || chr(10) || chr(10) || 'Source name: ' || source || chr(10) || chr(10) || text) END AS body FROM documents WHERE text IS NOT NULL",
)
def d09(spark, d):
    """A header is added once, however often that is tried."""
    docs = table(spark, d, "documents").where("text is not null")
    once = with_source_header(F.col("text"), F.col("source"))
    return docs.select("doc_id", F.md5(with_source_header(once, F.lit("another"))).alias("body"))


@query(
    "d26_outline", "D10 D26",
    rf"""WITH {LINES}, p AS (SELECT doc_id, section, block, CASE WHEN any_value(kind) = 'image' THEN trim(regexp_extract(string_agg(t, chr(10) ORDER BY i), '!\[([^\]]*)\]\(([^)]+)\)', 1)) ELSE string_agg(t, chr(10) ORDER BY i) END AS x FROM n WHERE kind NOT IN ('blank', 'heading') GROUP BY ALL),
q AS (SELECT doc_id, section, count(*) AS np, sum(len(list_filter(regexp_split_to_array(lower(trim(x, ' ')), '\s+'), lambda w: w <> ''))) AS nt FROM p GROUP BY ALL),
fr AS (SELECT doc_id, max((section = 0)::INT) AS f FROM n WHERE kind <> 'blank' GROUP BY doc_id),
s AS (SELECT DISTINCT doc_id, section FROM n WHERE kind <> 'blank')
SELECT doc_id, (section + f)::INT AS node_id, coalesce(np, 0)::BIGINT AS n_paragraphs, coalesce(nt, 0)::BIGINT AS n_tokens FROM s JOIN fr USING (doc_id) LEFT JOIN q USING (doc_id, section)""",
)
def d26(spark, d):
    return outline(_made(spark, d)).select("doc_id", "node_id", "n_paragraphs", "n_tokens")


@query("d27_inventory", "D27")
def d27(spark, d):
    """Every document in one row, also one without sections: all its sections with titles and counts, and what a table of names has on its own."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("_doc")).alias("source_name"))
    extra = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").cast("string").alias("pages"))
    out = inventory(outline(_made(spark, d)), extra, docs)
    return out.select("doc_id", "source_name", "title", "sections", F.size("sections").alias("n_sections"), F.get("sections", F.lit(0))["title"].alias("first"), "pages")


@query(
    "d29_section_bodies", "D29",
    f"""WITH {LINES}, h AS (SELECT doc_id, section, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM n WHERE kind = 'heading')
SELECT h.doc_id, h.section::BIGINT AS node_id, max(n.i)::INT AS last_line, md5(string_agg(n.t, chr(10) ORDER BY n.i)) AS body FROM h JOIN n ON n.doc_id = h.doc_id AND n.i >= h.i AND (z IS NULL OR n.i < z) GROUP BY ALL""",
)
def d29(spark, d):
    return section_bodies(_made(spark, d)).select("doc_id", "node_id", "last_line", F.md5("body").alias("body"))


@query(
    "d30_descendants", "D28 D30",
    f"""WITH {LINES}, h AS (SELECT doc_id, section, CASE WHEN regexp_matches(t, '^\\s*###') THEN 2 ELSE 1 END AS lv, trim(regexp_replace(t, '^\\s*#+\\s+', ''), ' ') AS title FROM n WHERE kind = 'heading'),
x AS (SELECT *, min(CASE WHEN lv = 1 THEN section END) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM h)
SELECT x.doc_id, x.title, string_agg(y.title, '|' ORDER BY y.section) AS below FROM x JOIN h y ON y.doc_id = x.doc_id AND x.lv = 1 AND y.section > x.section AND (x.stop IS NULL OR y.section < x.stop) GROUP BY x.doc_id, x.section, x.title""",
)
def d30(spark, d):
    """Below each heading of the first level; the front section holds none of the first, so it stays out."""
    nodes = outline(_made(spark, d))
    return descendants(nodes).join(nodes.where("title <> '前言'").select("doc_id", "node_id", "title"), ["doc_id", "node_id"]).select("doc_id", "title", F.array_join("below", "|").alias("below"))


@query("d28_two_level_profile", "D28")
def d28(spark, d):
    nodes = outline(_made(spark, d)).withColumn("summary", F.concat_ws(" ", F.col("n_tokens").cast("string"), "title"))
    return tree_profile(nodes, 100)
