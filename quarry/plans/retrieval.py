"""Queries over retrieval operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.text import content_tokens, normalised, title_parts, tokens
from quarry.operators.blocks import best_of_terms, best_vectors, in_order, term_blocks
from quarry.operators.retrieval import Weighed, bm25, corpus_statistics, evidence_lines, fused, neighbors, postings, regex_hits, reranked, term_statistics, top_k
from quarry.operators.rankers import gated
from quarry.operators.routing import FacetRouting, route_facets, route_titles, search_headings
from quarry.operators.sampling import verbatim
from quarry.plans.register import query
from quarry.sources.tables import dealt, paragraphs, scratch_table, small, table

PAR = """par AS (SELECT doc_id, p_idx, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
  unnest(range(len(string_split(text, chr(10))))) AS p_idx FROM documents) WHERE trim(text, ' ') <> '')"""
TOK = r"list_filter(regexp_split_to_array(lower(trim({0}, ' ')), '\s+'), lambda x: x <> '')"
STATS = f"""{PAR}, tok AS (SELECT doc_id, p_idx, {TOK.format('text')} AS t FROM par),
posts AS (SELECT doc_id, p_idx, len, term, count(*) AS tf FROM (SELECT doc_id, p_idx, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
st AS (SELECT greatest(count(*), 1) AS n, avg(len(t)) AS avgdl FROM tok),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts, st GROUP BY term)"""
BM25 = f"""{STATS}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('query')}) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, p_idx, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl) + 1e-9)), 9) AS score
 FROM posts JOIN idf USING (term) JOIN qt USING (term), st GROUP BY ALL HAVING score > 0)"""
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {0}) AS rank"


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _par(spark, d):
    return paragraphs(table(spark, d, "documents"))


@query("r01_corpus_statistics", "R1", f"WITH {STATS} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def r01(spark, d):
    par = _par(spark, d)
    return term_statistics(postings(par), corpus_statistics(par)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("r02_bm25_topk", "R1 R2 F6", f"WITH {BM25} SELECT query_id, doc_id, p_idx::INT AS p_idx, round(score, 2) AS score, rank::INT AS rank FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM bm) WHERE rank <= 5")
def r02(spark, d):
    """Ranked by whole scores, shown with two places."""
    return Weighed(_par(spark, d), _queries(spark, d)).best(5).withColumn("score", F.round("score", 2))


@query(
    "r03_regex_topk", "R3 J5",
    f"""WITH {PAR}, p(query_id, pattern) AS (VALUES (1, 'tion'), (2, '^the '), (3, '[0-9]+'), (4, 'licen[cs]e')),
h AS (SELECT query_id, doc_id, p_idx, len(regexp_extract_all(text, '(?im)' || pattern)) AS score FROM par, p WHERE regexp_matches(text, '(?im)' || pattern))
SELECT query_id, doc_id, p_idx::INT AS p_idx, score::INT AS score, rank::INT AS rank FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM h) WHERE rank <= 5""",
)
def r03(spark, d):
    patterns = spark.createDataFrame([(1, "tion"), (2, "^the "), (3, "[0-9]+"), (4, "licen[cs]e"), (5, "no (end")], "query_id int, pattern string")
    hits = regex_hits(_par(spark, d), patterns).where("error is null")  # the last pattern gives its error alone
    return top_k(hits.drop("error"), 5, "doc_id", "p_idx")


VEC = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-12)) AS e FROM v),
c AS (SELECT q.vec_id AS query_id, n.vec_id, q.label = n.label AS same, round(greatest(-1, least(1, list_inner_product(q.e, n.e))), 4) AS score
 FROM n q, n WHERE q.vec_id % 50 = 0 AND n.vec_id <> q.vec_id)"""


def _cosines(spark, d, k, *ties):
    """What may be among the k best of each vector whose id is divisible by 50, against all others."""
    n = dealt(table(spark, d, "embeddings"), "vec_id").select("vec_id", "label", normalised(F.col("embedding")).alias("e"))
    q = n.where(F.col("vec_id") % 50 == 0).toDF("query_id", "qlabel", "qe")
    best = best_vectors(n, q, k, 4, [*ties], others="vec_id")
    return best.select("query_id", "vec_id", (F.col("qlabel") == F.col("label")).alias("same"), "score")


@query("r04_vector_topk", "R4 F24", f"WITH {VEC} SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, {RANK.format('vec_id DESC')} FROM c) WHERE rank <= 5")
def r04(spark, d):
    """Equal scores in reversed order."""
    return top_k(_cosines(spark, d, 5, ("vec_id", "descending")), 5, F.desc("vec_id")).select("query_id", "vec_id", "score", "rank")


@query(
    "r04_vector_label_hits", "R4 E21",
    f"WITH {VEC}, r AS (SELECT *, {RANK.format('vec_id')} FROM c) SELECT query_id, count(*) FILTER (same)::BIGINT AS hits, coalesce(min(CASE WHEN same THEN rank END), 0)::INT AS first_hit FROM r WHERE rank <= 10 GROUP BY query_id",
)
def r04b(spark, d):
    r = top_k(_cosines(spark, d, 10, ("vec_id", "ascending")), 10, "vec_id")
    return r.groupBy("query_id").agg(F.count_if("same").alias("hits"), F.coalesce(F.min(F.when(F.col("same"), F.col("rank"))), F.lit(0)).alias("first_hit"))


# Second score of a paragraph for fusion: share of the query's distinct words that it holds.
COVER = f"""cov AS (SELECT query_id, doc_id, p_idx, round(count(DISTINCT term) * 1.0 / any_value(nq), 4) AS score
 FROM posts JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS nq FROM qt) USING (term) GROUP BY ALL)"""

HYBRID = f"""WITH {BM25}, {COVER.replace('FROM posts', 'FROM posts').replace('GROUP BY ALL)', 'GROUP BY query_id, doc_id, p_idx)')},
a AS (SELECT * FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM bm) WHERE rank <= 20), b AS (SELECT * FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM cov) WHERE rank <= 20),
f AS (SELECT query_id, doc_id, p_idx, coalesce(a.score, 0) AS l, coalesce(b.score, 0) AS v FROM a FULL JOIN b USING (query_id, doc_id, p_idx)),
g AS (SELECT query_id, doc_id, p_idx, l, v, max(l) OVER w AS ml, min(v) OVER w AS lo, max(v) OVER w AS hi FROM f WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT query_id, doc_id, p_idx, round(0.5 * CASE WHEN ml > 0 THEN l / ml ELSE 0 END + 0.5 * CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS score FROM g)"""


def _hybrid(spark, d):
    keys, x = ["query_id", "doc_id", "p_idx"], Weighed(_par(spark, d), _queries(spark, d))
    return fused(x.best(20).select(*keys, "score"), x.covering(20).select(*keys, "score"), keys)


@query("r05_hybrid_topk", "J3", f"{HYBRID} SELECT query_id, doc_id, p_idx::INT AS p_idx, score, rank::INT AS rank FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM h) WHERE rank <= 5")
def r05(spark, d):
    return top_k(_hybrid(spark, d), 5, "doc_id", "p_idx")


DOC_VEC = f"""dv AS (SELECT vec_id AS doc_id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS e FROM embeddings),
vc AS (SELECT q.query_id, dv.doc_id, 0 AS p_idx, round(greatest(-1, least(1, list_inner_product(qv.e, dv.e))), 2) AS score FROM q JOIN dv qv ON qv.doc_id = q.query_id, dv)"""


@query(
    "r05_vector_hybrid", "R5",
    f"""WITH {BM25}, {DOC_VEC}, a AS (SELECT * FROM (SELECT query_id, doc_id, p_idx, round(score, 2) AS score, {RANK.format('doc_id, p_idx')} FROM bm) WHERE rank <= 20), b AS (SELECT * FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM vc) WHERE rank <= 20),
f AS (SELECT query_id, doc_id, p_idx, coalesce(a.score, 0) AS l, coalesce(b.score, 0) AS v FROM a FULL JOIN b USING (query_id, doc_id, p_idx)),
g AS (SELECT query_id, doc_id, p_idx, l, v, max(l) OVER w AS ml, min(v) OVER w AS lo, max(v) OVER w AS hi FROM f WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT query_id, doc_id, p_idx, round(0.5 * CASE WHEN ml > 0 THEN l / ml ELSE 0 END + 0.5 * CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS score FROM g)
SELECT query_id, doc_id, p_idx::INT AS p_idx, score, rank::INT AS rank FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM h) WHERE rank <= 5""",
)
def r05_vectors(spark, d):
    """Words and vectors: the vector of a document stands at its beginning, that of a test item is its question's."""
    q, keys = _queries(spark, d), ["query_id", "doc_id", "p_idx"]
    a = Weighed(_par(spark, d), q).best(20).select(*keys, F.round("score", 2).alias("score"))
    v = dealt(table(spark, d, "embeddings"), "vec_id").select(F.col("vec_id").alias("doc_id"), normalised(F.col("embedding")).alias("e"))
    qv = v.select(F.col("doc_id").alias("query_id"), F.col("e").alias("qe")).join(q.select("query_id"), "query_id", "left_semi")
    b = top_k(best_vectors(v, qv, 20, 2, [("doc_id", "ascending")]), 20, "doc_id").select("query_id", "doc_id", F.lit(0).alias("p_idx"), "score")
    return top_k(fused(a, b, keys), 5, "doc_id", "p_idx")


@query(
    "r06_two_stage", "R6 R16",
    f"""WITH {BM25}, s AS (SELECT * FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM bm) WHERE rank <= 30),
x AS (SELECT s.*, l.quality + 1.0 / (1 + s.doc_id % 97) AS rel FROM s LEFT JOIN labels l ON l.doc_id = s.doc_id),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC NULLS LAST, rank) AS final FROM x)
SELECT query_id, doc_id, p_idx::INT AS p_idx, rank::INT AS stage1_rank, rel IS NOT NULL AS rerank_ok, final::INT AS rank FROM y WHERE final <= 5""",
)
def r06(spark, d):
    """Thirty by words, then the quality that documents are labelled with as relevance; without a label the first order holds."""
    q = _queries(spark, d)
    first = scratch_table(Weighed(_par(spark, d), q).best(30), "first")
    rated = table(spark, d, "labels").select("doc_id", (F.col("quality") + 1 / (1 + F.col("doc_id") % 97)).alias("relevance"))
    relevance = rated.join(small(first.select("query_id", "doc_id", "p_idx")), "doc_id")
    out = reranked(first, relevance, 5, "doc_id", "p_idx")
    return out.select("query_id", "doc_id", "p_idx", "stage1_rank", "rerank_ok", "rank")


@query(
    "r22_evidence_lines", "R22",
    r"""WITH l AS (SELECT conv_id * 1000 + turn AS query_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[- ]+', '')), lambda x: x <> '') AS l FROM conversations)
SELECT query_id, greatest(len(l), 1)::BIGINT AS n, md5(array_to_string(l, chr(10))) AS content, CASE WHEN len(l) = 0 THEN 0 ELSE 1 END::DOUBLE AS score FROM l""",
)
def r22(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("answer"))
    g = evidence_lines(c).groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "content"))).alias("l"), F.max("score").alias("score"))
    return g.select("query_id", "n", F.md5(F.array_join(F.transform("l", lambda x: x["content"]), "\n")).alias("content"), "score")


@query(
    "r07_scoped_bm25", "R7 F11",
    f"""WITH {STATS}, q AS (SELECT item_id AS query_id, item_id * 7 AS doc_id, text AS query FROM benchmark),
qt AS (SELECT query_id, doc_id, term, count(*) AS qtf FROM (SELECT query_id, doc_id, unnest({TOK.format('query')}) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, p_idx, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl) + 1e-9)), 9) AS score
 FROM posts JOIN idf USING (term) JOIN qt USING (term, doc_id), st GROUP BY ALL HAVING score > 0),
t AS (SELECT * FROM (SELECT *, {RANK.format('p_idx')} FROM bm) WHERE rank <= 2)
SELECT q.query_id, q.doc_id, coalesce(t.p_idx, -1)::INT AS p_idx, coalesce(t.score, 0) AS score, q.doc_id IN (SELECT doc_id FROM par) AS ok FROM q LEFT JOIN t USING (query_id)""",
)
def r07(spark, d):
    par = _par(spark, d)
    q = _queries(spark, d).withColumn("doc_id", F.col("query_id") * 7)
    hits = top_k(bm25(par, q, scope=True), 2, "p_idx").select("query_id", "p_idx", "score")
    there = par.select("doc_id").distinct().withColumn("ok", F.lit(True))
    return q.join(there, "doc_id", "left").join(hits, "query_id", "left").select("query_id", "doc_id", F.coalesce("p_idx", F.lit(-1)).alias("p_idx"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("ok", F.lit(False)).alias("ok"))


PAGE = r"""pg AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(url, '//([^/]+)', 1) AS host, regexp_extract(url, '//[^/]+(/[^?]*)', 1) AS path FROM pages)"""


def _pages(spark, d):
    part = lambda c, p: F.regexp_extract(c, p, 1)
    return table(spark, d, "pages").select("page_id", part("html", "<title>([^<]*)").alias("title"), part("url", "//([^/]+)").alias("host"), part("url", "//[^/]+(/[^?]*)").alias("path"))


PARTS = "regexp_extract_all(lower({0}), '[a-z]+|[0-9]+')"
TITLES = rf"""{PAGE}, q AS (SELECT item_id AS query_id, {PARTS.format('text')} AS p FROM benchmark),
qq AS (SELECT query_id, p || CASE WHEN list_contains(p, 'jnj') THEN ['johnson'] ELSE [] END || CASE WHEN list_contains(p, 'jpm') THEN ['jpmorgan'] ELSE [] END AS p FROM q),
qc AS (SELECT query_id, p, array_to_string(p, '') AS c FROM qq),
cm AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS w FROM pg), pt AS (SELECT page_id, unnest(list_distinct({PARTS.format('title')})) AS w FROM pg),
m AS (SELECT query_id, page_id, w, CASE WHEN w IN ('annual', 'report', 'quarter', 'quarterly', 'fiscal', 'year', 'the', 'what', 'which', 'how', 'was', 'were', 'is', 'are', '10k', '10q', '20f', '8k') THEN 0.5
 WHEN regexp_matches(w, '^[0-9]{{4}}$') THEN 2 WHEN regexp_matches(w, '^[a-z]{{3,}}$') THEN 10 WHEN regexp_matches(w, '[a-z]') THEN 8 ELSE 1 END AS s FROM cm JOIN qc ON contains(c, w)),
n AS (SELECT query_id, page_id, w, CASE WHEN regexp_matches(w, '^[0-9]{{4}}$') THEN 2 WHEN length(w) >= 2 AND w NOT IN ('annual', 'report', 'quarter', 'quarterly', 'fiscal', 'year', 'the', 'what', 'which', 'how', 'was', 'were', 'is', 'are', '10k', '10q', '20f', '8k') THEN 1 ELSE 0 END AS s
 FROM pt JOIN qc ON list_contains(p, w) ANTI JOIN m USING (query_id, page_id, w)),
s AS (SELECT query_id, page_id, sum(s) AS s, string_agg(w, ',' ORDER BY w) AS matched FROM (FROM m UNION ALL FROM n) GROUP BY ALL),
r AS (SELECT query_id, page_id, title, matched, s + CASE WHEN contains(c, array_to_string({PARTS.format('title')}, '')) THEN 5 ELSE 0 END AS score FROM s JOIN pg USING (page_id) JOIN qc USING (query_id))"""


@query(
    "r08_title_routing", "R8 F3",
    f"WITH {TITLES} SELECT query_id, page_id, score::DOUBLE AS score, matched, rank::INT AS rank FROM (SELECT *, {RANK.format('title, page_id')} FROM r WHERE score > 0) WHERE rank <= 5",
)
def r08(spark, d):
    """Test items as questions over the titles of all pages."""
    docs = _pages(spark, d).select(F.col("page_id").alias("doc_id"), F.col("title").alias("source_name"))
    out = route_titles(_queries(spark, d), docs, 5).where("rank is not null")
    return out.select("query_id", F.col("doc_id").alias("page_id"), "score", F.array_join("matched_terms", ",").alias("matched"), "rank")


HEADING = "['the', 'a', 'an', 'of', 'to', 'for', 'and', 'or', 'in', 'on', 'what', 'which', 'how', 'is', 'are', 'was', 'were', 'fy']"


@query(
    "r09_heading_search_whole", "R9",
    rf"""WITH {PAR}, q AS (SELECT item_id AS query_id, doc_id, {PARTS.format('b.text')} AS q FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
j AS (SELECT query_id, doc_id, p_idx, text, q, array_to_string(q, '') AS qc, list_distinct({PARTS.format('text')}) AS t, array_to_string({PARTS.format('text')}, '') AS tc FROM q JOIN par USING (doc_id)),
m AS (SELECT *, list_filter(t, lambda x: NOT list_contains({HEADING}, x) AND (list_contains(q, x) OR length(x) >= 4 AND contains(qc, x))) AS m FROM j WHERE qc <> '' AND tc <> ''),
s AS (SELECT query_id || '-' || doc_id AS query_id, doc_id, p_idx, text, coalesce(list_sum(list_transform(m, lambda x: CASE WHEN length(x) >= 6 THEN 2 ELSE 1 END)), 0) + CASE WHEN contains(qc, tc) OR contains(tc, qc) THEN 4 ELSE 0 END AS score FROM m)
SELECT query_id, doc_id, p_idx::INT AS p_idx, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, {RANK.format('text, p_idx')} FROM s WHERE score > 0) WHERE rank <= 5""",
)
def r09_exact(spark, d):
    """Each test item over the lines of the documents that hold it, as their headings."""
    docs, b = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    q = verbatim(docs, b).join(b, "item_id").select(F.concat_ws("-", "item_id", "doc_id").alias("query_id"), "doc_id", F.col("text").alias("query"))
    nodes = _par(spark, d).select("doc_id", F.col("p_idx").alias("node_id"), F.col("text").alias("title"))
    out = search_headings(q, nodes, 5).where("rank is not null")
    return out.select("query_id", "doc_id", F.col("node_id").alias("p_idx"), "score", "rank")


def _filings(spark, d):
    """Names of filings, as many as there are nations, quarters and kinds of orders: FRANCE_1996Q2_10-Q."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.element_at(F.create_map(*map(F.lit, ("F", "10-K", "O", "10-Q", "P", "8-K"))), F.col("o_orderstatus")).alias("kind"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), "n_nationkey")
    name = F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("y").cast("string"), F.lit("Q"), F.col("q").cast("string"), F.lit("_"), "kind")
    return o.join(c, "o_custkey").select(name.alias("doc_id")).distinct().withColumn("source_name", F.col("doc_id"))


def _asked(spark, d):
    """A question on each nation and year of orders."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    q = table(spark, d, "nation").select("n_nationkey", F.initcap(F.lower("n_name")).alias("n")).crossJoin(F.broadcast(o))
    asked = F.concat(F.lit("What did "), "n", F.lit(" report in its 10-Q for the second quarter of FY"), F.col("y").cast("string"), F.lit("?"))
    return q.select((F.col("n_nationkey") * 10_000 + F.col("y")).alias("query_id"), asked.alias("query"))


def _facet_sql(dated: bool) -> str:
    """The filings and questions of the two functions above by facets, all pairs of them: fp."""
    stop = "x NOT IN ('UNITED', 'STATES') AND NOT regexp_matches(x, '^[0-9]{1,2}$')" if dated else "x NOT IN ('10', '8')"
    alias = "[array_to_string(t, ''), array_to_string(t, ' ')] || CASE WHEN length(ini) >= 2 THEN [ini, array_to_string(f, 'n'), array_to_string(f, 'and'), t[1] || 'n' || t[-1], left(t[1], 1) || 'n' || left(t[-1], 1)] ELSE [] END"
    held = "length(name) >= 3 AND contains(qt, name) OR list_contains(qk, name)"
    if dated:
        held += " OR len(list_filter(al, lambda a: length(a) >= 2 AND (contains(qt, a) OR list_contains(pr, a)))) > 0 OR len(list_filter(pr, lambda p: length(p) >= 3 AND (starts_with(name, p) OR starts_with(p, name)))) > 0"
    else:
        held += " OR len(t) > 0 AND list_has_all(qk, t)"
    return f"""fx AS (SELECT DISTINCT replace(n_name, ' ', '_') AS nat, year(o_orderdate) AS y, quarter(o_orderdate) AS qr, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS kind FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
f1 AS (SELECT *, nat || '_' || y || 'Q' || qr || '_' || kind AS doc_id, list_transform(list_filter(string_split(nat, '_'), lambda x: x <> '' AND {stop}), lambda x: lower(x)) AS t FROM fx),
f2 AS (SELECT *, list_transform(t, lambda x: left(x, 1)) AS f, array_to_string(list_transform(t, lambda x: left(x, 1)), '') AS ini, CASE WHEN len(t) > 0 THEN array_to_string(t, '') ELSE regexp_replace(lower(doc_id), '[^a-z0-9]+', '', 'g') END AS name FROM f1),
f3 AS (SELECT *, CASE WHEN len(t) > 0 THEN {alias} ELSE [] END AS al FROM f2),
qx AS (SELECT (n_nationkey * 10000 + y)::BIGINT AS query_id, y AS ay, lower(n_name) AS nn FROM nation, (SELECT DISTINCT year(o_orderdate) AS y FROM orders)),
q2 AS (SELECT *, regexp_replace('whatdid' || nn || 'reportinits10qforthesecondquarteroffy' || ay, '[^a-z0-9]+', '', 'g') AS qt, ['what', 'did', 'report', 'in', 'its', '10', 'q', 'for', 'the', 'second', 'quarter', 'of', 'fy' || ay] || regexp_extract_all(nn, '[a-z0-9]+') AS qk, ['what', 'q'] || list_transform(string_split(nn, ' '), lambda x: regexp_extract(x, '^[a-z][a-z0-9]*')) AS pr FROM qx),
fp AS (SELECT query_id, doc_id, t, name <> '' AND ({held}) AS bn, y, y = ay AS byr, qr, qr = 2 AS bq, kind, kind = '10-Q' AS bf FROM q2, f3),
fs AS (SELECT *, (CASE WHEN bn THEN 3 ELSE 0 END + CASE WHEN byr THEN 1.5 ELSE 0 END + CASE WHEN bq THEN 1 ELSE 0 END + CASE WHEN bf THEN 1 ELSE 0 END)::DOUBLE AS score, bn::INT + byr::INT + bq::INT + bf::INT AS match_count FROM fp)"""


@query(
    "r12_document_inventory", "R12 R14 F16 F17 F18 F19 F20 F21",
    f"""WITH {_facet_sql(True)}, rs AS (SELECT *, list_filter([CASE WHEN bn THEN 'company=' || array_to_string(t, ' ') END, CASE WHEN byr THEN 'year=' || y END, CASE WHEN bq THEN 'quarter=2' END, CASE WHEN bf THEN 'filing_type=10-Q' END], lambda x: x IS NOT NULL) AS r FROM fs)
SELECT query_id, doc_id, score, match_count, CASE WHEN len(r) > 0 THEN array_to_string(r, '; ') ELSE 'no strong match' END AS reasons, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_count DESC, doc_id))::INT AS rank FROM rs QUALIFY rank <= 5""",
)
def r12_inventory(spark, d):
    """Names of filings made of orders; a question on each nation and year (golden cases: tests/test_routing.py)."""
    ranked, _ = route_facets(_asked(spark, d), _filings(spark, d))
    return ranked.select("query_id", "doc_id", "score", "match_count", F.array_join("reasons", "; ").alias("reasons"), "rank")


@query("r13_document_inventory_undated", "R13", f"WITH {_facet_sql(False)} SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM fs QUALIFY rank <= 5")
def r13(spark, d):
    """The same without dates, names as a whole or in all their words. Years are taken as a whole."""
    ranked, _ = route_facets(_asked(spark, d), _filings(spark, d), dated=False)
    return ranked.select("query_id", "doc_id", "score", "rank")


@query("r15_matched_documents", "R15", f"WITH {_facet_sql(True)} SELECT query_id, doc_id, byr OR bq OR bf AS strong FROM fp WHERE bn")
def r15_matches(spark, d):
    """The documents that each question names, a row each, and whether anything else matches."""
    return FacetRouting(_asked(spark, d), _filings(spark, d)).matches()


@query(
    "r15_routing_coverage", "R15",
    f"""WITH {_facet_sql(True)} SELECT query_id, count(*)::BIGINT AS n_documents, count(*) FILTER (bn)::BIGINT AS n_by_name, count(*) FILTER (byr)::BIGINT AS n_by_year, count(*) FILTER (bq)::BIGINT AS n_by_quarter, count(*) FILTER (bf)::BIGINT AS n_by_filing, 0::BIGINT AS n_by_date,
count(*) FILTER (bn AND (byr OR bq OR bf))::BIGINT AS n_strong FROM fp GROUP BY query_id""",
)
def r15(spark, d):
    """How many documents each facet of a question matches."""
    return FacetRouting(_asked(spark, d), _filings(spark, d)).coverage()


@query(
    "r09_heading_search", "",
    rf"""WITH {PAR}, h AS (SELECT doc_id, p_idx, text AS title FROM par), q AS (SELECT item_id AS query_id, item_id * 7 AS doc_id, text AS query FROM benchmark),
j AS (SELECT query_id, doc_id, p_idx, title, list_distinct(regexp_extract_all(lower(title), '[a-z]+|[0-9]+')) AS t, list_distinct(regexp_extract_all(lower(query), '[a-z]+|[0-9]+')) AS w FROM q JOIN h USING (doc_id)),
s AS (SELECT query_id, doc_id, p_idx, title, list_sum(list_transform(list_filter(t, lambda x: list_contains(w, x)), lambda x: CASE WHEN length(x) >= 6 THEN 2 ELSE 1 END)) AS score FROM j)
SELECT query_id, doc_id, p_idx::INT AS p_idx, score::INT AS score, rank::INT AS rank FROM (SELECT *, {RANK.format('title, p_idx')} FROM s WHERE score > 0) WHERE rank <= 5""",
)
def r09(spark, d):
    h = _par(spark, d).select("doc_id", "p_idx", F.col("text").alias("title"))
    j = _queries(spark, d).withColumn("doc_id", F.col("query_id") * 7).join(h, "doc_id")
    both = F.array_intersect(title_parts("title"), title_parts("query"))
    score = F.aggregate(both, F.lit(0), lambda s, x: s + F.when(F.length(x) >= 6, 2).otherwise(1))
    s = j.select("query_id", "doc_id", "p_idx", "title", score.alias("score")).where("score > 0")
    return top_k(s, 5, "title", "p_idx").select("query_id", "doc_id", "p_idx", "score", "rank")


@query("r09_whole_heading_search", "")
def r09_whole(spark, d):
    """Whole lines of all documents as headings, scored in blocks by the words of the queries."""
    x = _queries(spark, d).select("query_id", F.explode(F.array_distinct(title_parts("query"))).alias("term"))
    x = x.withColumn("weight", F.when(F.length("term") >= 6, 2).otherwise(1))
    rows = in_order(_par(spark, d), "p_idx").select("doc_id", "p_idx", F.col("text").alias("title"), F.array_distinct(title_parts("text")).alias("t"))
    ties = ["title", "doc_id", "p_idx"]
    s = best_of_terms(rows, list(term_blocks(x)), x.schema["query_id"].dataType, 5, lambda tf, size: tf * 1.0, 9, ties)
    return top_k(s, 5, *ties).select("query_id", "doc_id", "p_idx", F.col("score").cast("long").alias("score"), "rank")


READ_SECTION = f"""WITH {PAR}, r AS (SELECT doc_id, doc_id % 4 AS a, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id % 4 + 2 END AS b FROM documents)
SELECT r.doc_id, count(*)::BIGINT AS n, md5(string_agg(text, chr(10) ORDER BY p_idx)) AS body FROM r JOIN par USING (doc_id) WHERE p_idx >= a AND (b = -1 OR p_idx < b) GROUP BY r.doc_id"""


@query("r10_read_section", "J6", READ_SECTION)
def r10(spark, d):
    return _sections(spark, d, table(spark, d, "documents"))


@query("r10_whole_read_section", "J6", READ_SECTION)
def r10_whole(spark, d):
    return _sections(spark, d, table(spark, d, "documents"))


def _sections(spark, d, docs):
    """A range of paragraphs of each of the documents, to the end where b is -1."""
    i = F.col("doc_id")
    r = docs.select(i, (i % 4).alias("a"), F.when(i % 5 == 0, -1).otherwise(i % 4 + 2).alias("b"))
    hits = _par(spark, d).join(r, "doc_id").where("p_idx >= a and (b = -1 or p_idx < b)")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "text"))), lambda x: x["text"]), "\n")
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(body).alias("body"))


@query(
    "r11_neighbors", "R11",
    f"""WITH {PAR} SELECT doc_id, p_idx::INT AS p_idx, array_to_string(list(p_idx) OVER w, ',') AS places, md5(array_to_string(list(text) OVER w, chr(10))) AS context
FROM par WINDOW w AS (PARTITION BY doc_id ORDER BY p_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
)
def r11(spark, d):
    return neighbors(_par(spark, d)).select("doc_id", "p_idx", F.array_join("paragraph_indexes", ",").alias("places"), F.md5("context").alias("context"))


@query(
    "r12_metadata_routing", "",
    r"""WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderpriority AS kind FROM orders),
f AS (SELECT * FROM o WHERE o_orderkey % 50 = 0),
s AS (SELECT f.o_orderkey AS query_id, o.o_orderkey AS doc_id, 3.0 + CASE WHEN f.y = o.y THEN 1.5 ELSE 0 END + CASE WHEN f.q = o.q THEN 1 ELSE 0 END + CASE WHEN f.kind = o.kind THEN 1 ELSE 0 END AS score,
 1 + (f.y = o.y)::INT + (f.q = o.q)::INT + (f.kind = o.kind)::INT AS match_count FROM f JOIN o USING (o_custkey) WHERE f.o_orderkey <> o.o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_count DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM s)
SELECT query_id, doc_id, score::DOUBLE AS score, match_count::INT AS match_count, n::BIGINT AS candidates, rank::INT AS rank FROM r WHERE rank <= 5""",
)
def r12(spark, d):
    """Documents are orders: the entity is the customer, which blocks the join."""
    date = F.col("o_orderdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year(date).alias("y"), F.quarter(date).alias("q"), F.col("o_orderpriority").alias("kind"))
    f = o.where("o_orderkey % 50 = 0").toDF("query_id", "o_custkey", "fy", "fq", "fkind")
    same = [F.col("fy") == F.col("y"), F.col("fq") == F.col("q"), F.col("fkind") == F.col("kind")]
    score = F.lit(3.0) + sum((F.when(c, w).otherwise(0.0) for c, w in zip(same, (1.5, 1.0, 1.0), strict=True)), F.lit(0.0))
    s = f.join(o, "o_custkey").where("query_id <> o_orderkey").select("query_id", F.col("o_orderkey").alias("doc_id"), score.alias("score"), (F.lit(1) + sum((c.cast("int") for c in same), F.lit(0))).alias("match_count"))
    w = Window.partitionBy("query_id")
    s = s.withColumn("candidates", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("match_count"), "doc_id")))
    return s.where("rank <= 5")


@query(
    "r17_query_expansion", "R17 R18",
    rf"""WITH {STATS}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
v AS (SELECT query_id, 0 AS pos, query AS v FROM q UNION ALL SELECT query_id, 1, lower(query) FROM q UNION ALL SELECT query_id, 2, split_part(query, '.', 1) FROM q),
u AS (SELECT query_id, pos, v FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(v) ORDER BY pos) AS k FROM v) WHERE k = 1),
qt AS (SELECT query_id, pos, term, count(*) AS qtf FROM (SELECT query_id, pos, unnest({TOK.format('v')}) AS term FROM u) GROUP BY ALL),
bm AS (SELECT query_id, pos, doc_id, p_idx, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl) + 1e-9)), 9) AS s FROM posts JOIN idf USING (term) JOIN qt USING (term), st GROUP BY ALL),
m AS (SELECT query_id, doc_id, p_idx, max(s) AS score FROM bm GROUP BY ALL)
SELECT query_id, doc_id, p_idx::INT AS p_idx, score, rank::INT AS rank FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM m) WHERE rank <= 5""",
)
def r17(spark, d):
    q = _queries(spark, d)
    v = q.select("query_id", F.posexplode(F.array("query", F.lower("query"), F.split("query", r"\.")[0])).alias("pos", "v"))
    w = Window.partitionBy("query_id", F.lower("v")).orderBy("pos")
    u = v.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.struct("query_id", "pos").alias("query_id"), F.col("v").alias("query"))
    # what is among a query's five best is among the five best of one of its wordings
    best = Weighed(_par(spark, d), u).best(5).groupBy(F.col("query_id.query_id").alias("query_id"), "doc_id", "p_idx").agg(F.max("score").alias("score"))
    return top_k(best, 5, "doc_id", "p_idx")


@query(
    "r19_centroids", "R19",
    "SELECT label, (i - 1)::INT AS place, round(avg(e), 5) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL",
)
def r19(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("place", "e"))
    return e.groupBy("label", "place").agg(F.round(F.avg(F.col("e").cast("double")), 5).alias("mean"))


@query(
    "r20_two_level", "R20",
    f"""WITH {BM25}, dd AS (SELECT query_id, doc_id, max(score) AS score FROM bm GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, {RANK.format('doc_id')} FROM dd) WHERE rank <= 3)
SELECT query_id, doc_id, rank::INT AS rank, count(*)::BIGINT AS n_lines, sum(length(text))::BIGINT AS chars FROM t JOIN par USING (doc_id) GROUP BY ALL""",
)
def r20(spark, d):
    par = _par(spark, d)
    t = scratch_table(Weighed(par, _queries(spark, d)).best(3, documents=True), "best")
    return par.join(small(t), "doc_id").groupBy("query_id", "doc_id", "rank").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars"))


@query(
    "r21_keyword_lookup", "R21",
    "SELECT 'turn' AS kind, conv_id AS id, count(*)::BIGINT AS n FROM conversations WHERE text ILIKE '%tion the%' GROUP BY conv_id UNION ALL SELECT 'document', doc_id, 1 FROM documents WHERE text ILIKE '%tion the%'",
)
def r21(spark, d):
    like = F.col("text").ilike("%tion the%")
    a = table(spark, d, "conversations").where(like).groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n")).select(F.lit("turn").alias("kind"), "id", "n")
    return a.unionByName(table(spark, d, "documents").where(like).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("n")))


@query(
    "r23_gate", "R16",
    f"""WITH {BM25}, n AS (SELECT query_id, count(*) AS n FROM bm GROUP BY query_id)
SELECT query_id, query_id % 3 = 0 AND coalesce(n, 0) > 0 AS routed, greatest(2, least(30, 2 + (coalesce(n, 0) % 40)))::BIGINT AS depth FROM q LEFT JOIN n USING (query_id)""",
)
def r23(spark, d):
    q = _queries(spark, d)
    n = Weighed(_par(spark, d), q).counts()
    n0 = F.coalesce("n", F.lit(0))
    return q.join(n, "query_id", "left").select("query_id", ((F.col("query_id") % 3 == 0) & (n0 > 0)).alias("routed"), F.greatest(F.lit(2), F.least(F.lit(30), 2 + n0 % 40)).alias("depth"))


@query(
    "r23_gated_results", "R23",
    f"""WITH {TITLES}, t AS (SELECT query_id, page_id AS hit, rank FROM (SELECT *, {RANK.format('title, page_id')} FROM r WHERE score > 0) WHERE rank <= 3),
bs AS (SELECT query_id, page_id AS hit, rank FROM (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS rank FROM q, pg) WHERE rank <= 2),
g AS (SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 = 0 AND item_id IN (SELECT query_id FROM t))
SELECT query_id, hit, rank::INT AS rank, true AS is_routed FROM t WHERE query_id IN (SELECT query_id FROM g) UNION ALL SELECT query_id, hit, rank::INT, false FROM bs WHERE query_id NOT IN (SELECT query_id FROM g)""",
)
def r23_gated(spark, d):
    """Pages by title where the gate opens, else the first pages."""
    q = _queries(spark, d)
    docs = _pages(spark, d).select(F.col("page_id").alias("doc_id"), F.col("title").alias("source_name"))
    routed = route_titles(q, docs, 3).where("rank is not null").select("query_id", F.col("doc_id").alias("hit"), "rank")
    first = docs.orderBy("doc_id").limit(2).select(F.col("doc_id").alias("hit"))
    base = q.select("query_id").crossJoin(F.broadcast(first)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hit")))
    return gated(routed, base, q.where("query_id % 2 = 0 or query_id % 3 = 0").select("query_id", (F.col("query_id") % 3 == 0).alias("use_tool")))
