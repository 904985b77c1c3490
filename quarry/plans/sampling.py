"""Queries over sampling, splitting, and sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.sampling import balance_errors, best_split, drifted, group_split, manifest, order, pilot, quota, round_robin, unchanged, verbatim
from quarry.plans.register import query
from quarry.sources.formats import round_trip
from quarry.sources.tables import scratch_table, table

SPLIT = """g AS (SELECT o_custkey, count(*) AS k, sha1('s1' || o_custkey) AS h FROM orders GROUP BY o_custkey),
c AS (SELECT o_custkey, sum(k) OVER (ORDER BY h) * 1.0 / sum(k) OVER () AS share FROM g),
s AS (SELECT o.*, CASE WHEN share <= 0.4 THEN 'train' WHEN share <= 0.6 THEN 'dev' ELSE 'test' END AS split FROM orders o JOIN c USING (o_custkey))"""


@query("p01_random_split", "P1 P8", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY sha1('s0' || o_orderkey)) <= 100 THEN 'train' ELSE 'dev' END AS split FROM (SELECT * FROM orders ORDER BY sha1('s0' || o_orderkey) LIMIT 150)")
def p01(spark, d):
    first = table(spark, d, "orders").select("o_orderkey", order("s0", "o_orderkey").alias("h")).orderBy("h").limit(150)
    from pyspark.sql import Window

    return first.select("o_orderkey", F.when(F.row_number().over(Window.orderBy("h")) <= 100, "train").otherwise("dev").alias("split"))


TYPED = """e AS (SELECT *, sha1(seed || o_custkey) AS h FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey), (SELECT 's' || i AS seed FROM range(8) r(i))),
c AS (SELECT seed, o_custkey, sum(k) OVER (PARTITION BY seed ORDER BY h, o_custkey) * 1.0 / sum(k) OVER (PARTITION BY seed) AS share FROM e),
x AS (SELECT seed, o_custkey, CASE WHEN share <= 0.4 THEN 'train' WHEN share <= 0.6 THEN 'dev' ELSE 'test' END AS split FROM c),
n AS (SELECT seed, split, o_orderpriority AS kind, count(*) AS n FROM x JOIN orders USING (o_custkey) GROUP BY ALL),
w AS (SELECT seed, split, kind, total * part AS want FROM (SELECT o_orderpriority AS kind, count(*) AS total FROM orders GROUP BY 1), (SELECT DISTINCT seed FROM e), (VALUES ('train', 0.4), ('dev', 0.2), ('test', 0.4)) v(split, part)),
err AS (SELECT seed, round(sum(abs(coalesce(n, 0) - want)), 4)::DOUBLE AS error FROM w LEFT JOIN n USING (seed, split, kind) GROUP BY seed)"""


@query("p05_balance_errors", "P5 P7", f"WITH {TYPED} SELECT seed, error FROM err")
def p05(spark, d):
    return balance_errors(table(spark, d, "orders"), "o_custkey", "o_orderpriority", 8)


@query(
    "p10_best_split_manifest", "P5 P10 P11",
    f"""WITH {TYPED}, b AS (SELECT seed FROM err ORDER BY error, seed LIMIT 1), s AS (SELECT orders.*, split FROM orders JOIN x USING (o_custkey) JOIN b USING (seed)),
k AS (SELECT split, string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority || '=' || n) AS kinds FROM (SELECT split, o_orderpriority, count(*) AS n FROM s GROUP BY ALL) GROUP BY split)
SELECT split, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS n_groups, any_value(kinds) AS kinds, bit_xor(('0x' || left(md5(o_orderkey::VARCHAR), 15))::BIGINT) AS digest, true AS disjoint FROM s JOIN k USING (split) GROUP BY split""",
)
def p10(spark, d):
    s = best_split(table(spark, d, "orders"), "o_custkey", "o_orderpriority", 8)
    return manifest(s, "o_custkey", "o_orderpriority", "o_orderkey", "best of 8").drop("seed")


@query(
    "p10_drift", "P10",
    f"""WITH {TYPED}, b AS (SELECT seed FROM err ORDER BY error, seed LIMIT 1), s AS (SELECT orders.*, split FROM orders JOIN x USING (o_custkey) JOIN b USING (seed))
SELECT split, 'changed' AS "case" FROM s WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT DISTINCT split, 'accepted' FROM s""",
)
def p10_drift(spark, d):
    """A stored manifest against the same split without its first order, and against the split as it was."""
    s = scratch_table(best_split(table(spark, d, "orders"), "o_custkey", "o_orderpriority", 8), "split")
    made = lambda df: manifest(df, "o_custkey", "o_orderpriority", "o_orderkey", "best of 8")
    before = scratch_table(made(s), "manifest")
    less = s.join(F.broadcast(s.agg(F.min("o_orderkey").alias("o_orderkey"))), "o_orderkey", "left_anti")
    bad = drifted(made(less), before).select("split", F.lit("changed").alias("case"))
    return bad.unionByName(unchanged(made(s), before).select("split", F.lit("accepted").alias("case")))


@query(
    "p06_balanced_pilot", "P6",
    """WITH o AS (SELECT *, sha1('s6' || o_orderkey) AS h FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY h, o_orderkey) AS k FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS j FROM a WHERE k = 1)
SELECT o_orderkey, o_custkey, o_orderpriority, j > 10 AS topped_up FROM b ORDER BY j > 10, h, o_orderkey LIMIT 53""",
)
def p06(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return pilot(rows, "o_custkey", "o_orderpriority", "o_orderkey", "s6", 53, 5)


@query("p02_round_robin", "P2", "SELECT o_orderkey, o_orderpriority, turn::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha1('s2' || o_orderkey), o_orderkey) AS turn FROM orders) ORDER BY turn, o_orderpriority LIMIT 203")
def p02(spark, d):
    return round_robin(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", "s2", 203)


@query("p03_quota", "P3", "SELECT o_orderkey, o_custkey, turn::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY sha1('s3' || o_orderkey), o_orderkey) AS turn FROM orders) WHERE turn <= 2")
def p03(spark, d):
    return quota(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", "s3", 2)


@query("p04_group_split", "P4 P11", f"WITH {SPLIT} SELECT split, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS n_groups FROM s GROUP BY split")
def p04(spark, d):
    return group_split(table(spark, d, "orders"), "o_custkey", "s1").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_groups"))


@query(
    "p07_balance_error", "P7 P10",
    f"""WITH {SPLIT}, a AS (SELECT split, o_orderpriority AS kind, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT split, sum(n) AS m FROM a GROUP BY split), k AS (SELECT kind, sum(n) AS m FROM a GROUP BY kind), z AS (SELECT sum(n) AS m FROM a)
SELECT split, round(sum(abs(coalesce(n, 0) - t.m * k.m * 1.0 / z.m)), 4)::DOUBLE AS error FROM t CROSS JOIN k CROSS JOIN z LEFT JOIN a USING (split, kind) GROUP BY split""",
)
def p07(spark, d):
    s = group_split(table(spark, d, "orders"), "o_custkey", "s1")
    a = s.groupBy("split", F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))
    t, k, z = a.groupBy("split").agg(F.sum("n").alias("ts")), a.groupBy("kind").agg(F.sum("n").alias("ks")), a.agg(F.sum("n").alias("zs"))
    full = t.crossJoin(F.broadcast(k)).crossJoin(F.broadcast(z)).join(a, ["split", "kind"], "left")  # splits x kinds: a few rows
    return full.groupBy("split").agg(F.round(F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.col("ts") * F.col("ks") / F.col("zs"))), 4).alias("error"))


@query("p09_shards", "P9", "SELECT i::INT AS shard, count(*)::BIGINT AS n FROM (SELECT o_orderkey % 7 AS i FROM orders) GROUP BY i")
def p09(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_orderkey") % 7).cast("int").alias("shard")).agg(F.count("*").alias("n"))


@query("p15_leak_scan", "P15", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def p15(spark, d):
    return verbatim(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


def _formats(name, ids, source, kind, sql, columns):
    @query(name, ids, sql)
    def run(spark, d):
        return round_trip(spark, table(spark, d, source).select(*columns), kind)

    return run


_formats("s01_jsonl", "S15", "benchmark", "json", "SELECT item_id, text FROM benchmark", ["item_id", "text"])
_formats("s05_csv", "S15", "conversations", "csv", "SELECT conv_id, turn, role, text FROM conversations", ["conv_id", "turn", "role", "text"])
_formats("s11_parquet", "S15", "embeddings", "parquet", "SELECT vec_id, label FROM embeddings", ["vec_id", "label"])
_formats("s10_orc", "S15", "documents", "orc", "SELECT doc_id, lang, source FROM documents", ["doc_id", "lang", "source"])


@query("s07_first_per_id", "", "SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey")
def s07(spark, d):
    """Keep-first and keep-last per key, as ingest with IGNORE and REPLACE does."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("s09_spans", "S9", "SELECT doc_id, substr(text, (doc_id % 30)::BIGINT + 1, 20) AS span FROM documents")
def s09(spark, d):
    start = F.col("doc_id") % 30
    return table(spark, d, "documents").select("doc_id", F.substr("text", (start + 1).cast("int"), F.lit(20)).alias("span"))


@query("s19_delete_documents", "S19 J4", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s19(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(gone, "doc_id", "left_anti").select("doc_id", "n_chars")
