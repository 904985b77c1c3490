"""Queries that cut whole documents into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.chunking import SENTENCE_END, chunk_policy, chunks, recursive_chunks, sentence_chunks
from quarry.plans.register import query
from quarry.sources.tables import dealt, table


def _docs(spark, d):
    return dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query(
    "d14_fixed_chunks", "D14",
    "SELECT doc_id, s::INT AS start, length(substr(text, s + 1, 800))::INT AS n, md5(substr(text, s + 1, 800)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(0, length(text), 700)) AS s FROM documents)",
)
def d14(spark, d):
    return chunks(table(spark, d, "documents"), 800, 100).select("doc_id", "start", F.length("chunk").alias("n"), F.md5("chunk").alias("chunk_md5"))


@query(
    "d16_policy_chunks", "D16",
    """WITH p AS (SELECT *, CASE WHEN lang = 'en' THEN 1000 ELSE 800 END AS size, CASE WHEN lang = 'en' THEN 150 ELSE 100 END AS lap FROM documents)
SELECT doc_id, s::INT AS start, length(substr(text, s + 1, size))::INT AS n, md5(substr(text, s + 1, size)) AS chunk_md5 FROM (SELECT doc_id, text, size, unnest(range(0, length(text), size - lap)) AS s FROM p)""",
)
def d16(spark, d):
    """English documents are taken as filings, whose chunks are larger."""
    docs, filing = table(spark, d, "documents"), F.coalesce(F.col("lang") == "en", F.lit(False))
    c = chunks(docs.where(filing), *chunk_policy(800, 100, finance=True)).unionByName(chunks(docs.where(~filing), *chunk_policy(800, 100)))
    return c.select("doc_id", "start", F.length("chunk").alias("n"), F.md5("chunk").alias("chunk_md5"))


_END = SENTENCE_END.replace(r"\s*", "")


def packed(source: str, size: int = 800, lap: int = 100, least: int = 200, most: int = 1200) -> str:
    """SQL of sentences packed one by one, for texts (doc_id, text): k is the next sentence, b and e where the chunk at hand begins and ends, (cb, ce) one that is full."""
    other = f"[^{_END[1:-1]}]"
    return rf"""d AS (SELECT doc_id, text, list(z ORDER BY i) AS ends FROM (SELECT doc_id, text, i, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM
  (SELECT doc_id, text, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{other}*{_END}\s*|{other}+') AS s FROM {source}))) GROUP BY ALL),
st AS (SELECT doc_id, 0 AS step, 1 AS k, 0::BIGINT AS b, 0::BIGINT AS e, NULL::BIGINT AS cb, NULL::BIGINT AS ce FROM d
 UNION ALL SELECT doc_id, step + 1, k2, CASE WHEN NOT closes THEN CASE WHEN b = e THEN e ELSE b END WHEN again = b AND k2 = k THEN e2 ELSE again END, e2, CASE WHEN closes THEN b END, CASE WHEN closes THEN e2 END
 FROM (SELECT *, CASE WHEN m = '' THEN tail ELSE tail + length(m) END AS again FROM (SELECT *, regexp_extract(substr(text, tail + 1, e2 - tail), '^{other}*{_END}\s*') AS m
 FROM (SELECT *, greatest(b, e2 - {lap}) AS tail FROM (SELECT *, CASE WHEN takes THEN z ELSE e END AS e2, CASE WHEN takes THEN k + 1 ELSE k END AS k2
 FROM (SELECT st.*, d.text, d.ends[k]::BIGINT AS z, b < e AND d.ends[k] - b > {size} AS closes, b = e OR d.ends[k] - b <= {most} AS takes FROM st JOIN d USING (doc_id) WHERE k <= len(d.ends))))))),
full_ AS (SELECT doc_id, step, substr(text, cb + 1, ce - cb) AS c FROM st JOIN d USING (doc_id) WHERE cb IS NOT NULL),
last_ AS (SELECT st.doc_id, st.step, substr(text, b + 1, e - b) AS c FROM st JOIN d USING (doc_id) WHERE k > len(ends) AND b < e),
top_ AS (SELECT doc_id, max(step) AS step FROM full_ GROUP BY doc_id),
made AS (SELECT f.doc_id, f.step, f.c || CASE WHEN f.step = t.step AND length(l.c) < {least} THEN l.c ELSE '' END AS c FROM full_ f JOIN top_ t ON t.doc_id = f.doc_id LEFT JOIN last_ l ON l.doc_id = f.doc_id
 UNION ALL SELECT l.doc_id, l.step + 1, l.c FROM last_ l LEFT JOIN top_ t ON t.doc_id = l.doc_id WHERE t.step IS NULL OR length(l.c) >= {least}),
grouped AS (SELECT *, sum((length(c) >= {least})::INT) OVER w + CASE WHEN first_value(length(c)) OVER w < {least} THEN 1 ELSE 0 END AS g FROM made WINDOW w AS (PARTITION BY doc_id ORDER BY step)),
chunked AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS n, string_agg(c, '' ORDER BY step) AS chunk FROM grouped GROUP BY doc_id, g)"""


@query("d15_sentence_chunks", "D15", f"WITH RECURSIVE {packed('documents')} SELECT doc_id, n, length(chunk)::INT AS size, md5(chunk) AS chunk_md5 FROM chunked")
def d15(spark, d):
    return sentence_chunks(spark, _docs(spark, d)).select("doc_id", "n", F.length("chunk").alias("size"), F.md5("chunk").alias("chunk_md5"))


@query("d17_recursive_chunks", "D17")
def d17(spark, d):
    """Whole documents, split at the widest separators that make pieces short enough (brute force: tests/test_chunking.py)."""
    return recursive_chunks(_docs(spark, d)).select("doc_id", "n", F.length("chunk").alias("size"), F.md5("chunk").alias("chunk_md5"))
