"""Queries over evaluation, rules and event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.text import answer_tokens, is_refusal, measured_tokens
from quarry.operators import rules
from quarry.operators.evaluation import (
    arms, best_gold_f1, by_split, completeness, judged_again, outcome, paired, passes, ranking_assertions, refusal_override, relation, report_lines, select_candidate, token_f1_by_words,
)
from quarry.operators.retrieval import Weighed, top_k
from quarry.operators.routing import FacetRouting, route_titles
from quarry.operators.sampling import hard_cases, indexed, verbatim, weak_and_strong
from quarry.operators.traces import budget, candidate_depths, event_counts, ingestion_totals, log_summary, merged_results, paginate, resumed, round_distribution, round_summary, rounds
from quarry.plans.register import query
from quarry.plans.retrieval import BM25, RANK, _asked, _facet_sql, _filings, _par, _queries
from quarry.sources.tables import scratch_path, scratch_table, small, table
from quarry.streaming.monitor import progress
from quarry.streaming.pagination import paginate_stream

ANS = r"""list_filter(regexp_split_to_array(translate(lower(replace({0}, ',', '')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the', 'and'))"""
JUDGED = """j AS (SELECT doc_id AS case_id, 'base' AS arm, quality * 4 AS score, (100 + doc_id * 37 % 400) AS tokens, (10 + doc_id * 13 % 50) / 10.0 AS latency, doc_id % 5 AS kind FROM labels
 UNION ALL SELECT doc_id, 'candidate', greatest(0, least(4, quality * 4 + CASE WHEN doc_id % 11 = 0 THEN 2 WHEN doc_id % 17 = 0 THEN -2 ELSE 0 END)), (90 + doc_id * 41 % 380), (8 + doc_id * 17 % 45) / 10.0, doc_id % 5 FROM labels)"""
PAIRED = f"""{JUDGED}, p AS (SELECT case_id, b.kind, b.score AS b, c.score AS c, b.tokens AS b_tokens, c.tokens AS c_tokens, c.score - b.score AS delta FROM (SELECT * FROM j WHERE arm = 'base') b JOIN (SELECT * FROM j WHERE arm = 'candidate') c USING (case_id))"""
OUT = """count(*)::BIGINT AS n, count(*) FILTER (delta > 0)::BIGINT AS wins, count(*) FILTER (delta = 0)::BIGINT AS ties, count(*) FILTER (delta < 0)::BIGINT AS losses,
count(*) FILTER (delta <= -2)::BIGINT AS large_regressions, sum(delta)::BIGINT AS net, round(coalesce((sum(c_tokens) - sum(b_tokens)) / nullif(sum(b_tokens), 0), 0), 4)::DOUBLE AS token_change"""


def _judged(spark, d):
    """Two arms made from labels by the id."""
    i, q = F.col("doc_id"), F.col("quality") * 4
    labels = table(spark, d, "labels")
    row = lambda arm, score, tokens, latency: labels.select(i.alias("case_id"), F.lit(arm).alias("arm"), score.alias("score"), tokens.alias("tokens"), (latency / 10).alias("latency"), (i % 5).alias("kind"))
    moved = F.greatest(F.lit(0), F.least(F.lit(4), q + F.when(i % 11 == 0, 2).when(i % 17 == 0, -2).otherwise(0)))
    return row("base", q, 100 + i * 37 % 400, 10 + i * 13 % 50).unionByName(row("candidate", moved, 90 + i * 41 % 380, 8 + i * 17 % 45))


@query(
    "e01_token_f1", "E1",
    f"""WITH p AS (SELECT b.item_id, d.doc_id, {ANS.format('b.text')} AS g, {ANS.format('d.text')} AS t FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40),
x AS (SELECT item_id, doc_id, w, count(*) AS n FROM (SELECT item_id, doc_id, unnest(g) AS w FROM p) GROUP BY ALL), y AS (SELECT item_id, doc_id, w, count(*) AS n FROM (SELECT item_id, doc_id, unnest(t) AS w FROM p) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(least(x.n, y.n)) AS same FROM x JOIN y USING (item_id, doc_id, w) GROUP BY ALL)
SELECT item_id, doc_id, round(coalesce(same * 2.0 / (len(g) + len(t)), 0), 4)::DOUBLE AS f1 FROM p LEFT JOIN s USING (item_id, doc_id)""",
)
def e01(spark, d):
    b = table(spark, d, "benchmark").select("item_id", answer_tokens("text").alias("g"))
    docs = scratch_table(table(spark, d, "documents").select("doc_id", answer_tokens("text").alias("t")), "answers")
    p = docs.select("doc_id").join(small(b.select("item_id")), F.col("doc_id") % 40 == F.col("item_id") % 40)
    return token_f1_by_words(p, docs, b)


@query(
    "e01_whole_token_f1", "E1 E2",
    f"""WITH p AS (SELECT b.item_id, d.doc_id, {ANS.format('b.text')} AS g, {ANS.format('d.text')} AS t FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
x AS (SELECT item_id, doc_id, w, count(*) AS n FROM (SELECT item_id, doc_id, unnest(g) AS w FROM p) GROUP BY ALL), y AS (SELECT item_id, doc_id, w, count(*) AS n FROM (SELECT item_id, doc_id, unnest(t) AS w FROM p) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(least(x.n, y.n)) AS same FROM x JOIN y USING (item_id, doc_id, w) GROUP BY ALL),
f AS (SELECT doc_id, count(*) AS n_golds, max(round(coalesce(same * 2.0 / (len(g) + len(t)), 0), 4)) AS f1 FROM p LEFT JOIN s USING (item_id, doc_id) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_golds, 0)::BIGINT AS n_golds, coalesce(f1, 0)::DOUBLE AS f1 FROM documents d LEFT JOIN f USING (doc_id)""",
)
def e01_whole(spark, d):
    """Each whole document against the items that it holds verbatim: the best F1, 0 without any."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    p = scratch_table(verbatim(docs, items), "pairs")
    said = docs.join(p.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", answer_tokens("text").alias("t"))
    f1 = token_f1_by_words(p, said, items.select("item_id", answer_tokens("text").alias("g")))
    best = f1.groupBy("doc_id").agg(F.count("*").alias("n_golds"), F.max("f1").alias("f1"))
    return docs.select("doc_id").join(best, "doc_id", "left").fillna(0, ["n_golds", "f1"])


GOLDS = """gd AS (SELECT conv_id * 1000 + turn AS case_id, text, list_filter([lead(text, 1) OVER w, lead(text, 2) OVER w], lambda x: x IS NOT NULL) AS golds FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
gx AS (SELECT case_id, unnest(golds) AS gold, generate_subscripts(golds, 1) AS place FROM gd)"""


def _golds(spark, d):
    """Turns as answers, the two turns behind each as its golds."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), "text", F.array_compact(F.array(F.lead("text", 1).over(w), F.lead("text", 2).over(w))).alias("golds"))


def _best_f1_sql(tok):
    return f"""WITH {GOLDS}, pg AS (SELECT case_id, place, {tok.format('text')} AS t, {tok.format('gold')} AS g FROM gx JOIN gd USING (case_id)),
x AS (SELECT case_id, place, w, count(*) AS n FROM (SELECT case_id, place, unnest(g) AS w FROM pg) GROUP BY ALL), y AS (SELECT case_id, place, w, count(*) AS n FROM (SELECT case_id, place, unnest(t) AS w FROM pg) GROUP BY ALL),
s AS (SELECT case_id, place, sum(least(x.n, y.n)) AS same FROM x JOIN y USING (case_id, place, w) GROUP BY ALL),
f AS (SELECT case_id, place, round(coalesce(same * 2.0 / (len(g) + len(t)), 0), 4) AS f1 FROM pg LEFT JOIN s USING (case_id, place))
SELECT gd.case_id, coalesce(max(f1), 0)::DOUBLE AS f1, count(f1)::BIGINT AS n_golds FROM gd LEFT JOIN f USING (case_id) GROUP BY gd.case_id"""


@query("e02_best_gold_f1", "E1 E2", _best_f1_sql(ANS))
def e02(spark, d):
    return best_gold_f1(_golds(spark, d), "case_id", answer_tokens("text"), F.col("golds"), answer_tokens)


@query("e05_measured_f1", "E5", _best_f1_sql("regexp_extract_all(lower({0}), '[A-Za-z0-9.%$-]+')"))
def e05(spark, d):
    """F1 over tokens that keep signs of measure and articles."""
    return best_gold_f1(_golds(spark, d), "case_id", measured_tokens("text"), F.col("golds"), measured_tokens)


@query(
    "e04_refusals_of_both", "E4",
    """SELECT doc_id, quality * 4 * CASE WHEN r AND g THEN 0 ELSE 1 END + CASE WHEN r AND g THEN 4 ELSE 0 END AS score, CASE WHEN r AND g THEN 1.0 ELSE 0.25 END::DOUBLE AS f1
FROM (SELECT doc_id, quality, doc_id % 3 = 0 AS r, doc_id % 2 = 0 AS g FROM labels)""",
)
def e04_both(spark, d):
    i = F.col("doc_id")
    answer = F.when(i % 3 == 0, "This is Not Mentioned anywhere").otherwise("42")
    golds = F.array(F.lit("43"), F.when(i % 2 == 0, "no information").otherwise("44"))
    scored = table(spark, d, "labels").select("doc_id", (F.col("quality") * 4).alias("score"), F.lit(0.25).alias("f1"), answer.alias("answer"), golds.alias("golds"))
    return refusal_override(scored, is_refusal("answer"), F.exists("golds", is_refusal)).select("doc_id", "score", "f1")


@query(
    "e09_metrics_by_split", "E6 E9",
    f"""WITH {JUDGED}, s AS (SELECT j.*, CASE case_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM j WHERE arm = 'base')
SELECT coalesce(split, 'all') AS split, count(*)::BIGINT AS n, round(avg(score), 4)::DOUBLE AS avg_score, round(sum(score) / (4.0 * count(*)), 4)::DOUBLE AS accuracy, round(avg(tokens), 4)::DOUBLE AS avg_tokens FROM s GROUP BY ROLLUP (split)""",
)
def e09(spark, d):
    j = _judged(spark, d).where("arm = 'base'")
    return by_split(j, j.select("case_id", F.when(F.col("case_id") % 3 == 0, "train").when(F.col("case_id") % 3 == 1, "dev").otherwise("test").alias("split")))


@query(
    "e12_pair_metrics", "E7 E12 E13 E23",
    f"""WITH {JUDGED}, p AS (SELECT b.case_id, b.score AS b, c.score AS c, b.tokens AS bt, c.tokens AS ct, b.latency AS bl, c.latency AS cl FROM (SELECT * FROM j WHERE arm = 'base') b JOIN (SELECT * FROM j WHERE arm = 'candidate') c USING (case_id))
SELECT CASE WHEN c > b THEN 'candidate_better' WHEN c < b THEN 'baseline_better' ELSE 'tie' END AS relation, count(*)::BIGINT AS n, sum(bt)::BIGINT AS base_tokens, sum(ct)::BIGINT AS candidate_tokens, round((sum(ct) - sum(bt)) / sum(bt), 4)::DOUBLE AS token_change, round((sum(cl) - sum(bl)) / sum(bl), 4)::DOUBLE AS latency_change FROM p GROUP BY 1""",
)
def e12(spark, d):
    j = _judged(spark, d)
    latency = lambda arm, name: j.where(F.col("arm") == arm).select("case_id", F.col("latency").alias(name))
    p = paired(j, "base", "candidate").join(latency("base", "b_latency"), "case_id").join(latency("candidate", "c_latency"), "case_id")
    relation = F.when(F.col("delta") > 0, "candidate_better").when(F.col("delta") < 0, "baseline_better").otherwise("tie")
    change = lambda a, b: F.round(F.coalesce(F.try_divide(F.sum(b) - F.sum(a), F.sum(a)), F.lit(0.0)), 4)
    return p.groupBy(relation.alias("relation")).agg(
        F.count("*").alias("n"), F.sum("b_tokens").cast("long").alias("base_tokens"), F.sum("c_tokens").cast("long").alias("candidate_tokens"), change("b_tokens", "c_tokens").alias("token_change"), change("b_latency", "c_latency").alias("latency_change")
    )


@query(
    "e15_selected_candidate", "E15",
    f"""WITH {JUDGED}, a AS (SELECT CASE WHEN arm = 'base' THEN 'base' ELSE 'k' || kind END AS arm, round(sum(score) / (4.0 * count(*)), 4) AS accuracy, count(*) AS net, round(avg(tokens), 4) AS tokens, round(avg(latency), 4) AS latency FROM j GROUP BY 1)
SELECT arm, accuracy::DOUBLE AS accuracy, net::BIGINT AS net FROM a WHERE accuracy >= (SELECT accuracy FROM a WHERE arm = 'base') ORDER BY arm <> 'base' DESC, accuracy DESC, net DESC, tokens, latency, arm LIMIT 1""",
)
def e15(spark, d):
    """The candidates are the kinds of cases, so each has its own metrics."""
    j = _judged(spark, d).withColumn("arm", F.when(F.col("arm") == "base", "base").otherwise(F.concat(F.lit("k"), F.col("kind").cast("string"))))
    m = arms(j).select("arm", "accuracy", F.col("n").alias("net"), F.col("avg_tokens").alias("tokens"), F.col("avg_latency").alias("latency"))
    return select_candidate(m, "base").select("arm", "accuracy", "net")


@query(
    "e20_judged_again", "E19 E20",
    """WITH a AS (SELECT doc_id AS case_id, md5(text) AS answer FROM documents), s AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE 'other' END AS answer, CASE WHEN doc_id % 2 = 0 THEN 'judge' ELSE 'former' END AS m, doc_id % 5 AS score FROM documents)
SELECT a.case_id, coalesce(s.score, -1)::BIGINT AS score, s.score IS NOT NULL AS held FROM a LEFT JOIN (SELECT * FROM s WHERE m = 'judge') s USING (case_id, answer)""",
)
def e20(spark, d):
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    answers = docs.select(i.alias("case_id"), F.md5("text").alias("answer"))
    saved = docs.select(i.alias("case_id"), F.when(i % 3 == 0, F.md5("text")).otherwise("other").alias("answer"), F.when(i % 2 == 0, "judge").otherwise("former").alias("judge_model"), (i % 5).alias("score"))
    held, rest = judged_again(answers, saved, "judge")
    return held.select("case_id", "score", F.lit(True).alias("held")).unionByName(rest.select("case_id", F.lit(-1).cast("long").alias("score"), F.lit(False).alias("held")))


@query("e22_ranking_assertions", "E22")
def e22(spark, d):
    """Each filing's own name as a question: the expected document is given for some, and said in words for others (the rest only have to run)."""
    docs = _filings(spark, d)
    q = docs.select(F.col("doc_id").alias("query_id"), F.replace("doc_id", F.lit("_"), F.lit(" ")).alias("query"))
    i = F.crc32("query_id") % 3
    tests = q.select(F.col("query_id").alias("name"), "query_id", F.when(i == 0, F.col("query_id")).otherwise("").alias("expected_top"), F.when(i == 1, F.concat("query_id", F.lit(" is ranked first"))).otherwise("").alias("expected_text"))
    ranked = route_titles(q, docs, 1).where("rank = 1")
    return ranking_assertions(tests, ranked).groupBy("check").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


@query(
    "e25_report_lines", "E25",
    f"""WITH {PAIRED} SELECT row_number() OVER (ORDER BY delta DESC, case_id)::BIGINT AS place, case_id, '| ' || case_id || ' | ' || b || ' | ' || c || ' | ' || delta || ' | ' || replace(regexp_replace(text, '\\s+', ' ', 'g'), '|', '\\|') || ' |' AS line FROM p JOIN documents ON doc_id = case_id""",
)
def e25(spark, d):
    p = paired(_judged(spark, d), "base", "candidate").join(table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "text"), "case_id")
    return report_lines(p, "text")


@query(
    "e26_completeness", "E26",
    """WITH e AS (SELECT doc_id, source FROM documents), f AS (SELECT doc_id, 'x' AS source FROM labels UNION SELECT -doc_id - 1, 'x' FROM labels WHERE doc_id % 4 = 0)
SELECT coalesce(e.source, f.source) AS source, count(e.doc_id)::BIGINT AS n_expected, count(f.doc_id)::BIGINT AS n_found, count(*) FILTER (f.doc_id IS NULL)::BIGINT AS n_missing, count(*) FILTER (e.doc_id IS NULL)::BIGINT AS n_unexpected, count(*) FILTER (f.doc_id IS NULL OR e.doc_id IS NULL) = 0 AS complete FROM e FULL JOIN f USING (doc_id) GROUP BY 1""",
)
def e26(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.lit("x").alias("source"))
    found = labels.unionByName(labels.where("doc_id % 4 = 0").withColumn("doc_id", -F.col("doc_id") - 1))
    return completeness(table(spark, d, "documents").select("doc_id", "source"), found, "doc_id", "source")


@query(
    "p13_weak_and_strong", "P13",
    f"WITH {JUDGED}, c AS (SELECT case_id, score FROM j WHERE arm = 'candidate') (SELECT case_id, score::INT AS score, 'failure' AS kind FROM c WHERE score <= 2 ORDER BY score, case_id LIMIT 30) UNION ALL (SELECT case_id, score::INT, 'success' FROM c WHERE score >= 4 ORDER BY score DESC, case_id LIMIT 10)",
)
def p13(spark, d):
    return weak_and_strong(_judged(spark, d).where("arm = 'candidate'").select("case_id", "score"), 30, 10)


@query(
    "p14_hard_cases", "P14",
    f"""WITH {JUDGED}, c AS (SELECT case_id, kind, score, (case_id * 7 % 100) / 100.0 AS recall, tokens FROM j WHERE arm = 'candidate'),
t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score, recall, tokens DESC, case_id) AS turn FROM c), h AS (SELECT * FROM t ORDER BY turn, score, recall, tokens DESC, case_id LIMIT 30),
g AS (SELECT * FROM c WHERE score >= 4 ORDER BY tokens, case_id LIMIT 4)
SELECT case_id, turn::INT AS turn, 'hard' AS why FROM h UNION ALL SELECT case_id, 0, 'cheap' FROM g WHERE case_id NOT IN (SELECT case_id FROM h)""",
)
def p14(spark, d):
    c = _judged(spark, d).where("arm = 'candidate'").select("case_id", "kind", "score", (F.col("case_id") * 7 % 100 / 100).alias("recall"), "tokens")
    return hard_cases(c, "kind", 30).select("case_id", "turn", "why")


@query(
    "e03_evidence_recall", "E3 J1",
    f"""WITH {BM25}, t AS (SELECT * FROM (SELECT *, {RANK.format('doc_id, p_idx')} FROM bm) WHERE rank <= 5),
h AS (SELECT query_id, string_agg(par.text, chr(10) ORDER BY rank) AS found FROM t JOIN par USING (doc_id, p_idx) GROUP BY query_id),
r AS (SELECT query_id, query, found, list_distinct({ANS.format('query')}) AS e, list_distinct({ANS.format('found')}) AS f FROM q JOIN h USING (query_id))
SELECT query_id, position(query IN found) > 0 OR (len(e) >= 4 AND len(list_intersect(e, f)) * 1.0 / len(e) >= 0.8) AS hit, round(len(list_intersect(e, f)) * 1.0 / len(e), 4)::DOUBLE AS cover FROM r""",
)
def e03(spark, d):
    par, q = _par(spark, d), _queries(spark, d)
    best = scratch_table(Weighed(par, q).best(5).select("query_id", "doc_id", "p_idx", "rank"), "best")
    t = par.join(small(best), ["doc_id", "p_idx"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("h"))
    r = q.join(t, "query_id").withColumn("found", F.array_join(F.transform("h", lambda x: x["text"]), "\n"))
    e, f = F.array_distinct(answer_tokens("query")), F.array_distinct(answer_tokens("found"))
    cover = F.size(F.array_intersect(e, f)) / F.size(e)
    return r.select("query_id", (F.col("found").contains(F.col("query")) | ((F.size(e) >= 4) & (cover >= 0.8))).alias("hit"), F.round(cover, 4).alias("cover"))


@query("e04_refusal_override", "", "SELECT item_id, CASE WHEN regexp_matches(lower(text), 'not mentioned|no information|cannot be answered|none|unknown|don''t know') OR item_id % 7 = 0 THEN 4 ELSE 0 END::INT AS score FROM benchmark")
def e04(spark, d):
    b = table(spark, d, "benchmark").withColumn("answer", F.when(F.col("item_id") % 7 == 0, "Not mentioned").otherwise(F.col("text")))
    return b.select("item_id", F.when(is_refusal("answer"), 4).otherwise(0).alias("score"))


@query(
    "e08_arm_metrics", "E7 E8",
    f"""WITH {JUDGED} SELECT arm, count(*)::BIGINT AS n, round(avg(score), 4)::DOUBLE AS avg_score, round(sum(score) / (4.0 * count(*)), 4)::DOUBLE AS accuracy, round(avg(tokens), 4)::DOUBLE AS avg_tokens, round(avg(latency), 4)::DOUBLE AS avg_latency FROM j GROUP BY arm""",
)
def e08(spark, d):
    return arms(_judged(spark, d))


@query("e10_paired_ab", "E10 E11 J1", f"WITH {PAIRED} SELECT {OUT} FROM p")
def e10(spark, d):
    return outcome(paired(_judged(spark, d), "base", "candidate"))


@query("e13_relations", "E13", f"WITH {PAIRED} SELECT case_id, delta::INT AS delta, CASE WHEN delta > 0 THEN 'candidate_better' WHEN delta < 0 THEN 'baseline_better' ELSE 'tie' END AS relation FROM p")
def e13(spark, d):
    relation = F.when(F.col("delta") > 0, "candidate_better").when(F.col("delta") < 0, "baseline_better").otherwise("tie")
    return paired(_judged(spark, d), "base", "candidate").select("case_id", "delta", relation.alias("relation"))


@query("e18_to_adjudicate", "E18", f"WITH {PAIRED} SELECT case_id, b, c FROM p WHERE b <> c")
def e18(spark, d):
    """Cases on whose score the two arms differ."""
    return paired(_judged(spark, d), "base", "candidate").where("b <> c").select("case_id", "b", "c")


@query(
    "e14_gate", "E14",
    f"""WITH {PAIRED}, o AS (SELECT kind, {OUT} FROM p GROUP BY kind)
SELECT kind, wins, losses, net, net >= 0 AND wins > losses AND large_regressions = 0 AND token_change <= 0.1 AS passed, row_number() OVER (ORDER BY net DESC, token_change, kind)::INT AS place,
CASE WHEN large_regressions > 0 THEN 'quarantine' WHEN wins > losses THEN 'retain' ELSE 'unproven' END AS advice FROM o""",
)
def e14(spark, d):
    j = _judged(spark, d)
    o = outcome(paired(j, "base", "candidate").join(j.where("arm = 'base'").select("case_id", "kind"), "case_id"), "kind")
    place = F.row_number().over(Window.orderBy(F.desc("net"), "token_change", "kind"))  # over the few kinds
    advice = F.when(F.col("large_regressions") > 0, "quarantine").when(F.col("wins") > F.col("losses"), "retain").otherwise("unproven")
    return o.select("kind", "wins", "losses", "net", passes(o).alias("passed"), place.alias("place"), advice.alias("advice"))


@query(
    "e16_disagreement", "E16",
    f"""WITH {JUDGED}, r AS (SELECT case_id, score / 4.0 AS acc, (case_id * 7 % 100) / 100.0 AS recall FROM j WHERE arm = 'candidate')
SELECT case_id, CASE WHEN recall >= 0.8 AND acc <= 0.2 THEN 'found_but_wrong' ELSE 'right_but_unfound' END AS "case" FROM r WHERE recall >= 0.8 AND acc <= 0.2 OR recall <= 0.2 AND acc >= 0.8""",
)
def e16(spark, d):
    r = _judged(spark, d).where("arm = 'candidate'").select("case_id", (F.col("score") / 4).alias("acc"), (F.col("case_id") * 7 % 100 / 100).alias("recall"))
    a, b = (F.col("recall") >= 0.8) & (F.col("acc") <= 0.2), (F.col("recall") <= 0.2) & (F.col("acc") >= 0.8)
    return r.where(a | b).select("case_id", F.when(a, "found_but_wrong").otherwise("right_but_unfound").alias("case"))


@query(
    "e17_shard_merge", "E17",
    f"""WITH {JUDGED}, s AS (SELECT case_id, score, 0 AS shard FROM j WHERE arm = 'base' AND case_id % 2 = 0 UNION ALL SELECT case_id, score, 1 FROM j WHERE arm = 'base' AND case_id % 3 = 0)
SELECT count(*)::BIGINT AS n_rows, count(DISTINCT case_id)::BIGINT AS n_cases, (count(*) - count(DISTINCT case_id))::BIGINT AS n_repeated, round(avg(score), 4)::DOUBLE AS avg_score FROM s""",
)
def e17(spark, d):
    base = _judged(spark, d).where("arm = 'base'").select("case_id", "score")
    s = base.where("case_id % 2 = 0").unionByName(base.where("case_id % 3 = 0"))
    per = s.groupBy("case_id").agg(F.count("*").alias("k"), F.sum("score").alias("t"))
    n = F.sum("k")
    return per.agg(n.alias("n_rows"), F.count("*").alias("n_cases"), (n - F.count("*")).alias("n_repeated"), F.round(F.sum("t") / n, 4).alias("avg_score"))


# --- rules -------------------------------------------------------------------------------------------------------

CASES = """cs AS (SELECT item_id AS case_id, 'What growth rate is highest here? ' || text AS question FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations)"""
TAG_EDGES = f"(?:^|[^{rules.LETTER[1:]})", f"(?:$|[^{rules.LETTER[1:]})"
TAG_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(question), '{rules.whole_words(p, *TAG_EDGES)}') THEN '{t}' END" for t, p in rules.TAG_PATTERNS.items())
TAGS = f"{CASES}, t AS (SELECT case_id, question, list_sort(list_filter([{TAG_SQL}], lambda x: x IS NOT NULL)) AS tags FROM cs)"
#: Rules of the queries below: operator, required, other and excluded tags, confidence, trigger, boundary.
RULES = (
    ("QUERY_POLICY", ["entity"], ["temporal"], ["rounding"], "high", "segment region", ""), ("QUERY_POLICY", ["extraction"], [], [], "low", "which state", "dividends are paid"), ("ANSWER_GUARD", ["comparison"], [], ["unit"], "medium", "most", ""),
    ("STOP_RULE", [], ["trend", "numerical"], [], "medium", "change less", "year"), ("EVIDENCE_GUARD", ["source_scope"], [], [], "high", "according", ""),
)
_list = lambda x: "[" + ", ".join(f"'{y}'" for y in x) + "]::VARCHAR[]"
RULE_SQL = "x(rule_id, op, req, any_, exc, conf, supp) AS (VALUES " + ", ".join(f"('r{i}', '{r[0]}', {_list(r[1])}, {_list(r[2])}, {_list(r[3])}, {rules.CONFIDENCE[r[4]]}, {i + 1})" for i, r in enumerate(RULES)) + ")"
ROUTED = f"""{TAGS}, {RULE_SQL}, m AS (SELECT case_id, rule_id, op, 4 * len(req) + 2 * len(list_intersect(any_, tags)) + conf + least(2, supp) AS score FROM t, x WHERE list_has_all(tags, req) AND NOT list_has_any(tags, exc) AND (len(any_) = 0 OR list_has_any(any_, tags))),
b AS (SELECT *, row_number() OVER (PARTITION BY case_id, op ORDER BY score DESC, rule_id DESC) AS k FROM m), c AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, rule_id DESC) AS rank FROM b WHERE k = 1),
rt AS (SELECT case_id, rule_id, score, rank FROM c WHERE rank <= 2)"""


def _cases(spark, d):
    """Test items and turns as questions, with their tags."""
    c = table(spark, d, "conversations").select((1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.col("text").alias("question"))
    c = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.concat(F.lit("What growth rate is highest here? "), "text").alias("question")).unionByName(c)
    return c.withColumn("tags", rules.question_tags("question"))


def _rules(spark):
    rows = [(f"r{i}", *r[:5], [str(k) for k in range(i + 1)], r[5], "", r[6]) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_id string, repair_operator string, required_tags array<string>, any_tags array<string>, excluded_tags array<string>, confidence string, supporting_case_ids array<string>, trigger_description string, student_instruction string, do_not_apply_when string")


@query("f23_question_tags", "F23", f"WITH {TAGS} SELECT case_id, array_to_string(tags, ',') AS tags FROM t")
def f23(spark, d):
    return _cases(spark, d).select("case_id", F.array_join("tags", ",").alias("tags"))


@query(
    "x04_rule_routing", "X4 X6 J7",
    f"""WITH {ROUTED} SELECT t.case_id, coalesce(string_agg(rule_id || ':' || score, ',' ORDER BY rank), '') AS selected, count(rule_id) = 0 AS fallback FROM t LEFT JOIN rt USING (case_id) GROUP BY t.case_id""",
)
def x04(spark, d):
    """Rules whose required tags a case has, and none of the excluded ones; the best of each operator, two at most."""
    cases = _cases(spark, d)
    m = rules.route_manifest(cases, rules.route_rules(cases, _rules(spark)))
    said = F.array_join(F.transform("selected", lambda x: F.concat_ws(":", x, F.element_at("scores", x).cast("string"))), ",")
    return m.select("case_id", said.alias("selected"), "fallback")


@query("x05_routing_by_trigger", "X5 F22")
def x05(spark, d):
    """Routing that heeds triggers and boundaries (golden cases: tests/test_rules.py)."""
    return rules.route_rules_by_trigger(_cases(spark, d), _rules(spark).withColumn("advice", F.lit(None).cast("string"))).select("case_id", "rule_id", "score", "rank")


@query(
    "x07_route_groups", "X7",
    f"WITH {ROUTED}, g AS (SELECT case_id, string_agg(rule_id, ',' ORDER BY rank) AS selected FROM rt GROUP BY case_id) SELECT selected, count(*)::BIGINT AS n_cases FROM g GROUP BY selected",
)
def x07(spark, d):
    cases = _cases(spark, d)
    g = rules.route_groups(rules.route_manifest(cases, rules.route_rules(cases, _rules(spark))), "v1")
    return g.select(F.array_join("selected", ",").alias("selected"), "n_cases")


@query(
    "x08_overlay", "X8",
    f"WITH {ROUTED} SELECT t.case_id, CASE WHEN count(rule_id) > 0 THEN md5('routed ' || any_value(question)) ELSE md5(any_value(question)) END AS answer, count(rule_id) > 0 AS is_routed FROM t LEFT JOIN rt USING (case_id) GROUP BY t.case_id",
)
def x08(spark, d):
    """Answers of routed cases replace the base ones."""
    cases = _cases(spark, d)
    routed = rules.route_rules(cases, _rules(spark)).select("case_id").distinct().join(cases, "case_id").select("case_id", F.md5(F.concat(F.lit("routed "), "question")).alias("answer"))
    return rules.overlaid(cases.select("case_id", F.md5("question").alias("answer")), routed)


OUTCOMES = f"""{ROUTED}, pr AS (SELECT case_id, (case_id % 5)::INT AS b, ((case_id * 3) % 5)::INT AS c, (100 + case_id % 40)::INT AS bt, (100 + case_id % 37)::INT AS ct FROM t),
oc AS (SELECT rule_id, count(*) AS applied, count(*) FILTER (c > b) AS wins, count(*) FILTER (c = b) AS ties, count(*) FILTER (c < b) AS losses, count(*) FILTER (c - b <= -2) AS lr, sum(c - b) AS sd, round(avg(ct - bt), 4) AS td FROM rt JOIN pr USING (case_id) GROUP BY rule_id),
ad AS (SELECT *, CASE WHEN lr > 0 OR losses > wins THEN 'quarantine' WHEN wins > losses THEN 'retain' ELSE 'unproven' END AS advice FROM oc)"""


def _outcomes(spark, d):
    cases, i = _cases(spark, d), F.col("case_id")
    m = rules.route_manifest(cases, rules.route_rules(cases, _rules(spark)))
    pairs = cases.select("case_id", (i % 5).cast("int").alias("b"), (i * 3 % 5).cast("int").alias("c"), (100 + i % 40).cast("int").alias("b_tokens"), (100 + i % 37).cast("int").alias("c_tokens")).withColumn("delta", F.col("c") - F.col("b"))
    return rules.rule_outcomes(m, pairs)


@query("e24_rule_outcomes", "E24", f"WITH {OUTCOMES} SELECT rule_id, applied::BIGINT AS applied, wins::BIGINT AS wins, ties::BIGINT AS ties, losses::BIGINT AS losses, lr::BIGINT AS large_regressions, sd::BIGINT AS score_delta, td::DOUBLE AS avg_token_delta, advice FROM ad")
def e24(spark, d):
    return _outcomes(spark, d)


@query("x09_active_rules", "X9", f"WITH {OUTCOMES} SELECT rule_id, coalesce(advice, 'candidate') AS advice FROM x LEFT JOIN ad USING (rule_id) WHERE coalesce(advice, 'candidate') <> 'quarantine'")
def x09(spark, d):
    return rules.active_rules(_rules(spark), _outcomes(spark, d)).select("rule_id", "advice")


RAW = f"""{CASES}, rw AS (SELECT case_id, CASE case_id % 4 WHEN 0 THEN 'content_query' WHEN 1 THEN 'answer_completeness' WHEN 2 THEN 'section_selection' ELSE 'elsewhere' END AS st, CASE case_id % 3 WHEN 0 THEN 'STOP_RULE' WHEN 1 THEN 'ANSWER_GUARD' ELSE 'guess' END AS op,
 CASE WHEN case_id % 5 = 0 THEN ['trend'] ELSE []::VARCHAR[] END AS req, CASE WHEN case_id % 2 = 0 THEN ['entity', 'unit'] ELSE ['extraction'] END AS any_, trim(regexp_replace(question, '\\s+', ' ', 'g'), ' ') AS ins, CASE WHEN case_id % 7 = 0 THEN 3 WHEN case_id % 7 = 1 THEN 2 ELSE 1 END AS conf FROM cs),
ok AS (SELECT *, 'exp_' || left(sha1(op || '|' || st || '|' || array_to_string(req, ',') || '|' || array_to_string(any_, ',') || '|' || lower(ins)), 12) AS rule_id FROM rw WHERE st <> 'elsewhere' AND op <> 'guess' AND length(ins) BETWEEN 1 AND 700 AND len(string_split(ins, ' ')) <= 90 AND (len(req) > 0 OR list_contains(any_, 'entity')))"""


def _raw_rules(spark, d):
    """Raw rules made of questions: stages, operators, tags and confidence by the id, some of them not allowed."""
    i, none = F.col("case_id"), F.array().cast("array<string>")
    return _cases(spark, d).select(
        F.when(i % 4 == 0, "content_query").when(i % 4 == 1, "answer_completeness").when(i % 4 == 2, " section_selection").otherwise("elsewhere").alias("failure_stage"),
        F.when(i % 3 == 0, "stop_rule").when(i % 3 == 1, "ANSWER_GUARD ").otherwise("guess").alias("repair_operator"), F.when(i % 5 == 0, F.array(F.lit("Trend"), F.lit("x"))).otherwise(none).alias("required_tags"),
        F.when(i % 2 == 0, F.array(F.lit("unit"), F.lit("entity"))).otherwise(F.array(F.lit("extraction"))).alias("any_tags"), none.alias("excluded_tags"), F.col("question").alias("student_instruction"), F.lit("when").alias("trigger_description"),
        F.lit(None).cast("string").alias("do_not_apply_when"), F.lit("seen").alias("causal_evidence"), F.array(i.cast("string"), F.lit("-1")).alias("supporting_case_ids"), F.when(i % 7 == 0, "High").when(i % 7 == 1, "medium").otherwise("?").alias("confidence"),
    )


@query("x01_checked_rules", "X1", f"WITH {RAW} SELECT rule_id, count(*)::BIGINT AS n FROM ok GROUP BY rule_id")
def x01(spark, d):
    return rules.checked_rules(_raw_rules(spark, d), _cases(spark, d)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "x03_rule_library", "X2 X3",
    f"""WITH {RAW}, g AS (SELECT rule_id, count(DISTINCT case_id) AS supp, max(conf) AS conf, any_value(len(req)) AS nr, any_value(length(ins)) AS n FROM ok GROUP BY rule_id)
SELECT rule_id, supp::INT AS n_supporters, conf::INT AS confidence, row_number() OVER (ORDER BY supp DESC, conf DESC, nr DESC, n, rule_id)::INT AS place FROM g QUALIFY place <= 40""",
)
def x03(spark, d):
    """Duplicates merged, the first forty by supporters, confidence, required tags and brevity."""
    top = rules.rule_library(rules.merged_rules(rules.checked_rules(_raw_rules(spark, d), _cases(spark, d))), 40)
    c = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    return top.select("rule_id", F.size("supporting_case_ids").alias("n_supporters"), c.alias("confidence"), "place")


@query(
    "x02_merge_rules", "",
    "SELECT o_orderpriority AS rule, count(DISTINCT o_custkey)::BIGINT AS supporters, max(o_totalprice) AS confidence, min(o_orderkey) AS first_case, row_number() OVER (ORDER BY count(DISTINCT o_custkey) DESC, o_orderpriority)::INT AS place FROM orders GROUP BY o_orderpriority",
)
def x02(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("rule")).agg(F.countDistinct("o_custkey").alias("supporters"), F.max("o_totalprice").alias("confidence"), F.min("o_orderkey").alias("first_case"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("supporters"), "rule")))  # over the few rules


# --- event logs ---------------------------------------------------------------------------------------------------

LOG = r"log AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS tool, regexp_extract(props, '[0-9]+') AS chunk, value, ts FROM events)"


def _log(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.row_number().over(w).alias("seq"), F.col("event_type").alias("tool"), F.regexp_extract("props", "[0-9]+", 0).alias("chunk"), "value", "ts")


@query(
    "t01_rounds", "T5",
    f"WITH {LOG} SELECT query_id, max((seq - 1) // 5 + 1)::INT AS rounds, max_by(tool, seq) AS last_tool, array_to_string(list_sort(list_distinct(list(tool))), ',') AS tools, count(*)::BIGINT AS n FROM log GROUP BY query_id",
)
def t01(spark, d):
    return _log(spark, d).groupBy("query_id").agg(F.max(F.floor((F.col("seq") - 1) / 5) + 1).cast("int").alias("rounds"), F.max_by("tool", "seq").alias("last_tool"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"), F.count("*").alias("n"))


STEPS = f"""{LOG}, sp AS (SELECT query_id, seq, (seq - 1) // 5 + 1 AS round, CASE WHEN tool = 'purchase' THEN 'final_answer' WHEN tool = 'error' THEN 'max_rounds_reached' WHEN seq % 2 = 0 THEN 'llm_request' ELSE 'tool_call' END AS event FROM log),
pq AS (SELECT query_id, coalesce(max(CASE WHEN event = 'llm_request' THEN round END), 0)::INT AS rounds, coalesce(max_by(event, seq) FILTER (event IN ('final_answer', 'max_rounds_reached')), 'unknown') AS terminated_by FROM sp GROUP BY query_id)"""


def _steps(spark, d):
    """The events as steps of queries: purchases end a query with an answer, errors for want of rounds."""
    seq = F.col("seq")
    event = F.when(F.col("tool") == "purchase", "final_answer").when(F.col("tool") == "error", "max_rounds_reached").when(seq % 2 == 0, "llm_request").otherwise("tool_call")
    return _log(spark, d).select("query_id", "seq", (F.floor((seq - 1) / 5) + 1).cast("int").alias("round"), event.alias("event"))


@query("t01_terminations", "T1", f"WITH {STEPS} SELECT query_id, rounds, terminated_by FROM pq")
def t01_ends(spark, d):
    return rounds(_steps(spark, d))


@query("t01_round_summary", "T1", f"WITH {STEPS} SELECT count(*)::BIGINT AS n_queries, round(avg(rounds), 2)::DOUBLE AS mean, median(rounds)::DOUBLE AS median, max(rounds) AS most, min(rounds) AS least FROM pq")
def t01_summary(spark, d):
    return round_summary(rounds(_steps(spark, d))).drop("distribution")


@query("t12_event_counts", "T12", f"WITH {STEPS} SELECT query_id, count(*) FILTER (event = 'final_answer')::BIGINT AS n_final_answer, count(*) FILTER (event = 'max_rounds_reached')::BIGINT AS n_max_rounds_reached, count(*) FILTER (event = 'tool_call')::BIGINT AS n_tool_call FROM sp GROUP BY query_id")
def t12(spark, d):
    return event_counts(_steps(spark, d), ("final_answer", "max_rounds_reached", "tool_call"))


@query("t10_resume", "T10", "SELECT item_id, item_id IN (SELECT doc_id FROM labels) AS is_done FROM benchmark")
def t10(spark, d):
    """Items are tasks; those whose id is labelled are done."""
    pending, done = resumed(table(spark, d, "benchmark").select("item_id"), table(spark, d, "labels").select(F.col("doc_id").alias("item_id")), "item_id")
    return pending.select("item_id", F.lit(False).alias("is_done")).unionByName(done.select("item_id", F.lit(True).alias("is_done")))


@query(
    "t11_ingestion_totals", "T11",
    """SELECT source AS "group", count(*)::BIGINT AS n, round(sum(n_chars / 1000.0), 4)::DOUBLE AS seconds, sum(n_chars)::BIGINT AS tokens FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source HAVING count(*) > 20) GROUP BY source""",
)
def t11(spark, d):
    """Sources are groups; those with over twenty toxic documents failed."""
    docs = table(spark, d, "documents")
    toxic = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id").groupBy(F.col("source").alias("group")).agg(F.count("*").alias("n")).where("n > 20")
    return ingestion_totals(docs.select(F.col("source").alias("group"), (F.col("n_chars") / 1000).alias("seconds"), F.col("n_chars").alias("tokens")), toxic)


@query("t02_tool_counts", "T2", "SELECT event_type AS tool, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_queries FROM events GROUP BY event_type")
def t02(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_queries"))


@query("t04_trajectories", "T4", f"WITH {LOG} SELECT query_id, string_agg(tool || ':' || chunk, ' ' ORDER BY seq) AS steps FROM log WHERE seq <= 24 GROUP BY query_id")
def t04(spark, d):
    g = _log(spark, d).where("seq <= 24").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "tool", "chunk").alias("s")))).alias("s"))
    return g.select("query_id", F.array_join(F.transform("s", lambda x: x["s"]), " ").alias("steps"))


#: A walk through each query's hits: what every chunk of seven was first seen in, how often, and how many of a round are new.
PAGES = f"""{LOG}, hp AS (SELECT query_id, ((seq - 1) // 5)::INT AS round, ((seq - 1) % 5)::INT AS rank, chunk::INT % 7 AS c, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS i FROM log),
wk AS (SELECT query_id, 0::BIGINT AS i, -1 AS round, -1 AS rank, 0 AS c, 0 AS new, [0, 0, 0, 0, 0, 0, 0] AS firsts, [0, 0, 0, 0, 0, 0, 0] AS times, false AS shown, false AS old FROM hp GROUP BY query_id
 UNION ALL SELECT query_id, i, round, rank, c, nw + ("show" AND NOT od)::INT, list_transform(firsts, lambda x, j: CASE WHEN j = c + 1 AND "show" AND times[c + 1] = 0 THEN round ELSE x END),
 list_transform(times, lambda x, j: CASE WHEN j = c + 1 AND "show" THEN x + 1 ELSE x END), "show", od
 FROM (SELECT h.query_id, h.i, h.round, h.rank, h.c, w.firsts, w.times, CASE WHEN h.round = w.round THEN w.new ELSE 0 END AS nw, CASE WHEN h.round = w.round THEN w.new ELSE 0 END < 2 AS "show", w.times[h.c + 1] > 0 AND w.firsts[h.c + 1] < h.round AS od
 FROM wk w JOIN hp h ON h.query_id = w.query_id AND h.i = w.i + 1))"""
PAGES_SQL = f"WITH RECURSIVE {PAGES} SELECT query_id, round, rank, c::VARCHAR AS chunk, CASE WHEN old THEN 'SEEN' ELSE 'NEW' END AS state, firsts[c + 1]::INT AS first_seen_round, times[c + 1]::INT AS times_seen FROM wk WHERE shown"


def _hits(spark, d):
    log = _log(spark, d)
    return log.select("query_id", F.floor((F.col("seq") - 1) / 5).cast("int").alias("round"), ((F.col("seq") - 1) % 5).cast("int").alias("rank"), (F.col("chunk").cast("int") % 7).cast("string").alias("chunk"))


@query("t06_pagination", "T6", PAGES_SQL)
def t06(spark, d):
    return paginate(_hits(spark, d), k=2)


@query("t06_pagination_stream", "T6", PAGES_SQL)
def t06_stream(spark, d):
    """The same by a stream over files of rounds, with what queries have seen as its state."""
    rounds_ = _hits(spark, d).groupBy("query_id", "round").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    last = F.col("round") == F.max("round").over(Window.partitionBy("query_id"))
    path = scratch_path(spark, "rounds")
    rounds_.withColumn("last", last).repartitionByRange(8, "round").write.parquet(path)
    return paginate_stream(spark, path, k=2)


@query(
    "t07_budget", "T7",
    f"""WITH {LOG}, a AS (SELECT query_id, seq, tool, chunk, row_number() OVER k <= 1 AS f FROM log WINDOW k AS (PARTITION BY query_id, tool, chunk ORDER BY seq)),
b AS (SELECT *, f AND (tool <> 'click' OR sum((f AND tool = 'click')::INT) OVER (PARTITION BY query_id ORDER BY seq) <= 2) AS o FROM a),
c AS (SELECT *, o AND sum(o::INT) OVER (PARTITION BY query_id ORDER BY seq) <= 5 AS ok FROM b),
e AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY query_id, tool, chunk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u, coalesce(sum(ok::INT) OVER (PARTITION BY query_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM c)
SELECT query_id, seq::INT AS seq, ok AS allowed, CASE WHEN ok THEN '' WHEN u >= 1 THEN 'duplicate' WHEN t >= 5 THEN 'budget' ELSE 'structure budget' END AS reason FROM e""",
)
def t07(spark, d):
    calls = _log(spark, d).select("query_id", "seq", "tool", F.concat_ws("|", "tool", "chunk").alias("key"))
    return budget(calls, identical=1, searches=5, structures=2, structure_tool="click")


@query(
    "t07_single_limit", "T7",
    f"WITH {LOG} SELECT query_id, seq::INT AS seq, row_number() OVER (PARTITION BY query_id, tool, chunk ORDER BY seq) <= 2 AS allowed FROM log",
)
def t07b(spark, d):
    w = Window.partitionBy("query_id", "tool", "chunk").orderBy("seq")
    return _log(spark, d).select("query_id", "seq", (F.row_number().over(w) <= 2).alias("allowed"))


@query("t08_token_sums", "T8", "SELECT user_id AS query_id, event_type AS phase, count(*)::BIGINT AS calls, round(sum(value), 2) AS tokens FROM events GROUP BY ALL")
def t08(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("phase")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("tokens"))


@query(
    "t09_progress_stream", "T9",
    """WITH w AS (SELECT date_trunc('hour', ts) AS hour, event_type, value FROM events)
SELECT hour, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS failed, round(count(*) / 3600.0, 6)::DOUBLE AS per_second, round(sum(value), 2)::DOUBLE AS tokens FROM w GROUP BY hour""",
)
def t09(spark, d):
    """Completed and failed events, their rate and tokens in tumbling windows, as a stream in append mode over what is there."""
    return progress(spark, f"{d}/events.parquet", "1 hour", failed="error")


# --- measures and summaries of the rows above ---------------------------------------------------------------------


@query(
    "e06_summary_means", "E6",
    f"""WITH e AS ({_best_f1_sql(ANS)}), r AS (SELECT case_id, coalesce(max(contains(text, gold)::INT), 0) AS recall FROM gd LEFT JOIN gx USING (case_id) GROUP BY case_id),
s AS (SELECT f1, recall, CASE WHEN recall = 1 THEN 4 ELSE floor(4 * f1) END AS score FROM e JOIN r USING (case_id))
SELECT count(*)::BIGINT AS n, round(avg(f1), 4)::DOUBLE AS f1, round(avg(recall), 4)::DOUBLE AS recall, round(avg(score), 4)::DOUBLE AS accuracy, round(sum(score) / (4.0 * count(*)), 4)::DOUBLE AS accuracy_share FROM s""".replace(
        f"WITH e AS (WITH {GOLDS}, ", f"WITH {GOLDS}, e AS (WITH "
    ),
)
def e06(spark, d):
    """Turns against the two behind them: F1, whether one stands in the turn, and a score of 4 for that, else by F1."""
    g = scratch_table(_golds(spark, d), "golds")
    recall = g.select("case_id", F.exists("golds", lambda x: F.col("text").contains(x)).cast("int").alias("recall"))
    s = best_gold_f1(g, "case_id", answer_tokens("text"), F.col("golds"), answer_tokens).join(recall, "case_id")
    s = s.withColumn("score", F.when(F.col("recall") == 1, 4).otherwise(F.floor(4 * F.col("f1"))))
    mean = lambda c: F.round(F.avg(c), 4).alias
    return s.agg(F.count("*").alias("n"), mean("f1")("f1"), mean("recall")("recall"), mean("score")("accuracy"), F.round(F.sum("score") / (4 * F.count("*")), 4).alias("accuracy_share"))


@query("e13_clamped_relations", "E13", "SELECT doc_id AS case_id, CASE WHEN c > b THEN 'candidate_better' WHEN c < b THEN 'baseline_better' ELSE 'tie' END AS relation FROM (SELECT doc_id, quality * 4 AS b, greatest(0, least(4, quality * 4 + doc_id % 7 - 3)) AS c FROM labels)")
def e13_clamped(spark, d):
    """Candidate scores that leave the scale are brought back into it."""
    return table(spark, d, "labels").select(F.col("doc_id").alias("case_id"), relation(F.col("quality") * 4, F.col("quality") * 4 + F.col("doc_id") % 7 - 3).alias("relation"))


@query("e17_generated_means", "E17", "SELECT count(*)::BIGINT AS n_generated, count(quality)::BIGINT AS n_judged, round(coalesce(sum(quality * 4), 0) / count(*), 4)::DOUBLE AS avg_score FROM documents LEFT JOIN labels USING (doc_id)")
def e17_generated(spark, d):
    """Means over shards are taken over all generated answers, judged or not."""
    g = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", (F.col("quality") * 4).alias("score")), "doc_id", "left")
    return g.agg(F.count("*").alias("n_generated"), F.count("score").alias("n_judged"), F.round(F.coalesce(F.sum("score"), F.lit(0)) / F.count("*"), 4).alias("avg_score"))


@query(
    "e22_expected_filings", "E22",
    f"""WITH {_facet_sql(False)}, tp AS (SELECT query_id, doc_id FROM fs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1),
ex AS (SELECT (n_nationkey * 10000 + a.y)::BIGINT AS query_id, max(CASE WHEN x.qr = 2 AND x.kind = '10-Q' AND x.y = a.y AND x.nat = replace(n_name, ' ', '_') THEN x.doc_id END) AS want FROM nation, (SELECT DISTINCT y FROM fx) a, f1 x GROUP BY 1)
SELECT CASE WHEN want IS NULL THEN 'execution_only' ELSE 'top_doc' END AS "check", count(*)::BIGINT AS n, count(*) FILTER (want IS NULL OR want = doc_id)::BIGINT AS n_passed FROM ex JOIN tp USING (query_id) GROUP BY 1""",
)
def e22_filings(spark, d):
    """The filing that a question on a nation's second quarter is for, taken from the orders, against the one ranked first; half are said in words."""
    asked, docs = _asked(spark, d), _filings(spark, d)
    o = table(spark, d, "orders").where("o_orderstatus = 'O' and quarter(o_orderdate) = 2").select("o_custkey", F.year("o_orderdate").alias("y"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    want = o.join(c, "o_custkey").select("n_nationkey", "y").distinct().join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), "n_nationkey")
    name = F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("y").cast("string"), F.lit("Q2_10-Q"))
    want = want.select((F.col("n_nationkey") * 10_000 + F.col("y")).alias("query_id"), name.alias("want"))
    t, said = asked.select("query_id").join(want, "query_id", "left"), F.col("query_id") % 2 == 0
    tests = t.select(F.col("query_id").cast("string").alias("name"), "query_id", F.when(said, "").otherwise(F.col("want")).alias("expected_top"), F.when(said, F.concat(F.lit("top result is "), "want")).otherwise("").alias("expected_text")).fillna("")
    out = ranking_assertions(tests, FacetRouting(asked, docs, dated=False).ranked(1))
    return out.groupBy("check").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


@query(
    "x10_instructions", "X10",
    f"""WITH {CASES}, i AS (SELECT case_id, trim(question, ' ') AS q, CASE WHEN case_id % 3 = 0 THEN 'the figure is rounded...' ELSE '' END AS b FROM cs)
SELECT case_id, md5(CASE WHEN b = '' THEN q ELSE q || ' Do not apply this rule when the figure is rounded.' END) AS instruction FROM i""",
)
def x10(spark, d):
    """Questions as instructions; a third of them have a boundary."""
    boundary = F.when(F.col("case_id") % 3 == 0, " the figure is rounded... ")
    return _cases(spark, d).select("case_id", F.md5(rules.instruction_text(F.col("question"), boundary)).alias("instruction"))


@query("t01_round_distribution", "T1", f"WITH {STEPS} SELECT rounds, count(*)::BIGINT AS n FROM pq GROUP BY rounds")
def t01_distribution(spark, d):
    return round_distribution(rounds(_steps(spark, d)))


@query(
    "t03_log_summary", "T3",
    f"""WITH {LOG}, e AS (SELECT query_id, tool, CASE WHEN seq % 2 = 0 THEN 'llm_response' ELSE 'tool_call' END AS event FROM log)
SELECT count(DISTINCT query_id) FILTER (event = 'llm_response')::BIGINT AS n_questions, count(*) FILTER (event = 'llm_response')::BIGINT AS n_rounds, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT tool || '=' || count(*) AS s FROM e WHERE event = 'tool_call' GROUP BY tool)) AS calls FROM e""",
)
def t03(spark, d):
    log = _log(spark, d).withColumn("event", F.when(F.col("seq") % 2 == 0, "llm_response").otherwise("tool_call"))
    return log_summary(log.select("query_id", "event", "tool"))


@query(
    "t12_enrichment", "T12",
    f"""WITH {LOG}, nx AS (SELECT query_id, seq, tool, lead(tool) OVER (PARTITION BY query_id ORDER BY seq) AS after, row_number() OVER (PARTITION BY query_id, tool, chunk ORDER BY seq) AS k FROM log)
SELECT query_id, count(*) FILTER (k > 2)::BIGINT AS n_tool_budget_blocked, count(*) FILTER (tool = 'purchase')::BIGINT AS n_gate_decision, count(*) FILTER (tool = 'error' AND after IS NOT NULL AND after <> 'error')::BIGINT AS n_tool_call_recovered, count(*) FILTER (tool = 'error')::BIGINT AS n_http_error FROM nx GROUP BY query_id""",
)
def t12_enrichment(spark, d):
    """Calls blocked by a budget of two alike, gates at purchases, errors, and those that the next call recovers from."""
    log = scratch_table(_log(spark, d), "log")
    blocked = budget(log.select("query_id", "seq", "tool", F.concat_ws("|", "tool", "chunk").alias("key")), identical=2, searches=1_000_000).where("not allowed")
    after = log.withColumn("after", F.lead("tool").over(Window.partitionBy("query_id").orderBy("seq")))
    kind = lambda df, event: df.select("query_id", F.lit(event).alias("event"))
    error = F.col("tool") == "error"
    every = kind(log, "step").unionByName(kind(blocked, "tool_budget_blocked")).unionByName(kind(log.where("tool = 'purchase'"), "gate_decision"))
    every = every.unionByName(kind(after.where(error & (F.col("after") != "error")), "tool_call_recovered")).unionByName(kind(log.where(error), "http_error"))
    return event_counts(every, ("tool_budget_blocked", "gate_decision", "tool_call_recovered", "http_error"))


@query(
    "t10_merged_results", "T10 P8",
    """WITH t AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS "index", conv_id || '-' || turn AS task FROM conversations ORDER BY conv_id, turn LIMIT 300)
SELECT "index"::INT AS "index", task, CASE WHEN turn % 2 = 0 THEN 'kept' ELSE 'new' END AS result FROM t""",
)
def t10_merged(spark, d):
    """The first 300 turns as tasks with a global index; every other one was done before, and some of these again."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task"))
    tasks = scratch_table(indexed(turns, 300, "conv_id", "turn"), "tasks")
    done = tasks.where("turn % 2 = 0").select("task", F.lit("kept").alias("result"))
    pending, _ = resumed(tasks, done, "task")
    fresh = pending.unionByName(tasks.where("turn % 4 = 0")).select("task", F.lit("new").alias("result"))
    return merged_results(tasks, done, fresh, "task").select("index", "task", "result")


@query(
    "r16_candidate_depth", "R16",
    f"""WITH RECURSIVE {PAGES}, rd AS (SELECT DISTINCT query_id, round FROM hp), fs AS (SELECT DISTINCT query_id, c, firsts[c + 1] AS first FROM wk WHERE shown)
SELECT rd.query_id, rd.round, count(fs.c)::BIGINT AS seen, greatest(2, least(6, 2 + count(fs.c)))::BIGINT AS depth FROM rd LEFT JOIN fs ON fs.query_id = rd.query_id AND fs.first < rd.round GROUP BY rd.query_id, rd.round""",
)
def r16_depth(spark, d):
    """Two hits a round, and as many more as the query was shown before, up to six."""
    hits = scratch_table(_hits(spark, d), "hits")
    return candidate_depths(paginate(hits, k=2), hits, 2, 6)
