"""Measures of answers and comparisons of two arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import placed, small


def token_f1(pairs: DataFrame, predicted: Column, gold: Column, *keys: str) -> DataFrame:
    """(keys, f1) of token arrays as multisets; 0 without overlap."""
    count = lambda c, n: pairs.select(*keys, F.explode(c).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias(n))
    both = count(predicted, "p").join(count(gold, "g"), [*keys, "w"]).groupBy(*keys).agg(F.sum(F.least("p", "g")).alias("same"))
    n = F.col("same") * 2.0 / (F.size(predicted) + F.size(gold))
    return pairs.join(both, list(keys), "left").select(*keys, F.round(F.coalesce(n, F.lit(0.0)), 4).alias("f1"))


def token_f1_by_words(pairs: DataFrame, docs: DataFrame, golds: DataFrame) -> DataFrame:
    """(item_id, doc_id, f1) of pairs (item_id, doc_id) of documents (doc_id, t) and golds (item_id, g), arrays of tokens.

    A document's words are counted once, whatever the number of its pairs, and only those that some gold has; of the rest
    its length is enough.
    """
    count = lambda df, key, c, n: df.select(key, F.explode(c).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))
    gold = count(golds, "item_id", "g", "n_gold")
    said = docs.select("doc_id", F.explode("t").alias("w")).join(small(gold.select("w").distinct()), "w", "left_semi").groupBy("doc_id", "w").agg(F.count("*").alias("n_said"))
    sized = pairs.join(docs.select("doc_id", F.size("t").alias("n_t")), "doc_id").join(small(golds.select("item_id", F.size("g").alias("n_g"))), "item_id")
    same = pairs.join(said, "doc_id").join(small(gold), ["item_id", "w"]).groupBy("item_id", "doc_id").agg(F.sum(F.least("n_said", "n_gold")).alias("same"))
    f1 = F.coalesce(F.col("same") * 2.0 / (F.col("n_t") + F.col("n_g")), F.lit(0.0))
    return sized.join(same, ["item_id", "doc_id"], "left").select("item_id", "doc_id", F.round(f1, 4).alias("f1"))


#: Scores lie between these.
LEAST, MOST = 0, 4


def relation(b: Column | str, c: Column | str) -> Column:
    """Which of two scores is better, each brought into the scale first."""
    clamp = lambda x: F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col(x) if isinstance(x, str) else x))
    return F.when(clamp(c) > clamp(b), "candidate_better").when(clamp(c) < clamp(b), "baseline_better").otherwise("tie")


def arms(judged: DataFrame) -> DataFrame:
    """(arm, n, avg_score, accuracy, avg_tokens, avg_latency) of judged rows (case_id, arm, score, tokens, latency)."""
    return judged.groupBy("arm").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("avg_score"), F.round(F.sum("score") / (4 * F.count("*")), 4).alias("accuracy"),
        F.round(F.avg("tokens"), 4).alias("avg_tokens"), F.round(F.avg("latency"), 4).alias("avg_latency"),
    )


def paired(judged: DataFrame, base: str, candidate: str) -> DataFrame:
    """(case_id, b, c, delta, and both sides' tokens) of the cases that both arms have."""
    side = lambda arm, s: judged.where(F.col("arm") == arm).select("case_id", F.col("score").alias(s), F.col("tokens").alias(f"{s}_tokens"))
    return side(base, "b").join(side(candidate, "c"), "case_id").withColumn("delta", F.col("c") - F.col("b"))


def outcome(pairs: DataFrame, *by: str) -> DataFrame:
    """Wins, ties, losses, large regressions (2 or more), net score and relative change of tokens."""
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") == 0).alias("ties"), F.count_if(F.col("delta") < 0).alias("losses"),
        F.count_if(F.col("delta") <= -2).alias("large_regressions"), F.sum("delta").cast("long").alias("net"),
        F.round(F.coalesce(F.try_divide(F.sum("c_tokens") - F.sum("b_tokens"), F.sum("b_tokens")), F.lit(0.0)), 4).alias("token_change"),
    )


def passes(o: DataFrame) -> Column:
    """A candidate passes if it nets no loss, wins more than it loses, has no large regression and at most 1.1 times the tokens."""
    return (F.col("net") >= 0) & (F.col("wins") > F.col("losses")) & (F.col("large_regressions") == 0) & (F.col("token_change") <= 0.1)


def best_gold_f1(cases: DataFrame, key: str, predicted: Column, golds: Column, tokenise) -> DataFrame:
    """(key, f1, n_golds): the best F1 of an answer's tokens against each of its golds (an array of texts); 0 without any."""
    p = cases.select(key, predicted.alias("p"), F.posexplode(golds).alias("place", "gold")).select(key, "place", "p", tokenise("gold").alias("g"))
    best = token_f1(p, F.col("p"), F.col("g"), key, "place").groupBy(key).agg(F.max("f1").alias("f1"), F.count("*").alias("n_golds"))
    return cases.select(key).join(best, key, "left").fillna(0, ["f1", "n_golds"])


def refusal_override(scored: DataFrame, refuses: Column, golds_refuse: Column) -> DataFrame:
    """Where answer and a gold refuse alike the answer is right: F1 of 1, score of 4."""
    both = refuses & golds_refuse
    return scored.withColumn("f1", F.when(both, 1.0).otherwise(F.col("f1"))).withColumn("score", F.when(both, 4).otherwise(F.col("score")))


def by_split(judged: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, n, avg_score, accuracy, avg_tokens) of each split, zeros for one without cases, and of all ("all")."""
    m = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    out = judged.join(splits, "case_id").rollup("split").agg(F.count("*").alias("n"), m(F.avg("score")).alias("avg_score"), m(F.sum("score") / (4 * F.count("*"))).alias("accuracy"), m(F.avg("tokens")).alias("avg_tokens"))
    out = out.withColumn("split", F.coalesce("split", F.lit("all")))
    return splits.select("split").distinct().unionByName(out.select("split")).distinct().join(out, "split", "left").fillna(0)


def select_candidate(arm_metrics: DataFrame, base: str) -> DataFrame:
    """The one row of arms (arm, accuracy, net, tokens, latency) to go on with: among candidates no less accurate than the base
    the best by accuracy, net score, fewer tokens, less latency; the base itself if there is none."""
    at_least = arm_metrics.where(F.col("arm") == base).select(F.col("accuracy").alias("least"))
    fine = arm_metrics.join(F.broadcast(at_least), F.col("accuracy") >= F.col("least")).drop("least")
    order = (F.desc(F.col("arm") != base), F.desc("accuracy"), F.desc("net"), "tokens", "latency", "arm")
    return fine.orderBy(*order).limit(1)


def judged_again(answers: DataFrame, saved: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Answers (case_id, answer) whose saved judgement (case_id, answer, judge_model, score) holds, and those to judge.

    A judgement holds if the same model gave it; of several the largest score counts. With an unchanged answer the two arms
    tie by the earlier score.
    """
    own = saved.where(F.col("judge_model") == model).groupBy("case_id", "answer").agg(F.max("score").alias("score"))
    held = answers.join(own, ["case_id", "answer"])
    return held, answers.join(own, ["case_id", "answer"], "left_anti")


def ranking_assertions(tests: DataFrame, ranked: DataFrame) -> DataFrame:
    """(name, check, expected_top, actual_top, passed) of tests (name, query_id, expected_top, expected_text) on ranked rows.

    The expected document is given, or said in words; without one the test only asks that the ranking ran.
    """
    said = [F.nullif(F.regexp_extract("expected_text", p, 1), F.lit("")) for p in (r"top result is\s+([A-Z][A-Z0-9_-]+)", r"([A-Z][A-Z0-9_-]+)\s+is ranked first", r"([A-Z][A-Z0-9_-]+)\s+is ranked before")]
    want = F.coalesce(F.nullif(F.trim("expected_top"), F.lit("")), *said)
    top = ranked.where("rank = 1").select("query_id", F.col("doc_id").cast("string").alias("actual_top"))
    out = tests.select("name", "query_id", want.alias("expected_top")).join(top, "query_id", "left")
    passed = F.col("expected_top").isNull() | F.coalesce(F.upper("actual_top") == F.upper("expected_top"), F.lit(False))
    return out.select("name", F.when(F.col("expected_top").isNull(), "execution_only").otherwise("top_doc").alias("check"), "expected_top", "actual_top", passed.alias("passed"))


def report_lines(pairs: DataFrame, text: str) -> DataFrame:
    """(place, case_id, line): a Markdown table row for each pair, the largest gains first; bars and line ends of the text are taken out.
    """
    clean = F.replace(F.regexp_replace(text, r"\s+", " "), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("case_id").cast("string"), F.col("b").cast("string"), F.col("c").cast("string"), F.col("delta").cast("string"), clean), F.lit(" |"))
    rows = placed(pairs.select("case_id", "delta", line.alias("line")), F.desc("delta"), F.asc("case_id"))
    return rows.select((F.col("place") + 1).alias("place"), "case_id", "line")


def completeness(expected: DataFrame, found: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n_expected, n_found, n_missing, n_unexpected, complete) of ids (key, by) that should and do occur."""
    both = expected.select(key, by, F.lit(1).alias("e")).join(found.select(key, F.col(by).alias("found_by"), F.lit(1).alias("f")).dropDuplicates([key]), key, "full")
    g = both.groupBy(F.coalesce(by, "found_by").alias(by)).agg(F.count("e").alias("n_expected"), F.count("f").alias("n_found"), F.count_if(F.col("f").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_unexpected"))
    return g.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_unexpected") == 0))
