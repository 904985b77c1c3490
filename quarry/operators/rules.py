"""Tables of rules ("experiences"): checked, merged, ranked, routed to cases, and judged by their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import content_tokens
from quarry.sources.tables import small

#: Stages of a failure, operators of a repair, tags, and what confidence counts.
STAGES = ("title_routing", "document_commitment", "content_query", "section_selection", "evidence_coverage", "numerical_reasoning", "qualitative_reasoning", "temporal_or_unit_alignment", "answer_completeness", "search_loop_or_cost", "gold_or_judge_ambiguity")
OPERATORS = ("QUERY_POLICY", "EVIDENCE_GUARD", "COMPARISON_GUARD", "ANSWER_GUARD", "STOP_RULE", "WORKFLOW_POLICY")
TAGS = ("numerical", "calculation", "trend", "comparison", "entity", "extraction", "temporal", "unit", "rounding", "complete_set", "source_scope")
TELLING = ("numerical", "calculation", "trend", "comparison", "unit", "rounding", "complete_set", "source_scope")
BROAD = ("extraction", "temporal", "entity")
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
#: The pattern of a question (small letters) behind each tag.
TAG_PATTERNS = {
    "numerical": r"\b(calculate|compute|ratio|margin|percentage|percent|how much|amount|revenue growth|per share|ebitda|capex)\b",
    "calculation": r"\b(calculate|compute|formula|defined as|divided by|less|growth rate|ratio)\b",
    "trend": r"\b(improv|trend|accelerat|decelerat|increase|decrease|declin|grew|growth|change)\w*\b",
    "comparison": r"\b(compare|versus|vs\.?|higher|lower|highest|lowest|largest|smallest|most|least|greater)\b",
    "entity": r"\b(which|who|whose|identity|named|name of|key agenda|issuer|executive|ceo|segment|region)\b",
    "extraction": r"\b(what|which|who|how much|how many|state|identify|key agenda)\b",
    "temporal": r"\b(fy\s?\d{2,4}|20\d{2}|quarter|q[1-4]|year|period|as of|dated)\b",
    "unit": r"\b(unit|units|percent|percentage|million|billion|thousand|usd|dollars?|basis points?|bps)\b",
    "rounding": r"\b(round|decimal places?|nearest|precision)\b",
    "complete_set": r"\b(highest|lowest|largest|smallest|most|least|all (?:segments|regions|years|categories))\b",
    "source_scope": r"\b(only has access|only use|primarily within|based only|statement of|according to)\b",
}
#: What words are made of. `\b` and `\w` of the patterns mean these letters, whatever an engine takes them for.
LETTER = r"[\p{L}\p{N}_]"
_NONE = "array<string>"


def whole_words(pattern: str, before: str = f"(?<!{LETTER})", after: str = f"(?!{LETTER})") -> str:
    """A pattern of TAG_PATTERNS with the edges of its words written out; engines without lookaround take others."""
    return before + pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\w", LETTER) + after


def question_tags(question: Column | str, reasoning: Column | str | None = None) -> Column:
    """The tags of a question, sorted; a kind of reasoning that names numbers counts as numerical."""
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    made = {tag: q.rlike(whole_words(p)) for tag, p in TAG_PATTERNS.items()}
    if reasoning is not None:
        made["numerical"] = made["numerical"] | F.coalesce(F.lower(F.col(reasoning) if isinstance(reasoning, str) else reasoning).contains("numerical"), F.lit(False))
    return F.array_sort(F.array_compact(F.array(*(F.when(c, tag) for tag, c in made.items()))))


def _tags(c: str) -> Column:
    known = F.filter(F.transform(F.coalesce(c, F.array().cast(_NONE)), lambda x: F.lower(F.trim(x))), lambda x: x.isin(*TAGS))
    return F.array_sort(F.array_distinct(known))


def checked_rules(raw: DataFrame, cases: DataFrame) -> DataFrame:
    """The raw rules that hold: known stage and operator, texts within their lengths, support among the cases (case_id), a
    tag that tells something. Tags, texts and support are normalised; rule_id is a hash of what the rule says.

    raw: failure_stage, repair_operator, required_tags, any_tags, excluded_tags, student_instruction, trigger_description,
    do_not_apply_when, causal_evidence, supporting_case_ids, confidence. Support is found by a join with the cases.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    low = F.lower(F.trim("confidence"))
    r = raw.withColumn("_n", F.monotonically_increasing_id()).select(
        "_n", F.trim("failure_stage").alias("failure_stage"), F.upper(F.trim("repair_operator")).alias("repair_operator"), _tags("required_tags").alias("required_tags"), _tags("any_tags").alias("any_tags"),
        _tags("excluded_tags").alias("excluded_tags"), *(flat(c).alias(c) for c in ("student_instruction", "trigger_description", "do_not_apply_when", "causal_evidence")),
        "supporting_case_ids", F.when(low.isin(*CONFIDENCE), low).otherwise("low").alias("confidence"),
    )
    n = lambda c: F.length(c)
    tells = F.array_remove(F.array_union("required_tags", "any_tags"), "extraction")
    fine = (
        F.col("failure_stage").isin(*STAGES) & F.col("repair_operator").isin(*OPERATORS) & n("student_instruction").between(1, 700) & (F.size(F.split("student_instruction", " ")) <= 90)
        & n("trigger_description").between(1, 600) & (n("do_not_apply_when") <= 600) & n("causal_evidence").between(1, 1600) & (F.size(tells) > 0)
    )
    r = r.where(fine)
    said = r.select("_n", F.explode("supporting_case_ids").alias("case_id")).join(cases.select(F.col("case_id").cast("string")).distinct(), "case_id", "left_semi")
    said = said.groupBy("_n").agg(F.array_sort(F.collect_set("case_id")).alias("supporting_case_ids"))
    signature = F.concat_ws("|", "repair_operator", "failure_stage", F.array_join("required_tags", ","), F.array_join("any_tags", ","), F.lower("student_instruction"))
    return r.drop("supporting_case_ids").join(said, "_n").withColumn("rule_id", F.concat(F.lit("exp_"), F.left(F.sha1(signature.cast("binary")), F.lit(12))))


def _weight(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for e in CONFIDENCE.items() for x in e)), c), F.lit(1))


def merged_rules(rules: DataFrame, order: str = "_n") -> DataFrame:
    """One row a rule_id: the first one's texts, all supporters, the largest confidence."""
    first = [c for c in rules.columns if c not in ("rule_id", "supporting_case_ids", "confidence", order)]
    return rules.groupBy("rule_id").agg(
        *(F.min_by(c, order).alias(c) for c in first), F.array_sort(F.array_distinct(F.flatten(F.collect_list("supporting_case_ids")))).alias("supporting_case_ids"), F.max_by("confidence", _weight("confidence")).alias("confidence")
    )


def rule_library(rules: DataFrame, n: int) -> DataFrame:
    """The first n rules by supporters, confidence, required tags and brevity, with their place."""
    order = (F.desc(F.size("supporting_case_ids")), F.desc(_weight("confidence")), F.desc(F.size("required_tags")), F.length("student_instruction"), "rule_id")
    top = rules.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over n rows


def _best_two(m: DataFrame, most: int) -> DataFrame:
    best = [F.desc("score"), F.desc("rule_id")]
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("case_id", "repair_operator").orderBy(*best))).where("k = 1").drop("k")
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*best))).where(F.col("rank") <= most)


def _applicable(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a case (case_id, tags) and a rule whose required tags it has, one of the others if there are any, and none excluded."""
    own, r = cases.select("case_id", "tags"), small(rules)
    fits = (F.size(F.array_except("required_tags", "tags")) == 0) & ~F.arrays_overlap("excluded_tags", "tags") & ((F.size("any_tags") == 0) | F.arrays_overlap("any_tags", "tags"))
    return own.join(r, fits).withColumn("any_hit", F.array_intersect("any_tags", "tags"))


def route_rules(cases: DataFrame, rules: DataFrame, most: int = 2) -> DataFrame:
    """(case_id, rule_id, repair_operator, score, rank): the best rule of each operator, `most` at most, for each case."""
    m = _applicable(cases, rules)
    score = 4 * F.size("required_tags") + 2 * F.size("any_hit") + _weight("confidence") + F.least(F.lit(2), F.size("supporting_case_ids"))
    return _best_two(m.select("case_id", "rule_id", "repair_operator", score.alias("score")), most)


def route_rules_by_trigger(cases: DataFrame, rules: DataFrame, most: int = 2) -> DataFrame:
    """The same with words: cases have question too, rules advice too (what their outcomes told, or null).

    A rule is out if the question has a word of its boundary, if no tag that matches tells something, or (but for answer
    guards) if the question shares no word with its trigger and instruction.
    """
    words = rules.select(
        "rule_id", "repair_operator", "required_tags", "any_tags", "excluded_tags", "confidence", "supporting_case_ids", "advice",
        content_tokens(F.concat_ws(" ", "trigger_description", "student_instruction")).alias("trigger"), content_tokens(F.coalesce("do_not_apply_when", F.lit(""))).alias("boundary"),
    )
    m = _applicable(cases, words).join(cases.select("case_id", content_tokens("question").alias("words")), "case_id")
    telling, broad = F.array(*map(F.lit, TELLING)), F.array(*map(F.lit, BROAD))
    matched = F.array_union("required_tags", "any_hit")
    shared = F.size(F.array_intersect("words", "trigger"))
    m = m.where(~F.arrays_overlap("words", "boundary") & F.arrays_overlap(matched, telling) & ((F.col("repair_operator") == "ANSWER_GUARD") | (shared > 0)))
    score = (
        5 * F.size(F.array_intersect("required_tags", telling)) + 3 * F.size(F.array_intersect("any_hit", telling)) + 2 * F.least(F.lit(3), shared) + _weight("confidence")
        + F.when(F.col("advice") == "retain", 2).otherwise(0) - F.size(F.array_intersect(matched, broad))
    )
    return _best_two(m.select("case_id", "rule_id", "repair_operator", score.alias("score")), most)


def route_manifest(cases: DataFrame, routes: DataFrame) -> DataFrame:
    """(case_id, tags, selected, scores, fallback) of every case; selected in order of rank."""
    g = routes.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "score"))).alias("s"))
    out = cases.select("case_id", "tags").join(g, "case_id", "left")
    pick = lambda c: F.transform("s", lambda x: x[c])
    return out.select("case_id", "tags", F.coalesce(pick("rule_id"), F.array().cast(_NONE)).alias("selected"), F.map_from_arrays(pick("rule_id"), pick("score")).alias("scores"), F.col("s").isNull().alias("fallback"))


def route_groups(manifest: DataFrame, version: str) -> DataFrame:
    """(route_id, selected, n_cases): cases with the same rules in the same order run together; the id is a hash of all that.

    The id is made of a digest of the sorted members, summed in Spark, not of their list, which has no bound.
    """
    g = manifest.where("not fallback").groupBy("selected").agg(F.count("*").alias("n_cases"), F.sum(F.xxhash64("case_id").cast("decimal(38,0)")).alias("members"))
    signature = F.concat_ws("|", F.lit(version), F.array_join("selected", "|"), F.col("members").cast("string"))
    return g.select(F.concat(F.lit("route_"), F.left(F.sha1(signature.cast("binary")), F.lit(10))).alias("route_id"), "selected", "n_cases")


def overlaid(base: DataFrame, routed: DataFrame) -> DataFrame:
    """(case_id, answer, is_routed): a routed answer replaces the base one; cases that only the routed side has stay out."""
    r = routed.select("case_id", F.col("answer").alias("new")).dropDuplicates(["case_id"])
    return base.join(r, "case_id", "left").select("case_id", F.coalesce("new", "answer").alias("answer"), F.col("new").isNotNull().alias("is_routed"))


def rule_outcomes(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rule_id, applied, wins, ties, losses, large_regressions, score_delta, avg_token_delta, advice) of pairs (case_id, b, c,
    delta, b_tokens, c_tokens): quarantine after a large regression or more losses than wins, retain after more wins."""
    r = manifest.select("case_id", F.explode("selected").alias("rule_id")).join(pairs, "case_id")
    g = r.groupBy("rule_id").agg(
        F.count("*").alias("applied"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") == 0).alias("ties"), F.count_if(F.col("delta") < 0).alias("losses"),
        F.count_if(F.col("delta") <= -2).alias("large_regressions"), F.sum("delta").cast("long").alias("score_delta"), F.round(F.avg(F.col("c_tokens") - F.col("b_tokens")), 4).alias("avg_token_delta"),
    )
    advice = F.when((F.col("large_regressions") > 0) | (F.col("losses") > F.col("wins")), "quarantine").when(F.col("wins") > F.col("losses"), "retain").otherwise("unproven")
    return g.withColumn("advice", advice)


def active_rules(rules: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rules with what their outcomes advise ("candidate" without any), those in quarantine left out."""
    out = rules.join(outcomes.select("rule_id", "advice"), "rule_id", "left").withColumn("advice", F.coalesce("advice", F.lit("candidate")))
    return out.where("advice <> 'quarantine'")


def instruction_text(instruction: Column | str, boundary: Column | str) -> Column:
    """The instruction, and when it doesn't apply."""
    i, b = (F.trim(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))) for x in (instruction, boundary))
    return F.when(b == "", i).otherwise(F.concat(i, F.lit(" Do not apply this rule when "), F.regexp_replace(b, r"\.+$", ""), F.lit(".")))
