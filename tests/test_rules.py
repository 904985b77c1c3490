"""Golden cases of rule tables."""

from pyspark.sql import functions as F

from quarry.operators import rules as R

SCHEMA = "failure_stage string, repair_operator string, required_tags array<string>, any_tags array<string>, excluded_tags array<string>, student_instruction string, trigger_description string, do_not_apply_when string, causal_evidence string, supporting_case_ids array<string>, confidence string"


def raw(spark, *changes):
    base = {"failure_stage": "content_query", "repair_operator": "query_policy", "required_tags": [" Trend "], "any_tags": ["unit", "junk"], "excluded_tags": [], "student_instruction": "Compare  the\nmargins", "trigger_description": "margin growth", "do_not_apply_when": "no ratio is asked.", "causal_evidence": "seen", "supporting_case_ids": ["1", "2", "9"], "confidence": "HIGH"}
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], SCHEMA)


def test_checked_and_merged(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    df = raw(
        spark, {}, {"confidence": "low", "supporting_case_ids": ["3"], "student_instruction": "compare the margins"}, {"failure_stage": "other"}, {"repair_operator": "x"}, {"required_tags": [], "any_tags": ["extraction"]},
        {"required_tags": None, "any_tags": None}, {"student_instruction": " "}, {"student_instruction": "w " * 91}, {"trigger_description": "x" * 601}, {"supporting_case_ids": ["77"]}, {"supporting_case_ids": None}, {"causal_evidence": ""},
    )
    fine = R.checked_rules(df, cases)
    assert fine.count() == 2 and fine.select("rule_id").distinct().count() == 1
    r = R.merged_rules(fine).first()
    assert (r.supporting_case_ids, r.confidence, r.student_instruction, r.required_tags, r.any_tags) == (["1", "2", "3"], "high", "Compare the margins", ["trend"], ["unit"])
    assert R.rule_library(R.merged_rules(fine), 5).first().place == 1


def test_tags(spark):
    q = spark.createDataFrame([(1, "What was the growth rate of revenue in FY2022, in percent?", None), (2, "Who leads?", "Numerical reasoning")], "case_id int, question string, r string")
    got = {x.case_id: x.t for x in q.select("case_id", R.question_tags("question", "r").alias("t")).collect()}
    assert got == {1: ["calculation", "extraction", "numerical", "temporal", "trend", "unit"], 2: ["entity", "extraction", "numerical"]}


def routed_rules(spark):
    rows = [
        ("a", "QUERY_POLICY", ["trend"], ["unit"], [], "high", ["1", "2", "3"], "margin growth", "look at margins", "dividends are asked", None), ("b", "QUERY_POLICY", ["trend"], [], [], "low", ["1"], "growth", "x", "", "retain"),
        ("c", "ANSWER_GUARD", [], ["unit"], ["rounding"], "medium", ["1"], "zzz", "zzz", "", None), ("d", "STOP_RULE", ["temporal"], [], [], "high", ["1"], "growth", "x", "", None), ("e", "STOP_RULE", ["trend"], ["rounding"], [], "high", ["1"], "growth", "x", "", None),
    ]
    return spark.createDataFrame(rows, "rule_id string, repair_operator string, required_tags array<string>, any_tags array<string>, excluded_tags array<string>, confidence string, supporting_case_ids array<string>, trigger_description string, student_instruction string, do_not_apply_when string, advice string")


def test_routing(spark):
    cases = spark.createDataFrame([(1, "What growth of margins in 2022?", ["temporal", "trend", "unit"]), (2, "Were dividends growing?", ["trend"]), (3, "None", [])], "case_id int, question string, tags array<string>")
    got = {(r.case_id, r.rank): (r.rule_id, r.score) for r in R.route_rules(cases, routed_rules(spark)).collect()}
    assert got == {(1, 1): ("a", 4 + 2 + 3 + 2), (1, 2): ("d", 4 + 3 + 1), (2, 1): ("b", 4 + 1 + 1)}
    got = {(r.case_id, r.rank): (r.rule_id, r.score) for r in R.route_rules_by_trigger(cases, routed_rules(spark)).collect()}
    # a shares growth and margin; d's only matching tag is broad; c needs no shared word; dividends shut a out, and b shares nothing
    assert got == {(1, 1): ("a", 5 + 3 + 2 * 2 + 3), (1, 2): ("c", 3 + 2)}
    m = R.route_manifest(cases, R.route_rules(cases, routed_rules(spark)))
    rows = {r.case_id: r for r in m.collect()}
    assert rows[1].selected == ["a", "d"] and rows[1].scores == {"a": 11, "d": 8} and rows[3].fallback and rows[3].selected == []
    groups = R.route_groups(m, "v").collect()
    assert sorted((r.selected, r.n_cases) for r in groups) == [(["a", "d"], 1), (["b"], 1)] and len({r.route_id for r in groups}) == 2
    base, new = (spark.createDataFrame(x, "case_id int, answer string") for x in ([(1, "x"), (2, "y"), (3, "z")], [(1, "new"), (7, "?")]))
    assert sorted(tuple(r) for r in R.overlaid(base, new).collect()) == [(1, "new", True), (2, "y", False), (3, "z", False)]
    pairs = spark.createDataFrame([(1, 2, 4, 2, 10, 30), (2, 4, 2, -2, 10, 10)], "case_id int, b int, c int, delta int, b_tokens int, c_tokens int")
    o = R.rule_outcomes(m, pairs)
    assert {r.rule_id: (r.wins, r.losses, r.avg_token_delta, r.advice) for r in o.collect()} == {"a": (1, 0, 20.0, "retain"), "d": (1, 0, 20.0, "retain"), "b": (0, 1, 0.0, "quarantine")}
    active = {r.rule_id: r.advice for r in R.active_rules(routed_rules(spark).drop("advice"), o).collect()}
    assert active == {"a": "retain", "c": "candidate", "d": "retain", "e": "candidate"}


def test_instruction_text(spark):
    df = spark.createDataFrame([("Do it.", "none is there."), (" Do ", None)], "a string, b string")
    assert [r.x for r in df.select(R.instruction_text("a", "b").alias("x")).collect()] == ["Do it. Do not apply this rule when none is there.", "Do"]
    assert df.select(F.lit(1)).count() == 2


def test_letters_of_all_alphabets_end_a_word_in_query_and_sql(spark, tmp_path):
    import duckdb

    from quarry.plans.catalogue import ORACLES, QUERIES

    spark.createDataFrame([(1, 0, "u", "ñdollar cióndoga"), (1, 1, "u", "a dollar, ñ"), (1, 2, "u", "declinó é"), (1, 3, "u", "yearé vs.x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "é")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, QUERIES["f23_question_tags"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    for name in ("conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(duck.execute(ORACLES["f23_question_tags"]).fetchall())
    assert dict(got)[1001000] == "" and dict(got)[1001001] == "unit" and dict(got)[1001002] == "trend" and dict(got)[1001003] == "comparison"
