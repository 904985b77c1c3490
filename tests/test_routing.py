"""Golden cases of names, periods and routing."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import periods, text
from quarry.operators.routing import route_facets, route_titles, search_headings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_stems(spark):
    words = "increasingly statements payment capitalization facilities growing companies reported processes margins percentages has 10-year co2 abc"
    got = one(spark, text.content_tokens(F.lit(words)))
    assert got == sorted(["abc", "capitaliz", "co2", "compan", "facil", "grow", "increas", "margin", "payment", "percent", "process", "state"])


def test_periods(spark):
    q = F.lit("In Q2 of FY2024, fiscal year 2022 and 2019Q3: the fourth quarter of 20211 and Q5 or XQ1, 1st quarter")
    assert one(spark, periods.years(q)) == [2019, 2022, 2024]
    assert one(spark, periods.quarters(q, words=True)) == [1, 2, 3, 4] and one(spark, periods.quarters(q)) == [2, 3]


@pytest.mark.parametrize(("t", "want"), [("BOEING_2022_10K", "10-K"), ("a 10-Q", "10-Q"), ("x 8k y", "8-K"), ("110K", None), ("the annual  report", "10-K"), ("Q1 EARNINGS and quarterly report", "earnings"), ("quarterly report", "10-Q")])
def test_filing(spark, t, want):
    assert one(spark, periods.filing(F.lit(t))) == want


def test_dates(spark):
    got = one(spark, periods.dates(F.lit("on 2022-03-04, March 5th, 2021 and 6 Apr. 2020; also May 2019, 2022/3/4 and 12022-01-01")))
    assert [(x.y, x.m, x.d) for x in got] == [(2019, 5, 0), (2020, 4, 0), (2020, 4, 6), (2021, 3, 5), (2022, 3, 4)]
    meet = lambda a, b: one(spark, periods.dates_meet(periods.dates(F.lit(a)), periods.dates(F.lit(b))))
    assert meet("May 2019", "2019-05-07") and not meet("2019-05-08", "2019-05-07") and not meet("", "2019-05-07")


def test_names(spark):
    assert one(spark, periods.name_tokens(F.lit("ACME_WIDGETS_INC_2022Q3_10Q_dated-2022-08-04"))) == ["ACME", "WIDGETS"]
    assert set(one(spark, periods.aliases(F.array(F.lit("johnson"), F.lit("jones"))))) == {"johnsonjones", "johnson jones", "jj", "jnj", "jandj", "johnsonnjones"}
    assert [one(spark, periods.is_generic_name(F.lit(x))) for x in ("doc_12", "17", "ab12", "boeing", "")] == [True, True, True, False, True]
    assert one(spark, periods.proper_tokens(F.lit("What did 3M and AT in FY2022 say?"))) == ["what", "3m", "at"]


DOCS = [("1", "3M_2022_10K"), ("2", "BESTBUY_2024Q2_10Q"), ("3", "BOEING_2022_10K"), ("4", "FOOTLOCKER_2022_8K"), ("5", "PEPSICO_2022_10K"), ("6", "JOHNSON_JOHNSON_2022_10K"), ("7", "JPMORGAN_2022_10K")]
QUESTIONS = {
    1: ("Which Best Buy product category changed in Q2 of FY2024?", "2"), 2: ("According to Boeing's 2022 annual report, what was the amount?", "3"), 3: ("What was PepsiCo's EBITDA in FY2022?", "5"),
    4: ("Are JnJ FY2022 financials growing?", "6"), 5: ("Are JPM gross margins stable?", "7"),
}


def test_titles(spark):
    q = spark.createDataFrame([(i, t) for i, (t, _) in QUESTIONS.items()] + [(9, "---")], "query_id int, query string")
    docs = spark.createDataFrame(DOCS, "doc_id string, source_name string")
    got = {(r.query_id, r.rank): r for r in route_titles(q, docs, 5).collect()}
    assert {i: got[i, 1].doc_id for i in QUESTIONS} == {i: d for i, (_, d) in QUESTIONS.items()}
    assert not got[9, None].ok and got[9, None].doc_id is None
    first = got[2, 1]  # boeing 10, 2022 2; its parts 10 and k stand in the question only as part of words
    assert (first.score, first.matched_terms) == (12.0, ["2022", "boeing"])
    assert got[1, 1].score == 10 + 2  # bestbuy; the year, part of 2024q2; q and 2 alone count nothing


def test_headings(spark):
    nodes = spark.createDataFrame([("2", "a", "Risk Factors"), ("2", "b", "Domestic Revenue Mix"), ("3", "c", "Domestic revenue")], "doc_id string, node_id string, title string")
    q = spark.createDataFrame([(1, "domestic revenue by product category", "2"), (2, "revenue", "999"), (3, "--", "2"), (4, "revenue mix", "2")], "query_id int, query string, doc_id string")
    got = {r.query_id: r for r in search_headings(q, nodes).collect()}
    assert (got[1].node_id, got[1].score) == ("b", 4.0) and (got[2].ok, got[3].ok) == (False, False)
    assert got[4].score == 2 + 1 + 4


def test_facets(spark):
    docs = spark.createDataFrame([("ACME_2021_10K", "a"), ("ACME_2022_10K", "b"), ("ACME_2022Q2_10Q", "c"), ("ZED_CORP_2022_10K", "d"), ("ZED_2022_8K_dated-2022-08-04", "e"), ("doc_7", "NORTH_STAR_2022_10K")], "doc_id string, source_name string")
    questions = {
        1: ("What was Acme's revenue in the 10-K of FY2022?", "ACME_2022_10K"), 2: ("What did Acme say in the second quarter of 2022?", "ACME_2022Q2_10Q"), 3: ("What does Zed's 10-K of 2022 hold?", "ZED_CORP_2022_10K"),
        4: ("What did Zed file on August 4, 2022?", "ZED_2022_8K_dated-2022-08-04"), 5: ("How did NnS do in its annual report?", "doc_7"), 6: ("unrelated", "ACME_2021_10K"),
    }
    q = spark.createDataFrame([(i, t) for i, (t, _) in questions.items()], "query_id int, query string")
    ranked, coverage = route_facets(q, docs)
    got = {r.query_id: r for r in ranked.where("rank = 1").collect()}
    assert {i: got[i].doc_id for i in questions} == {i: d for i, (_, d) in questions.items()}
    assert got[1].score == 3 + 1.5 + 0.5 + 1 and got[6].reasons == ["no strong match"] and got[6].score == 0.75 + 0.5 + 0.5
    assert "date=2022-08-04" in got[4].reasons and got[4].match_count == 3
    c = {r.query_id: r for r in coverage.collect()}
    assert (c[1].n_documents, c[1].n_by_name, c[1].n_by_year, c[1].n_strong) == (6, 3, 5, 3)


def _all_pairs(q, docs, k, dated):
    """Every question with every document, by the facets of both."""
    from quarry.operators.routing import document_facets, question_facets

    dd, qq = document_facets(docs, dated).collect(), question_facets(q, dated).collect()
    squeeze = lambda x: "".join(c for c in x.lower() if c.isascii() and c.isalnum())
    ranked, coverage = set(), set()
    for a in qq:
        rows = []
        for b in dd:
            held = len(b.name) >= 3 and b.name in a.q_text or b.name in a.q_tokens
            if dated:
                held = held or any(len(x) >= 2 and (x in a.q_text or x in a.q_proper) for x in b.aliases) or any(len(p) >= 3 and (b.name.startswith(p) or p.startswith(b.name)) for p in a.q_proper)
            else:
                held = held or bool(b.tokens) and all(squeeze(t) in a.q_tokens for t in b.tokens)
            flags = [bool(b.name) and held, bool(set(b.years) & set(a.q_years)) if a.q_years else None, bool(set(b.quarters) & set(a.q_quarters)) if a.q_quarters else None, b.filing == a.q_filing if a.q_filing else None,
                     dated and any(x.y == y.y and x.m == y.m and (x.d == y.d or 0 in (x.d, y.d)) for x in a.q_dates for y in b.dates)]
            score = 3 * flags[0] + sum(w * (0.5 if f is None else f) for w, f in zip((1.5, 1, 1), flags[1:4])) + 2 * flags[4]
            rows.append((-score, -sum(f is True for f in flags) if dated else 0, b.doc_id, flags))
        rows.sort(key=lambda r: r[:3])
        ranked |= {(a.query_id, r[2], -r[0], i + 1) for i, r in enumerate(rows[:k])}
        count = lambda i: sum(r[3][i] is True for r in rows)
        coverage.add((a.query_id, len(rows), *map(count, range(5)), sum(r[3][0] and any(f is True for f in r[3][1:]) for r in rows)))
    return ranked, coverage


@pytest.mark.parametrize("dated", [True, False])
def test_facets_as_all_pairs(spark, dated):
    import random

    r = random.Random(dated)
    names = ["ACME", "ACME_WIDGETS", "ZED", "NORTH_STAR", "JOHNSON_JOHNSON", "AB_INC", "SOLAR_WIND_SEA", "doc", "10_TEN", "ACMEON"]
    tails = ["2021_10K", "2022_10K", "2022Q2_10Q", "2021Q3_10Q", "2022_8K_dated-2022-08-04", "2022_8K_dated-2022-08-09", "EARNINGS", "EARNINGS_RELEASE_2022Q4", "", "FY2021_ANNUAL REPORT", "May 2021"]
    docs = sorted({(f"{r.choice(names)}_{r.choice(tails)}_{r.randint(1, 40):03d}x", r.choice(["", "NORTH_STAR_2022_10K", "a"])) for _ in range(220)})
    docs += [("7", "ZED_2021_10K"), ("doc_8", "SOLAR_WIND_SEA_2022"), ("", "")]
    asked = ["What was Acme's revenue in the 10-K of FY2022?", "What did Zed file on August 4, 2022?", "How did NnS do in its annual report for the quarter ended May 2021?", "unrelated", "", "jnj and SWS 2021Q3", "JOHNSON widgets Acme 2nd quarter", "sea wind solar in 2022 8-K earnings release", "AB in August 2022", "Northern Star 10q"]
    d = spark.createDataFrame(docs, "doc_id string, source_name string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    for k in (1, 5):
        got, cover = route_facets(q, d, k, dated)
        ranked, coverage = _all_pairs(q, d, k, dated)
        assert {(x.query_id, x.doc_id, x.score, x.rank) for x in got.collect()} == ranked
    assert {tuple(x) for x in cover.select("query_id", "n_documents", "n_by_name", "n_by_year", "n_by_quarter", "n_by_filing", "n_by_date", "n_strong").collect()} == coverage
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("NestedLoop") <= 1  # the first k documents of all
