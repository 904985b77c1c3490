"""Golden cases of scans, sinks and adapters, over small files."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.sources import adapters as A
from quarry.sources import datasets as D


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_scans(spark, tmp_path):
    lines = put(tmp_path, "a.jsonl", '{"id": 1, "q": "x"}\n\n{"id": 2\n{"id": 1, "q": "y"}\n')
    rows = D.json_lines(spark, lines, "id int, q string")
    assert sorted(r.q for r in rows.collect()) == ["x", "y"] and D.first_per_id(rows, "id", "q").first().q == "x" and D.last_per_id(rows, "id", "q").first().q == "y"
    put(tmp_path, "w/list.json", '[{"id": 1},\n {"id": 2}]')
    put(tmp_path, "w/one.json", '{"id": 3}')
    assert sorted(r.id for r in D.json_whole(spark, f"file://{tmp_path}/w", "id int").collect()) == [1, 2, 3]
    put(tmp_path, "k/1.json", '{"p1": {"t": "old"}, "p2": {"t": "b"}}')
    put(tmp_path, "k/2.json", '{"p1": {"t": "new"}}')
    assert {r.key: r.value.t for r in D.json_keyed(spark, f"file://{tmp_path}/k", "struct<t:string>").collect()} == {"p1": "new", "p2": "b"}
    put(tmp_path, "c/train.csv", 'id,text\n1,"two\nlines, ""quoted"""\n')
    put(tmp_path, "c/test.csv", "id,text\n2,x\n")
    assert {(r.id, r.text, r.original_split) for r in D.csv_rows(spark, f"file://{tmp_path}/c", "id string, text string").collect()} == {("1", 'two\nlines, "quoted"', "train"), ("2", "x", "test")}
    log = put(tmp_path, "log.jsonl", '{"query_id": "a", "event": "x"}\nnot json\n{"event": "y"}\n{"query_id": "b", "event": "z"}\n')
    ids = spark.createDataFrame([("b",), ("c",)], "query_id string")
    assert [r.event for r in D.event_log(spark, log, "query_id string, event string", ids).collect()] == ["z"] and D.event_log(spark, log, "query_id string, event string").count() == 2
    res = put(tmp_path, "res.json", json.dumps({"results": [{"question": "q", "answer": "1"}, {"question": "q", "answer": "2"}, {"question": "r", "answer": "3"}]}))
    assert {r.question: r.answer for r in D.results(spark, res, "struct<question:string,answer:string>").collect()} == {"q": "2", "r": "3"}


def test_inventory_corpus_vectors_spans(spark, tmp_path):
    for name in ("a.md", "a.pdf", "b.pdf", "z.txt"):
        put(tmp_path, f"docs/{name}", "x")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/docs").select("path")
    got = D.inventory(spark.createDataFrame([("a",), ("b",), ("c",)], "doc_name string"), files).collect()
    assert {r.doc_name: (r.kind, (r.path or "")[-5:]) for r in got} == {"a": ("md", "/a.md"), "b": ("pdf", "b.pdf"), "c": ("missing", "")}
    schema = "doc_id int, source_name string, nodes array<struct<id:string,title:string,paragraphs:array<string>>>"
    nodes = D.corpus_nodes(spark.createDataFrame([(1, "n", [("1", "t", ["p"]), ("2", "u", [])])], schema))
    assert [(r.node_id, r.seq, r.doc_name) for r in nodes.collect()] == [("1", 0, "n"), ("2", 1, "n")]
    with pytest.raises(Exception, match="no nodes in document 7"):
        D.corpus_nodes(spark.createDataFrame([(7, "n", [])], schema)).collect()
    par, ids, vec = spark.createDataFrame([(1, "1", 0), (1, "1", 1)], "doc_id int, node_id string, p_idx int"), spark.createDataFrame([(1, "1", 0, 5)], "doc_id int, node_id string, p_idx int, row int"), spark.createDataFrame([(5, [1.0])], "row int, embedding array<double>")
    assert [(r.p_idx, r.embedding) for r in D.with_vectors(par, ids, vec).orderBy("p_idx").collect()] == [(0, [1.0]), (1, None)]
    p = D.spans(spark.createDataFrame([("f", 2, 4), ("g", 0, 1)], "path string, start int, end int"), spark.createDataFrame([("f", "abcdef")], "path string, text string"))
    assert {r.path: r.span for r in p.collect()} == {"f": "cd", "g": None}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "t1"), (2, "t2")], "doc_id int, title string")
    qs = spark.createDataFrame([(1, "a", "q1"), (1, "b", "q2"), (2, "c", "q3")], "doc_id int, case_id string, question string")
    D.write_splits(docs, qs, spark.createDataFrame([("a", "train"), ("b", "dev"), ("c", "dev")], "case_id string, split string"), f"file://{tmp_path}/s")
    got = spark.read.json(f"file://{tmp_path}/s").collect()
    assert {(r.split, r.doc_id, tuple(x.case_id for x in r.qa), r.title) for r in got} == {("train", 1, ("a",), "t1"), ("dev", 1, ("b",), "t1"), ("dev", 2, ("c",), "t2")}
    r = spark.createDataFrame([("x", "m", 1.0), ("x", "n", 2.0)], "section string, metric string, value double")
    new = spark.createDataFrame([("x", "n", 3.0), ("y", "k", 4.0)], "section string, metric string, value double")
    assert {(x.section, x.metric, x.value) for x in D.upserted(r, new).collect()} == {("x", "m", 1.0), ("x", "n", 3.0), ("y", "k", 4.0)}
    put(tmp_path, "out/part1/a.json", '{"global_index": 0, "answer": "x"}\n{"global_index": 1, "answer": null}')
    put(tmp_path, "out/part2/a.json", '{"global_index": 0, "answer": "y"}\n{"global_index": 2, "answer": "z"}')
    got = D.merged_shards(spark, f"file://{tmp_path}/out/part*/a.json", "global_index int, answer string").orderBy("global_index").collect()
    assert [(r.global_index, r.answer) for r in got] == [(0, "x"), (2, "z")]


def test_finance_and_open_domain(spark):
    f = spark.createDataFrame([("f1", "D", "C", "q", "a", "type", "r", "j", [("e1", "D"), (" ", "D"), (None, "D")])], A.FINANCE)
    r = A.finance(f).first()
    assert (r.sample_id, r.golds, r.evidence, r.category, r.metadata["company"]) == ("D", ["a"], ["e1"], "type", "C")
    o = spark.createDataFrame([("i", "q", [("T", "x")], [("a", ["s1", "s2"]), (" ", ["s3"])])], A.OPEN_DOMAIN)
    r = A.open_domain(o).first()
    assert (r.golds, r.evidence, r.title) == (["a"], ["s1", "s2", "s3"], "T")


def test_papers(spark):
    answer = lambda un=False, spans=(), free="", yes=None, ev=(): ((un, list(spans), free, yes, list(ev)),)
    qas = [
        ("q1", "1", [answer(un=True), answer(un=True)]), ("q2", "2", [answer(un=True), answer(spans=["a", "b"], ev=["e1"]), answer(free=" f ", ev=["e1", "e2"]), answer(yes=False), answer(spans=["a", "b"])]), ("q3", "3", []),
    ]
    keyed = spark.createDataFrame([("p", ("T", "abs", [("Intro", ["x", ""])], [("A figure here", "1-T.png"), ("Counts", "2.png")], qas))], f"key string, value {A.PAPER}")
    r, = A.papers(keyed).collect()
    assert (r.question, r.golds, r.evidence, r.answer_types) == ("T: q2", ["Not mentioned", "a; b", "f", "No"], ["e1", "e2"], ["unanswerable", "extractive", "free_form", "yes_no"])
    assert A.paper_markdown(keyed).first().markdown == "# T\n\nPaper ID: p\n\n## Abstract\n\nabs\n\n## Intro\n\nx\n\n**Figure 1**: A figure here\n\n**Table 2**: Counts"
    case = A.canonical_cases(A.papers(keyed)).first()
    assert (case.case_id, case.gold, case.excerpts) == ("p#1", "Not mentioned；a; b；f；No", ["e1", "e2"])


def test_multi_hop(spark):
    df = spark.createDataFrame([("i", "q", "a", "bridge", "hard", (["A", "B"], [["a0", "a1"], ["b0"]]), (["B", "A", "A", "Z"], [0, 1, 9, 0]))], A.MULTI_HOP)
    assert A.multi_hop(df).first().evidence == ["b0", "a1"]
    assert {(r.title, r.sent_id, r.sentence) for r in A.multi_hop_joined(df).collect()} == {("B", 0, "b0"), ("A", 1, "a1")}


def test_syllabus(spark):
    row = lambda i, kind, *x: (i, "S", kind, "q", "a", *x)
    df = spark.createDataFrame([row("1", "multi", "s1", " ", "s1", None, None, "r1", "s1", "r1", None, None), row("2", "No Answer", *[None] * 10)], A.SYLLABUS)
    r, = A.syllabus(df).collect()
    assert (r.case_id, r.evidence) == ("1", ["s1", "s1", "r1"])


def test_contract_lines_keep_the_digits_of_their_own_number(spark):
    md = A.contract_markdown(spark.createDataFrame([(1, "T", "0 first 0\n1 second 1\n 2 third 2")], "doc_id int, title string, text string")).first().markdown
    assert md == "# T\n\n### 0 first 0\n### 1 second 1\n### 2 third 2"


def test_legal(spark):
    files = spark.createDataFrame([("maud", [("q1", [("f1", [1, 3], "x"), ("f2", [0, 2], "y")]), ("q2", [])])], f"subset string, {A.LEGAL}")
    r, = A.legal(files, spark.createDataFrame([("f1", "abcdef")], "path string, text string")).collect()
    assert (r.sample_id, r.golds, r.evidence, r.category) == ("f1", ["x", "y"], ["bc", "y"], "maud")
    md = A.contract_markdown(spark.createDataFrame([(1, "T", "MERGER AGREEMENT\nArticle I Terms\n\n\n\n1.2 Price\n(a) cash\nplain text")], "doc_id int, title string, text string")).first().markdown
    assert md == "# T\n\n## MERGER AGREEMENT\n### Article I Terms\n\n### 1.2 Price\n- (a) cash\nplain text"


def test_conversations_and_subsets(spark):
    qa = spark.createDataFrame([("s", 0, "q", "7", ["D1:1; D1:2", "D9:9"], 1), ("s", 1, "q", "x", [], 5), ("s", 2, "q", "x", None, 2)], "sample_id string, place int, question string, answer string, evidence array<string>, category int")
    turns = spark.createDataFrame([("s", "D1:1", "Ann", "hi"), ("s", "D1:2", "Bob", "yo")], "sample_id string, dia_id string, speaker string, text string")
    got = {r.place: r for r in A.conversation_qa(qa, turns).collect()}
    assert got[0].evidence == ["Ann: hi", "Bob: yo", "D9:9"] and got[0].golds == ["7"] and got[2].evidence == [] and 1 not in got
    docs = spark.createDataFrame([(1, [("a",), ("b",)]), (2, [("c",)])], "doc_id int, qa array<struct<case_id:string>>")
    left = A.subset(docs, spark.createDataFrame([("b",), ("x",)], "case_id string")).collect()
    assert [(r.doc_id, [x.case_id for x in r.qa]) for r in left] == [(1, ["b"])]
    there, missing = A.required_documents(spark.createDataFrame([("A",), ("B",), (None,)], "title string"), spark.createDataFrame([("A",), ("C",)], "title string"))
    assert [r.title for r in there.collect()] == ["A"] and [r.title for r in missing.collect()] == ["B"]
    none, _ = A.required_documents(spark.createDataFrame([("Q",)], "title string"), spark.createDataFrame([("A",)], "title string"))
    with pytest.raises(Exception, match="none of the needed documents"):
        none.unionByName(none).groupBy().agg(F.sum("n_required")).crossJoin(A.required_documents(spark.createDataFrame([("Q",)], "title string"), spark.createDataFrame([("A",)], "title string"))[1]).collect()
    art = spark.createDataFrame([("T", [["One.", "Two."], [" "], ["Three."]])], "title string, text array<array<string>>")
    assert A.article_markdown(art).first().markdown == "# T\n\nOne. Two.\n\nThree."
