"""Stored tables: which buckets a change rewrites, and what a second ingest does."""

import glob
import os

from pyspark.sql import functions as F

from quarry.sources import datasets, relational
from quarry.sources.stored import StoredTable


def _files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def _rows(t):
    return sorted((tuple(r) for r in t.read().collect()), key=str)


def test_delete_rewrites_the_buckets_of_its_keys_alone(spark, tmp_path):
    t = StoredTable(spark, f"{tmp_path}/t", "k long, v string", ("k",), 8)
    t.insert_or_ignore(spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    (tmp_path / "t" / "unrelated.txt").write_text("stays")
    before = _files(t.path)
    gone = [3, 77]
    touched = {r.bucket for r in t._with_bucket(spark.createDataFrame([(k,) for k in gone], "k long")).collect()}
    t.delete(spark.createDataFrame([(3,), (77,), (77,), (9999,)], "k long").where("k < 1000"))
    after = _files(t.path)
    of = lambda files, inside: {f for f in files if (int(f.split("bucket=")[1].split("/")[0]) in touched) == inside}
    assert {f: before[f] for f in of(before, False)} == {f: after[f] for f in of(after, False)}
    assert not of(before, True) & of(after, True)
    assert _rows(t) == sorted(((k, "x") for k in range(200) if k not in gone), key=str)
    t.delete(t.read().select("k"))
    assert _rows(t) == [] and not _files(t.path) and (tmp_path / "t" / "unrelated.txt").read_text() == "stays"
    t.insert_or_replace(spark.createDataFrame([(1, "y")], "k long, v string"))
    t.clear()
    assert _rows(t) == [] and os.path.exists(tmp_path / "t" / "unrelated.txt")


def test_ignore_and_replace(spark, tmp_path):
    t = StoredTable(spark, f"{tmp_path}/t", "k string, v string", ("k",), 4)
    frame = lambda *rows: spark.createDataFrame(rows, "k string, v string, n int")
    t.insert_or_ignore(frame(("a", "2", 2), ("a", "1", 1), (None, "0", 1), ("b", None, 1)), "n")
    assert _rows(t) == sorted([("a", "1"), (None, "0"), ("b", None)], key=str)
    files = _files(t.path)
    t.insert_or_ignore(frame(("a", "9", 1), (None, "9", 1)), "n")
    assert _files(t.path) == files
    t.insert_or_replace(frame(("a", "8", 1), ("a", "9", 2), (None, "0", 1), ("c", "3", 1)), "n")
    assert _rows(t) == sorted([("a", "9"), (None, "0"), ("b", None), ("c", "3")], key=str)
    files = _files(t.path)
    t.insert_or_replace(frame(("a", "9", 1)), "n")
    assert _files(t.path) == files


def test_a_second_ingest_changes_nothing(spark, tmp_path):
    text = '[{"sample_id": "conv-26", "conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "Hi \\"you\\""}, {"speaker": "B", "text": "x"}], "session_1_date_time": "May 1", "session_3": [{"speaker": "A", "dia_id": "D3:1", "text": "late"}], "session_20": [{"speaker": "A", "text": "too late"}], "session_2": "lost"},' \
        ' "session_summary": {"session_1_summary": "s1", "session_2_summary": ""}, "observation": {"session_1_observation": {"A": [["is here", "D1:1"], ["alone"], ["both", ["D1:1", "D1:2"]]]}}}]'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(text)
    (tmp_path / "in" / "b.json").write_text('{"sample_id": "other", "conversation": {"session_1": []}, "session_summary": {}, "observation": {}}')
    samples = datasets.json_whole(spark, f"{tmp_path}/in", relational.CONVERSATION)
    tables = relational.conversation_tables(samples)
    first = {k: _rows(t) for k, t in relational.ingest(spark, tables, f"{tmp_path}/out").items()}
    files = {k: _files(f"{tmp_path}/out/{k}") for k in tables}
    again = {k: _rows(t) for k, t in relational.ingest(spark, tables, f"{tmp_path}/out").items()}
    assert first == again and files == {k: _files(f"{tmp_path}/out/{k}") for k in tables}
    assert sorted(r[1:] for r in first["conversations"]) == [("conv-26", 1, "May 1", 1, "D1:1", "A", 'Hi "you"'), ("conv-26", 1, "May 1", 2, "", "B", "x"), ("conv-26", 3, "", 1, "D3:1", "A", "late")]
    assert [r[1:] for r in first["session_summaries"]] == [("conv-26", 1, "s1")]
    assert sorted(r[1:] for r in first["observations"]) == [("conv-26", 1, "A", 0, "is here", "D1:1"), ("conv-26", 1, "A", 2, "both", "D1:1, D1:2")]
    md = {r.sample_id: r.markdown for r in relational.session_markdown(samples).collect()}
    assert md == {"conv-26": '# Chat History: conv-26\n\n## Session 1\nDATE: May 1\nSUMMARY: s1\n**A**: Hi "you" [D1:1]\n**B**: x', "other": "# Chat History: other\n\n## Session 1"}
    hits = relational.keyword_hits({k: t.read() for k, t in relational.ingest(spark, tables, f"{tmp_path}/out").items()}, "HERE")
    assert [(r.kind, r.key) for r in hits.collect()] == [("observations", "conv-26/1/A/0")]


def test_a_file_listing_reads_no_contents(spark, tmp_path):
    for name in ("a.md", "b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_text("text")
    files = datasets.listed(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_name string")
    assert {(r.doc_name, r.kind) for r in datasets.inventory(names, files).collect()} == {("a", "md"), ("b", "pdf"), ("c", "missing")}
