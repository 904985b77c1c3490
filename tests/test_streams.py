"""Pagination as a stream: any order of files, going on later, and what is kept."""

import random

from quarry.operators.traces import candidate_depths, log_summary, merged_results, paginate
from quarry.streaming.pagination import ROUNDS, SHOWN, paginate_stream


def _walk(rounds, k):
    """What is shown of {query: [chunks of each round]}, by a plain walk."""
    out = set()
    for q, own in rounds.items():
        seen = {}
        for n, chunks in enumerate(own):
            new = 0
            for rank, c in enumerate(chunks):
                if new == k:
                    break
                first, times = seen.get(c, (n, 0))
                state = "SEEN" if times and first < n else "NEW"
                new += state == "NEW"
                seen[c] = (first, times + 1)
                out.add((q, n, rank, c, state, first, times + 1))
    return out


def test_stream_as_a_walk_in_any_order_of_files(spark, tmp_path):
    r = random.Random(2)
    rounds = {q: [[r.choice("abcdefgh") for _ in range(r.randint(0, 6))] for _ in range(r.randint(1, 7))] for q in range(25)}
    rows = [(q, n, chunks, n == len(own) - 1 and q % 3 > 0) for q, own in rounds.items() for n, chunks in enumerate(own)]
    r.shuffle(rows)
    path = f"{tmp_path}/rounds"
    for i in range(4):
        spark.createDataFrame(rows[i::4], ROUNDS).coalesce(1).write.mode("append").parquet(path)
    got = [tuple(x) for x in paginate_stream(spark, path, 2, f"file://{tmp_path}/log", files=1).collect()]
    assert len(got) == len(set(got)) and set(got) == _walk(rounds, 2)
    hits = spark.createDataFrame([(q, n, k, c) for q, own in rounds.items() for n, chunks in enumerate(own) for k, c in enumerate(chunks)], "query_id long, round int, rank int, chunk string")
    assert {tuple(x) for x in paginate(hits, 2).collect()} == set(got)
    kept = {x.key.query_id for x in spark.read.format("statestore").load(f"file://{tmp_path}/log").collect()}
    assert kept == {q for q in rounds if q % 3 == 0}  # those whose last round was never told
    more = [(q, len(own), ["a", "b", "z"], True) for q, own in rounds.items() if q % 3 == 0]
    spark.createDataFrame(more, ROUNDS).coalesce(1).write.mode("append").parquet(path)
    later = {tuple(x) for x in paginate_stream(spark, path, 2, f"file://{tmp_path}/log", files=1).collect()}
    longer = {q: [*own, ["a", "b", "z"]] for q, own in rounds.items() if q % 3 == 0}
    assert later == _walk(longer, 2) | set(got)
    assert not spark.read.format("statestore").load(f"file://{tmp_path}/log").collect()


def test_golden_pages(spark):
    rows = [(1, 1, 0, "1"), (1, 1, 1, "2"), (1, 2, 0, "1"), (1, 2, 1, "2"), (1, 2, 2, "3"), (1, 2, 3, "4")]
    shown = paginate(spark.createDataFrame(rows, "query_id long, round int, rank int, chunk string"), 2)
    assert [(r["chunk"], r["state"]) for r in shown.where("round = 2").orderBy("rank").collect()] == [("1", "SEEN"), ("2", "SEEN"), ("3", "NEW"), ("4", "NEW")]
    rounds = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "query_id long, round int")
    depths = {(r["query_id"], r["round"]): (r["seen"], r["depth"]) for r in candidate_depths(shown, rounds, 2, 5).collect()}
    assert depths == {(1, 1): (0, 2), (1, 2): (2, 4), (1, 3): (4, 5), (2, 1): (0, 2)}
    assert SHOWN.count(",") == 6


def test_log_summary_and_merged_results(spark):
    log = spark.createDataFrame([("q", "llm_response", None), ("q", "llm_response", None), ("r", "tool_call", "x"), ("q", "tool_call", "x"), ("q", "tool_call", "a")], "query_id string, event string, tool string")
    assert tuple(log_summary(log).first()) == (1, 2, "a=1,x=2")
    frame = lambda *rows: spark.createDataFrame(rows, "task string, result string")
    tasks = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "index int, task string")
    got = merged_results(tasks, frame(("a", "old")), frame(("a", "new"), ("c", "new"), ("x", "new")), "task").orderBy("index")
    assert [(r["index"], r["task"], r["result"]) for r in got.collect()] == [(0, "a", "old"), (2, "c", "new")]


def test_manifests_refuse_drift(spark):
    import pytest

    from quarry.operators.sampling import drifted, manifest, unchanged

    frame = lambda rows: spark.createDataFrame(rows, "k int, g int, kind string, split string")
    rows = [(i, i // 2, "ab"[i % 2], "train" if i < 6 else "dev") for i in range(10)]
    made = lambda x: manifest(frame(x), "g", "kind", "k", "s")
    before = made(rows)
    assert unchanged(made(rows[::-1]), before).count() == 2 and drifted(made(rows[::-1]), before).count() == 0
    less = rows[1:]
    assert [r["split"] for r in drifted(made(less), before).collect()] == ["train"]
    with pytest.raises(Exception, match="splits differ from their manifest: train"):
        unchanged(made(less), before).collect()
    assert [r["split"] for r in drifted(made(rows[:6]), before).collect()] == ["dev"]
