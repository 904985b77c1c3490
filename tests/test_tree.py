"""Sections as a tree against plain walks."""

import random

from quarry.operators import tree


def _nodes(seed, n):
    r = random.Random(seed)
    rows, level = [], 1
    for i in range(1, n + 1):
        rows.append((1, i, level))
        level = r.randint(1, min(6, level + 1))
    return rows


def _above(rows):
    out, stack = {}, []
    for _, i, level in rows:
        while stack and stack[-1][1] >= level:
            stack.pop()
        out[i] = [x for x, _ in stack]
        stack.append((i, level))
    return out


def test_intervals_and_paths(spark):
    rows = _nodes(3, 80)
    above = _above(rows)
    got = {r.node_id: r for r in tree.numbered(spark.createDataFrame(rows, "doc_id int, node_id int, level int")).collect()}
    for i, x in got.items():
        below = [j for j in above if i in above[j]]
        assert x.path == above[i] and (x.enter, x.leave) == (i, max([i, *below]))


def test_context_of_every_depth(spark):
    rows = _nodes(5, 60)
    above = _above(rows)
    nodes = tree.numbered(spark.createDataFrame(rows, "doc_id int, node_id int, level int"))
    picked = [(7, 1, 4, 2.0), (7, 1, 20, 5.0), (7, 1, 20, 3.0), (8, 1, 33, 1.0)]
    hits = spark.createDataFrame(picked, "query_id int, doc_id int, node_id int, score double")
    for up in range(3):
        for down in range(3):
            want = {}
            for q, _, i, s in picked:
                around = {i: 0} | {j: -k for k, j in enumerate(reversed(above[i]), 1) if k <= up} | {j: above[j][::-1].index(i) + 1 for j in above if i in above[j] and above[j][::-1].index(i) < down}
                for j, d in around.items():
                    want[q, j] = max(want.get((q, j), (0, -99, 0)), (s, -abs(d), d))
            got = {(r.query_id, r.node_id): (r.score, -abs(r.distance), r.distance) for r in tree.with_context(hits, nodes, up, down).collect()}
            assert got == want


def test_slices_are_clamped(spark):
    nodes = spark.createDataFrame([(1, 1, 4), (1, 2, 0)], "doc_id int, node_id int, n_paragraphs int")
    corpus = spark.createDataFrame([(1, 1, 0, "text", "a"), (1, 1, 1, "image", "see"), (1, 1, 2, "text", "  "), (1, 1, 3, "image", "")], "doc_id int, node_id int, p_idx int, kind string, text string")
    asked = [(1, -5, -1), (1, 0, 2), (1, 1, 99), (1, 3, 1), (1, 9, -1), (2, 0, -1), (3, 0, -1)]
    requests = spark.createDataFrame([(k, 1, n, a, b) for k, (n, a, b) in enumerate(asked)], "request_id int, doc_id int, node_id int, start int, end int")
    out = {}
    for r in tree.read_sections(requests, nodes, corpus).collect():
        out.setdefault((r.request_id, r.ok), []).append((r.p_idx, r.text))
    both = [(0, "a"), (1, "[image_ocr]see[/image_ocr]")]
    none = [(None, None)]
    assert {k: sorted(v, key=str) for k, v in out.items()} == {(0, True): both, (1, True): both, (2, True): both[1:], (3, True): none, (4, True): none, (5, True): none, (6, False): none}
    plain = tree.read_sections(requests.where("request_id = 2"), nodes, corpus, images=False).collect()
    assert [(r.p_idx, r.text) for r in plain] == [(1, "see")]


def test_two_levels_fall_back(spark):
    queries = spark.createDataFrame([(1, "x"), (2, "nothing")], "query_id int, query string")
    scored = spark.createDataFrame([(1, 5, 2.0), (1, 6, 3.0), (1, 7, 1.0)], "query_id int, doc_id int, score double")
    docs = spark.createDataFrame([(i,) for i in (9, 8, 5, 6, 7)], "doc_id int")
    search = lambda asked: asked.where("doc_id = 6").selectExpr("asked", "4 as node_id")
    got = {tuple(r) for r in tree.two_level(queries, scored, docs, 2, search).collect()}
    assert got == {(1, 6, 1, 3.0, 4), (1, 5, 2, 2.0, 1), (2, 5, 1, 0.5, 1), (2, 6, 2, 0.5, 4)}
    nodes = tree.numbered(spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 1)], "doc_id int, node_id int, level int"))
    bodies = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "doc_id int, node_id int, body string")
    assert {(r.node_id, r.body) for r in tree.subtree_bodies(nodes.where("node_id <> 2"), nodes, bodies).collect()} == {(1, "a\nb"), (3, "c")}
