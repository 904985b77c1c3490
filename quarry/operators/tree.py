"""The tree of a document's sections by numbers alone: slices, neighbours, context and bodies are joins on equal keys.

Sections are numbered depth first. A section's interval ends at the last one below it, and its path names those above
it, the outermost first; both are windows over the sections in order, so that no join walks the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.retrieval import top_k

LEVELS = 6


def numbered(nodes: DataFrame) -> DataFrame:
    """Adds enter, leave (the first and last number of a section's subtree) and path (array of the sections above) to nodes (doc_id, node_id, level, ...)."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    level = F.col("level")
    after = Window.partitionBy("doc_id").orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, -1)  # running: a frame to the end is made anew for each row
    stop = F.coalesce(*(F.when(level == n, F.min(F.when(level <= n, F.col("node_id"))).over(after)) for n in range(1, LEVELS + 1)))
    last = F.max("node_id").over(Window.partitionBy("doc_id"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    above = F.array_compact(F.array(*(F.when(level > n, F.last(F.when(level == n, F.col("node_id")), ignorenulls=True).over(before)) for n in range(1, LEVELS))))
    return nodes.withColumn("enter", F.col("node_id")).withColumn("leave", F.coalesce(stop - 1, last)).withColumn("path", above)


def read_sections(requests: DataFrame, nodes: DataFrame, corpus: DataFrame, images: bool = True) -> DataFrame:
    """(request_id, ok, doc_id, node_id, p_idx, text) of requests (request_id, doc_id, node_id, start, end).

    A request is for the paragraphs from start to before end of one section (nodes: doc_id, node_id, n_paragraphs; corpus:
    doc_id, node_id, p_idx, kind, text); both are clamped to what there is, and an end of -1 is the section's. Blank
    paragraphs are left out. An image's text stands between marks, or alone without `images`. An unknown section gives
    one row that is not ok; one without paragraphs in the slice gives one that is.
    """
    n = F.col("n_paragraphs")
    r = requests.join(nodes.select("doc_id", "node_id", "n_paragraphs"), ["doc_id", "node_id"], "left").withColumn("ok", n.isNotNull())
    r = r.withColumn("a", F.greatest(F.lit(0), F.least("start", n))).withColumn("b", F.greatest("a", F.least(F.when(F.col("end") == -1, n).otherwise(F.col("end")), n)))
    marked = F.concat(F.lit("[image_ocr]"), "text", F.lit("[/image_ocr]"))
    shown = F.when((F.col("kind") == "image") & F.lit(images), marked).otherwise(F.col("text"))
    own = corpus.where(F.trim("text") != "").select("doc_id", "node_id", "p_idx", shown.alias("text"))
    places = r.where("ok and a < b").select("request_id", "doc_id", "node_id", F.explode(F.sequence("a", F.col("b") - 1)).alias("p_idx"))
    hits = places.join(own, ["doc_id", "node_id", "p_idx"]).select("request_id", "p_idx", "text")
    return r.select("request_id", "ok", "doc_id", "node_id").join(hits, "request_id", "left")


def neighbors_in_section(corpus: DataFrame, up: int = 1, down: int = 1) -> DataFrame:
    """Adds to paragraphs (doc_id, node_id, p_idx, text) the places (paragraph_indexes) and texts (context) of those up to `up` before and `down` behind in the same section, their own among them."""
    w = Window.partitionBy("doc_id", "node_id").orderBy("p_idx").rangeBetween(-up, abs(down))
    return corpus.withColumn("paragraph_indexes", F.collect_list("p_idx").over(w)).withColumn("context", F.array_join(F.collect_list("text").over(w), "\n"))


def with_context(hits: DataFrame, nodes: DataFrame, parents: int = 0, children: int = 0) -> DataFrame:
    """(query_id, doc_id, node_id, score, distance) of hits (query_id, doc_id, node_id, score) and the sections around them.

    nodes come from numbered(). Added are those up to `parents` levels above and `children` levels below, with their hit's
    score; distance is negative above. A section that comes up several times, among several wordings of a query too,
    counts once, with its best score and, of these, the smallest distance.
    """
    path = nodes.select("doc_id", "node_id", "path")
    own = hits.select("query_id", "doc_id", "node_id", "score")
    out = own.withColumn("distance", F.lit(0))
    if parents:
        up = own.join(path, ["doc_id", "node_id"]).select("query_id", "doc_id", "score", F.posexplode(F.slice(F.reverse("path"), 1, parents)).alias("k", "node_id"))
        out = out.unionByName(up.select("query_id", "doc_id", "node_id", "score", (-F.col("k") - 1).alias("distance")))
    if children:
        below = path.select("doc_id", F.col("node_id").alias("inner"), F.posexplode(F.slice(F.reverse("path"), 1, children)).alias("k", "node_id"))
        down = own.join(below, ["doc_id", "node_id"]).select("query_id", "doc_id", F.col("inner").alias("node_id"), "score", (F.col("k") + 1).alias("distance"))
        out = out.unionByName(down)
    best = F.max(F.struct("score", -F.abs("distance"), "distance"))
    return out.groupBy("query_id", "doc_id", "node_id").agg(best.alias("b")).select("query_id", "doc_id", "node_id", "b.score", "b.distance")


def subtree_bodies(wanted: DataFrame, nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_id, node_id, body) of wanted sections (doc_id, node_id) with all below them: bodies (doc_id, node_id, body) whose number lies in their interval."""
    spans = wanted.select("doc_id", "node_id").distinct().join(nodes.select("doc_id", "node_id", "enter", "leave"), ["doc_id", "node_id"])
    own = spans.select("doc_id", F.col("node_id").alias("top"), F.explode(F.sequence("enter", "leave")).alias("node_id")).join(bodies, ["doc_id", "node_id"])
    g = own.groupBy("doc_id", "top").agg(F.array_sort(F.collect_list(F.struct("node_id", "body"))).alias("l"))
    return g.select("doc_id", F.col("top").alias("node_id"), F.array_join(F.transform("l", lambda x: x["body"]), "\n").alias("body"))


def two_level(queries: DataFrame, scored: DataFrame, docs: DataFrame, k: int, search) -> DataFrame:
    """(query_id, doc_id, rank, score, node_id) of queries (query_id, query): their k best documents by scored (query_id, doc_id, score), then what search finds in these.

    A query without any scored document gets the first k documents (doc_id) with a score of 0.5. search(asked) takes rows
    (asked, query_id, doc_id, query) and gives (asked, node_id) of the sections that fit; where none does it is the first.
    """
    first = docs.select("doc_id").distinct().orderBy("doc_id").limit(k)
    lost = queries.select("query_id").join(scored.select("query_id").distinct(), "query_id", "left_anti")
    base = lost.crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.5))
    best = top_k(scored.select("query_id", "doc_id", "score").unionByName(base), k, "doc_id")
    asked = best.join(queries, "query_id").withColumn("asked", F.concat_ws("-", F.col("query_id").cast("string"), F.col("doc_id").cast("string")))
    found = search(asked.select("asked", "query_id", "doc_id", "query"))
    return asked.select("asked", "query_id", "doc_id", "rank", "score").join(found, "asked", "left").select("query_id", "doc_id", "rank", "score", F.coalesce("node_id", F.lit(1)).alias("node_id"))
