"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct word shingles. They are ordered by how frequent their class is, rare first, then
by hash. Sets at the wanted similarity share tokens among the first of both orders (the prefix), and share g + 1 of
them when the prefixes are extended by g. So if they share no rare token there, they share g + 1 frequent ones, two of
which fall in one of g hash groups: rare tokens are indexed singly, frequent ones as pairs within a group. Frequencies
come from a table of fixed size that counts all documents; they set the order and the index, never the result.

Each index entry's documents are first held against one of them, then components are formed, and only documents of
different components that share an entry are compared further, until none is left. So a group of copies costs in
proportion to its size, and no link between different components is missed. Counts of tokens in 256 hash classes, kept
for each document, bound the distance of a pair from below and spare most comparisons of whole sets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, add_tables, blocks, components, id_filter, in_filter, lean, mix64, packed, read_table, small_batches, word_hashes

SKETCH = 1 << 21
CLASSES = 256
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; with fewer words, the whole sequence as one."""
    out: list[np.ndarray] = []
    for s in blocks([len(t or "") for t in texts]):
        w, doc = word_hashes(texts[s])
        n = s.stop - s.start
        with np.errstate(over="ignore"):
            m = max(0, len(w) - words + 1)
            h = np.zeros(m, np.uint64)
            for i in range(words):
                h = h * _A + w[i : i + m] * _B
            own = doc[:m] == doc[words - 1 : words - 1 + m]
            h, at = mix64(h[own]), doc[:m][own]
            size = np.bincount(doc, minlength=n)
            for d in np.flatnonzero((size > 0) & (size < words)):
                whole = np.uint64(size[d])
                for x in w[doc == d]:
                    whole = whole * _A + x * _B
                h, at = np.append(h, mix64(np.array([whole + _C]))), np.append(at, d)
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        h, at = h[new], at[new]
        out += np.split(h, np.searchsorted(at, np.arange(1, n)))
    return out


def _classes(h: np.ndarray) -> np.ndarray:
    """How many tokens fall in each hash class, 255 at most (which can only bring two sets nearer)."""
    return np.minimum(np.bincount((h & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8)


class Index:
    """Index entries of a set, for similarity num / den."""

    def __init__(self, counts: np.ndarray, num: int, den: int, frequent: int):
        load = counts.sum() / len(counts)
        excess = counts - load
        least = max(6 * math.sqrt(load), frequent)
        self.shift = np.uint64(64 - int(math.log2(len(counts))))
        #: 0: no sign of being frequent; then by powers of two. From `first` on a token counts as frequent.
        self.level = np.where(excess < least / 2, 0, np.log2(np.maximum(excess, 1) / (least / 2)).astype(np.int64) + 1).astype(np.int8)
        self.first, self.num, self.den = 2, num, den

    def groups(self, level: int) -> int:
        size = int(1.25**level)
        return max(1, (size - -(-self.num * size // self.den) + 1) // 4)

    def entries(self, h: np.ndarray) -> np.ndarray:
        """Keys of a set. Two different sets at the similarity share one at least."""
        n = len(h)
        if n * self.den < self.num * (n + 1) and (n - 1) * self.den < self.num * n:
            return h[:0]  # only equal sets reach the similarity
        rank = self.level[(h >> self.shift).astype(np.int64)]
        order = np.lexsort((h, rank))
        h, rank = h[order], rank[order]
        prefix = n - -(-self.num * n // self.den) + 1
        low = int(math.log(n) / math.log(1.25))
        high = int(math.log(n * self.den / self.num) / math.log(1.25))
        out, longest = [], 0
        for level in range(low, high + 1):
            g = self.groups(level)
            p = min(n, prefix + g)
            longest = max(longest, p)
            often = h[:p][rank[:p] >= self.first]
            if len(often) > 1:
                group = (mix64(often ^ _C) % np.uint64(g)).astype(np.int64)
                for k in np.unique(group):
                    own = np.sort(often[group == k])
                    i, j = np.triu_indices(len(own), 1)
                    with np.errstate(over="ignore"):
                        out.append(mix64(own[i] * _A + own[j] * _B + np.uint64(level) * _C))
        out.append(h[:longest][rank[:longest] < self.first])
        return np.unique(np.concatenate(out))


def _verify(spark: SparkSession, docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    vec = sets.select("doc_id", "n", "vec")
    near = pairs.join(vec.toDF("a", "na", "va"), "a").join(vec.toDF("b", "nb", "vb"), "b")

    def close(batches):
        import pyarrow as pa

        for b in batches:
            va, vb = (np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16) for c in ("va", "vb"))
            na, nb = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("na", "nb"))
            fits = (num + den) * np.abs(va - vb).sum(axis=1, dtype=np.int64) <= (den - num) * (na + nb)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(fits))

    near = scratch.save(near.mapInArrow(lean(close), "a long, b long"), f"{name}-near")
    if near.isEmpty():
        return near
    ends = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = in_filter(spark, docs, "doc_id", id_filter(ends, "doc_id"))

    def gather(batches):
        import pyarrow as pa

        for b in batches:
            h = shingle_sets(b.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in h], pa.binary())], names=["doc_id", "h"])

    whole = scratch.save(some.mapInArrow(lean(gather), "doc_id long, h binary").join(ends.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), f"{name}-sets")

    def check(batches):
        import pyarrow as pa

        for b in batches:
            ok = []
            for x, y in zip(b.column(b.schema.get_field_index("ha")).to_pylist(), b.column(b.schema.get_field_index("hb")).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = near.join(whole.toDF("a", "ha"), "a").join(whole.toDF("b", "hb"), "b")
    out = scratch.save(both.mapInArrow(lean(check), "a long, b long"), f"{name}-edges")
    scratch.drop(f"{name}-near", f"{name}-sets")
    return out


def _across(num: int, den: int):
    """Pairs of different components within a bucket, or between two blocks of it, whose distance may be small enough."""

    def across(key, table):
        import pyarrow as pa

        rows = table.combine_chunks()
        ids, n, c, block = (rows.column(x).to_numpy() for x in ("id", "n", "c", "block"))
        v = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)
        # a pair that meets in several buckets is given by one of them, as far as the documents' first keys tell
        low = np.zeros((len(ids), 8), np.int64)
        for i, x in enumerate(rows.column("low").to_pylist()):
            low[i, : len(x)] = x
            low[i, len(x) :] = x[0]
        here, a, b = key[0].as_py(), [], []
        for i in range(len(ids)):
            j = np.flatnonzero((c != c[i]) & (ids > ids[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])))
            if key[1] != key[2]:
                j = j[block[j] != block[i]]
            j = j[(num + den) * np.abs(v[j] - v[i]).sum(axis=1, dtype=np.int64) <= (den - num) * (n[j] + n[i])]
            if len(j):
                both = (low[j][:, :, None] == low[i]).any(axis=2)
                least = np.where(both, low[j], np.iinfo(np.int64).max).min(axis=1)
                j = j[~both.any(axis=1) | (least == here)]
            a.append(np.full(len(j), ids[i]))
            b.append(ids[j])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return across


def jaccard_components(spark: SparkSession, documents: DataFrame, words: int = 5, num: int = 80, den: int = 100, frequent: int = 32, small: int = 32, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text, ...); links: den * intersection >= num * union.

    component_id is the smallest doc_id reachable by links, the document's own if it has none. Null, empty and blank
    texts have no shingles and link with nothing. Rows with the same doc_id all come back, each with its own text's
    count; their component is common. A null doc_id takes no part and has a null component.
    """
    small_batches(spark, 500)
    scratch = Scratch(spark, "jaccard")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def first(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("vec", pa.binary()), ("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
        counts = np.zeros(SKETCH, np.int64)
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), words)
            with np.errstate(over="ignore"):
                f1 = [int(mix64(h ^ _A).sum().astype(np.int64)) for h in sets]
                f2 = [int(mix64(h ^ _B).sum().astype(np.int64)) for h in sets]
            every = np.concatenate(sets)
            counts += np.bincount((every >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([_classes(h).tobytes() for h in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema
            )
        for chunk, data in packed(counts):
            yield pa.RecordBatch.from_pydict({"doc_id": [None], "n": [None], "f1": [None], "f2": [None], "vec": [None], "chunk": [chunk], "part": [TaskContext.get().partitionId() // 64], "counts": [data]}, schema=schema)

    passed = scratch.save(docs.mapInArrow(lean(first), "doc_id long, n long, f1 long, f2 long, vec binary, chunk int, part int, counts binary"), "first")
    counts = add_tables(passed.where("chunk is not null").select("chunk", "part", F.col("counts").alias("n")), SKETCH)
    own = passed.where("chunk is null").drop("chunk", "part", "counts")
    # equal sets: one document stands for all
    reps = scratch.save(own.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("vec").alias("vec")), "reps")
    sets = reps.select(F.col("rep").alias("doc_id"), "n", "vec")
    index = spark.sparkContext.broadcast(Index(counts, num, den, frequent))

    def entries(batches):
        import pyarrow as pa

        for b in batches:
            ids, all_texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i in range(0, len(ids), 200):
                h = shingle_sets(all_texts[i : i + 200], words)
                keys = [index.value.entries(x) for x in h]
                size = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids[i : i + 200], size)), pa.array(np.repeat(np.array([len(x) for x in h], np.int64), size))], names=["key", "id", "n"]
                )

    distinct = docs.join(reps.select(F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    posts = scratch.save(distinct.mapInArrow(lean(entries), "key long, id long, n long"), "posts")
    order = F.struct(F.xxhash64("id", F.pmod("key", F.lit(4))).alias("o"), "id", "n")
    heads = posts.groupBy("key").agg(F.count("*").alias("m"), F.min(order).alias("head")).where("m > 1").select("key", "m", F.col("head.id").alias("hid"), F.col("head.n").alias("hn"))
    heads = scratch.save(heads, "heads")
    shared = scratch.save(posts.join(heads, "key"), "shared")
    scratch.drop("posts", "heads")

    fits = lambda x, y: F.expr(f"{den} * least({x}, {y}) >= {num} * greatest({x}, {y})")
    pairs = shared.where("id <> hid").where(fits("n", "hn")).select(F.least("id", "hid").alias("a"), F.greatest("id", "hid").alias("b")).distinct()
    edges = _verify(spark, docs, sets, pairs, words, num, den, scratch, "one")
    known = components(spark, edges, scratch, "cc-one")

    # what is left: documents of different components that share an entry
    placed = shared.drop("hid", "hn").join(known, "id", "left").select("key", "m", "id", "n", F.coalesce("component", "id").alias("c"))
    placed = scratch.save(placed, "placed")
    scratch.drop("shared")
    open_keys = scratch.save(placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key"), "open")
    left = scratch.save(placed.join(open_keys, "key"), "left")
    scratch.drop("placed", "open")
    few = left.where(F.col("m") <= small)
    x, y = few.toDF("key", "m", "a", "na", "ca"), few.drop("m").toDF("key", "b", "nb", "cb")
    pairs = x.join(y, "key").where("a < b and ca <> cb").where(fits("na", "nb")).select("a", "b").distinct()
    many = left.where(F.col("m") > small)
    low = many.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, 8).alias("low"))
    many = many.join(low, "id").join(sets.select(F.col("doc_id").alias("id"), "vec"), "id")
    many = many.withColumn("parts", F.ceil(F.col("m") / F.lit(block)).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    pairs2 = many.select("key", "bi", "bj", "id", "n", "c", "block", "vec", "low").groupBy("key", "bi", "bj").applyInArrow(_across(num, den), "a long, b long")
    more = _verify(spark, docs, sets, pairs.unionByName(pairs2).distinct(), words, num, den, scratch, "two")
    if not more.isEmpty():
        known = components(spark, edges.unionByName(more), scratch, "cc-two")
    scratch.drop("left")

    of = scratch.save(reps.select("n", "f1", "f2", "rep").join(known.withColumnRenamed("id", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component")), "of")
    out = own.join(of, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents at 3-word shingles and similarity 0.9."""
    return jaccard_components(spark, read_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.c = p.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
