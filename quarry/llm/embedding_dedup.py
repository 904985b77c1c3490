"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, components, read_table, small_batches

SKETCH = 128


def tables_needed(cosine: float, bits: int, miss: float) -> int:
    """Tables of `bits` signs each, so that a pair at the threshold shares no bucket with probability `miss` at most."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def most_apart(cosine: float, miss: float) -> int:
    """Signs of a sketch in which a pair at the threshold differs, but with probability `miss` at most."""
    p, left = math.acos(cosine) / math.pi, 1.0
    for k in range(SKETCH + 1):
        left -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if left <= miss:
            return k
    return SKETCH


def _signs(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(20_240_607).standard_normal((n, dim)).T


def _hash(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(rep, mult, vec, sketch, codes): each distinct vector's signs on further planes, and its bucket in every table."""

    def part(batches):
        import pyarrow as pa

        schema = pa.schema([("rep", pa.int64()), ("mult", pa.int64()), ("vec", pa.binary()), ("sketch", pa.binary()), ("codes", pa.list_(pa.int64()))])
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raw = b.column(2).to_pylist()
            sketch, codes = [b""] * len(raw), [None] * len(raw)
            for size in {len(x) for x in raw}:
                own = [i for i, x in enumerate(raw) if len(x) == size]
                if size not in planes:
                    planes[size] = _signs(size // 8, SKETCH + tables * bits)
                side = np.frombuffer(b"".join(raw[i] for i in own)).reshape(len(own), -1) @ planes[size] > 0
                code = side[:, SKETCH:].reshape(len(own), tables, bits) @ (1 << np.arange(bits))
                for i, x, y in zip(own, np.packbits(side[:, :SKETCH], axis=1), code, strict=True):
                    sketch[i], codes[i] = x.tobytes(), y
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sketch, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], schema=schema)

    return vectors.select("rep", "mult", "vec").mapInArrow(part, "rep long, mult long, vec binary, sketch binary, codes array<long>")


def _meet(apart: int):
    """Those of a bucket, or of two blocks of it, whose sketch is near another's."""

    def meet(key, table):
        import pyarrow as pa

        table = table.combine_chunks()
        s = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(table.num_rows, -1)
        block = table.column("block").to_numpy()
        near = sum(np.bitwise_count(x[:, None] ^ x[None, :]).astype(np.int16) for x in s.T) <= apart
        np.fill_diagonal(near, False)
        if key[1] != key[2]:
            near &= block[:, None] != block[None, :]
        return table.filter(pa.array(near.any(axis=1))).select(["key", "bi", "bj", "rep", "t", "block"])

    return meet


def _compare(cosine: float):
    """Compares the vectors of one bucket, or of two blocks of it: sums of links, and edges to each cluster's first."""

    def compare(key, table):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        t = table.column("t")[0].as_py()
        order = np.argsort(table.column("rep").to_numpy())
        rep, mult, block = (table.column(c).to_numpy()[order] for c in ("rep", "mult", "block"))
        raw, code = table.column("vec").to_pylist(), table.column("codes").to_pylist()
        v = np.array([np.frombuffer(raw[i], np.float64) for i in order])
        codes = np.array([code[i] for i in order])
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
        near = (v @ v.T) >= cosine
        np.fill_diagonal(near, False)
        if key[1] != key[2]:
            near &= block[:, None] != block[None, :]
        i, j = np.nonzero(np.triu(near))
        first = ~(codes[i, :t] == codes[j, :t]).any(axis=1)  # a pair counts in the first table where it meets
        links = np.bincount(i[first], mult[j[first]], len(rep)) + np.bincount(j[first], mult[i[first]], len(rep))
        label = np.arange(len(rep))
        while len(i):
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            low = low[low]
            if (low == label).all():
                break
            label = low
        some = np.flatnonzero((links > 0) | (label != np.arange(len(rep))))
        return pa.Table.from_arrays([pa.array(rep[some]), pa.array(rep[label[some]]), pa.array(links[some].astype(np.int64))], schema=schema)

    return compare


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = 0.95, miss: float = 1e-4, fill: int = 32, block: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, ...).

    Equal vectors are compared once, whatever their number. Two vectors are compared when they share a bucket of any
    table; the number of signs grows with the number of vectors so that an average bucket holds about `fill`, and the
    number of tables so that a pair at the threshold is missed with probability `miss` at most. What goes to the buckets
    is a sketch of 128 more signs; only vectors whose sketch is near another's there are fetched and compared exactly.
    Buckets of over `block` vectors are compared in pairs of blocks. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different lengths; their component is their own id.
    Rows that repeat a vec_id come back as often, each with its own vector's links; a null vec_id links with nothing, and
    has a null component and kept false. No vectors give no rows. Other columns aren't read.
    """
    small_batches(spark)
    scratch = Scratch(spark, "vectors")

    def keys(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            raw = []
            for x in b.column(1).to_pylist():
                v = None
                if x and None not in x:
                    v = np.array(x, np.float64)
                    v = v if np.isfinite(v).all() and v.any() else None
                raw.append(None if v is None else (v + 0.0).tobytes())
            key = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(keys, "vec_id long, key binary, vec binary")
    rows = scratch.save(rows, "rows")
    groups = rows.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.min("vec").alias("vec"))
    groups = scratch.save(groups, "groups")
    n = groups.count()
    bits = max(4, math.ceil(math.log2(max(n, 1) / fill)))
    tables = tables_needed(cosine, bits, 0.9 * miss)
    hashed = scratch.save(_hash(groups, bits, tables), "hashed")

    placed = hashed.select("rep", "sketch", F.length("vec").alias("dim"), F.posexplode("codes").alias("t", "code"))
    placed = placed.select("rep", "sketch", "t", F.xxhash64("dim", "t", "code").alias("key"))  # two buckets of one key only cost time
    full = scratch.save(placed.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block), "full")
    parts = F.coalesce(F.ceil(F.col("m") / F.lit(block)).cast("int"), F.lit(1))
    dealt = placed.join(full, "key", "left").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "rep", "t", "block", "sketch")
    near = dealt.groupBy("key", "bi", "bj").applyInArrow(_meet(most_apart(cosine, 0.1 * miss)), "key long, bi int, bj int, rep long, t int, block int")
    near = scratch.save(near, "near")
    found = near.join(hashed.select("rep", "mult", "vec", "codes"), "rep").groupBy("key", "bi", "bj").applyInArrow(_compare(cosine), "a long, b long, n long")
    found = scratch.save(found, "found")
    scratch.drop("full", "hashed", "near")

    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts_of = components(spark, found.where("a <> b").select("a", "b"), scratch)
    known = groups.select("key", "rep", "mult").join(links, "rep", "left").join(parts_of.withColumnRenamed("id", "rep"), "rep", "left")
    known = scratch.save(known.select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of `embeddings` at cosine 0.95."""
    return near_vectors(spark, read_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
      AND list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e)) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.c = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(c) AS component_id, min(c) = vec_id AS kept
FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY vec_id
"""
