"""Line dedup: two Bloom filters over line hashes; only suspected repeats shuffle for exact confirmation."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.llm.common import Scratch, column, lean, mix64, others, read_table, small_batches

_STRIP = " \t\n\x0b\x0c\r"
_CHUNK = 1 << 14  # bytes of a filter that are merged together


def line_key(line: str) -> bytes:
    """The line stripped, A-Z lower-cased, as UTF-8 (bytes.lower changes nothing else)."""
    return line.strip(_STRIP).encode("utf-8", "surrogatepass").lower()


def _long_lines(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """Places of each key of at least min_chars code points, by the key's 128-bit hash."""
    out: dict[bytes, list[int]] = {}
    if text:
        for i, line in enumerate(text.split("\n")):
            if len(line) >= min_chars and len(line.strip(_STRIP)) >= min_chars:
                out.setdefault(hashlib.blake2b(line_key(line), digest_size=16).digest(), []).append(i)
    return out


def _places(hashes: list[bytes], bits: int) -> np.ndarray:
    """Two places in the filter for each hash."""
    two = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    return (mix64(two) % np.uint64(bits)).astype(np.int64)


def _merge(once, twice, once2, twice2):
    return once | once2, twice | twice2 | (once & once2)


def seen_twice(spark: SparkSession, docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The filter of what at least two documents hold (bits of it may be set besides).

    Each task fills one pair of filters, of bits / 8 bytes each, however many documents it has. The chunks of the
    filters are merged 64 at a time, so no task gathers all of them.
    """

    def fill(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            hashes = [h for t in b.column(0).to_pylist() for h in _long_lines(t, min_chars)]
            if hashes:
                at, n = np.unique(_places(hashes, bits), return_counts=True)
                byte, bit = at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)
                again = (n > 1) | (once[byte] & bit > 0)
                np.bitwise_or.at(twice, byte[again], bit[again])
                np.bitwise_or.at(once, byte, bit)
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // 64
        o, t = once.reshape(-1, _CHUNK), twice.reshape(-1, _CHUNK)
        for i in range(len(o)):
            if o[i].any():
                yield pa.RecordBatch.from_pydict({"chunk": [i], "part": [part], "once": [o[i].tobytes()], "twice": [t[i].tobytes()]}, schema=arrow)

    def merge(key, table):
        import pyarrow as pa

        o, t = np.zeros(_CHUNK, np.uint8), np.zeros(_CHUNK, np.uint8)
        for o2, t2 in zip(table.column("once"), table.column("twice"), strict=True):
            o, t = _merge(o, t, np.frombuffer(o2.as_buffer(), np.uint8), np.frombuffer(t2.as_buffer(), np.uint8))
        return pa.Table.from_pydict({"chunk": [key[0].as_py()], "part": [key[1].as_py() // 64], "once": [o.tobytes()], "twice": [t.tobytes()]}, schema=arrow)

    import pyarrow as pa

    kinds, arrow = "chunk int, part int, once binary, twice binary", pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    filled = docs.select("text").mapInArrow(lean(fill), kinds)
    merged = filled
    for _ in range(3):  # 64 tasks' chunks at a time: for up to 262,144 tasks
        merged = merged.groupBy("chunk", "part").applyInArrow(merge, kinds)
    out = np.zeros(bits // 8, np.uint8)
    for chunk, twice in merged.select("chunk", "twice").collect():  # bits / 8 bytes at most
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] |= np.frombuffer(twice, np.uint8)
    return out


def filter_bits(docs: DataFrame, min_chars: int, least: int = 1 << 23, most: int = 1 << 29) -> int:
    """Bits of a filter for all the lines that documents can hold: four for each min_chars characters, within bounds."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return min(most, max(least, 1 << (4 * chars // max(min_chars, 1)).bit_length()))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int | None = None) -> DataFrame:
    """Adds n_lines, n_dropped and kept to documents (doc_id, text, ...).

    A line's key is the line stripped of [\\x20\\x09-\\x0D], A-Z lower-cased. Keys of at least min_chars code points
    that at least min_docs documents hold lose all their lines but those in the largest doc_id that holds them.
    Null and empty texts are one empty line. A doc_id that occurs twice counts once, and its rows are treated alike; rows
    without a doc_id count for no line and lose none. Texts and lines of any length are read whole. No documents give no
    rows. Columns n_lines, n_dropped and kept are replaced; all others stay, whatever their names.
    The filters take bits / 8 bytes each on the driver and in a worker. Without `bits` they grow with the text, up to
    64 MB; fuller filters let more lines shuffle, but the result stays exact, since counts come from grouping the
    suspected lines' 128-bit hashes.
    """
    small_batches(spark)
    scratch = Scratch(spark, "lines")
    bits = bits or filter_bits(docs, min_chars)
    sent = spark.sparkContext.broadcast(seen_twice(spark, docs, min_chars, bits))

    def suspects(batches):
        import pyarrow as pa

        for b in batches:
            keys, ids = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = list(_long_lines(t, min_chars))
                keys += own
                ids += [i] * len(own)
            if keys:
                at = _places(keys, bits)
                hit = ((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                keys, ids = [k for k, h in zip(keys, hit, strict=True) if h], [k for k, h in zip(ids, hit, strict=True) if h]
            yield pa.RecordBatch.from_pydict({"key": keys, "doc_id": ids}, schema=pa.schema([("key", pa.binary()), ("doc_id", pa.int64())]))

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = scratch.save(base.mapInArrow(lean(suspects), "key binary, doc_id long").where("doc_id is not null").distinct(), "held")
    common = held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    common = scratch.save(common, "common")  # so that both sides of the join are dealt out for it, and a hot key can be split
    lost = held.join(common, "key").where("doc_id <> last").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("key").alias("lost"))
    lost = scratch.save(lost, "lost")
    scratch.drop("held", "common")

    other = others(docs, "n_lines", "n_dropped", "kept")
    own = docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(other)), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    joined = own.join(lost.hint("shuffle_hash"), "id", "left").drop("id", *(f"c{i}" for i, c in enumerate(other) if c == "text"))
    rest = [f"c{i}" if c != "text" else "text" for i, c in enumerate(other)]
    kinds = StructType([*joined.select(*rest).schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())])

    def kept(batches):
        import pyarrow as pa

        for b in batches:
            rows = ([], [], [])
            for t, g in zip(b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.schema.get_field_index("lost")).to_pylist(), strict=True):
                lines = (t or "").split("\n")
                n = len(lines)
                if g:
                    found = _long_lines(t, min_chars)
                    away = {i for h in g for i in found.get(h, ())}
                    lines = [x for i, x in enumerate(lines) if i not in away]
                for column, x in zip(rows, (n, n - len(lines), "\n".join(lines)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=kinds.names)

    return joined.mapInArrow(lean(kept), kinds).toDF(*other, "n_lines", "n_dropped", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept lines of every document."""
    out = drop_repeated_lines(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.i, k.line, c.last IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
