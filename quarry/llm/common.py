"""Helpers that the operators of this subpackage share: scratch tables, word hashes, bounded bit sets, components."""

from __future__ import annotations

import ctypes
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: [\x20\x09-\x0D].
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that Arrow hands to Python at a time; documents are long, so the default of 10,000 is too many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def column(name: str) -> Column:
    """The column of this very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns of df but those that an operator makes itself."""
    return [c for c in df.columns if c.lower() not in made]


def spare(df: DataFrame, name: str) -> str:
    """A name for a column of an operator's own that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(function):
    """The function of a task's batches; when it is done, memory that is free goes back to the system.

    Python workers stay for other tasks, several of them on an executor, and would hold what the largest task took.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return run


class Scratch:
    """Tables written to the folder that spark.checkpoint.dir names, which all executors share.

    A table cuts the lineage: an executor lost later costs a read, not the work before it. Without the setting
    (as in tests) a folder under the warehouse is taken and set.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Removes tables that no returned DataFrame reads any more."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# --- word hashes -----------------------------------------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_POW: list[np.ndarray] = []
_WINDOW = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MUL)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse, for n places; those of a usual window are kept."""
    if len(_POW) and len(_POW[0]) >= n:
        return _POW[0], _POW[1]
    size, base = max(_WINDOW + 1, n), 0xD6E8FEB86659FD93
    made = [np.ones(size, np.uint64), np.ones(size, np.uint64)]
    for out, b in zip(made, (base, pow(base, -1, 1 << 64)), strict=True):
        done, step = 1, b
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * np.uint64(step)
            done, step = 2 * done, step * step % (1 << 64)
    if size == _WINDOW + 1:
        _POW[:] = made
    return made[0], made[1]


def _windows(data: bytes):
    """Stretches of about _WINDOW bytes that end behind white space; only a longer word makes a longer one."""
    begin = 0
    while begin < len(data):
        end = begin + _WINDOW
        if end < len(data):
            m = _GAP.search(data, end - 1)
            end = m.end() if m else len(data)
        yield begin, data[begin:end]
        begin = end


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and the index of each word's text.

    Words are runs of [^\\x20\\x09-\\x0D]; A-Z are lower-cased. A null text has no words. Texts of any length are
    hashed in windows of a megabyte.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    hashes, places = [], []
    for at, window in _windows(b" ".join(raw) + b" "):
        data = np.frombuffer(window, np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]  # the last byte is a space
        if len(start):
            power, inverse = _powers(len(data))
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
            h = (total[end] - total[start]) * inverse[start]
            hashes.append(mix64(h + (end - start).astype(np.uint64) * _MUL))
            places.append(start + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(ends, np.concatenate(places), side="right")


def blocks(sizes: list[int], limit: int = 1 << 20, count: int = 1 << 20):
    """Slices of a list, of `count` items at most that add up to about the limit; a larger item stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > limit or i - begin >= count):
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


# --- bounded bit sets --------------------------------------------------------------------------------------------


def id_filter(ids: DataFrame, column: str, bits: int = 1 << 22) -> np.ndarray:
    """A bit set of fixed size over the ids' hashes, for dropping most other rows before a join that is exact.

    The driver gets at most bits / 32 numbers, whatever the number of ids.
    """
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    words = (
        ids.select(place.alias("b")).groupBy((F.col("b") / 32).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("v"))
    )
    out = np.zeros(bits // 32, np.uint32)
    for w, v in words.collect():
        out[w] = v
    return out


def in_filter(spark: SparkSession, df: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """The rows whose id may be in the bit set (all that are, and a few others)."""
    bits, sent = len(words) * 32, spark.sparkContext.broadcast(words)
    keep = df.withColumn("_b", F.pmod(F.xxhash64(column), F.lit(bits)))
    schema = keep.schema

    def part(batches):
        import pyarrow as pa

        for b in batches:
            at = b.column(b.schema.get_field_index("_b")).to_numpy(zero_copy_only=False)
            hit = (sent.value[at // 32] >> (at % 32).astype(np.uint32)) & 1
            yield b.filter(pa.array(hit.astype(bool)))

    return keep.mapInArrow(part, schema).drop("_b")


# --- connected components ----------------------------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) of all ends of the edges (a, b): component is the smallest id reachable.

    Large-star and small-star rounds: each is a grouped minimum, which Spark combines before the shuffle, and a join
    back, which Spark splits where a node is hot. Each round is written down; rounds grow with the logarithm of the
    longest path.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, seen = scratch.save(pairs, f"{name}0"), None
    for step in range(1, 60):
        # the minima are written down before they are joined back, so that the join's sides are dealt out for it alone
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-a")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large, f"{name}-b")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-c")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = scratch.save(small.select("e.*").where("u <> v").distinct(), f"{name}{step}")
        scratch.drop(f"{name}-a", f"{name}-b", f"{name}-c")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{step - 1}")
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


# --- tables of fixed size that are summed over all rows ------------------------------------------------------------


CHUNK = 1 << 14
_TABLE = "chunk int, part int, n binary"


def packed(table: np.ndarray):
    """(chunk, bytes) of the chunks of a table of counts that aren't all zero, in as few bytes a number as will do."""
    for i in range(0, len(table), CHUNK):
        if (a := table[i : i + CHUNK]).any():
            top = a.max()
            yield i // CHUNK, a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _unpacked(data, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]).astype(np.int64)


def add_tables(tables: DataFrame, size: int) -> np.ndarray:
    """The sum of all tables given by their chunks (chunk, part, n); part: 64 tasks have the same.

    Chunks are added 64 at a time, so no task gathers all of them, and the driver gets one table.
    """
    import pyarrow as pa

    arrow = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("n", pa.binary())])

    def add(key, rows):
        n = min(CHUNK, size - key[0].as_py() * CHUNK)
        total = np.zeros(n, np.int64)
        for b in rows.column("n"):
            total += _unpacked(b.as_buffer(), n)
        return pa.Table.from_pydict({"chunk": [key[0].as_py()], "part": [key[1].as_py() // 64], "n": [next(packed(total))[1]]}, schema=arrow)

    for _ in range(3):
        tables = tables.groupBy("chunk", "part").applyInArrow(add, _TABLE)
    out = np.zeros(size, np.int64)
    for i, b in tables.select("chunk", "n").collect():
        n = min(CHUNK, size - i * CHUNK)
        out[i * CHUNK : i * CHUNK + n] += _unpacked(b, n)
    return out


def summed(df: DataFrame, fill, size: int) -> np.ndarray:
    """The sum over all tasks of the table that fill(batches) makes of a task's Arrow batches."""

    def part(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own = TaskContext.get().partitionId() // 64
        for chunk, data in packed(fill(batches)):
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "part": [own], "n": [data]}, schema=pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("n", pa.binary())]))

    return add_tables(df.mapInArrow(lean(part), _TABLE), size)
