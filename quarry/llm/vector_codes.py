"""Vector code compression: one codebook for each part of the vectors, learned by Lloyd rounds over two trees.

Blocks of vectors keep, for each part, a tree of boxes with cached sums. A round walks these trees and a tree over the
codebook's entries together: bounds on the distance between two boxes drop entries, a box that one entry is left for
takes it as a whole by its cached sum, and only points of the last boxes are compared, in integers.
"""

from __future__ import annotations

import hashlib
import io
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, read_table, small_batches

SCALE = 256
BLOCK = 8192
LEAF = 32
_COMBOS = 1 << 18


class Trees:
    """Trees of boxes over the points of all parts: node j of level l holds points n*j >> l to n*(j+1) >> l of the order."""

    def __init__(self, points: np.ndarray, order: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.points, self.order, self.levels = points, order, levels  # (parts, n, width), (parts, n), lows, highs and sums

    @staticmethod
    def edges(n: int, level: int) -> np.ndarray:
        return (n * np.arange((1 << level) + 1)) >> level

    @classmethod
    def build(cls, points: np.ndarray, depth: int) -> Trees:
        """Each box is cut at the middle point of its widest side."""
        parts, n, _ = points.shape
        order, levels = np.tile(np.arange(n), (parts, 1)), []
        for level in range(depth + 1):
            edges = cls.edges(n, level)
            own = np.take_along_axis(points, order[:, :, None], 1)
            lo, hi, total = (f.reduceat(own, edges[:-1], axis=1) for f in (np.minimum, np.maximum, np.add))
            levels.append((lo, hi, total))
            if level < depth:
                node = np.repeat(np.arange(1 << level), np.diff(edges))
                side = (hi - lo).argmax(axis=2)[:, node]
                value = np.take_along_axis(own, side[:, :, None], 2)[:, :, 0]
                group = node + (np.arange(parts) << level)[:, None]
                order = order.ravel()[np.lexsort((value.ravel(), group.ravel()))].reshape(parts, n)
        return cls(np.take_along_axis(points, order[:, :, None], 1), order, levels)

    def dump(self) -> bytes:
        out = io.BytesIO()
        for a in (self.points.astype(np.int32), self.order.astype(np.int32), *(x for lo, hi, s in self.levels for x in (lo.astype(np.int32), hi.astype(np.int32), s))):
            np.save(out, a, allow_pickle=False)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Trees:
        src, arrays = io.BytesIO(data), []
        while src.tell() < len(data):
            arrays.append(np.load(src, allow_pickle=False).astype(np.int64))
        rest = arrays[2:]
        return cls(arrays[0], arrays[1], [tuple(rest[i : i + 3]) for i in range(0, len(rest), 3)])


def assign(tree: Trees, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sums, counts): the nearest entry of every point in tree order (parts, n), and the entries' new sums.

    Distances are squared and in integers; ties go to the lower index, in whole boxes as in single points.
    """
    parts, n, width = tree.points.shape
    k = entries.shape[1]
    book = Trees.build(entries, math.ceil(math.log2(k)) if k > 1 else 0)
    codes, sums, counts = np.zeros((parts, n), np.int64), np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
    part, node, entry = np.arange(parts), np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    level = depth = 0
    last, deepest = len(tree.levels) - 1, len(book.levels) - 1
    while True:
        lo, hi, cached = tree.levels[level]
        a_lo, a_hi = lo[part, node], hi[part, node]
        b_lo, b_hi = (x[part, entry] for x in book.levels[depth][:2])
        least = (np.maximum(np.maximum(b_lo - a_hi, a_lo - b_hi), 0) ** 2).sum(axis=1)
        most = (np.maximum(a_hi - b_lo, b_hi - a_lo) ** 2).sum(axis=1)
        name = book.order[part, Trees.edges(k, depth)[entry]]  # of the node's first entry; the only one at the deepest level
        group = (part << level) + node
        order = np.lexsort((name, most, group))
        part, node, entry, least, most, name, group = (x[order] for x in (part, node, entry, least, most, name, group))
        first = np.flatnonzero(np.diff(group, prepend=-1))
        of = np.repeat(first, np.diff(first, append=len(group)))
        keep = least <= most[of]
        if depth == deepest:  # entries beaten all over the box by the one whose farthest corner is nearest
            best, other = entries[part[of], name[of]], entries[part, name]
            slope = -2 * (best - other)
            worst = (best * best - other * other + np.maximum(slope * lo[part, node], slope * hi[part, node])).sum(axis=1)
            keep &= ~((worst < 0) | ((worst == 0) & (name[of] < name)))
        part, node, entry, name, group = (x[keep] for x in (part, node, entry, name, group))
        if depth == deepest:
            first = np.flatnonzero(np.diff(group, prepend=-1))
            size = np.diff(first, append=len(group))
            whole = first[size == 1]
            edges = Trees.edges(n, level)
            begin, length = edges[node[whole]], edges[node[whole] + 1] - edges[node[whole]]
            np.add.at(sums, (part[whole], name[whole]), cached[part[whole], node[whole]])
            np.add.at(counts, (part[whole], name[whole]), length)
            codes.ravel()[_ranges(part[whole] * n + begin, length)] = np.repeat(name[whole], length)
            rest = np.repeat(size > 1, size)
            part, node, entry, name = (x[rest] for x in (part, node, entry, name))
        if not len(part) or (level == last and depth == deepest):
            break
        if depth < deepest:
            depth += 1
            part, node, entry = np.repeat(part, 2), np.repeat(node, 2), np.repeat(2 * entry, 2)
            entry[1::2] += 1
            edges = Trees.edges(k, depth)
            some = edges[entry] < edges[entry + 1]
            part, node, entry = part[some], node[some], entry[some]
        if level < last:
            level += 1
            part, node, entry = np.repeat(part, 2), np.repeat(2 * node, 2), np.repeat(entry, 2)
            node[1::2] += 1
    _compare(tree, entries, part, node, name, codes, sums, counts)
    return codes, sums, counts


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one behind the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)


def _compare(tree: Trees, entries, part, node, name, codes, sums, counts) -> None:
    """Settles the points of the boxes that several entries are left for; pairs of one box stand together."""
    if not len(part):
        return
    parts, n, width = tree.points.shape
    edges = Trees.edges(n, len(tree.levels) - 1)
    begin, length = part * n + edges[node], edges[node + 1] - edges[node]
    points, best, at = tree.points.reshape(-1, width), np.full(parts * n, np.iinfo(np.int64).max), codes.ravel()
    group = (part << (len(tree.levels) - 1)) + node
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    work, i = np.add.reduceat(length, starts), 0
    ends = np.append(starts[1:], len(part))
    while i < len(starts):  # some boxes at a time
        j = i + max(1, int(np.searchsorted(np.cumsum(work[i:]), _COMBOS, side="right")))
        s = slice(starts[i], ends[j - 1])
        place, who = _ranges(begin[s], length[s]), np.repeat(np.arange(s.start, s.stop), length[s])
        d = ((points[place] - entries[part[who], name[who]]) ** 2).sum(axis=1)
        np.minimum.at(best, place, d)
        win = d == best[place]
        at[place[win]] = entries.shape[1]
        np.minimum.at(at, place[win], name[who[win]])
        i = j
    single = starts
    place, where = _ranges(begin[single], length[single]), np.repeat(part[single], length[single])
    np.add.at(sums, (where, at[place]), points[place])
    np.add.at(counts, (where, at[place]), 1)


def _usable(vectors: DataFrame, parts: int) -> DataFrame:
    """(vec_id, label, e): rows whose vector can be coded."""
    e = F.col("e")
    # so that the squared distances of a whole vector fit a long
    fits = F.forall(e, lambda x: F.coalesce(F.abs(F.floor(x * SCALE).cast("double")) < (1 << 30) / F.sqrt(F.size(e)), F.lit(False)) & ~F.isnan(x))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e")).where(
        (F.size(e) >= parts) & (F.size(e) % parts == 0) & fits
    )


def _first(rows: DataFrame, n: int) -> list:
    return rows.orderBy(F.col("vec_id").asc_nulls_last(), "e").select("e").limit(n).collect()


def compress(spark: SparkSession, vectors: DataFrame, scratch: Scratch, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each row of vectors (vec_id, embedding, label), and the codebooks (parts, entries, width).

    A component x counts as floor(256 x). Codebooks start as the parts of the rows with the smallest vec_ids; each round
    assigns all parts and takes the floors of the means; entries that no part has stay. The vectors are read once and
    written as blocks of 8,192 with their trees; a round reads these and sends one sum for each entry and task, so what
    travels is of a fixed size. Rows whose vector is null or empty, or holds null or non-finite components, or ones whose
    distances don't fit a long (over 2^19 for 64 components), are dropped; so are those of another length than the first
    row that can be coded, and of lengths that the parts don't divide. Rows that repeat a vec_id are coded each by their
    own vector; among the first rows they go by their components, and a null vec_id comes last. With fewer rows than
    entries the codebooks are shorter; without rows there are none, and no rows come back. Labels may be of any type,
    and null; other columns aren't read.
    """
    small_batches(spark)
    rows = _usable(vectors, parts)
    first = _first(rows, entries)
    if not first:
        return spark.createDataFrame([], rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")), np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0].e)
    rows = rows.where(F.size("e") == dim)
    if any(len(r.e) != dim for r in first):
        first = _first(rows, entries)

    def cut(flat: np.ndarray) -> np.ndarray:
        return np.floor(flat.reshape(-1, parts, dim // parts) * SCALE).astype(np.int64).swapaxes(0, 1)

    book = cut(np.array([r.e for r in first]))
    label = rows.schema["label"].dataType.simpleString()

    def blocks(batches):
        import pyarrow as pa

        def made(held):
            t = pa.Table.from_batches(held).combine_chunks()
            e = t.column("e").chunk(0)
            tree = Trees.build(cut(e.flatten().to_numpy(zero_copy_only=False)), max(0, int(math.log2(t.num_rows / LEAF))) if t.num_rows > LEAF else 0)
            one = pa.array([0, t.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, t.column(c).chunk(0)) for c in ("vec_id", "label")] + [pa.array([tree.dump()], pa.binary())], names=["vec_id", "label", "tree"])

        held, n = [], 0
        for b in batches:
            while b.num_rows:
                some = b.slice(0, BLOCK - n)
                b = b.slice(some.num_rows)
                held.append(some)
                n += some.num_rows
                if n == BLOCK:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    made = scratch.save(rows.mapInArrow(blocks, f"vec_id array<bigint>, label array<{label}>, tree binary"), "blocks")

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(book)

        def totals(batches, sent=sent):
            import pyarrow as pa

            own = sent.value
            sums, counts = np.zeros(own.shape, np.int64), np.zeros(own.shape[:2], np.int64)
            for b in batches:
                for x in b.column(0):
                    _, s, c = assign(Trees.load(x.as_py()), own)
                    sums, counts = sums + s, counts + c
            some = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in some] + [pa.array(counts[some])] + [pa.array(sums[some][:, j]) for j in range(own.shape[2])],
                                             names=["part", "entry", "n", *(f"s{j}" for j in range(own.shape[2]))])

        width = [f"s{j}" for j in range(dim // parts)]
        got = made.select("tree").mapInArrow(totals, "part int, entry int, n long, " + ", ".join(f"{w} long" for w in width))
        got = got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(w).cast("decimal(38,0)")).alias(w) for w in width))
        book = book.copy()
        for r in got.collect():  # parts x entries rows
            book[r.part, r.entry] = [int(r[w]) // r.n for w in width]

    sent = spark.sparkContext.broadcast(book)

    def code(batches):
        import pyarrow as pa

        own = sent.value
        for b in batches:
            for ids, labels, data in zip(b.column(0), b.column(1), b.column(2), strict=True):
                tree = Trees.load(data.as_py())
                codes, _, _ = assign(tree, own)
                d = ((tree.points - np.take_along_axis(own, codes[:, :, None], 1)) ** 2).sum(axis=2)
                out, error = np.zeros((codes.shape[1], parts), np.uint8), np.zeros(codes.shape[1], np.int64)
                for p in range(parts):
                    out[tree.order[p], p] = codes[p]
                    error[tree.order[p]] += d[p]
                text = out.tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return made.mapInArrow(code, f"vec_id long, label {label}, code string, error long"), book


def decoded(codes: DataFrame, book: np.ndarray) -> DataFrame:
    """Adds vector to codes (code, ...): the middle of the cell of each component, as doubles."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(len(book) - 1)), lambda p: F.conv(F.substring(F.col("code"), p * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    table = F.array(*(F.array(*(F.array(*(F.lit((int(x) + 0.5) / SCALE) for x in entry)) for entry in part)) for part in book))
    return codes.withColumn("vector", F.flatten(F.transform(pairs, lambda c, p: F.element_at(F.element_at(table, p + 1), c + 1))))


def label_sums(codes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds label_error, the sum of error over equal labels (nulls together), to codes (label, error, ...).

    Labels that hold over a thousandth of the rows, of which there are at most a thousand, are broadcast; a label that
    the other rows are dealt out by holds at most a thousandth of them. Codes are read twice and must be a written table.
    """
    sums = scratch.save(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    n = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = sums.where(F.col("n") * 1000 > n).select(F.col("label").alias("_l"), "label_error")
    seldom = sums.where(F.col("n") * 1000 <= n).select(F.col("label").alias("_l"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_l"))
    hot = codes.join(F.broadcast(often), same)
    rest = codes.join(F.broadcast(often.drop("label_error")), same, "left_anti").join(seldom, same)
    return hot.unionByName(rest).drop("_l")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of `embeddings`: 16 parts, 64 entries, 2 rounds."""
    scratch = Scratch(spark, "codes")
    codes, book = compress(spark, read_table(spark, sf_dir, "embeddings"), scratch)
    codes = scratch.save(codes, "codes")
    scratch.drop("blocks")
    digest = hashlib.sha256(",".join(str(x) for x in book.ravel().tolist()).encode()).hexdigest()
    return label_sums(codes, scratch).select("vec_id", "code", "error", F.col("label_error").cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def _sql(width: int = 4, parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    js = range(1, width + 1)
    d = " + ".join(f"(v.x{j} - c.x{j}) * (v.x{j} - c.x{j})" for j in js)
    out = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS (SELECT vec_id, label, p, {', '.join(f'e[p * {width} + {j}]::BIGINT AS x{j}' for j in js)} FROM k, range({parts}) r(p))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM k ORDER BY vec_id LIMIT {entries})",
        f"c0 AS (SELECT p, c, {', '.join(f'x{j}' for j in js)} FROM v JOIN f USING (vec_id))",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, v.p, {', '.join(f'any_value(v.x{j}) AS x{j}' for j in js)}, any_value(v.label) AS label, min(({d}) * {entries} + c.c) AS best FROM v JOIN c{r} c ON v.p = c.p GROUP BY v.vec_id, v.p)")
        if r < rounds:
            means = ", ".join(f"coalesce(floor(m{j}), x{j})::BIGINT AS x{j}" for j in js)
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.c, {means} FROM c{r} c LEFT JOIN (SELECT p, best % {entries} AS c, {', '.join(f'sum(x{j})::DOUBLE / count(*) AS m{j}' for j in js)} FROM a{r} GROUP BY ALL) m USING (p, c))")
    out.append(f"s AS (SELECT sha256(string_agg(concat_ws(',', {', '.join(f'x{j}' for j in js)}), ',' ORDER BY p, c)) AS codebooks_sha256 FROM c{rounds})")
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT vec_id, string_agg(lower(printf('%02x', best % {entries})), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error,"
        f" (sum(sum(best // {entries})) OVER (PARTITION BY any_value(label)))::BIGINT AS label_error, any_value(codebooks_sha256) AS codebooks_sha256 FROM a{rounds}, s GROUP BY vec_id"
    )


OP11_SQL = _sql()
