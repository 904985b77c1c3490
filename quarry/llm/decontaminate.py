"""Benchmark decontamination by pigeonhole edit matching.

A test item that may be written with up to k errors is split into k + 1 pieces: a passage within k edits of the item
holds at least one piece unchanged. Pieces are found exactly, all at once, by an automaton; where some are found, the
item is searched with Myers' bit-parallel algorithm for its least edit distance to any stretch of the text there.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, lean, read_table, small_batches

_BLANK = re.compile(r"\s+")


def normal(text: str | None) -> str:
    """Small letters, one space for white space."""
    return _BLANK.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[str, int]]:
    """k + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(item[a:b], a) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of an item of m characters to a stretch of the text, and where the first such ends."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, (m, 0)
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (ones & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best[0]:
                best = (score, j + 1)
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & ones
        mv = ph & xv & ones
    return best


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: float):
        import ahocorasick

        self.items = [(i, t, math.floor(errors * len(t))) for i, text in items if (t := normal(text))]
        self.masks: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for x, (_, t, k) in enumerate(self.items):
            for piece, at in pieces(t, k):
                where.setdefault(piece, []).append((x, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, edits, end of the passage in the normalised text) of each item that is there, its best place."""
        if not self.any or not text:
            return []
        text = normal(text)
        starts: dict[int, list[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for x, at in places:
                starts.setdefault(x, []).append(end - n + 1 - at)
        out = []
        for x, found in starts.items():
            item, t, k = self.items[x]
            if (at := text.find(t)) >= 0:
                out.append((item, 0, at + len(t)))
                continue
            found.sort()
            best, begin, last = (k + 1, 0), found[0], found[0]
            for s in [*found[1:], None]:
                if s is not None and s - last <= len(t):
                    last = s
                    continue
                if x not in self.masks:
                    self.masks[x] = masks(t)
                low = max(0, begin - k)
                edits, end = least_distance(self.masks[x], len(t), text[low : last + len(t) + k])
                best = min(best, (edits, low + end))
                if s is not None:
                    begin = last = s
            if best[0] <= k:
                out.append((item, *best))
        return out


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, errors: float = 0.08, block: int = 5000) -> DataFrame:
    """(doc_id, item_id, edits, ends_at): documents with a passage within errors * length edits of a test item.

    Both sides are compared in small letters with single spaces. Items are taken about `block` at a time, fewer where
    they are long, which bounds what is sent to the tasks; each block is held against all documents, whole, whatever
    their length. Null, empty and blank items and texts match nothing; an item too short for an error is searched
    exactly. Rows with the same doc_id each give their own matches; of items with the same id, or the same text, each
    counts. A null doc_id comes back as null, an item without an id doesn't count. Of places where an item is as near,
    the first is given. Without documents or items there are no rows. Other columns aren't read.
    """
    small_batches(spark)
    scratch = Scratch(spark, "items")
    items = benchmark.where("item_id is not null and trim(text) <> ''").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = scratch.save(items.withColumn("row", F.monotonically_increasing_id()), "items")  # equal items are dealt out by row
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    parts = max(1, -(-n // block), -(-chars // (1000 * block)))
    out = None
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == k).select("item_id", "text")
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # about `block` items

        def part(batches, sent=sent):
            import pyarrow as pa

            matcher = Matcher(sent.value, errors)
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("ends_at", pa.int64())])
            for b in batches:
                rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in matcher.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], schema=schema)

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(part), "doc_id long, item_id long, edits long, ends_at long")
        out = found if out is None else out.unionByName(found)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a test item that a passage of the document repeats."""
    return contaminated(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
