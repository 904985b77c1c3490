"""Ranked lexical search: documents grouped by the terms of an item that they hold, the best groups evaluated first."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, read_table, small_batches, summed

#: Bytes of UTF-8 that belong to terms: those of other alphabets, digits and letters; A-Z are lower-cased, all else separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_STRETCH = 1 << 20
DOCS, POSTINGS = 4096, 1 << 21


def _terms(text: bytes | None):
    """Lists of the terms of stretches of about a megabyte of a text; a longer term makes a longer stretch."""
    data, begin = (text or b"").translate(_TABLE), 0
    while begin < len(data):
        end = data.find(b" ", begin + _STRETCH) if begin + _STRETCH < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): each item's distinct terms; rows that repeat an item_id are one item, null ids too."""

    def split(batches):
        import pyarrow as pa

        for b in batches:
            terms = [sorted({t for some in _terms(x) for t in some}) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary")).mapInArrow(split, "item_id long, terms array<binary>")
    return rows.select("item_id", F.explode("terms").alias("t")).distinct().groupBy("item_id").agg(F.array_sort(F.collect_list("t")).alias("terms"))


def _blocks(items: DataFrame, count: int, terms: int):
    """The items as lists of (item_id, terms), `count` items or `terms` terms at a time; one longer item stands alone."""
    held, n = [], 0
    for r in items.toLocalIterator():
        if held and (len(held) >= count or n + len(r.terms) > terms):
            yield held
            held, n = [], 0
        held.append((r.item_id, [bytes(t) for t in r.terms]))
        n += len(r.terms)
    if held:
        yield held


def _postings(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, n, terms, tf) of all documents with terms: their number, and those of the vocabulary with their counts."""

    def part(batches):
        import pyarrow as pa

        vocabulary = sent.value
        for b in batches:
            ids, ns, terms, tfs = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, counts = 0, Counter()
                for some in _terms(text.as_py()):
                    n += len(some)
                    counts.update(some)
                    if len(counts) > 1_000_000:  # only what is asked for is kept of very long texts
                        counts = Counter({t: c for t, c in counts.items() if t in vocabulary})
                if n:
                    found = sorted((v, c) for t, c in counts.items() if (v := vocabulary.get(t)) is not None)
                    ids.append(i)
                    ns.append(n)
                    terms.append(np.array([v for v, _ in found], np.int32).tobytes())
                    tfs.append(np.array([c for _, c in found], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(part, "doc_id long, n long, terms binary, tf binary")


def _gathered(batches):
    """Blocks of the postings of 4,096 documents or two million postings: ids, numbers of terms, bounds, terms, counts."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            held.append(row)
            size += len(row[2]) // 4
            if len(held) >= DOCS or size >= POSTINGS:
                yield held
                held, size = [], 0
    if held:
        yield held


class Searcher:
    """Keeps the best documents of each item over blocks of postings."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.k = [np.array(x, np.int64) for x in items], weights, n_docs, n_terms, k
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (-score, no id, id), best first
        self.place = np.full(len(weights), -1, np.int64)

    def impacts(self, tf: np.ndarray, n: np.ndarray, term: np.ndarray) -> np.ndarray:
        """What each posting adds to a score."""
        if n.max(initial=0) > (1 << 62) // (50 * max(self.n_docs, 1)):  # beyond 64 bits
            n = n.astype(object)
        m = (50 + (50 * n * self.n_docs) // self.n_terms).astype(np.int64)
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))

    def block(self, rows: list) -> None:
        ids = [r[0] for r in rows]
        length = np.array([len(r[2]) // 4 for r in rows])
        bounds = np.concatenate(([0], np.cumsum(length)))
        term = np.frombuffer(b"".join(r[2] for r in rows), np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), length)
        impact = self.impacts(np.frombuffer(b"".join(r[3] for r in rows), np.int64), np.repeat(np.array([r[1] for r in rows]), length), term)
        top = np.zeros(len(self.weights), np.int64)
        np.maximum.at(top, term, impact)
        by_term = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[by_term], np.arange(len(self.weights) + 1))
        posted = doc[by_term]
        for i, terms in enumerate(self.items):
            here = terms[starts[terms + 1] > starts[terms]]
            if len(here):
                self._item(i, here, ids, bounds, term, impact, top, starts, posted)

    def _item(self, i, here, ids, bounds, term, impact, top, starts, posted) -> None:
        step = max(8, (1 << 24) // len(here))  # documents whose masks are laid out at a time
        for low in range(0, len(ids), step):
            high = min(low + step, len(ids))
            self._masks(i, here, low, high, ids, bounds, term, impact, top, starts, posted)

    def _masks(self, i, here, low, high, ids, bounds, term, impact, top, starts, posted) -> None:
        has = np.zeros((len(here), high - low), bool)
        for j, t in enumerate(here):
            d = posted[starts[t] : starts[t + 1]]
            if low or high < len(ids):
                d = d[np.searchsorted(d, low) : np.searchsorted(d, high)]
            has[j, d - low] = True
        masks = np.ascontiguousarray(np.packbits(has, axis=0).T)
        _, first, group = np.unique(masks.view(f"V{masks.shape[1]}").ravel(), return_index=True, return_inverse=True)
        bound = top[here] @ has[:, first]
        order = np.argsort(-bound, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        docs = np.argsort(rank[group], kind="stable")  # documents by the bound of their mask
        most = bound[group[docs]]
        self.place[here] = 1
        at, take = 0, 2 * self.k
        while at < len(docs):
            best = self.best[i]
            least = -best[-1][0] if len(best) == self.k else 1
            end = int(np.searchsorted(-most, -least, side="right"))  # groups below this can't come in
            some = docs[at : min(at + take, end)] + low
            if not len(some):
                break
            self._evaluate(i, some, ids, bounds, term, impact)
            at, take = at + len(some), 2 * take
        self.place[here] = -1

    def _evaluate(self, i, docs, ids, bounds, term, impact) -> None:
        length = bounds[docs + 1] - bounds[docs]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(bounds[docs] - (ends - length), length)
        own = np.where(self.place[term[at]] > 0, impact[at], 0)
        total = np.concatenate(([0], np.cumsum(own)))
        score = total[ends] - total[ends - length]
        new = [(-s, ids[d] is None, ids[d] or 0) for s, d in zip(score.tolist(), docs.tolist(), strict=True) if s > 0]
        self.best[i] = sorted(self.best[i] + new)[: self.k]


def ranked(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50, count: int = 1000, terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of the highest scores above 0 for each item (item_id, text).

    Terms, weights and scores are those of the query's contract. Items go in blocks of `count` items or `terms` distinct
    terms at most (an item with more stands alone). A block tokenises all documents once and writes the postings of its
    terms; sums of these give the weights. Each task groups its documents by the mask of an item's terms, 4,096
    documents or two million postings at a time, bounds the score of a mask by the greatest share that each of its terms has
    there, and evaluates masks by falling bound until the k-th score is above the next; what it leaves are k rows an item.
    Null and empty texts have no terms: such documents don't count, such items have no rows. Equal scores go by ascending
    doc_id, a null one last. Rows that repeat a doc_id are documents of their own; rows that repeat an item_id, or have none,
    are one item with the terms of all. Texts of any length are read whole, a megabyte at a time. Without documents or
    items there are no rows. Other columns aren't read.
    """
    small_batches(spark)
    scratch = Scratch(spark, "search")
    found = []
    for b, block in enumerate(_blocks(item_terms(items), count, terms)):
        names = sorted({t for _, own in block for t in own})
        number = {t: i for i, t in enumerate(names)}
        sent = spark.sparkContext.broadcast(number)
        postings = scratch.save(_postings(docs, sent), f"postings{b}")
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break

        def fill(batches, size=len(names)):
            df = np.zeros(size, np.int64)
            for x in batches:
                df += np.bincount(np.frombuffer(b"".join(x.column(0).to_pylist()), np.int32), minlength=size)
            return df

        df = summed(postings.select("terms"), fill, len(names))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        query = spark.sparkContext.broadcast(([i for i, _ in block], [[number[t] for t in own] for _, own in block], weights))

        def search(batches, query=query, n_docs=n_docs, n_terms=n_terms):
            import pyarrow as pa

            ids, own, weights = query.value
            s = Searcher(own, weights, n_docs, n_terms, k)
            for rows in _gathered(batches):
                s.block(rows)
            for i, best in zip(ids, s.best, strict=True):
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(best), pa.int64()), pa.array([None if none else d for _, none, d in best], pa.int64()), pa.array([-x for x, _, _ in best], pa.int64())],
                                                     names=["item_id", "doc_id", "score"])

        hits = postings.mapInArrow(search, "item_id long, doc_id long, score long")
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        share = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(*order)
        hits = hits.withColumn("r", F.row_number().over(share)).where(F.col("r") <= k)
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
        found.append(scratch.save(hits.select("item_id", "rank", "doc_id", "score"), f"hits{b}"))
        scratch.drop(f"postings{b}")
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of all `documents` for every `benchmark` item: item_id, rank, doc_id, score."""
    return ranked(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark),
c AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
p AS (SELECT doc_id, term, tf FROM t WHERE term IN (SELECT term FROM q)),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
m AS (SELECT doc_id, 100 - 50 + ((50 * len(terms) * n_docs) // n_terms) AS m FROM d, c WHERE len(terms) > 0),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
