"""Katz backoff: Good-Turing discounted bigram counts over discounted unigrams, backoff weights normalised exactly.

A token's probability is looked up recursively: the discounted bigram if training has it, else the history's backoff
weight times the discounted unigram, else (for a word training lacks) the mass left for such words. The counts are in
tables partitioned by the token; the tables of backoff weights are partitioned by the history. Documents' tokens go to
the partition of their table as packed arrays; what comes back are sums for each document. Logarithms of counts and
the number of tokens of each discounted count are summed apart, so that discounts, which need all partitions' counts
of counts, can be put in at the end. Frequent tokens are dealt out over all partitions by token and history; frequent
bigrams, whose counts are summed before and broadcast, by their block of documents too.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, blocks, mix64, read_table, small_batches, summed, word_hashes

END, BOS = np.uint64(0x5C8E1D7A93B04F21), np.uint64(0x1F3A6B5D8C7E9042)
K = 5  # counts up to K are discounted by Good-Turing
LEFT = 1e-4  # taken off larger counts, so that some mass is always left to back off
_KINDS = "kind int, part int, block long, h long, v array<long>, data binary"


def _held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, history and document of all tokens of the texts; each text ends with END and begins after BOS."""
    w, doc = word_hashes(texts)
    size = np.bincount(doc, minlength=len(texts)) + 1
    last = np.cumsum(size) - 1
    t = np.full(int(size.sum()), END)
    own = np.ones(len(t), bool)
    own[last] = False
    t[own] = w
    h = np.concatenate(([BOS], t[:-1]))
    h[last[:-1] + 1] = BOS
    return t, h, np.repeat(np.arange(len(texts)), size)


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<3sI", a.dtype.str[1:].encode().ljust(3), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(data) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, out = raw[0], []
    at = 1 + 7 * n
    for i in range(n):
        kind, size = struct.unpack_from("<3sI", raw, 1 + 7 * i)
        dtype = np.dtype("<" + kind.decode().strip())
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _rows(rows: list[tuple]):
    import pyarrow as pa

    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("h", pa.int64()), ("v", pa.list_(pa.int64())), ("data", pa.binary())])
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _planes(ascending: np.ndarray) -> np.ndarray:
    """Ascending 64-bit numbers as differences, byte by byte, whose high bytes are mostly zeros."""
    return np.ascontiguousarray(np.diff(ascending, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def _whole(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


META, ENTRIES, SUMS, HISTORY, ASKED, HOT, HOT_ASKED, STATS, BACK = range(9)


def _home(h: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts)).astype(np.int64)


def _pair(t: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys of bigrams."""
    with np.errstate(over="ignore"):
        return mix64(t) * np.uint64(3) + h


def _deal(parts: int, hot: np.ndarray, hot_pairs: np.ndarray, limit: int = 8 << 20):
    """Packs the tokens of blocks of documents by partition."""

    def deal(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def emit():
            nonlocal n
            block = (task << 24) + n
            n += 1
            ids, texts = [x for x, _ in held], [x for _, x in held]
            held.clear()
            pieces = []
            for s in blocks([len(x or "") for x in texts]):
                t, h, doc = tokens(texts[s])
                with np.errstate(over="ignore"):
                    key = _pair(t, h)
                    by_block = key + mix64(np.array([block], np.uint64))
                    part = _home(np.where(np.isin(key, hot_pairs), by_block, np.where(np.isin(t, hot), t * np.uint64(3) + h, t)), parts)
                pieces.append((t, h, (doc + s.start).astype(np.int32), part.astype(np.int32)))
            del texts
            t, h, doc, part = (np.concatenate([p[i] for p in pieces]) for i in range(4))
            del pieces
            out = np.array([_held(i) for i in ids])
            rows = [(META, block % parts, block, None, None, _pack(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), out.astype(np.uint8), np.bincount(doc, minlength=len(ids)).astype(np.uint32)))]
            order = np.lexsort((h, t, part))
            t, h, doc, part = t[order], h[order], doc[order], part[order]
            del order
            cut = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                a, b = cut[p], cut[p + 1]
                tu, tn = np.unique(t[a:b], return_counts=True)
                hu, hi = np.unique(h[a:b], return_inverse=True)
                rows.append((ENTRIES, int(p), block, None, None, _pack(_planes(tu), _small(tn), _planes(hu), _small(hi), _small(doc[a:b]), out[doc[a:b]].astype(np.uint8))))
            return _rows(rows).to_batches()

        total = 0
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((i, x))
                total += len(x or "")
                if total >= limit or len(held) >= 20_000:
                    yield from emit()
                    total = 0
        if held:
            yield from emit()

    return deal


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple:
    u, at = np.unique(key, return_inverse=True)
    return u, *(np.bincount(at, v, len(u)) for v in values)


SLICES = 8  # of the range of hashes, which are worked on one after another


def _within(ascending: np.ndarray, k: int) -> slice:
    """Where the hashes of slice k stand."""
    low, high = (np.searchsorted(ascending, np.uint64(i * (1 << 64) // SLICES)) if i < SLICES else len(ascending) for i in (k, k + 1))
    return slice(int(low), int(high))


class _Load:
    """The tokens of one block of documents in one partition, by token: hashes of tokens and histories, documents."""

    def __init__(self, block: int, data):
        self.block = block
        planes, count, histories, at, doc, out = _unpack(data)
        self.t, self.h, self.at, self.doc, self.out = _whole(planes), _whole(histories), at, doc, out
        self.stop = np.cumsum(count, dtype=np.int64)
        self.c, self.r = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)  # training counts of each token and bigram

    def part(self, k: int) -> tuple[slice, np.ndarray, np.ndarray]:
        """Where the tokens of slice k stand, and their hashes and histories."""
        own = _within(self.t, k)
        begin = self.stop[own.start - 1] if own.start else 0
        size = np.diff(self.stop[own], prepend=begin)
        where = slice(int(begin), int(begin + size.sum()))
        return where, np.repeat(self.t[own], size), self.h[self.at[where]]

    def ends(self) -> np.ndarray:
        out = np.zeros(len(self.at), bool)
        i = int(np.searchsorted(self.t, END))
        if i < len(self.t) and self.t[i] == END:
            out[self.stop[i - 1] if i else 0 : self.stop[i]] = True
        return out


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, otherwise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values where a key is known (ascending), and where that is so."""
    if not len(known):
        return otherwise, np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[place] == keys
    return np.where(hit, values[place], otherwise), hit


def _score(parts: int, homes: int, hot: np.ndarray, hot_count: np.ndarray, hot_pairs: np.ndarray, pair_count: np.ndarray):
    """One partition of the count table, and the sums of the documents' tokens that it holds.

    Counts are made for a slice of the tokens at a time, and documents' sums for a block at a time, so that a task
    holds the packed tokens, two numbers for each, and the working arrays of an eighth of them.
    """

    def score(key, table):
        rows, loads = [], []
        for kind, block, data in zip(table.column("kind").to_pylist(), table.column("block").to_pylist(), table.column("data"), strict=True):
            if kind == META:
                rows.append((META, 0, block, None, None, data.as_py()))
            else:
                loads.append(_Load(block, data.as_buffer()))
        if not loads:
            return _rows(rows)
        stats, known = np.zeros(2 * (K + 1) + 2, np.int64), []
        count = lambda x: [int((x == i).sum()) for i in range(1, K + 2)]
        for k in range(SLICES):
            where, t, h = zip(*(x.part(k) for x in loads), strict=True)
            train = np.concatenate([x.out[w] == 0 for x, w in zip(loads, where, strict=True)])
            t, h = np.concatenate(t), np.concatenate(h)
            if not len(t):
                continue
            order = np.lexsort((h, t))
            t, h, train = t[order], h[order], train[order]
            new_t = np.concatenate(([True], t[1:] != t[:-1]))
            new_p = new_t | np.concatenate(([True], h[1:] != h[:-1]))
            of_t, of_p = np.cumsum(new_t) - 1, np.cumsum(new_p) - 1
            # training counts of tokens and of bigrams; of frequent ones other partitions hold some too
            c, is_hot = _looked_up(t[new_t], hot, hot_count, np.bincount(of_t, train).astype(np.int64))
            t, h = t[new_p], h[new_p]
            r, apart = _looked_up(_pair(t, h), hot_pairs, pair_count, np.bincount(of_p, train).astype(np.int64))
            own = c[~is_hot]
            stats += [*count(own), *count(r[~apart]), int((own > 0).sum()), int(own[own > K].sum())]
            seen = (r > 0) & ~apart
            known.append((h[seen], r[seen], c[of_t[new_p]][seen]))
            for x, values in (("c", c[of_t]), ("r", r[of_p])):
                back = np.empty(len(order), np.int64)
                back[order] = values
                begin = 0
                for load, w in zip(loads, where, strict=True):
                    getattr(load, x)[w] = back[begin : begin + w.stop - w.start]
                    begin += w.stop - w.start
        del order, t, h, train, back
        rows.append((STATS, 0, 0, None, stats.tolist(), None))

        # what each history needs for its backoff weight, one home at a time
        ph, pr, pc = (np.concatenate([x[i] for x in known]) for i in range(3))
        del known
        often = np.isin(ph, hot) | (ph == BOS)
        home = np.where(often, homes, _home(ph, homes))
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(homes + 2))
        for p in np.flatnonzero(np.diff(cut)):
            i = order[cut[p] : cut[p + 1]]
            r, c = pr[i], pc[i]
            hu, *v = _sum_by(ph[i], r, *((r == j) for j in range(1, K + 1)), np.where(c > K, c, 0), *((c == j) for j in range(1, K + 1)))
            v = [x.astype(np.int64) for x in v]
            if p == homes:
                rows += [(HOT, 0, 0, x, [int(y[j]) for y in v], None) for j, x in enumerate(hu.view(np.int64).tolist())]
            else:  # v[K + 1] is the sum of large unigram counts
                rows.append((HISTORY, int(p), 0, None, None, _pack(hu, *(_small(x) for x in v[: K + 1]), v[K + 1], *(_small(x) for x in v[K + 2 :]))))
        del ph, pr, pc, often, home, order

        asked = []
        for n, x in enumerate(loads):
            u = x.r == 0
            lc, lr = np.log10(np.maximum(x.c, 1)), np.log10(np.maximum(x.r, 1))
            docs, of_doc = np.unique(x.doc, return_inverse=True)
            total = lambda y: np.bincount(of_doc, y, len(docs))  # noqa: B023, E731
            # logarithms of counts that go into the score as they are, then numbers of tokens of each discounted count
            sums = [total(np.log10(x.c + 0.1)), total(x.c > 0), total(np.where(x.ends(), 0.0, -lc) + lr + np.where(u, lc, 0.0))]
            sums += [*(total(x.r == i) for i in range(1, K + 1)), total(x.r > K)]
            sums += [*(total(u & (x.c == i)) for i in range(1, K + 1)), total(u & (x.c > K)), total(u & (x.c == 0))]
            rows.append((SUMS, 0, x.block, None, None, _pack(_small(docs), *(y if k in (0, 2) else _small(y) for k, y in enumerate(sums)))))
            # tokens that back off: their documents ask for the history's weight
            qh, qd = x.h[x.at[u]], x.doc[u]
            often = np.isin(qh, hot) | (qh == BOS)
            if often.any():
                rows.append((HOT_ASKED, 0, x.block, None, None, _pack(_small(qd[often]), qh[often])))
            asked.append((qh[~often], np.full(int((~often).sum()), n, np.int32), qd[~often].astype(np.int32)))
        blocks_ = np.array([x.block for x in loads], np.int64)
        del loads
        qh, qb, qd = (np.concatenate([x[i] for x in asked]) for i in range(3))
        home = _home(qh, homes)
        order = np.lexsort((qh, home))
        cut = np.searchsorted(home[order], np.arange(homes + 1))
        for p in np.flatnonzero(np.diff(cut)):
            i = order[cut[p] : cut[p + 1]]
            rows.append((ASKED, int(p), 0, None, None, _pack(qh[i], blocks_[qb[i]], _small(qd[i]))))
        return _rows(rows)

    return score


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 1 to K from counts of counts 1 to K + 1; absolute ones where those make no sense."""
    d = np.array([1 - 0.5 / r for r in range(1, K + 1)])
    if n[0] > 0:
        common = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and common < 1:
                x = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                if 0 < x < 1:
                    d[r - 1] = x
    return d


class Discounts:
    """What all partitions' counts of counts give."""

    def __init__(self, n: int, v: int, uni: list[int], bi: list[int]):
        self.n, self.v = n, v
        self.uni, self.bi = discounts(uni), discounts(bi)
        r = np.arange(1, K + 1)
        low = (r * np.array(uni[:K])).sum()
        self.unknown = ((r * np.array(uni[:K]) * (1 - self.uni)).sum() + LEFT * (n - low)) / n if n else 1.0

    def backoff(self, total, n, large, m) -> np.ndarray:
        """Weights of histories from their count, numbers of bigrams of counts 1 to K, and the unigrams of those."""
        r = np.arange(1, K + 1)[:, None]
        n, m, total, large = (np.asarray(x, np.float64) for x in (n, m, total, large))
        left = ((n * r * (1 - self.bi[:, None])).sum(axis=0) + LEFT * (total - (n * r).sum(axis=0))) / total
        cover = ((m * r * self.uni[:, None]).sum(axis=0) + (1 - LEFT) * large) / self.n
        return left / np.maximum(1 - cover, 1e-12)


def _weights(model: Discounts):
    """Answers what documents asked of the histories of one partition, a slice of the histories at a time."""

    def weights(key, table):
        hist, asked = [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
            (hist if kind == HISTORY else asked).append(_unpack(data.as_buffer()))
        found = []
        for k in range(SLICES if asked else 0):
            own = [(x, _within(x[0], k)) for x in asked]
            qh, qb, qd = (np.concatenate([x[i][w] for x, w in own]) for i in range(3))
            value = np.zeros(len(qh))
            own = [(x, _within(x[0], k)) for x in hist]
            if len(qh) and any(w.stop > w.start for _, w in own):
                hu, *v = _sum_by(np.concatenate([x[0][w] for x, w in own]), *(np.concatenate([x[i][w].astype(np.float64) for x, w in own]) for i in range(1, 2 * K + 3)))
                answer = np.log10(v[0]) + np.log10(model.backoff(v[0], v[1 : K + 1], v[K + 1], v[K + 2 :]))
                place = np.minimum(np.searchsorted(hu, qh), len(hu) - 1)
                value = np.where(hu[place] == qh, answer[place], 0.0)  # a history that training lacks passes all to unigrams
            found.append((qb, qd.astype(np.int64), value))
        if not found:
            return _rows([])
        qb, qd, value = (np.concatenate([x[i] for x in found]) for i in range(3))
        order = np.lexsort((qd, qb))
        qb, qd, value = qb[order], qd[order], value[order]
        block, first = np.unique(qb, return_index=True)
        rows = []
        for b, a, z in zip(block.tolist(), first, [*first[1:], len(qb)], strict=True):
            d, s = _sum_by(qd[a:z], value[a:z])
            rows.append((BACK, 0, b, None, None, _pack(_small(d), s)))
        return _rows(rows)

    return weights


def _finish(model: Discounts, hot: np.ndarray, hot_answer: np.ndarray, begin: float):
    """Puts the sums of a block's documents together."""

    def finish(key, table):
        import pyarrow as pa

        rows = [(k, _unpack(x.as_buffer())) for k, x in zip(table.column("kind").to_pylist(), table.column("data"), strict=True)]
        ids, null, out, n = next(x for k, x in rows if k == META)
        sums, back = np.zeros((3 + K + 1 + K + 2, len(ids))), np.zeros(len(ids))
        for kind, x in rows:
            if kind == SUMS:
                for i, y in enumerate(x[1:]):
                    sums[i][x[0]] += y
            elif kind == BACK:
                back[x[0]] += x[1]
            elif kind == HOT_ASKED:
                np.add.at(back, x[0].astype(np.int64), hot_answer[np.searchsorted(hot, x[1])])
        n = n.astype(np.int64)
        base = sums[0] - n * math.log10(model.n + 0.1 * (model.v + 1))
        seen, unseen = sums[3 : 4 + K], sums[4 + K :]
        score = sums[2] + np.log10(model.bi) @ seen[:K] + math.log10(1 - LEFT) * (seen[K] + unseen[K]) + back - begin
        if model.n:
            score += np.log10(model.uni) @ unseen[:K] - unseen[: K + 1].sum(axis=0) * math.log10(model.n)
        score += unseen[K + 1] * math.log10(model.unknown)
        return pa.Table.from_arrays(
            [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(out.astype(bool)), pa.array(n), pa.array(np.rint(sums[1]).astype(np.int64)), pa.array(np.full(len(ids), model.n)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return finish


def katz_scores(spark: SparkSession, docs: DataFrame, per_part: int = 4_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents (doc_id, text, ...).

    Training documents are those whose crc32(doc_id as text) mod 10 is not 0. A null or empty text is its end alone;
    a null doc_id trains and comes back as null; rows with the same doc_id are documents of their own. Without any
    training document every token is unknown and has probability 1. No documents give no rows. A text of any length
    counts whole; a task holds one text and 8 million characters at a time. Other columns are neither read nor
    returned.
    """
    small_batches(spark, 250)
    scratch = Scratch(spark, "katz")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    high = np.uint64(48)

    def fill(batches):
        table = np.zeros(2 << 16, np.int64)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in blocks([len(x or "") for x in texts]):
                t, h, _ = tokens(texts[s])
                for i, x in enumerate((t, mix64(_pair(t, h)))):
                    table[i << 16 : (i + 1) << 16] += np.bincount((x >> high).astype(np.int64), minlength=1 << 16)
        return table

    sketch = summed(own, fill, 2 << 16)
    total = int(sketch[: 1 << 16].sum())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per_part), 1)
    homes = max(1, parts // 2)
    least = max(1, total // (8 * parts))
    busy = spark.sparkContext.broadcast(sketch >= least)

    def frequent(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s in blocks([len(x or "") for x in texts]):
                t, h, doc = tokens(texts[s])
                train = ~np.array([_held(i) for i in ids[s]])[doc]
                some = busy.value[(t >> high).astype(np.int64)]
                u, n, k = _sum_by(t[some], np.ones(int(some.sum())), train[some])
                some = np.flatnonzero(busy.value[(mix64(_pair(t, h)) >> high).astype(np.int64) + (1 << 16)])
                _, first, at = np.unique(_pair(t[some], h[some]), return_index=True, return_inverse=True)
                first, none = some[first], len(u)
                t, h = np.concatenate((u, t[first])), np.concatenate((np.zeros(none, np.uint64), h[first]))
                n, k = np.concatenate((n, np.bincount(at, minlength=len(first)))), np.concatenate((k, np.bincount(at, train[some], len(first))))
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(h.view(np.int64), mask=np.arange(len(h)) < none), pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64))], names=["t", "h", "n", "k"])

    counted = own.mapInArrow(frequent, "t long, h long, n long, k long").groupBy("t", "h").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    found = counted.where(F.col("n") >= least).select("t", "h", "k").collect()  # 8 tokens and 8 bigrams a partition at most
    top, pairs = [(t, k) for t, h, k in found if h is None], [r for r in found if r[1] is not None]
    hot = np.array([r[0] for r in top], np.int64).view(np.uint64)
    hot_count = np.array([r[1] for r in top], np.int64)
    hot, hot_count = hot[np.argsort(hot)], hot_count[np.argsort(hot)]

    pair_t, pair_h = (np.array([r[i] for r in pairs], np.int64).view(np.uint64) for i in (0, 1))
    pair_count, hot_pairs = np.array([r[2] for r in pairs], np.int64), _pair(pair_t, pair_h)
    order = np.argsort(hot_pairs)
    pair_t, pair_h, pair_count, hot_pairs = pair_t[order], pair_h[order], pair_count[order], hot_pairs[order]

    dealt = own.mapInArrow(_deal(parts, hot, hot_pairs), _KINDS).repartition(parts, "part")
    done = scratch.save(dealt.groupBy("part").applyInArrow(_score(parts, homes, hot, hot_count, hot_pairs, pair_count), _KINDS), "sums")
    width = 2 * (K + 1) + 2
    stats = done.where(F.col("kind") == STATS).agg(*(F.coalesce(F.sum(F.col("v")[i]), F.lit(0)) for i in range(width))).first()
    uni, bi, v, large = list(stats[: K + 1]), list(stats[K + 1 : 2 * K + 2]), stats[-2], stats[-1]
    for c in hot_count.tolist():
        v, large = v + (c > 0), large + (c if c > K else 0)
        if 0 < c <= K + 1:
            uni[c - 1] += 1
    for c in pair_count.tolist():
        if 0 < c <= K + 1:
            bi[c - 1] += 1
    n = large + sum(i * uni[i - 1] for i in range(1, K + 1))
    model = Discounts(int(n), int(v), [int(x) for x in uni], [int(x) for x in bi])

    sums = [F.sum(F.col("v")[i]) for i in range(2 * K + 2)]
    rows = done.where(F.col("kind") == HOT).groupBy("h").agg(*sums).collect()  # as many as frequent tokens at most
    known = {int(np.array([r[0]], np.int64).view(np.uint64)[0]): list(r[1:]) for r in rows}
    for t, h, c in zip(pair_t, pair_h.tolist(), pair_count.tolist(), strict=True):
        if c > 0:  # both tokens of a frequent bigram are frequent themselves, or the history is a text's beginning
            x, of_t = known.setdefault(h, [0] * (2 * K + 2)), int(hot_count[np.searchsorted(hot, t)])
            x[0] += c
            if c <= K:
                x[c] += 1
            if of_t > K:
                x[K + 1] += of_t
            else:
                x[K + 1 + of_t] += 1
    names = np.sort(np.append(hot, BOS))
    answer = np.zeros(len(names))
    for i, h in enumerate(names.tolist()):
        if h in known:
            x = known[h]
            answer[i] = math.log10(x[0]) + math.log10(model.backoff([x[0]], [[y] for y in x[1 : K + 1]], [x[K + 1]], [[y] for y in x[K + 2 :]])[0])
    begin = math.log10(known[int(BOS)][0]) if int(BOS) in known else 0.0

    back = done.where(F.col("kind").isin(HISTORY, ASKED)).groupBy("part").applyInArrow(_weights(model), _KINDS)
    rest = done.where(F.col("kind").isin(META, SUMS, HOT_ASKED)).unionByName(back)
    return rest.select("kind", "block", "data").groupBy("block").applyInArrow(
        _finish(model, names, answer, begin), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and Katz score of every document."""
    return katz_scores(spark, read_table(spark, sf_dir, "documents"))
