"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated scores and rejection."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, blocks, column, mix64, others, read_table, small_batches, spare

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\W\d_]")
_STRETCH = 1 << 20
_LONG = 1 << 18  # letters of a word that are hashed at a time
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def stretches(text: str):
    """About a megabyte at a time, cut where no word is."""
    begin = 0
    while begin < len(text):
        m = _BREAK.search(text, begin + _STRETCH) if begin + _STRETCH < len(text) else None
        end = m.end() if m else len(text)
        yield text[begin:end]
        begin = end


def words_of(text: str | None) -> Counter:
    """Lower-case words of the whole text with their counts; only words with a letter."""
    out: Counter = Counter()
    for s in stretches(text or ""):
        out.update(_WORD.findall(s.lower()))
    for w in [w for w in out if not w.isalpha() and not any(c.isalpha() for c in w)]:  # numerals that aren't digits
        del out[w]
    return out


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word) of all subwords of 1 to 4 signs of the words, each between marks of its begin and end.

    A single mark is no subword. A word of over 262,144 letters counts as several.
    """
    parts = [(i, w[j : j + _LONG]) for i, w in enumerate(words) for j in range(0, len(w), _LONG)]
    chars = np.frombuffer("".join(f"<{w}>" for _, w in parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for _, w in parts], np.int64)
    ends = np.cumsum(length)
    end, own = np.repeat(ends, length), np.repeat(np.array([i for i, _ in parts], np.int64), length)
    at = np.arange(len(chars))
    hashes, of = [], []
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64) * _K[0]
        for j in range(n):
            h += chars[j : j + m] * _K[j]
        inside = at[:m] + n <= end[:m]
        if n == 1:
            inside = (at > end - length.repeat(length)) & (at < end - 1)
        hashes.append((mix64(h[inside]) >> np.uint64(48)).astype(np.int64))
        of.append(own[:m][inside])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.int64), np.concatenate(of) if of else np.zeros(0, np.int64)


@dataclass
class Model:
    """Folded tables: what each bucket adds to each language's logit, the curve of the scores, the least accepted score."""

    langs: list[str]
    table: np.ndarray  # (BUCKETS, langs)
    bias: np.ndarray
    scale: float = 1.0
    growth: float = 0.0
    least: float = 0.0

    def probabilities(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of texts by the sums of their subwords' rows and the numbers of these."""
        z = (total / np.maximum(n, 1)[:, None] + self.bias) * (self.scale * np.maximum(n, 1) ** self.growth)[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]], langs: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent on (language, text, buckets, counts), one row a step, over four fifths of the texts.

    The other fifth sets the curve: probabilities are those of logits times scale * n ** growth, n the number of
    subwords, with the least loss there; and the score that one in a hundred of its rightly named texts falls below.
    """
    rng = np.random.default_rng(seed)
    k = len(langs)
    emb, out, bias = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)), np.zeros((dim, k)), np.zeros(k)
    seen = np.zeros(BUCKETS, bool)
    aside = np.array([r[1] % 5 == 0 for r in rows], bool)
    held, taught = np.flatnonzero(aside), np.flatnonzero(~aside)
    step, steps = 0, epochs * len(taught)
    for _ in range(epochs):
        for r in rng.permutation(taught):
            lang, _, buckets, counts = rows[r]
            if not len(buckets):
                continue
            share = counts / counts.sum()
            h = share @ emb[buckets]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1
            lr = rate * (1 - step / steps)
            back = out @ p
            out -= lr * np.outer(h, p)
            bias -= lr * 0.01 * p
            emb[buckets] -= lr * len(buckets) ** 0.5 * share[:, None] * back
            seen[buckets] = True
            step += 1
    table = np.where(seen[:, None], emb @ out, 0.0)
    model = Model(langs, table, bias)
    held = [r for r in held if len(rows[r][2])]
    if held and k > 1:
        total = np.array([rows[r][3] @ table[rows[r][2]] for r in held])
        n, y = np.array([float(rows[r][3].sum()) for r in held]), np.array([rows[r][0] for r in held])
        best = None
        for growth in np.arange(0, 0.55, 0.05):
            for scale in 2.0 ** np.arange(-4, 6.5, 0.25):
                model.scale, model.growth = float(scale), float(growth)
                p = model.probabilities(total, n)[np.arange(len(y)), y]
                loss = -np.log(np.maximum(p, 1e-12)).mean() + 1e-4 * (np.log(scale) ** 2)
                if best is None or loss < best[0]:
                    best = (loss, model.scale, model.growth)
        _, model.scale, model.growth = best
        p = model.probabilities(total, n)
        right = p.argmax(axis=1) == y
        model.least = float(np.quantile(p[right].max(axis=1), 0.01)) if right.any() else 0.0
    return model


def taught_rows(docs: DataFrame, bound: int, chars: int, most_langs: int) -> tuple[DataFrame, list[str]]:
    """(lang, text) of the sample, and its languages: equal shares of `bound` texts and of `chars` characters."""
    known = docs.where("lang is not null and text is not null").where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True)))
    known = known.select(F.col("lang").cast("string").alias("lang"), "text")
    langs = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("c")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not langs:
        return known.limit(0), []
    share, ends = len(langs), []
    for r in langs:
        part = min(1.0, bound / share / r.n, chars / share / max(r.c, 1))
        ends.append(F.struct(F.lit(r.lang).alias("l"), F.lit(int(part * (1 << 30))).alias("e")))
    place = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 30))
    limit = F.element_at(F.map_from_entries(F.array(*ends)), F.col("lang"))
    return known.where(place < F.coalesce(limit, F.lit(0))).distinct(), sorted(r.lang for r in langs)


def features(sample: DataFrame, langs: list[str], fragments: int = 3) -> DataFrame:
    """(lang, key, buckets, counts) of each text and of short runs of its words, so that short texts are learned too."""
    number = {name: i for i, name in enumerate(langs)}

    def part(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            out: list = [[], [], [], []]
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                rng = np.random.default_rng(seed)
                whole = words_of(text)
                runs = [whole]
                for _ in range(fragments):
                    at, n = int(rng.integers(len(text) + 1)), int(rng.integers(1, 9))
                    runs.append(Counter(_WORD.findall(text[at : at + 400].lower())[1 : 1 + n]))
                for j, run in enumerate(runs):
                    if j and not run:
                        continue
                    names = list(run)
                    buckets, of = subwords(names)
                    sums = np.bincount(buckets, np.array([run[w] for w in names])[of] if names else None, BUCKETS)
                    some = np.flatnonzero(sums)
                    for col, v in zip(out, (number[lang], seed * 8 + j, some.astype(np.int32).tobytes(), sums[some].astype(np.float32).tobytes()), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["lang", "key", "buckets", "counts"])

    return sample.select("lang", "text").mapInArrow(part, "lang int, key long, buckets binary, counts binary")


class Namer:
    """Sums of the model's rows for texts; the rows of words seen before are kept, within bounds."""

    def __init__(self, model: Model):
        self.model, self.known, self.rows, self.n = model, {}, np.zeros((1024, len(model.langs) + 1)), 0

    def _vectors(self, words: list[str]) -> np.ndarray:
        """The sum of the rows of each word's subwords, and their number."""
        k = len(self.model.langs)
        out = np.zeros((len(words), k + 1))
        for s in blocks([len(w) + 2 for w in words], 1 << 18):
            buckets, of = subwords(words[s])
            got, table = out[s], self.model.table[buckets]
            for j in range(k):
                got[:, j] = np.bincount(of, table[:, j], s.stop - s.start)
            got[:, k] = np.bincount(of, minlength=s.stop - s.start)
        return out

    def sums(self, counts: list[Counter]) -> np.ndarray:
        """(texts, languages and number of subwords)."""
        if self.n > 200_000:
            self.known, self.n = {}, 0
        new = list({w for c in counts for w in c if w not in self.known})
        short, long = [w for w in new if len(w) <= 64], [w for w in new if len(w) > 64]
        while len(self.rows) < self.n + len(new):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        names = self.known | {w: self.n + len(short) + i for i, w in enumerate(long)} if long else self.known
        self.rows[self.n : self.n + len(new)] = self._vectors(short + long)
        for i, w in enumerate(short):
            self.known[w] = names[w] = self.n + i
        self.n += len(short)
        out = np.zeros((len(counts), self.rows.shape[1]))
        for i, c in enumerate(counts):
            if c:
                out[i] = np.fromiter(c.values(), np.float64, len(c)) @ self.rows[[names[w] for w in c]]
        return out


def name_languages(spark: SparkSession, docs: DataFrame, bound: int = 4000, chars: int = 16_000_000, most_langs: int = 256) -> DataFrame:
    """Adds held_out, lang_pred, score and rejected to documents (doc_id, text, lang, ...).

    Learned from a sample of the texts with a lang whose crc32(doc_id as text) mod 4 is not 2: about `bound` different
    texts and `chars` characters at most in all, the same share of each of the `most_langs` languages with most rows
    (these are the documented bounds; the driver gets the sample's subword counts). Predictions cover all whole texts
    and see nothing but the text. A text that is null or has no letter is `und` with score 0 and rejected; so is every
    text if no language can be learned. rejected tells that the score is one that, at calibration, one in a hundred
    rightly named texts falls below; lang_pred stays the likeliest language. A null doc_id is not held out. Rows that repeat a
    doc_id are named each by their own text, equal texts alike; at ties the language first in order is named. Texts and
    words of any length are read whole. No documents give no rows. Columns held_out, lang_pred, score and rejected are
    replaced; all others stay, whatever their names.
    """
    small_batches(spark)
    scratch = Scratch(spark, "language")
    sample, langs = taught_rows(docs, bound, chars, most_langs)
    model = Model(langs, np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)))
    if langs:
        rows = scratch.save(features(sample, langs), "sample").orderBy("key", "lang").collect()  # about four times `bound`
        model = train([(r.lang, r.key // 8, np.frombuffer(r.buckets, np.int32).astype(np.int64), np.frombuffer(r.counts, np.float32).astype(np.float64)) for r in rows], langs)
        scratch.drop("sample")
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def name(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        namer = Namer(m)
        for texts in batches:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            values = texts.tolist()
            for s in blocks([len(t or "") for t in values], 1 << 18):
                counts = [words_of(t) for t in values[s]]
                if not m.langs:
                    continue
                sums = namer.sums(counts)
                p = m.probabilities(sums[:, :-1], sums[:, -1])
                for i, (c, best, top) in enumerate(zip(counts, p.argmax(axis=1), p.max(axis=1), strict=True)):
                    if c:
                        lang[s.start + i], score[s.start + i] = m.langs[best], min(top, 1.0)
            yield pd.DataFrame({"lang_pred": lang, "score": score, "rejected": [x == UNKNOWN or v < m.least for x, v in zip(lang, score)]})

    made = ("held_out", "lang_pred", "score", "rejected")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    other, own = others(docs, *made), spare(docs, "_named")
    named = docs.select(*map(column, other), held, name("text").alias(own))
    return named.select(*map(column, other), "held_out", *(F.col(own)[x].alias(x) for x in made[1:]))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    return name_languages(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")
