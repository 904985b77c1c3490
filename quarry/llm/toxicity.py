"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A word that may be disguised (leetspeak, letters spaced out, letters repeated) is a lattice of characters. Viterbi
decoding under a character language model, counted over all documents, picks the likeliest spelling. The classifier
weighs character n-grams of the restored words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from heapq import nlargest
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, blocks, column, others, read_table, small_batches, spare, summed

LM_SIZE = 1 << 20
FEATURES = 1 << 20
#: What a written sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "#": "aeiou"}
_ENDS = ".,;:!?\"'()[]{}<>*&%#$|~`^=/\\-_¿¡«»“”‘’"
_PLAIN = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1\1", re.S)
_SPACED = re.compile(r"(?<![^\s])[^\W_](?:[ .*_-]{1,2}[^\W_]){2,}(?![^\s.,;:!?])")
_SPLIT = re.compile(r"[^\w@$!|+*#]+|_+")
_M = 0xFFFFFFFFFFFFFFFF
_K = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_W = (*_K, 0xA0761D6478BD642F)
_SALT = (0, 0x51ED270B7A2B1A4D, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0x5851F42D4C957F2D)


# --- character language model --------------------------------------------------------------------------------------


def _gram(chars: tuple[int, ...]) -> int:
    """Place of a character n-gram (n from 1 to 4) in the table."""
    h = _SALT[len(chars)]
    for c, k in zip(reversed(chars), _K):
        h = (h + c * k) & _M
    h ^= h >> 29
    return ((h * 0xBF58476D1CE4E5B9) & _M) >> 44


def _count_words(words: Counter, table: np.ndarray) -> None:
    """Adds the n-grams of the words, each marked by 2 before and 3 behind, to the table."""
    if not words:
        return
    text = "".join(f"\x02\x02\x02{w}\x03" for w in words)
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter((len(w) + 4 for w in words), np.int64, len(words)))
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 5):
        h[n - 1 :] += c[: len(c) - n + 1] * np.uint64(_K[n - 1]) if n > 1 else c * np.uint64(_K[0])
        g = h + np.uint64(_SALT[n])
        g ^= g >> np.uint64(29)
        at = (g * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)
        own = c != 2  # a mark before a word is never predicted, but stands in contexts
        if n < 4:
            own = np.ones(len(c), bool)
        own[: n - 1] = False
        table += np.bincount(at[own].astype(np.int64), weights=weight[own], minlength=LM_SIZE).astype(np.int64)


def fit_characters(docs: DataFrame) -> np.ndarray:
    """Counts of all character 1- to 4-grams of the words of all documents, hashed into a table of fixed size."""

    def fill(batches):
        table, words = np.zeros(LM_SIZE, np.int64), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    words.update(t.lower().split())
                if len(words) > 200_000:
                    _count_words(words, table)
                    words = Counter()
        _count_words(words, table)
        return table

    return summed(docs.select("text"), fill, LM_SIZE)


class Restorer:
    """Viterbi decoding of character lattices under the character model."""

    def __init__(self, table: np.ndarray):
        self.n, self.cache = table, {}

    def _cost(self, a: int, b: int, c: int, d: int) -> float:
        """-log of the probability of d after a, b, c."""
        key = (a, b, c, d)
        if (got := self.cache.get(key)) is not None:
            return got
        n, p = self.n, 0.02 / 256
        for w, gram, context in ((0.6, (a, b, c, d), (a, b, c)), (0.25, (b, c, d), (b, c)), (0.1, (c, d), (c,))):
            if (under := n[_gram(context)]) > 0:
                p += w * min(1.0, float(n[_gram(gram)]) / float(under))
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[key] = out = -math.log(p)
        return out

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The cheapest text; each place of the lattice offers (characters, cost) pairs.

        All states are kept: one is the last three characters, so the options of three places bound their number.
        """
        best = {(2, 2, 2): (0.0, None)}
        for place in lattice:
            new: dict = {}
            for (a, b, c), (cost, back) in best.items():
                for chars, own in place:
                    x, y, z, total = a, b, c, cost + own
                    for ch in chars:
                        if ch == " ":  # a word ends here and the next one begins
                            total += self._cost(x, y, z, 3)
                            x = y = z = 2
                        else:
                            d = ord(ch)
                            total += self._cost(x, y, z, d)
                            x, y, z = y, z, d
                    if (old := new.get((x, y, z))) is None or total < old[0]:
                        new[(x, y, z)] = (total, (chars, back))
            best = new
        _, back = min(((cost + self._cost(*s, 3), back) for s, (cost, back) in best.items()), key=lambda e: e[0])
        out = []
        while back is not None:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out))

    def word(self, token: str) -> str:
        """A token with leetspeak and repetition undone; unambiguous ones stay."""
        lattice, i = [], 0
        while i < len(token):
            j = i
            while j < len(token) and token[j] == token[i]:
                j += 1
            run, ch = j - i, token[i]
            if ch in SIGNS:
                options = [(x, 1.0) for x in SIGNS[ch]]
                lattice += [[(ch, 2.0), *options]] * min(run, 2) if run < 3 else [[(ch, 2.0), *options, *((2 * x, 1.5) for x, _ in options)]]
            elif run >= 3:
                lattice.append([(ch, 0.5), (ch * 2, 0.5), (ch * run, 6.0)])
            else:
                lattice += [[(ch, 0.0)]] * run
            i = j
        return self.decode(lattice)

    def letters(self, spaced: str) -> str:
        """Letters spaced out, joined where the model finds a word."""
        chars = re.findall(r"[^\W_]", spaced)
        lattice = []
        for i, ch in enumerate(chars):
            options = [(ch, 0.0), *((x, 1.0) for x in SIGNS.get(ch, ""))]
            lattice.append(options if i == 0 else [*options, *((" " + x, c + 1.0) for x, c in options)])
        return self.decode(lattice)

    def words(self, token: str) -> list[str]:
        """The restored words of one lower-cased token of a text."""
        bare = token.strip(_ENDS)
        if bare.isalpha():
            return [self.word(bare) if _RUN.search(bare) else bare]
        out = []
        for x in _SPLIT.split(bare):
            if x.isalpha():
                out.append(self.word(x) if _RUN.search(x) else x)
            elif any(ch.isalpha() for ch in x):
                out.append(self.word(x.rstrip("!") or x))
        return [w for part in out for w in part.split() if w]

    def scored(self, token: str) -> list[str]:
        """What is scored of a token: its restored words, and the runs of letters between the signs of a disguised one."""
        bare = token.strip(_ENDS)
        if bare.isalpha():
            return [bare] if not _RUN.search(bare) else self.words(token)
        return self.words(token) + [p for x in _SPLIT.split(bare) if not x.isalpha() for p in _PLAIN.findall(x)]


# --- classifier ----------------------------------------------------------------------------------------------------


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words and of their character 4- and 5-grams, borders marked.

    First the places of the whole words, then a place of a 4-gram and of a 5-gram for each character (-1 where none
    begins, as at a word's end), then where each word's characters begin.
    """
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    c = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), size)
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES for w in words), np.int64, len(words))
    grams, h = np.full((2, len(c)), -1, np.int64), np.zeros(len(c), np.uint64)
    for n in range(1, 6):
        m = max(len(c) - n + 1, 0)
        h = h[:m] + c[n - 1 :] * np.uint64(_W[n - 1])
        if n >= 4 and m:
            g = h + np.uint64(_SALT[n - 1])
            g ^= g >> np.uint64(29)
            place = ((g * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)
            grams[n - 4, :m] = np.where(of[:m] == of[n - 1 :], place, -1)
    return whole, grams, np.cumsum(size) - size


def _distinct(words: list[str]) -> np.ndarray:
    """The distinct places of all the words."""
    found = []
    for s in blocks([len(w) for w in words]):
        whole, grams, _ = _features(words[s])
        found += [whole, grams[grams >= 0]]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _heaviest(words: list[str], weights: np.ndarray) -> list[float]:
    """The largest weight of each word's places."""
    out: list[float] = []
    for s in blocks([len(w) for w in words]):
        whole, grams, begin = _features(words[s])
        best = weights[whole]
        for g in grams:
            best = np.maximum(best, np.maximum.reduceat(np.where(g >= 0, weights[g], -np.inf), begin))
        out += best.tolist()
    return out


def _restored(texts: list[str | None], restorer: Restorer, known: dict, made):
    """For each text made(words)'s values of its distinct restored words.

    known keeps them by token: the value of its one word, or a list for the tokens in known[None].
    """
    for s in blocks([len(t or "") for t in texts], 1 << 18):
        split = []
        for t in texts[s]:
            low = (t or "").lower()
            split.append((set(low.split()), [w for m in _SPACED.finditer(low) for w in restorer.letters(m.group()).split()]))
        if len(known) > 200_000:
            known.clear()
        several = known.setdefault(None, set())
        new = list(set().union(*(tokens for tokens, _ in split)).difference(known))
        words = [restorer.scored(t) for t in new]
        joined = [w for _, spaced in split for w in spaced]
        values = iter(made([w for x in words for w in x] + joined))
        fresh = {t: next(values) if len(x) == 1 else [next(values) for _ in x] for t, x in zip(new, words, strict=True)}
        many = {t for t, x in zip(new, words, strict=True) if len(x) != 1}
        long = {t: v for t, v in fresh.items() if len(t) > 64}  # these seldom come back
        known.update(fresh)
        several |= many
        for tokens, spaced in split:
            lists = tokens & several
            found = [known[t] for t in tokens - lists] if lists else list(map(known.__getitem__, tokens))
            yield [*found, *chain.from_iterable(map(known.__getitem__, lists)), *islice(values, len(spaced))]
        for t in long:
            del known[t]
        several -= long.keys()


def labelled_sample(labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, toxic) of about `bound` labelled rows at most that aren't held out, chosen by a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    return known if n <= bound else known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, bound: int = 40_000) -> DataFrame:
    """Adds held_out, score and predicted to documents (doc_id, text, ...).

    Labels (doc_id, toxic) teach only where crc32(doc_id as text) mod 5 is not 0, from a sample of about `bound` rows
    at most (the documented bound; it is broadcast). Character counts and scores cover all documents in full. Null and
    empty texts have no words and get the score of a text without evidence. Without labels of both kinds every score
    is 0. A null doc_id isn't held out. Rows that repeat a doc_id are scored each by their own text; of those that repeat
    a labelled one, all count for the weights and the least evident one for the curve, so that the curve is fitted on
    `bound` rows at most. A text of any length is scored whole, a word of it too. No documents give no rows. Columns
    held_out, score and predicted are replaced; all others stay, whatever their names.
    """
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    chars = spark.sparkContext.broadcast(fit_characters(docs))
    sample = scratch.save(labelled_sample(labels, bound), "sample")
    n_all, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def fill(batches):
        table, known, restorer = np.zeros(2 * FEATURES, np.int64), {}, Restorer(chars.value)
        for b in batches:
            for words, toxic in zip(_restored(b.column(0).to_pylist(), restorer, known, list), b.column(1).to_pylist(), strict=True):
                table[_distinct(words) + toxic * FEATURES] += 1
        return table

    taught = base.join(F.broadcast(sample), "doc_id")
    counts = summed(taught.select("text", "toxic"), fill, 2 * FEATURES).reshape(2, FEATURES).astype(np.float64)
    rate = min(max(n_toxic / max(n_all, 1), 1e-3), 1 - 1e-3)
    p = (counts[1] + 10 * rate) / (counts.sum(axis=0) + 10)
    weights = spark.sparkContext.broadcast((np.log(p / (1 - p)) - math.log(rate / (1 - rate))).astype(np.float32))

    @F.pandas_udf("array<double>")
    def evidence(text):
        import pandas as pd

        restorer, known = state.setdefault("r", Restorer(chars.value)), state.setdefault("k", {})
        rows = []
        for values in _restored(text.tolist(), restorer, known, lambda words: _heaviest(words, weights.value)):
            top = nlargest(3, values)
            rows.append(top + [0.0] * (3 - len(top)))
        return pd.Series(rows)

    state: dict = {}
    seen = taught.select("doc_id", F.struct(evidence("text").alias("e"), "toxic").alias("s")).groupBy("doc_id").agg(F.min("s").alias("s"))
    rows = seen.select("s.e", "s.toxic").collect() if 0 < n_toxic < n_all else []  # of the sample
    coef = _fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) if rows else None
    other, own = others(docs, "held_out", "score", "predicted"), spare(docs, "_e")
    out = docs.select(*map(column, other), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), evidence("text").alias(own))
    score = F.lit(0.0)
    if coef is not None:
        top = [F.least(F.col(own)[i], F.lit(8.0)) for i in range(3)]
        score = 1 / (1 + F.exp(-sum((F.lit(float(c)) * x for c, x in zip(coef[1:], [*top, *(x * x for x in top)], strict=True)), F.lit(float(coef[0])))))
    return out.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(own)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), np.minimum(x, 8.0), np.minimum(x, 8.0) ** 2])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(spark, docs, read_table(spark, sf_dir, "labels")).drop("text")
