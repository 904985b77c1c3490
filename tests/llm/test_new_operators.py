"""Vector codes, lexical search and language identification against plain versions of the whole job."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm.common import Scratch
from quarry.llm.language import BUCKETS, Model, Namer, name_languages, op13_language, subwords, words_of
from quarry.llm.lexical import _terms, op12_lexical_search, ranked
from quarry.llm.vector_codes import Trees, assign, compress, decoded, label_sums, op11_vector_codes


def save(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


# --- vector codes --------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(code, error) of each usable (vec_id, vector), and all final entries."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for step in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(book[p])) for p in range(parts)] for c in cut]
        if step < rounds:
            for p in range(parts):
                for j in range(len(book[p])):
                    own = [c[p] for c, n in zip(cut, near) if n[p][1] == j]
                    if own:
                        book[p][j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, "".join(f"{n[1]:02x}" for n in x), sum(n[0] for n in x)) for (i, _), x in zip(kept, near)], book


@pytest.mark.parametrize(("n", "k", "spread", "leaf"), [(700, 64, 30, 16), (700, 64, 2, 8), (50, 50, 3, 16), (9, 5, 1, 2), (1, 1, 4, 2), (300, 37, 0, 16)])
def test_trees_assign_as_all_pairs_do(n, k, spread, leaf):
    r = np.random.default_rng(n + k)
    points = r.integers(-spread, spread + 1, (3, n, 4))
    book = points[:, r.permutation(n)[:k]]
    tree = Trees.load(Trees.build(points, max(0, int(math.log2(n / leaf))) if n > leaf else 0).dump())
    codes, sums, counts = assign(tree, book)
    want = ((points[:, :, None] - book[:, None]) ** 2).sum(axis=3).argmin(axis=2)
    for p in range(3):
        assert (codes[p] == want[p, tree.order[p]]).all()
        for j in range(k):
            assert counts[p, j] == (want[p] == j).sum() and (sums[p, j] == points[p, want[p] == j].sum(axis=0)).all()


def test_op11_against_a_plain_version(spark, tmp_path):
    r = random.Random(3)
    base = [[r.uniform(-1, 1) for _ in range(32)] for _ in range(20)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(base)], r.choice([1, 1, 2, None])) for i in range(150)]
    rows += [(1000 + i, list(base[0]), 9) for i in range(60)]  # copies
    rows += [(-1, None, 1), (-2, [0.5, None] * 16, 1), (-3, [float("nan")] + [0.1] * 31, 1), (-4, [float("inf")] + [0.1] * 31, 1), (-5, [], 1), (-6, [1e30] * 32, 1), (-7, [0.5] * 7, 1), (2000, [0.1] * 48, 1)]
    save(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tmp_path, "embeddings")
    good = [(i, v) for i, v, _ in rows if 0 <= i < 2000]
    want, book = plain_codes(good)
    labels = {i: x for i, _, x in rows}
    sums = {}
    for i, _, e in want:
        sums[labels[i]] = sums.get(labels[i], 0) + e
    digest = hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()
    got = {(x.vec_id, x.code, x.error, x.label_error, x.codebooks_sha256) for x in op11_vector_codes(spark, str(tmp_path)).collect()}
    assert got == {(i, c, e, sums[labels[i]], digest) for i, c, e in want}


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string, tree int, code string, e int"
    empty, book = compress(spark, spark.createDataFrame([], schema), Scratch(spark, "t"))
    assert empty.columns == ["vec_id", "label", "code", "error"] and empty.count() == 0 and book.size == 0
    rows = [(None, [0.25] * 16, "a", 1, "x", 2), (3, [0.5] * 16, None, 1, "x", 2), (3, [0.125] * 16, None, 1, "x", 2), (7, [-0.001] * 16, "b", 1, "x", 2)]
    scratch = Scratch(spark, "t")
    codes, book = compress(spark, spark.createDataFrame(rows, schema), scratch)
    codes = scratch.save(codes, "codes")
    assert book[0, :, 0].tolist() == [32, 128, -1, 64]  # repeated ids by their components, a null id last
    assert sorted((x.vec_id is None, x.code[:2], x.error) for x in codes.collect()) == [(False, "00", 0), (False, "01", 0), (False, "02", 0), (True, "03", 0)]
    assert {x.vector[0] for x in decoded(codes, book).collect()} == {32.5 / 256, 128.5 / 256, -0.5 / 256, 64.5 / 256}
    assert sorted(str(x.label) for x in label_sums(codes, scratch).collect()) == ["None", "None", "a", "b"]


def test_labels_that_many_rows_share_are_summed_apart(spark):
    scratch = Scratch(spark, "t")
    codes = scratch.save(spark.range(3000).selectExpr("id as vec_id", "case when id % 2 = 0 then null else cast(id as int) end as label", "id as error"), "codes")
    got = {(x.vec_id, x.label_error) for x in label_sums(codes, scratch).collect()}
    assert got == {(i, sum(range(0, 3000, 2)) if i % 2 == 0 else i) for i in range(3000)}


# --- lexical search --------------------------------------------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    split = [(i, plain_terms(t)) for i, t in docs]
    split = [(i, t) for i, t in split if t]
    n, total = len(split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(plain_terms(t))
    out = set()
    for item, terms in queries.items():
        hits = []
        for row, (i, t) in enumerate(split):
            m = 50 + (50 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * t.count(w)) // (1000 * t.count(w) + 20 * m)) for w in terms if w in t)
            if s > 0:
                hits.append((-s, i is None, i or 0, row))
        out |= {(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(hits)[:k])}
    return out


@pytest.mark.parametrize(("k", "count", "terms"), [(50, 1000, 200_000), (3, 4, 200_000), (1, 1000, 5)])
def test_search_against_a_plain_version(spark, k, count, terms):
    r = random.Random(k)
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "漢字", "x_y", "a-b", "9", "É", "A B"]
    text = lambda n: " ".join(words[min(int(r.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i, text(r.randint(0, 40))) for i in range(300)] + [(300 + i, "same text W1 w2") for i in range(120)]
    docs += [(5, text(9)), (5, text(9)), (None, "w1 w59"), (999, None), (998, " \n"), (997, "w0 " * 3000 + "w3")]
    items = [(i, text(r.randint(1, 30))) for i in range(12)] + [(3, "w9 w1"), (None, "w7"), (None, "w8"), (50, None), (51, ""), (52, "nowhere"), (53, "SAME")]
    got = [tuple(x) for x in ranked(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k, count, terms).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_search(docs, items, k) and len(got) > 10


def test_search_stops_early_with_the_same_hits(spark, monkeypatch, tmp_path):
    from quarry.llm import lexical

    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["a", "b", "c", "rare" if i < 60 else "d", "e"]) for _ in range(12))) for i in range(2000)]
    save(spark.createDataFrame(docs, "doc_id long, text string"), tmp_path, "documents")
    save(spark.createDataFrame([(1, "rare a b"), (2, "c d")], "item_id long, text string"), tmp_path, "benchmark")
    assert {tuple(x) for x in op12_lexical_search(spark, str(tmp_path)).collect()} == plain_search(docs, [(1, "rare a b"), (2, "c d")], 50)
    seen, old = [], lexical.Searcher._evaluate
    monkeypatch.setattr(lexical.Searcher, "_evaluate", lambda self, i, d, *rest: (seen.append(len(d)), old(self, i, d, *rest)))
    n, total = len(docs), 12 * len(docs)
    names = {"a": 0, "rare": 1}
    rows = [(i, 12, np.array([v for t, v in names.items() if t in x.split()], np.int32).tobytes(), np.array([x.split().count(t) for t in names if t in x.split()], np.int64).tobytes()) for i, x in docs]
    s = lexical.Searcher([[0, 1]], np.array([100, 5000]), n, total, 20)
    s.block(rows)
    assert sum(seen) < 200 and len(s.best[0]) == 20


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a", 3)], "doc_id long, text string, score long")
    assert ranked(spark, docs, items).count() == 0 and ranked(spark, some, items.limit(0)).count() == 0
    assert ranked(spark, some, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_long_texts_are_whole():
    text = ("word " * 300_000 + "z" * 2_000_000 + ".Last").encode()
    got = [t for some in _terms(text) for t in some]
    assert len(got) == 300_002 and got[-2:] == [b"z" * 2_000_000, b"last"]


# --- language identification -----------------------------------------------------------------------------------------


def test_subwords_are_those_of_each_word():
    def one(chars):
        h = len(chars) * 0x9E3779B97F4A7C15
        for c, k in zip(chars, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
            h += ord(c) * k
        h &= (1 << 64) - 1
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & ((1 << 64) - 1)
        return (h ^ h >> 31) >> 48

    words = ["haus", "a", "漢字", "é"]
    buckets, of = subwords(words)
    for i, w in enumerate(words):
        marked = f"<{w}>"
        want = [one(marked[j : j + n]) for n in (1, 2, 3, 4) for j in range(len(marked) - n + 1) if n > 1 or 0 < j < len(marked) - 1]
        assert sorted(buckets[of == i].tolist()) == sorted(want)
    assert len(subwords([])[0]) == 0


def test_words():
    assert words_of("The THE x2y  a_b ½ 12 'é'") == {"the": 2, "x": 1, "y": 1, "a": 1, "b": 1, "é": 1}
    assert words_of(None) == {} and len(words_of("ab " * 700_000)) == 1 and words_of("ab " * 700_000)["ab"] == 700_000


def test_namer_sums_as_a_plain_loop():
    r = np.random.default_rng(2)
    model = Model(["x", "y", "z"], r.normal(size=(BUCKETS, 3)), np.zeros(3))
    texts = ["eins zwei zwei", "", "a" * 300_000 + " b", "zwei drei"] * 2
    namer = Namer(model)
    for got, text in zip(namer.sums([words_of(t) for t in texts]), texts):
        total, n = np.zeros(3), 0
        for w, c in words_of(text).items():
            buckets, _ = subwords([w])
            total, n = total + c * model.table[buckets].sum(axis=0), n + c * len(buckets)
        assert np.allclose(got[:3], total) and got[3] == n
    assert "zwei" in namer.known and all(len(w) <= 64 for w in namer.known)


def _prose(r, lang, n):
    vowels = {"aa": "aeu", "bb": "io", "cc": "yöä"}[lang]
    return " ".join("".join(r.choice("bdgklmnprst") + r.choice(vowels) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_op13_names_held_out_texts(spark, tmp_path):
    r = random.Random(8)
    docs = [(i, _prose(r, lang, r.randint(1, 60)), lang) for i, lang in enumerate(r.choices(["aa", "bb", "cc"], k=600))]
    odd = [(10_001, None, "aa"), (10_002, "", None), (10_003, "12 ½ !", "bb"), (10_004, "привет как дела", None), (None, docs[0][1], None), (docs[0][0], docs[0][1], "aa"), (10_005, "GO TI LI NO " * 90_000, None)]
    save(spark.createDataFrame(docs + odd, "doc_id long, text string, lang string"), tmp_path, "documents")
    rows = op13_language(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + len(odd)
    got, want = {x.doc_id: x for x in rows}, {i: lang for i, _, lang in docs}
    held = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and all(got[i].held_out for i in held) and sum(got[i].held_out for i in want) == len(held)
    assert sum(got[i].lang_pred == want[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= x.score <= 1 for x in rows)
    for i in (10_001, 10_002, 10_003):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[10_004].lang_pred != "und" and got[10_004].rejected and got[10_004].score < 0.6
    assert got[10_005].lang_pred == "bb" and not got[None].held_out and got[None].lang_pred == got[docs[0][0]].lang_pred


def test_held_out_labels_teach_nothing(spark):
    r = random.Random(4)
    docs = [(i, _prose(r, lang, 20), lang) for i, lang in enumerate(r.choices(["aa", "bb"], k=200))]
    false = [(i, t, "bb" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in docs]
    out = [sorted((x.doc_id, x.lang_pred, x.score) for x in name_languages(spark, spark.createDataFrame(d, "doc_id long, text string, lang string")).collect()) for d in (docs, false)]
    assert out[0] == out[1]


def test_languages_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, score string, `a.b` int, `_n.n` int"
    out = name_languages(spark, spark.createDataFrame([(1, "no labels", None, "s", 1, 2)], schema))
    x = out.first()
    assert (x.lang_pred, x.score, x.rejected, x["a.b"]) == ("und", 0.0, True, 1) and out.columns.count("score") == 1
    assert name_languages(spark, spark.createDataFrame([], schema)).count() == 0
    one = name_languages(spark, spark.createDataFrame([(1, "only one", "qq", "s", 1, 2)], schema)).first()
    assert (one.lang_pred, one.score) == ("qq", 1.0)
