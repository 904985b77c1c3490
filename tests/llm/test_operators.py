"""Each operator against a brute-force version, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from quarry.llm.common import Scratch, components
from quarry.llm.decontaminate import contaminated, least_distance, masks
from quarry.llm.embedding_dedup import near_vectors
from quarry.llm.html_text import MARK, extract, own_labels, parse, template_pages, train
from quarry.llm.katz import katz_scores
from quarry.llm.line_dedup import drop_repeated_lines
from quarry.llm.ngram_join import jaccard_components
from quarry.llm.pieces import Lattices, decode, encode_sampled
from quarry.llm.pii import pseudonymise
from quarry.llm.token_files import TokenFile, read_token_files, write_token_files
from quarry.llm.toxicity import Restorer, fit_characters, score_toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, key string, kept string, ids string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(60)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(n)]
    for i in range(0, n, 4):  # near copies
        w = texts[i].split(" ")
        if len(w) > 25:
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0], None, "", " \t\n ", "One", "one TWO", "x" * 30_000, "A B\nc\n" * 3000]
    return list(enumerate(texts)) + [(None, "a null id"), (5, texts[5])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "k", "kept", "ids") for i, t in rows], SCHEMA)


def union_find(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    want = union_find(400, edges)
    got = {x.id: x.component for x in components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize(("k", "num", "small"), [(3, 90, 32), (5, 80, 2)])
def test_jaccard(spark, k, num, small):
    rows = [(i, t) for i, t in corpus() if i is not None]
    rows.pop()  # the repeated row is tested below
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = union_find(len(rows), edges)
    got = jaccard_components(spark, frame(spark, rows), k, num, 100, frequent=2, small=small, block=8).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, len(sets[i]), want[i]) for i in range(len(rows))]


def test_jaccard_odd_rows(spark):
    got = jaccard_components(spark, frame(spark, [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None)]), 3, 90, 100).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 1, None), (2, 0, 2), (4, 1, 4), (4, 1, 4)]
    assert jaccard_components(spark, frame(spark, []), 3, 90, 100).count() == 0


def test_lines(spark):
    long = "This line stands in many documents, more or less 😀"
    rows = [(i, f"  {long.upper() if i % 2 else long}\t\nown line {i} of the document, which is long enough to count\nx") for i in range(7)]
    rows += [(20, f"{long}\n{long}"), (21, None), (22, ""), (None, long), (3, "again")]
    got = {(r.doc_id, r.text): r for r in drop_repeated_lines(spark, frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows[:7]:
        assert (got[i, t].n_lines, got[i, t].n_dropped, got[i, t].kept) == (3, 1, "\n".join(t.split("\n")[1:]))
    assert (got[20, rows[7][1]].n_dropped, got[21, None].n_lines, got[22, ""].kept, got[None, long].n_dropped) == (0, 1, "", 0)
    assert got[3, "again"].n == 7
    assert drop_repeated_lines(spark, frame(spark, [])).count() == 0


def test_edit_distance():
    r = random.Random(2)
    for _ in range(100):
        p, t = ("".join(r.choice("ab ") for _ in range(r.randint(1, n))) for n in (20, 60))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert least_distance(masks(p), len(p), t)[0] == min(row)


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog and then it sleeps in the sun for a whole day."
    near = item.replace("quick", "quack").replace("whole ", "whle ")
    far = item[:30] + "something else entirely is written in this place"
    rows = [(1, f"before {item.upper()}\nafter"), (2, "x " + near.replace(" ", "\n ")), (3, far), (4, None), (5, ""), (None, item), (2, item)]
    b = spark.createDataFrame([(7, item), (8, None), (9, " "), (None, item), (7, item)], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.edits) for r in contaminated(spark, frame(spark, rows), b).collect())
    assert got == sorted([(1, 7, 0), (2, 7, 2), (-1, 7, 0), (2, 7, 0)] * 2)
    assert contaminated(spark, frame(spark, rows), b.where("false")).count() == 0
    assert contaminated(spark, frame(spark, []), b).count() == 0


def test_token_files(spark):
    rows, path = [(i, t) for i, t in corpus() if i != 5] + [(900, "It's a <|endoftext|> d'été ΣΑΣ É, 12-3 …")], public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer, scratch = Tokenizer.from_file(path), Scratch(spark, "files")
    manifest = scratch.save(write_token_files(spark, frame(spark, rows), path, scratch.path("files"), rows=16), "manifest")
    got = sorted((r.doc_id, r.start, bytes(r.ids)) for r in read_token_files(manifest).collect())
    start = 0
    for (i, t), (j, s, raw) in zip(sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]), got, strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (i, start, ids.tobytes()) == (j, s, raw)
        start += len(ids)
    first = manifest.orderBy("part").first().file
    file = TokenFile(first)
    assert file.find(int(file.ids[3])) == [file.document(3)]
    assert file.find(-5) == []


def test_pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [*corpus(), (70, "two  spaces ▁ and\t日本語 😀 \r\n"), (71, "the the the")]
    out = decode(encode_sampled(spark, frame(spark, rows), path), path).collect()
    assert all(r.decoded == (r.text or "") and r.n == 7 for r in out)
    again = encode_sampled(spark, frame(spark, rows[::-1]).repartition(3), path).collect()
    assert {(r.doc_id, r.text): bytes(r.ids) for r in out} == {(r.doc_id, r.text): bytes(r.ids) for r in again}
    assert encode_sampled(spark, frame(spark, []), path).count() == 0


def test_sampled_shares():
    """Segmentations come up as often as the product of their pieces' weights says."""
    lattices = Lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    weight = dict(zip(lattices.ids.tolist(), np.exp(lattices.weights), strict=True))
    pieces = {model.id_to_piece(i): i for i in weight}

    def ways(s):
        if not s:
            return [()]
        return [(pieces[s[:n]], *rest) for n in range(1, len(s) + 1) if s[:n] in pieces for rest in ways(s[n:])]

    want = {w: math.prod(weight[i] for i in w) for w in ways("there")}
    total, n, seen = sum(want.values()), 20_000, {}
    for ids in lattices.sample(list(range(n)), ["there"] * n, 1):
        seen[tuple(ids.tolist())] = seen.get(tuple(ids.tolist()), 0) + 1
    assert set(seen) <= set(want)
    for w, x in want.items():
        assert abs(seen.get(w, 0) / n - x / total) < 0.02


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    v = [*(base + 0.05 * r.standard_normal((40, 16))), *(base + 0.05 * r.standard_normal((40, 16))), *([base[0]] * 5)]
    rows = [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v)]
    odd = [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None, 1.0]), (205, [1.0, 2.0])]
    x = np.array([y for _, y in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = union_find(len(x), [tuple(e) for e in np.argwhere(near)])
    for block in (512, 3):
        got = near_vectors(spark, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), block=block, fill=8).collect()
        assert sorted((g.vec_id, g.n_links, g.component_id, g.kept) for g in got) == [(i, int(near[i].sum()), want[i], want[i] == i) for i in range(len(x))] + [(i, 0, i, True) for i, _ in odd]
    assert near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_html(spark):
    known = template_pages(120, 1)
    model = train([parse(x, MARK) for x in known])
    wrong = total = 0
    for x in template_pages(60, 2):
        page = parse(x, MARK)
        labels = [None]
        for b in page.blocks[1:]:
            labels.append(b.label if b.label is not None else labels[b.parent])
        p = model.marginals(page)
        wrong, total = wrong + sum((p[b] >= 0.5) != (labels[b] == 1) for b, _ in page.runs), total + len(page.runs)
    assert wrong <= 0.01 * total
    page = parse("<article><p>x</p></article>")
    assert own_labels(page)
    rows = [(1, "<html><body><nav><a href=/>home</a></nav><article><h1>A &amp;&nbsp;B</h1><p>One  <b>two</b><br>three.<p>Four &lt;5</article><script>no</script><footer>&copy; us</footer>", "t"), (2, None, "t"), (3, "", "t"), (4, "<div", "t")]
    got = {r.page_id: r.text for r in extract(spark, spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    assert got[1] == "A & B\n\nOne two three.\n\nFour <5"
    assert (got[2], got[3], got[4]) == ("", "", "")


def test_marginals_are_exact():
    """Sum-product gives what summing over all labellings gives."""
    import itertools

    model = train([parse(x, MARK) for x in template_pages(30, 4)])
    page = parse("<div><p>One two three.</p><ul><li><a href=/>x</a></li></ul></div>")
    alone = []
    for b in page.blocks:
        from quarry.llm.html_text import _features

        p = 1 / (1 + math.exp(-max(-12, min(12, sum(model.weights[i] for i in _features(b))))))
        alone.append((1 - p, p))
    n, total, on = len(page.blocks), 0.0, [0.0] * len(page.blocks)
    for s in itertools.product((0, 1), repeat=n):
        w = math.prod(alone[i][s[i]] for i in range(n)) * math.prod(model.pair[s[page.blocks[i].parent]][s[i]] for i in range(1, n))
        total += w
        for i in range(n):
            on[i] += w * s[i]
    assert np.allclose(model.marginals(page), np.array(on) / total)


def test_pii(spark):
    rows = [(1, "call +1 (555) 123-4567, born 1984-02-29 or 13/05/1990"), (2, "555-123-4567 4111111111111111 4111-1111-1111-1111 4111111111111112 192.168.1.10 300.1.1.1"), (3, "Bob.S42@mail.example.com bob.s42@mail.example.com DE89 3704 0044 0532 0130 00 123-45-6789 1999-13-45"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonymise(df, "k").collect()}
    assert got[4].text is None and got[5].text == "" and got[4].pii_kinds == []
    phone = re.search(r"\((\d{3})\) (\d{3})-(\d{4})", got[1].text)
    assert "-".join(phone.groups()) == got[2].text.split(" ")[0] != "555-123-4567"
    card, dashed = got[2].text.split(" ")[1:3]
    assert card == dashed.replace("-", "") and card != "4111111111111111"
    luhn = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(card)))
    assert luhn % 10 == 0
    assert "4111111111111112" in got[2].text and "300.1.1.1" in got[2].text and "192.168.1.10" not in got[2].text
    a, b = got[3].text.split(" ")[:2]
    assert a.lower() == b and a != "Bob.S42@mail.example.com" and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z]\d\d@mail\.example\.com", a)
    iban = re.search(r"DE[\d ]{20,25}", got[3].text)[0].replace(" ", "")[:22]
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1 and "1999-13-45" in got[3].text
    assert re.search(r"born \d{4}-\d\d-\d\d or \d\d/\d\d/\d{4}", got[1].text)
    assert pseudonymise(df, "other").where("doc_id = 2").first().text != got[2].text


def test_pii_is_a_permutation(spark):
    df = spark.range(0, 4000).selectExpr("concat('10.0.', id div 256, '.', id % 256) as text")
    assert pseudonymise(df, "k").distinct().count() == 4000
    days = spark.range(0, 3000).selectExpr("date_format(date_add(date'1990-01-01', cast(id as int)), 'dd/MM/yyyy') as text")
    out = pseudonymise(days, "k").select("text").distinct().collect()
    assert len(out) == 3000


def test_toxicity(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice(["an", "be", "co", "du", "el", "fi"]) for _ in range(r.randint(1, 4))) for _ in range(200)]
    bad = ["idiot", "stupid", "moron"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(vocabulary) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    odd = [(1000, None), (1001, ""), (1002, "an 1d10t be"), (1003, "an s t u p i d be"), (1004, "an mooooron be"), (None, "an be")]
    lf = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(spark, frame(spark, rows + odd), lf).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004, None)] == [0, 0, 1, 1, 1, 0]
    restorer = Restorer(fit_characters(frame(spark, rows)))
    assert restorer.words("1d10t!") == ["idiot"] and restorer.letters("m o r o n") == "moron"
    assert {r.predicted for r in score_toxicity(spark, frame(spark, rows[:9]), lf.where("false")).collect()} == {0}
    assert score_toxicity(spark, frame(spark, []), lf).count() == 0


@pytest.mark.parametrize(("letters", "bad", "before"), [([chr(0x4E00 + i) for i in range(300)], "鼻龍龜鼠", 150), ("абвгдежзиклмнопрстуя", "дура", 3)])
def test_toxicity_scores_grams_of_characters_in_whole_words(spark, letters, bad, before):
    """An evil stem glued into a run, also far behind its 64th character, counts."""
    r = random.Random(6)
    some = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows = []
    for i in range(500):
        w = [some(before + 4 + 3) for _ in range(1 if before > 64 else 30)]
        w[0] = some(before) + (bad if i % 3 == 0 else some(4)) + some(3)
        rows.append((i, " ".join(w)))
    lf = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = [x for x in score_toxicity(spark, frame(spark, rows), lf).collect() if x.held_out]
    assert len(got) > 60 and sum(x.predicted == (x.doc_id % 3 == 0) for x in got) >= 0.95 * len(got)


def test_restoration_is_exact():
    """Against a plain search over whole texts' costs, on lattices longer and wider than any beam."""

    class Priced(Restorer):
        def _cost(self, a, b, c, d):
            """Pays off three characters later."""
            return (0.0 if a == ord("f") else 3.0) + zlib.crc32(repr((a, b, c, d)).encode()) % 1000 / 1000

    def price(model, text):
        total, x = 0.0, (2, 2, 2)
        for ch in text:
            total += model._cost(*x, 3 if ch == " " else ord(ch))
            x = (2, 2, 2) if ch == " " else (*x[1:], ord(ch))
        return total + model._cost(*x, 3)

    def cheapest(model, lattice):
        best = {(2, 2, 2): 0.0}
        for place in lattice:
            new = {}
            for x, cost in best.items():
                for chars, own in place:
                    y, total = x, cost + own
                    for ch in chars:
                        total += model._cost(*y, 3 if ch == " " else ord(ch))
                        y = (2, 2, 2) if ch == " " else (*y[1:], ord(ch))
                    new[y] = min(new.get(y, math.inf), total)
            best = new
        return min(cost + model._cost(*x, 3) for x, cost in best.items())

    model = Priced(np.zeros(1 << 20, np.int64))
    for n in (20, 65, 150):
        own = {x: 2.4 if x == "f" else 0.0 for x in ("abcdef" if n == 20 else "abf")}
        lattice = [[*own.items()] + ([(" " + x, c + 1.0) for x, c in own.items()] if i else []) for i in range(n)]
        got = model.decode(lattice)
        assert len(got.replace(" ", "")) == n and math.isclose(price(model, got) + got.count(" ") + sum(own.get(x, 0.0) for x in got), cheapest(model, lattice))


def test_katz(spark):
    rows = [(i, (t or "")[:4000]) for i, t in corpus(n=120)]
    got = sorted(katz_scores(spark, frame(spark, rows), per_part=500).collect(), key=lambda r: (r.doc_id or -1, r.n_tokens))
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    docs = [[*words(t), "\n"] for _, t in rows]
    from collections import Counter

    from quarry.llm.katz import K, LEFT, discounts

    c1, c2 = Counter(), Counter()
    for h, w in zip(held, docs, strict=True):
        if not h:
            c1.update(w)
            c2.update(zip(["", *w[:-1]], w))
    n = sum(c1.values())
    counts = lambda c: [sum(x == i for x in c.values()) for i in range(1, K + 2)]
    d1, d2 = discounts(counts(c1)), discounts(counts(c2))
    take = lambda d, r: r * (d[r - 1] if r <= K else 1 - LEFT)
    unknown = 1 - sum(take(d1, c) for c in c1.values()) / n
    one = lambda w: take(d1, c1[w]) / n if c1[w] else unknown
    total, left, cover = Counter(), Counter(), Counter()
    for (h, w), r in c2.items():
        total[h] += r
        left[h] += r - take(d2, r)
        cover[h] += one(w)
    two = lambda h, w: take(d2, c2[h, w]) / total[h] if (h, w) in c2 else (left[h] / total[h] / (1 - cover[h]) if h in total else 1) * one(w)
    for h in list(total)[:20]:
        assert abs(sum(two(h, w) for w in [*c1, "never seen"]) - 1) < 1e-9
    want = []
    for (i, _), h, w in zip(rows, held, docs, strict=True):
        base = sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (len(c1) + 1))) for x in w)
        want.append((i or (-1 if i is None else 0), h, len(w), sum(c1[x] > 0 for x in w), n, base, sum(math.log10(two(a, b)) for a, b in zip(["", *w[:-1]], w))))
    want.sort(key=lambda x: (x[0], x[2]))
    for r, w in zip(got, want, strict=True):
        assert (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert abs(r.base_score - w[5]) < 1e-6 and abs(r.score - w[6]) < 1e-6
    assert katz_scores(spark, frame(spark, [])).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    from quarry.llm import stages

    r = random.Random(9)
    vocabulary = ["".join(r.choice(["an", "be", "co", "du"]) for _ in range(r.randint(2, 4))) for _ in range(150)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item = "Which of these passages does the benchmark hold, and which of them are new to it?"
    docs = [(i, text(60)) for i in range(40)]
    labels = []
    for i in range(100, 400):
        toxic = i % 4 == 0
        docs.append((i, text(40) + (" idiot moron idiot" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    copy = docs[3][1].split(" ")
    copy[30] = "changed"
    docs += [(900, " ".join(copy)), (901, text(20) + " " + item), (902, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stages.run(spark, str(tmp_path)).collect()
    want = {i for i, _ in docs if not (100 <= i < 400 and i % 4 == 0)} - {900, 901}
    assert {r.doc_id for r in got} == want and all(r.lossless for r in got)


def test_katz_deals_a_hot_bigram_out(spark):
    """A bigram of nearly all documents is in many partitions, and scores don't depend on that."""
    from quarry.llm.katz import _KINDS, ENTRIES, _deal, _pair, _unpack, tokens

    df = spark.createDataFrame([(i, "of the " * 40 + f"w{i}") for i in range(400)], "doc_id long, text string").repartition(4)
    t, h, _ = tokens(["of the of the"])
    keys = np.unique(_pair(t[1:4], h[1:4]))
    deal = _deal(16, np.unique(t[:2]), keys, limit=4000)
    size = {}
    for r in df.mapInArrow(deal, _KINDS).where(f"kind = {ENTRIES}").collect():
        size[r.part] = size.get(r.part, 0) + len(_unpack(r.data)[4])
    assert max(size.values()) < 0.4 * sum(size.values())
    spread, alone = (sorted(katz_scores(spark, df, per_part=n).collect()) for n in (500, 1 << 40))
    assert [r[:5] for r in spread] == [r[:5] for r in alone]
    assert np.allclose([r[5:] for r in spread], [r[5:] for r in alone])


@pytest.mark.parametrize("before", [
    "<body><select><option>A<option>B</select>", "<body><select><optgroup><option>A<optgroup><option>B</select>", "<head><title>x</title><meta charset=a>", "<head><title>x</title></head>", "<body><svg/>", '<body><svg width="1" />',
    "<body><svg><path d=x><g></svg>", "<body><div><label>A</div>", "<body><datalist><option>A</datalist>", "<body><button>A<button>B</button>", "<body><button><svg></button>", "<body><select><option>A<input>", "<body></svg></option>",
])
def test_html_skips_only_what_is_not_shown(before):
    assert [t for _, t in parse(f"{before}<p>Shown text.</p><p>More.</p>").runs] == ["Shown text.", "More."]


def test_html_takes_all_class_words():
    page = parse(f'<div class="{" ".join("abcdefghijklmn")} advert">x</div><p>y <svg>no</svg> z <select><option>no</select>')
    assert page.blocks[1].words[-1] == "advert" and [t for _, t in page.runs] == ["x", "y z"]


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    from quarry.llm import stages

    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    item, copied = text(30), text(60)
    rows = [(1, copied), (1, copied), (2, copied), (3, text(60)), (3, f"{text(20)} {item} {text(20)}"), (None, f"{text(20)} {item}"), (None, text(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = lambda stage: sorted(((x.doc_id, x.text) for x in stage(spark, docs, str(tmp_path)).collect()), key=repr)
    assert found(stages.near_duplicates) == sorted([rows[0], *rows[3:]], key=repr)
    assert found(stages.decontamination) == sorted([*rows[:4], rows[6]], key=repr)
