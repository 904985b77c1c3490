"""Queries that SQL can't express, against plain versions of the whole job on small tables."""

import datetime
import html.parser
import math
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import stages
from quarry.llm.decontaminate import normal, op2_decontamination
from quarry.llm.embedding_dedup import near_vectors
from quarry.llm.html_text import MARK, op5_html_text, template_pages
from quarry.llm.pii import op7_pii, pseudonymise
from quarry.llm.toxicity import FEATURES, _features, _fit, _SPACED, Restorer, fit_characters, op8_toxicity


def save(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def least_edits(item: str, text: str) -> int:
    """Sellers' dynamic programme over the whole text."""
    row = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for i, a in enumerate(item, 1):
        new = np.minimum(row + 1, np.append(i, row[:-1] + (t != ord(a))))
        steps = np.arange(len(new))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_op2_against_all_pairs(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(r.randint(1, 20)) for _ in range(40)] + ["ab", "x y", "é" * 30]
    docs = []
    for i in range(120):
        passage = list(r.choice(items))
        for _ in range(r.randint(0, max(1, len(passage) // 9))):
            passage[r.randrange(len(passage))] = r.choice(["", "q", "a", " "])
        docs.append((i, prose(r.randint(0, 60)) + r.choice([" ", "\n", "  ", ""]) + "".join(passage).upper() + " " + prose(r.randint(0, 9))))
    docs += [(500, prose(30_000) + " " + items[0]), (501, None), (502, " \n")]
    save(spark.createDataFrame(docs, "doc_id long, text string"), tmp_path, "documents")
    save(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), tmp_path, "benchmark")
    want = set()
    for i, t in docs:
        for j, x in enumerate(items):
            t2, x2 = normal(t), normal(x)
            if t2 and (e := least_edits(x2, t2)) <= math.floor(0.08 * len(x2)):
                want.add((i, j, e))
    assert {(x.doc_id, x.item_id, x.edits) for x in op2_decontamination(spark, str(tmp_path)).collect()} == want and len(want) > 150


def test_stage_decontamination_against_all_pairs(spark, tmp_path):
    r = random.Random(12)
    items = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(12)) for _ in range(5)]
    docs = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)) + (" " + items[i % 5] if i % 3 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    save(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), tmp_path, "benchmark")
    want = {i for i, t in docs if all(least_edits(normal(x), normal(t)) > math.floor(0.08 * len(normal(x))) for x in items)}
    assert {x.doc_id for x in stages.decontamination(spark, df, str(tmp_path)).collect()} == want == {i for i, _ in docs if i % 3}


class Marked(html.parser.HTMLParser):
    """Block texts that stand in marked content, by the standard library's parser; pages are well formed but for <p>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.now = [("#", None)], [], ""

    def flush(self):
        text = " ".join(self.now.split())
        if text and self.stack[-1][1] == 1:
            self.out.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            return
        if tag in ("img", "input", "br"):
            self.now += " "
            return
        self.flush()
        if self.stack[-1][0] == "p":
            self.stack.pop()
        mark = dict(attrs).get(MARK)
        self.stack.append((tag, int(mark) if mark else self.stack[-1][1]))

    def handle_endtag(self, tag):
        if tag == "a":
            return
        self.flush()
        while len(self.stack) > 1 and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        self.now += data


def test_op5_against_marked_pages(spark, tmp_path):
    rows, want = [], []
    for i, x in enumerate(template_pages(150, 77)):
        x = x.replace("<title>x</title>", "<title>x</title><script>if (a < b) '</p>'</script><style>p{}</style>")
        parser = Marked()
        parser.feed(x.replace("<script>if (a < b) '</p>'</script><style>p{}</style>", "").replace("<title>x</title>", ""))
        want.append("\n\n".join(parser.out))
        rows.append((i, f"http://x/{i}", re.sub(f' {MARK}="."', ' data-content="More info"' if i % 2 else "", x)))
    save(spark.createDataFrame(rows, "page_id long, url string, html string"), tmp_path, "pages")
    got = {x.page_id: x for x in op5_html_text(spark, str(tmp_path)).collect()}
    assert all(got[i].n_chars == len(got[i].text) for i in got)
    assert sum(got[i].text == want[i] for i in range(len(rows))) >= 0.97 * len(rows)


VALUES = {
    "card": lambda r: luhn("".join(r.choice("0123456789") for _ in range(15))), "ip": lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4)),
    "date": lambda r: (datetime.date(1, 1, 1) + datetime.timedelta(r.randrange(3_652_059))).isoformat(), "ssn": lambda r: f"{r.choice([*range(1, 666), *range(667, 900)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
    "phone": lambda r: f"({r.randint(200, 999)}) {r.randint(0, 999):03d}-{r.randint(0, 9999):04d}", "email": lambda r: f"{''.join(r.choice('abcxyz.09') for _ in range(r.randint(3, 90)))}q@mail.example.com",
    "secret": lambda r: f'token = "{"".join(r.choice("abcXYZ0189_-") for _ in range(r.randint(8, 400)))}"', "iban": lambda r: iban("DE", "".join(r.choice("0123456789") for _ in range(18))),
}


def luhn(body: str) -> str:
    total = sum(sum(divmod(2 * int(x), 10)) if i % 2 == 0 else int(x) for i, x in enumerate(reversed(body)))
    return body + str(-total % 10)


def iban(country: str, body: str) -> str:
    value = lambda s: int("".join(str(int(x, 36)) for x in s))
    return f"{country}{98 - value(body + country + '00') % 97:02d}{body}"


def valid(kind: str, s: str) -> bool:
    if kind == "card":
        return luhn(s[:-1]) == s
    if kind == "ip":
        return all(0 <= int(x) <= 255 and str(int(x)) == x for x in s.split("."))
    if kind == "date":
        return bool(datetime.date.fromisoformat(s))
    if kind == "ssn":
        a, b, c = map(int, s.split("-"))
        return 0 < a < 900 and a != 666 and b > 0 and c > 0
    if kind == "iban":
        return iban(s[:2], s[4:]) == s
    return True


def test_op7_replaces_every_valid_value_and_nothing_else(spark, tmp_path):
    """Values are planted between words; their pseudonyms must be valid, of one shape, linked, and different for different values."""
    r = random.Random(21)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    planted = {kind: sorted({make(r) for _ in range(60)}) for kind, make in VALUES.items()}
    rows, parts = [], []
    for i in range(160):
        own = [(k, r.choice(planted[k])) for k in r.choices([*VALUES], k=6)]
        words = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(7)]
        rows.append((i, words[0] + "".join(f" {v} {w}" for (_, v), w in zip(own, words[1:]))))
        parts.append((own, words))
    rows += [(900, "4111111111111112 300.1.1.1 1999-13-45 000-12-3456 DE00370400440532013000 a@b"), (901, None), (902, ""), (3, rows[3][1])]
    save(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "documents")
    out = op7_pii(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    got = {x.doc_id: x for x in out}
    assert got[900].text == rows[160][1] and got[900].n_found == 0 and got[901].text is None and got[902].text == ""
    names: dict[tuple[str, str], str] = {}
    for (own, words), i in zip(parts, range(160)):
        pattern = re.escape(words[0]) + "".join(f" (.+?) {re.escape(w)}" for w in words[1:])
        found = re.fullmatch(pattern, got[i].text, re.S)
        assert found and got[i].n_found == 6
        for (kind, value), new in zip(own, found.groups()):
            assert names.setdefault((kind, value), new) == new and (kind == "ip" or shape(new) == shape(value)) and valid(kind, new)
    for kind in VALUES:
        new = [b for (k, _), b in names.items() if k == kind]
        assert len(set(x.lower() for x in new)) == len(new) and sum(a != b for (k, a), b in names.items() if k == kind) >= len(new) - 1


def test_op7_permutes_dates_one_to_one(spark):
    """All days of four years, in the three ways of writing, and the ends of the calendar."""
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(i) for i in range(1461)]
    for written in (lambda d: d.isoformat(), lambda d: f"{d.day:02d}/{d.month:02d}/{d.year}", lambda d: f"{d.month}.{d.day}.{d.year}"):
        df = spark.createDataFrame([(i, written(d)) for i, d in enumerate(days)], "doc_id long, text string")
        got = [x.text for x in pseudonymise(df, "k").collect()]
        assert len(set(got)) == len(set(written(d) for d in days))
    ends = [f"{y}-{x}" for y in ("0001", "0002", "1799", "9998", "9999") for x in ("01-01", "12-31", "02-28")]
    got = [x.text for x in pseudonymise(spark.createDataFrame([(x,) for x in ends], "text string"), "k").collect()]
    assert len(set(got)) == len(ends) and all(datetime.date.fromisoformat(x) for x in got) and not set(got) & set(ends)


def test_op8_against_a_plain_version(spark, tmp_path):
    r = random.Random(31)
    vocabulary = ["".join(r.choice(["an", "be", "co", "du", "el", "fi"]) for _ in range(r.randint(1, 4))) for _ in range(80)]
    bad, docs, labels = ["idiot", "stup1d", "m o r o n", "mooooron"], [], []
    for i in range(150):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        if i % 4 == 0:
            w.insert(r.randint(0, len(w)), r.choice(bad))
        docs.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(i % 4 == 0)))
    docs += [(300, None), (301, "x" * 5000 + " idiot"), (3, docs[4][1])]
    save(spark.createDataFrame(docs, "doc_id long, text string"), tmp_path, "documents")
    save(spark.createDataFrame(labels, "doc_id long, toxic int"), tmp_path, "labels")
    got = op8_toxicity(spark, str(tmp_path)).collect()

    restorer = Restorer(fit_characters(spark.createDataFrame(docs, "doc_id long, text string")))

    def words(text):
        low = (text or "").lower()
        spaced = [w for m in _SPACED.finditer(low) for w in restorer.letters(m.group()).split()]
        return [w for t in sorted(set(low.split())) for w in restorer.scored(t)] + spaced

    def places(word):
        whole, grams, _ = _features([word])
        return {int(whole[0])} | {int(x) for x in grams.ravel() if x >= 0}

    taught = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    counts = np.zeros((2, FEATURES))
    for i, t in docs:
        if i in taught:
            for x in set().union(*map(places, words(t))):
                counts[taught[i], x] += 1
    rate = sum(taught.values()) / len(taught)
    p = (counts[1] + 10 * rate) / (counts.sum(axis=0) + 10)
    weight = (np.log(p / (1 - p)) - math.log(rate / (1 - rate))).astype(np.float32)
    top = lambda t: (sorted((max(weight[x] for x in places(w)) for w in words(t)), reverse=True) + [0.0] * 3)[:3]
    rows = {}
    for i, t in docs:
        if i in taught:
            rows[i] = min(rows.get(i, [math.inf]), top(t))
    coef = _fit(np.array([rows[i] for i in sorted(rows)], float), np.array([taught[i] for i in sorted(rows)]))
    want = []
    for i, t in docs:
        x = np.minimum(np.array(top(t), float), 8)
        want.append((i, 1 / (1 + math.exp(-(coef[0] + coef[1:4] @ x + coef[4:] @ x**2)))))
    for (i, a), x in zip(sorted(want), sorted((x.doc_id, x.score) for x in got), strict=True):
        assert i == x[0] and abs(a - x[1]) < 1e-6
    assert all(x.predicted == (x.score >= 0.5) and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)


def test_op4_finds_planted_links(spark):
    """Recall at the threshold, among vectors enough for many tables; and a cluster larger than a block."""
    r = np.random.default_rng(5)
    n, d = 1500, 32
    base = r.standard_normal((2 * n, d))
    unit = base[:n] / np.linalg.norm(base[:n], axis=1)[:, None]
    other = r.standard_normal((n, d))
    other -= (other * unit).sum(axis=1)[:, None] * unit
    other /= np.linalg.norm(other, axis=1)[:, None]
    c = r.uniform(0.94, 0.97, n)[:, None]
    x = np.concatenate([base, c * unit + np.sqrt(1 - c * c) * other, base[:1] + 0.05 * r.standard_normal((600, d))]).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {g.vec_id: g.n_links for g in near_vectors(spark, df).collect()}
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum() and want[:n].sum() > 500


@pytest.mark.parametrize("kind", ["toxicity", "line_dedup", "near_duplicates", "decontamination", "pieces"])
def test_stages_take_odd_tables(spark, tmp_path, kind):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables."""
    stage = dict(stages.STAGES)[kind]
    save(spark.createDataFrame([(999, 1), (2, 0), (None, 1), (1, None)], "doc_id long, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([(1, "an item that no document holds"), (None, "x"), (2, None), (3, "")], "item_id long, text string"), tmp_path, "benchmark")
    names = ["_id", "_lost", "_key", "_e", "_row", "row", "kept", "n_lines", "score", "held_out", "predicted", "ids", "decoded", "component_id", "key", "a.b", "hash", "n"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{x}` string" for x in names)
    line = "a line that stands in many documents, long enough to count as one"
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n "), (None, "seven eight nine"), (None, None), (5, "wort " * 40_000 + "ende"), (6, "x" * 300_000), (7, "eins zwei drei vier fünf 鼻龍龜")]
    texts += [(20 + i, f"{line}\nand its own {i} words {i * 7}") for i in range(6)]
    rows = [(i, t, len(t or ""), *(f"v{i}{x}" for x in names)) for i, t in texts]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    if kind == "pieces":
        assert len(got) == len(rows) and all(x.lossless for x in got)
    else:
        assert out.columns == docs.columns and all(tuple(x)[3:] == tuple(f"v{x[0]}{y}" for y in names) for x in got)
        gone = {"near_duplicates": 1}.get(kind, 0)
        assert len(got) == len(rows) - gone
        if kind == "line_dedup":
            assert sorted(x.doc_id for x in got if x.text and line in x.text) == [25]
            assert all(x.n_chars == len(x.text or "") for x in got)
        else:
            assert {(x.doc_id, x.text) for x in got} == {(i, t) for i, t in texts}
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert stage(spark, spark.createDataFrame([(None, None)], "doc_id long, text string"), str(tmp_path)).count() == 1
