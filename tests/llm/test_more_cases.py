"""Cases that the other modules leave open: layouts written by hand, odd tables, and the sampled pieces of whole texts."""

import zlib

import numpy as np
import pytest
import public_tokenizers

from quarry.llm.common import Scratch
from quarry.llm.embedding_dedup import near_vectors
from quarry.llm.html_text import MARK, extract, op5_html_text, parse, template_pages, train
from quarry.llm.pieces import op10_pieces
from quarry.llm.pii import pseudonymise
from quarry.llm.token_files import read_token_files, write_token_files
from quarry.llm.toxicity import Restorer, _restored

# --- html ----------------------------------------------------------------------------------------------------------

LAYOUTS = [
    ("<body><div id=top><a href=/>Home</a> <a href=/news>News</a></div><article><h2>On bridges</h2><p>We share a comment on cookies and privacy, and readers reply.</p></article></body>",
     "On bridges\n\nWe share a comment on cookies and privacy, and readers reply."),
    ("<body><main><h1>Recipe</h1><ol><li>Boil the water.<li>Add salt.</ol><table><tr><td>Salt<td>5 g<tr><td>Water<td>1 l</table></main><footer>&copy; 2021 Cook</footer>",
     "Recipe\n\nBoil the water.\n\nAdd salt.\n\nSalt\n\n5 g\n\nWater\n\n1 l"),
    ("<body><nav><a href=/a>A</a></nav><article><header></header><p>First <em>line</em>&nbsp;of&#32;text.</p><ul><li><a href=/1>Source one</a></li><li><a href=/2>Source two</a></li></ul><aside><h3>Related</h3><p>Buy now!</p></aside><p>Last.</p></article>",
     "First line of text.\n\nSource one\n\nSource two\n\nLast."),
    ('<body><article><p>Short.</p><form><p>Subscribe to our newsletter</p><input></form><p>The end of it.</p><div class="comments"><p>Nice post, thanks for sharing.</p><p>I reply to that.</p></div></article>', "Short.\n\nThe end of it."),
    ('<body><div class="cookie-banner"><p>This site uses cookies.</p></div><main><section><h2>Part</h2><p>Copyright law changed twice in that century, and newsletters said so.</p></section></main>',
     "Part\n\nCopyright law changed twice in that century, and newsletters said so."),
    ("<body><article><blockquote><p>He said: share what you have.</p></blockquote><pre>x = 1\ny = 2</pre><figure><img src=a><figcaption>A picture of the sea.</figcaption></figure></article>", "He said: share what you have.\n\nx = 1 y = 2\n\nA picture of the sea."),
]


def test_op5_of_layouts_that_no_template_has(spark, tmp_path):
    spark.createDataFrame([(i, "u", x) for i, (x, _) in enumerate(LAYOUTS)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: x.text for x in op5_html_text(spark, str(tmp_path)).collect()}
    for i, (_, want) in enumerate(LAYOUTS):
        assert got[i] == want, i


@pytest.mark.parametrize("size", [40, 79, 159, 239, 319, 399, 5000])
def test_articles_of_any_length_keep_words_of_notices(size):
    model = train([parse(x, MARK) for x in template_pages()])
    text = ("Readers of the paper asked why a comment on the cookie and privacy rules was shared again. " * (size // 80 + 1))[:size].strip()
    assert model.text(f"<body><nav><ul><li><a href=/>home</a></li></ul></nav><article><p>{text}</p></article><footer>x</footer>") == text


def test_html_of_odd_tables(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    page = "<body><article><p>Same page, many times, with text.</p></article>"
    rows = [(1, page, 1, 2), (1, page, 1, 2), (None, page, 1, 2), (2, f"<body><article><p>{long}</p></article>", 1, 2), (3, "</p>" * 3000 + "<div>" * 3000 + "</ul>" * 3000 + "x", 1, 2)]
    schema = "page_id long, html string, `a.b` int, _k int"
    out = extract(spark, spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(x.page_id) for x in out) == ["1", "1", "2", "3", "None"] and all(x["a.b"] == 1 and x._k == 2 for x in out)
    assert {x.text for x in out if x.page_id in (1, None)} == {"Same page, many times, with text."} and next(x.text for x in out if x.page_id == 2) == long
    assert extract(spark, spark.createDataFrame([], schema)).count() == 0


def test_training_needs_both_labels():
    with pytest.raises(ValueError, match="both labels"):
        train([parse(x) for x in template_pages(5)])


# --- pii -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("before", "value", "after"), [
    ('{"password": "', "hunter2abc9", '"}'), ("password=", "hunter2abc9", " and more"), ("token: '", "abcdefgh12", "'"), ('api_key = "', "A1b2C3d4E5", '"'), ("SECRET:", "x9x9x9x9", ", then"),
    ("{'token':'", "abc-def-123", "'}"), ('"apikey" :\t"', "0123456789abcdef", '"'), ("my_password = ", "q1w2e3r4t5", ""),
])
def test_secrets_in_every_writing(spark, before, value, after):
    text = before + value + after
    x = pseudonymise(spark.createDataFrame([(text,)], "text string"), "k").first()
    assert x.pii_kinds == ["secret"] and x.text.startswith(before) and x.text.endswith(after) and len(x.text) == len(text)
    new = x.text[len(before) : len(x.text) - len(after)]
    assert new != value and [c.isdigit() for c in new] == [c.isdigit() for c in value] or set(value) <= set("0123456789abcdef")


@pytest.mark.parametrize("text", ["The password: required for all", "token = something", 'password: "short"', "a secret: keep it", "token=abcdefgh", "secret: 12345678 times"])
def test_words_behind_names_of_secrets_stay(spark, text):
    assert pseudonymise(spark.createDataFrame([(text,)], "text string"), "k").first().text == text


def test_pii_of_odd_tables(spark):
    schema = "text string, _m int, _k string, pii_kinds int"
    assert pseudonymise(spark.createDataFrame([], schema), "k").count() == 0
    long = "plain words stand here " * 12_000
    out = pseudonymise(spark.createDataFrame([(long + "10.1.2.3", 7, "x", 1), (None, 7, "x", 1), ("", 7, "x", 1)], schema), "k").collect()
    assert all((x._m, x._k) == (7, "x") for x in out)
    got = next(x for x in out if x.text)
    assert got.text.startswith(long) and got.pii_kinds == ["ip"] and not got.text.endswith("10.1.2.3")


# --- others ----------------------------------------------------------------------------------------------------------


def test_token_files_of_an_empty_table(spark):
    scratch = Scratch(spark, "files")
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = scratch.save(write_token_files(spark, docs, public_tokenizers.path("word_bpe_49k.json"), scratch.path("files")), "manifest")
    assert read_token_files(manifest).count() == 0


def test_vectors_without_ids_or_with_one_id_twice(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, "a"), (5, v, "a"), (5, v, "a"), (5, [-1.0, 0.0, 1.0], "a"), (9, v, "a")]
    out = [(x.vec_id, x.n_links, x.component_id, x.kept) for x in near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")).collect()]
    assert sorted(out, key=str) == sorted([(None, 0, None, False), (5, 2, 5, True), (5, 2, 5, True), (5, 0, 5, True), (9, 2, 5, False)], key=str)


def test_short_restored_words_are_scored():
    class Plain:
        def letters(self, s):
            return s.replace(" ", "")

        def scored(self, token):
            return [token]

    got = list(_restored(["x 你 好 吗 y"], Plain(), {}, list))
    assert any("你好吗" in w or w == "你好吗" for w in got[0])
    restorer = Restorer(np.zeros(1 << 20, np.int64))
    assert {"ab", "c"} <= set(restorer.scored("ab1c"))


def test_op10_against_a_plain_version(spark, tmp_path):
    """Forward sums and backward draws of each segment by plain loops over a dictionary of pieces."""
    import re

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i): (i, 1 / (r + 2)) for r, i in enumerate(normal)}
    longest, mask = max(map(len, pieces)), (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    def segment(s, salt):
        shown = "".join("\0" if c == "▁" else "▁" if c == " " else c for c in s)
        forward, edges = [1.0], [[]]
        for to in range(1, len(s) + 1):
            own = [(n, *pieces[shown[to - n : to]]) for n in range(min(longest, to), 0, -1) if shown[to - n : to] in pieces]
            if not any(n == 1 for n, _, _ in own):
                own.append((1, -ord(s[to - 1]), np.exp(-12.0)))
            ways = [forward[to - n] * w for n, _, w in own]
            forward.append(sum(ways))
            edges.append([(n, i, x / forward[-1]) for (n, i, _), x in zip(own, ways)])
        at, out, step = len(s), [], 0
        while at:
            u = (mix((salt + step * 0x9E3779B97F4A7C15) & mask) >> 11) * 2.0**-53
            run, step = 0.0, step + 1
            for n, i, share in edges[at]:
                run += share
                if run > u:
                    break
            out.append([i] if i >= 0 else [model.piece_to_id(f"<0x{b:02X}>") for b in chr(-i).encode()])
            at -= n
        return [i for x in reversed(out) for i in x]

    texts = ["There were three of them, and the others were there too.", "", "two  spaces ▁ and\t日本語 😀 \r\n\nlast ", "Unbelievable internationalisation " * 20, None, "a", "\n"] + [f"Row {i} of the table holds some words" for i in range(60)]
    docs = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(8, texts[8])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in docs:
        row = mix(((i or 0) + 0x9E3779B97F4A7C15) & mask)
        ids = [x for k, s in enumerate(re.findall(r"\n| +[^ \n]*|[^ \n]+", t or "")) for x in segment(s, mix(row ^ (k * 0xD6E8FEB86659FD93 & mask)))]
        want.append((i, len(t or ""), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert sorted(map(tuple, op10_pieces(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_lean_tasks_give_the_same_rows(spark):
    from quarry.llm.common import lean

    def twice(batches):
        for b in batches:
            yield b
            yield b

    assert spark.range(100).mapInArrow(lean(twice), "id long").count() == 200
    assert list(lean(lambda batches: iter(()))([1, 2])) == []
