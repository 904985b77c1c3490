"""HTML extraction by a tree-structured graphical model.

A page's blocks form a tree. Each block is content or not; what can be seen of it (tag, class words, length, share of
links, marks) gives a factor for the block alone, and each parent and child share a factor. Sum-product messages run
from the leaves to the root and back, which gives each block's exact marginal. The factors are trained on labelled
pages: pages made from templates that mark their content, and a bounded sample of the table's own pages whose markup
tells the article from the rest.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import column, others, read_table, small_batches

SIZE = 1 << 14
MARK = "data-label-of-template"
#: An attribute as browsers read it: a quote counts only behind =, and only if it is closed.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\s>]*)))?")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?![\"'])[^\s>]*))?)*+)(?:>|\Z)",
    re.S,
)
_WORD = re.compile(r"[a-z]+")
#: Elements whose text is never shown, or belongs to controls.
_SKIPPED = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "option", "button", "label", "audio", "video", "datalist"}
#: Those that end at their own end tag or at the next of their kind; without one, they end at the next block.
_CONTROLS = {"select", "button", "label"}
_OPEN = {"svg", "math", "object", "canvas", "audio", "video", "datalist"}  # those that end at an end tag of their kind
_NEXT = {x: re.compile(rf"<(/?){x}(?=[\s/>])", re.I) for x in _CONTROLS}
_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in (*_OPEN, "script", "style", "noscript", "template", "title", "textarea", "iframe")}
_RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe"}
#: What may stand in a head; any other element begins the body.
_IN_HEAD = {"base", "head", "html", "link", "meta", "noscript", "script", "style", "template", "title"}
_SELF_CLOSED = re.compile(r"(?<!\S)/\s*\Z|[\"']\s*/\s*\Z|(?:\A|\s)[^\s=\"']+/\s*\Z")
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What an opening tag closes, up to the element that holds it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SIGNS = re.compile(r"©|\(c\)|copyright|cookie|subscrib|newsletter|sign in|log in|repl(?:y|ies)|comment|advert|sponsor|share|privacy|rights reserved", re.I)

_SIGN_WORDS = ("comment", "comments", "cookies", "privacy", "share", "copyright", "reply", "subscribe", "newsletter", "sponsor", "advert", "sign in", "log in")
#: Elements and class words that tell what is no article.
_OFF = {"nav", "header", "footer", "aside", "form", "menu"}
_OFF_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumbs", "comment", "comments", "consent", "cookie", "footer", "menu", "nav", "navigation", "newsletter", "notice", "promo", "recommended", "related",
    "reply", "share", "sidebar", "social", "sponsored", "subscribe", "widget",
}


@dataclass
class Block:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    label: int | None = None
    runs: int = 0
    chars: int = 0
    linked: int = 0
    children: int = 0
    last: str = ""  # the last character of its text
    n_words: int = 0
    signs: Counter = field(default_factory=Counter)  # words of notices and controls in its text
    land: str = "-"  # the nearest landmark around it: "in" an article, "off" in what is none, or "-"


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)  # block and text, in page order


def parse(html: str | None, mark: str | None = None) -> Page:
    """Blocks of a page and their runs of text; character references decoded, white space made single spaces.

    mark names an attribute that gives a block's label, on pages made for training alone; a page's own attributes never do.
    """
    page = Page([Block("#page", -1)])
    if not html:
        return page
    blocks, stack, parts, state = page.blocks, [0], [], {"link": 0, "linked": 0}
    #: Open elements whose text is skipped, how many blocks held each, and whether it is a control without an end.
    skipped: list[tuple[str, int, bool]] = []
    endless: set[str] = set()  # kinds of which no end tag follows
    opened: Counter = Counter()  # open blocks by tag

    def flush() -> None:
        text = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        linked, state["linked"] = state["linked"], 0
        if text:
            b = blocks[stack[-1]]
            page.runs.append((stack[-1], text))
            b.runs, b.chars, b.linked = b.runs + 1, b.chars + len(text), b.linked + min(linked, len(text))
            b.last, b.n_words = text[-1], b.n_words + text.count(" ") + 1
            b.signs.update(x.lower()[:7] for x in _SIGNS.findall(text))

    def close(k: int) -> None:
        flush()
        opened.subtract(blocks[b].tag for b in stack[k:])
        del stack[k:]
        state["link"] = 0
        while skipped and skipped[-1][1] > k:
            skipped.pop()

    def end_skipped(*names: str) -> None:
        """Ends the innermost open element of these names, and all in it."""
        for k in range(len(skipped) - 1, -1, -1):
            if skipped[k][0] in names:
                held = skipped[k][1]
                if len(stack) > held:
                    close(held)
                del skipped[k:]
                break

    def add(text: str) -> None:
        if skipped and skipped[-1][0] == "head" and text.strip():
            skipped.pop()
        if text and not skipped:
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text.strip())

    def unclosed(name: str, at: int) -> bool:
        if name in _CONTROLS:
            m = _NEXT[name].search(html, at)
            return m is None or not m[1]
        if name in _OPEN and name not in endless and not _END[name].search(html, at):
            endless.add(name)
        return name in endless

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if html.startswith("<![CDATA[", m.start()):
                add(_html.escape(html[m.start() + 9 : at].removesuffix("]]>")))
            continue
        ends = bool(m[1])
        if skipped and not ends:
            if name not in _IN_HEAD:
                end_skipped("head")
            if name in ("option", "optgroup"):
                if skipped and skipped[-1][0] == "option":
                    skipped.pop()
            elif name in ("input", "textarea", "select") and any(x[0] == "select" for x in skipped):
                end_skipped("select")
                if name == "select":
                    continue
            elif name == "button":
                end_skipped("button")
        if name in _SKIPPED:
            if name in _RAW and not ends:
                # what stands behind the end tag's name goes with it; without an end only code takes the rest of the page
                stop = None if name in endless else _END[name].search(html, at)
                if stop is None:
                    endless.add(name)
                    at = n if name in ("script", "style") else at
                else:
                    at = stop.start()
            elif name not in _RAW:
                if ends:
                    end_skipped(name)
                elif not _SELF_CLOSED.search(m[3]):
                    skipped.append((name, len(stack), unclosed(name, at)))
            continue
        if name == "body":
            skipped.clear()
        if name in _VOID:
            if name in ("br", "hr", "wbr"):
                add(" " if name != "wbr" else "")
            continue
        if name in _INLINE:
            if name == "a":
                state["link"] = 0 if ends else 1
            continue
        if skipped:  # the first block behind an unclosed control is no part of it
            del skipped[next((i for i, x in enumerate(skipped) if x[2]), len(skipped)) :]
        if ends:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if blocks[stack[k]].tag == name))
            else:
                flush()
            continue
        if blocks[stack[-1]].tag == "p" or name in _CLOSES:
            shut, held = _CLOSES.get(name, ((), ()))
            some = blocks[stack[-1]].tag == "p" or any(opened[x] for x in shut)
            for k in range(len(stack) - 1, 0, -1) if some else ():
                tag = blocks[stack[k]].tag
                if tag in held:
                    break
                if tag in shut or (tag == "p" and k == len(stack) - 1):
                    close(k)
                    if tag in shut:
                        break
        flush()
        words, label = [], None
        for key, *values in _ATTRIBUTE.findall(m[3]):
            key = key.lower()
            if key in ("class", "id", "role"):
                words += _WORD.findall("".join(values).lower())
            elif key in ("hidden", "aria-hidden"):
                words.append("hidden")
            elif key == mark:
                label = int("".join(values))
        parent = blocks[stack[-1]]
        parent.children += 1
        land = "off" if name in _OFF or not _OFF_WORDS.isdisjoint(words) else "in" if name in ("article", "main") else parent.land
        blocks.append(Block(name, stack[-1], tuple(words), label, land=land))
        stack.append(len(blocks) - 1)
        opened[name] += 1
    flush()
    return page


def _features(b: Block) -> list[int]:
    """Places of what is seen of a block."""
    size = 0 if not b.chars else 1 + sum(b.chars > x for x in (15, 40, 80, 200, 500))
    links = 0 if not b.linked else 1 + sum(b.linked > x * b.chars for x in (0.2, 0.5, 0.9))
    seen = ["bias", f"tag {b.tag}", f"size {size}", f"links {links} {b.land}", f"size {size} links {links} {b.land}", f"tag {b.tag} links {links} {b.land}"]
    seen += [f"word {w}" for w in b.words]
    if b.chars:
        seen.append(f"end {b.last in '.!?…:;\"”'}")
    if b.signs:  # by how many words they stand among, in texts of any length
        dense = sum(b.signs.total() * x > b.n_words for x in (20, 6))
        seen += [f"signs {dense} {b.land}", *(f"sign {x} {dense} {b.land}" for x in b.signs)]
    return [zlib.crc32(x.encode()) % SIZE for x in seen]


@dataclass
class Model:
    weights: list[float]
    pair: tuple[tuple[float, float], tuple[float, float]]  # factor of parent's and child's state

    def marginals(self, page: Page) -> list[float]:
        """Probability of each block to be content: sum-product over the tree, which stands in page order."""
        blocks, w, psi = page.blocks, self.weights, self.pair
        n = len(blocks)
        up: list[list[float]] = []
        for b in blocks:
            z = max(-12.0, min(12.0, sum(w[i] for i in _features(b))))
            p = 1 / (1 + math.exp(-z))
            up.append([1 - p, p])
        sent: list = [None] * n
        for i in range(n - 1, 0, -1):  # children stand behind their parents
            a, c = up[i]
            m0, m1 = a * psi[0][0] + c * psi[0][1], a * psi[1][0] + c * psi[1][1]
            sent[i] = m0, m1 = m0 / (m0 + m1), m1 / (m0 + m1)
            x = up[blocks[i].parent]
            x[0], x[1] = x[0] * m0, x[1] * m1
            s = x[0] + x[1]
            x[0], x[1] = x[0] / s, x[1] / s
        belief = [up[0]]
        for i in range(1, n):
            x, (m0, m1) = belief[blocks[i].parent], sent[i]
            a, c = x[0] / max(m0, 1e-300), x[1] / max(m1, 1e-300)
            d0, d1 = a * psi[0][0] + c * psi[1][0], a * psi[0][1] + c * psi[1][1]
            y0, y1 = up[i][0] * d0, up[i][1] * d1
            belief.append([y0 / (y0 + y1), y1 / (y0 + y1)])
        return [x[1] for x in belief]

    def text(self, html: str | None) -> str:
        page = parse(html)
        p = self.marginals(page)
        return "\n\n".join(t for b, t in page.runs if p[b] >= 0.5)


# --- training --------------------------------------------------------------------------------------------------------


def template_pages(n: int = 240, seed: int = 5) -> list[str]:
    """Pages from templates; MARK tells what is content (1) and what isn't (0), for a block and all below it."""
    r = random.Random(seed)

    def words(k: int) -> str:
        return " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9))) for _ in range(k))

    def sentence(lo: int = 6, hi: int = 30) -> str:
        return words(r.randint(lo, hi)).capitalize() + r.choice((".", ".", ".", ".", ".", "!", "?", "", " |", "%%"))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(r.randint(1, 3))}</a></li>' for i in range(k))

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.2:
            return f"<p>{words(r.randint(1, 3)).capitalize()}.</p>"
        if kind < 0.3:
            return f"<h2>{words(4)}</h2>"
        if kind < 0.38:
            return f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(3))}</ul>"
        if kind < 0.44:
            return f"<blockquote><p>{sentence()}</p></blockquote>"
        if kind < 0.48:
            return f"<pre>{words(9)}</pre>"
        if kind < 0.52:
            return f"<table><tr><th>{words(1)}</th><td>{words(2)}</td></tr></table>"
        if kind < 0.56:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        if kind < 0.59:
            return f"<ul>{links(r.randint(1, 4))}</ul>"
        if kind < 0.72:  # articles speak of comments and cookies too
            text = sentence(3, 40).split()
            for _ in range(r.randint(1, 4)):
                text.insert(r.randint(1, len(text)), r.choice(_SIGN_WORDS))
            return f"<p>{' '.join(text)}</p>"
        inside = f' <a href="/x">{words(2)}</a> ' if r.random() < 0.3 else " "
        return f"<p>{sentence()}{inside}{' '.join(sentence() for _ in range(r.randint(0, 6)))}" + ("</p>" if r.random() < 0.9 else "<br>")

    def reader() -> str:
        return f'<div class="{r.choice(["comment", "comment-body", "reply", "comment-item"])}"><p class="meta">{words(2)} says</p><p>{" ".join(sentence() for _ in range(r.randint(1, 4)))}</p></div>'

    wrap = [("<article{}>", "</article>"), ("<main{}>", "</main>"), ('<div class="post-content"{}>', "</div>"), ('<div id="content"{}>', "</div>"), ('<section class="article-body"{}>', "</section>"), ('<div class="entry story text"{}>', "</div>"), ('<div role="main"{}>', "</div>"), ("<main><article{}>", "</article></main>"), ('<div itemprop="articleBody" class="main body"{}>', "</div>")]
    before = [
        lambda: f"<nav{{}}><ul>{links(r.randint(3, 9))}</ul></nav>", lambda: f"<header{{}}><a href=/>{words(2)}</a><p>{words(4)}</p></header>",
        lambda: f'<div class="menu navigation"{{}}><ul>{links(6)}</ul></div>', lambda: f'<div class="breadcrumbs"{{}}><a href=/>{words(1)}</a> &gt; <a href=/b>{words(1)}</a></div>',
        lambda: f'<div class="{r.choice(["ad", "ads", "advert", "advertisement banner", "sponsored promo"])}"{{}}>{sentence()}</div>', lambda: f'<div id="{r.choice(["cookie-notice", "cookie-banner", "gdpr-consent", "notice"])}"{{}}><p>{sentence()} cookies</p></div>',
    ]
    after = [
        lambda: f"<footer{{}}>&copy; {words(3)} &middot; {sentence()}</footer>", lambda: f'<aside{{}}><h3>{words(2)}</h3><ul>{links(5)}</ul><p>{sentence()}</p></aside>',
        lambda: f'<div class="{r.choice(["sidebar", "widget", "related", "recommended"])}"{{}}><h3>{words(2)}</h3><p>{sentence()}</p><ul>{links(4)}</ul></div>',
        lambda: f'<div class="{r.choice(["comments", "comment-list", "discussion comments"])}" id="comments"{{}}><h3>{r.randint(2, 9)} comments</h3>{"".join(reader() for _ in range(r.randint(1, 4)))}</div>',
        lambda: f'<section class="comments"{{}}><h2>comments</h2><ol><li>{" ".join(sentence() for _ in range(3))}</li></ol></section>',
        lambda: f'<form class="newsletter subscribe"{{}}><p>{sentence()}</p><input></form>', lambda: f'<div class="share social"{{}}><a href=#>share</a> <a href=#>{words(1)}</a></div>',
        lambda: f'<div class="footer copyright"{{}}><p>&copy; 2020 {words(4)}. All rights reserved</p></div>', before[4], before[5],
    ]
    off, on, out = f' {MARK}="0"', f' {MARK}="1"', []
    for _ in range(n):
        open_, shut = r.choice(wrap)
        body = [f"<h1>{words(5)}</h1>", *(paragraph() for _ in range(r.randint(1, 12)))]
        if r.random() < 0.35:
            body.insert(r.randint(1, len(body)), r.choice([before[4], after[6], after[2], after[5]])().format(off))
        if r.random() < 0.25:
            body.append(r.choice([after[3], after[4]])().format(off))
        parts = [x().format(off) for x in r.sample(before, r.randint(1, 3))] + [open_.format(on), *body, shut] + [x().format(off) for x in r.sample(after, r.randint(1, 4))]
        page = "".join(parts)
        if r.random() < 0.4:
            page = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">{page}</div>'
        out.append(f"<html><head><title>x</title></head><body>{page}</body></html>")
    return out


def own_labels(page: Page) -> bool:
    """Labels a page's blocks by its own markup; False if it names no article."""
    named = False
    for b in page.blocks[1:]:
        up = page.blocks[b.parent].label
        if b.tag in _OFF or _OFF_WORDS & set(b.words):
            b.label = 0
        elif b.tag in ("article", "main"):
            b.label, named = 1, True
        else:
            b.label = up
    return named


def train(pages: list[Page]) -> Model:
    """Factors from labelled pages: logistic regression for a block alone, counts of pairs for parent and child.

    A block without a label takes its parent's; one above all labels counts as content if most text below it is. Pages
    have to hold both kinds of blocks, else there is nothing to tell apart.
    """
    rows, y, pairs = [], [], np.ones((2, 2))
    for page in pages:
        blocks = page.blocks
        mass = [[0.0, 0.0] for _ in blocks]
        labels: list[int | None] = [blocks[0].label]
        for b in blocks[1:]:
            labels.append(b.label if b.label is not None else labels[b.parent])
        for i in range(len(blocks) - 1, -1, -1):
            b = blocks[i]
            if labels[i] is not None:
                mass[i][labels[i]] += b.chars
            if i:
                for k in (0, 1):
                    mass[b.parent][k] += mass[i][k]
        final = [x if x is not None else int(mass[i][1] > mass[i][0]) for i, x in enumerate(labels)]
        for i, b in enumerate(blocks):
            rows.append(_features(b))
            y.append(final[i])
            if i:
                pairs[final[b.parent], final[i]] += 1
    if len(set(y)) < 2:
        raise ValueError("the pages need blocks of both labels")
    size = np.array([len(x) for x in rows])
    col, row, target = np.concatenate(rows), np.repeat(np.arange(len(rows)), size), np.array(y, float)
    w, grad2 = np.zeros(SIZE), np.full(SIZE, 1e-6)
    for _ in range(150):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)), -30, 30)))
        g = np.bincount(col, (p - target)[row], SIZE) / len(rows) + 1e-5 * w
        grad2 += g * g
        w -= 0.5 * g / np.sqrt(grad2)
    # the pair factor says what the parent's state adds to how common the child's state is
    joint = pairs / pairs.sum()
    ratio = joint / joint.sum(axis=1, keepdims=True) / joint.sum(axis=0, keepdims=True)
    return Model(w.tolist(), tuple(map(tuple, ratio.tolist())))


def extract(spark: SparkSession, pages: DataFrame, bound: int = 400, longest: int = 200_000) -> DataFrame:
    """Adds text, the main text of each page's whole html, to pages (page_id, html, ...).

    Trained on 240 template pages and `bound` pages of the table at most (the documented bound: different pages, chosen
    by a hash of the html, of `longest` characters at most; only those whose markup names an article). Null and empty html give an empty text. Pages that
    repeat, or repeat a page_id, come back as often; no pages give no rows. A page of any length is read whole, in
    memory in proportion to its own length. A column `text` is replaced; all others stay, whatever their names.
    """
    small_batches(spark, 250)
    place = F.pmod(F.xxhash64("html", F.lit(3)), F.lit(1 << 30))
    short = pages.where(F.length("html") <= longest).select("html")
    n = short.count()
    share = min(1.0, 2 * bound / max(n, 1))  # with twice the bound, copies and chance leave enough
    sample = short.where(place < int(share * (1 << 30))).distinct().orderBy(place, "html").limit(bound)
    known = [parse(x, MARK) for x in template_pages()]
    known += [p for (x,) in sample.collect() if own_labels(p := parse(x))]
    sent = spark.sparkContext.broadcast(train(known))

    @F.udf("string", useArrow=True)
    def text(html):
        return sent.value.text(html)

    return pages.select(*map(column, others(pages, "text")), text("html").alias("text"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    out = extract(spark, read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
