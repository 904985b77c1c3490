"""Documents into chunks: of a fixed size, of whole sentences, between the widest separators."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a sentence, with the white space behind; where a text is split, the widest first, then anywhere.
SENTENCE_END = r"[.。!！?？;；\n]\s*"
SEPARATORS = ("\n\n", "\n", "。", ".", " ", "")


def chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, start, chunk): chunks of `size` characters, each `size - overlap` after the last, while any text is left."""
    if overlap >= size:
        raise ValueError("the overlap has to be smaller than the size")
    starts = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))).alias("start"))
    return starts.select("doc_id", "start", F.substr("text", F.col("start") + 1, F.lit(size)).alias("chunk"))


def chunk_policy(size: int, overlap: int, finance: bool = False) -> tuple[int, int]:
    """Size and overlap of chunks; for filings at least 1,000 and 150."""
    return (max(size, 1000), max(overlap, 150)) if finance else (size, overlap)


def _cut(docs: DataFrame, pack: Callable[[str], list[str]]) -> DataFrame:
    """(doc_id, n, chunk) of what a function makes of each text; a chunk depends on all before it."""
    made = F.udf(lambda t: pack(t or ""), "array<string>", useArrow=True)
    return docs.select("doc_id", F.posexplode(made("text")).alias("n", "chunk"))


def sentence_spans(text: str, size: int, overlap: int, most: int) -> tuple[list[tuple[int, int]], tuple[int, int]]:
    """Where each full chunk of whole sentences begins and ends, and the same of what is left."""
    pattern = re.compile(SENTENCE_END)
    ends = [m.end() for m in pattern.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out, begin, end, k = [], 0, 0, 0
    while k < len(ends):
        if begin < end and ends[k] - begin > size:
            taken = ends[k] - begin <= most
            if taken:
                end, k = ends[k], k + 1
            out.append((begin, end))
            tail = max(begin, end - overlap) if overlap > 0 else end
            m = pattern.search(text, tail, end)
            again = m.end() if m else tail
            begin = end if again == begin and not taken else again  # a chunk isn't repeated as a whole for ever
        else:
            end, k = ends[k], k + 1
    return out, (begin, end)


def sentence_chunks(spark: SparkSession, docs: DataFrame, size: int = 800, overlap: int = 100, least: int = 200, most: int = 1200) -> DataFrame:
    """(doc_id, n, chunk) of documents (doc_id, text).

    Sentences are packed up to `size` characters; the one that passes it still comes in up to `most`. A chunk begins with
    what the one before holds behind the first sentence's end among its last `overlap` characters. Chunks under `least`,
    the last one first, join the chunk before them. Null and empty texts have no chunks.
    """
    most = max(most, size)

    def pack(text: str) -> list[str]:
        if not text:
            return []
        spans, (begin, end) = sentence_spans(text, size, overlap, most)
        made = [text[a:b] for a, b in spans]
        if begin < end:
            if made and end - begin < least:
                made[-1] += text[begin:end]
            else:
                made.append(text[begin:end])
        groups: list[list[str]] = []
        for c in made:
            if groups and len(c) < least:
                groups[-1].append(c)
            else:
                groups.append([c])
        return ["".join(g) for g in groups]

    return _cut(docs, pack)


def recursive_spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Where each chunk begins and ends, with white space at its ends."""
    out: list[tuple[int, int]] = []

    def merge(pieces: list[tuple[int, int]]) -> None:
        held: deque[tuple[int, int]] = deque()
        for a, b in pieces:
            if held and b - held[0][0] > size:
                out.append((held[0][0], held[-1][1]))
                while held and (held[-1][1] - held[0][0] > overlap or b - held[0][0] > size):
                    held.popleft()
            held.append((a, b))
        if held:
            out.append((held[0][0], held[-1][1]))

    def cut(a: int, b: int, level: int) -> None:
        while level < len(separators) and separators[level] and text.find(separators[level], a, b) < 0:
            level += 1
        if level == len(separators):
            out.append((a, b))
            return
        sep = separators[level]
        if not sep:  # anywhere: a window of characters
            while b - a > size:
                out.append((a, a + size))
                a += size - overlap
            out.append((a, b))
            return
        good, at = [], a
        while at < b:  # a separator stays with the piece behind it
            end = text.find(sep, at + len(sep) if text.startswith(sep, at) else at, b)
            end = b if end < 0 else end
            if end - at < size:
                good.append((at, end))
            else:
                merge(good)
                good = []
                cut(at, end, level + 1)
            at = end
        merge(good)

    if text:
        cut(0, len(text), 0)
    return out


def recursive_chunks(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, n, chunk) of documents (doc_id, text): pieces between the widest separators, packed to `size` characters.

    A text is cut before each of the widest separators that it has. Pieces that are not shorter than `size` are cut in
    the same way at the next separator, at last anywhere; the others are packed, and a chunk begins with the last pieces
    of the one before, up to `overlap` characters. Chunks have no white space at their ends; those of nothing else go.
    """
    if overlap >= size:
        raise ValueError("the overlap has to be smaller than the size")
    return _cut(docs, lambda text: [c for a, b in recursive_spans(text, size, overlap) if (c := text[a:b].strip())])
