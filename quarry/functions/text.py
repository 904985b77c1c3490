"""Column functions over text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Phrases that count as a refusal.
REFUSALS = ("not mentioned", "no information", "cannot be answered", "none", "unknown", "don't know")
#: Words that the content tokeniser leaves out.
STOP_WORDS = (
    "about", "after", "all", "also", "and", "answer", "apply", "asks", "any", "are", "available", "based", "before", "company", "content", "data", "document", "evidence", "explicitly",
    "expressed", "filing", "financial", "first", "for", "from", "has", "have", "into", "its", "most", "only", "period", "question", "relevant", "report", "result", "requested", "search", "source",
    "sources", "specific", "specified", "statement", "that", "the", "their", "then", "this", "when", "where", "which", "with", "year",
)
#: Endings that the stemmer takes off, in this order, and words with a stem of their own.
ENDINGS = ("ingly", "ments", "ment", "ation", "ities", "ing", "ies", "ed", "es", "s")
STEMS = {"percentage": "percent", "percentages": "percent", "percents": "percent"}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Words between white space, small letters."""
    return F.filter(F.split(F.lower(F.trim(_col(text))), r"\s+"), lambda x: x != "")


def title_parts(text: Column | str) -> Column:
    """Runs of letters and runs of digits, small letters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z]+|[0-9]+"), 0)


def answer_tokens(text: Column | str) -> Column:
    """Tokens of a normalised answer: no commas or punctuation, no articles."""
    bare = F.translate(F.lower(F.translate(_col(text), ",", "")), PUNCTUATION, "")
    return F.filter(F.split(bare, r"\s+"), lambda x: ~x.isin("", "a", "an", "the", "and"))


def measured_tokens(text: Column | str) -> Column:
    """Tokens with their signs of measure, articles kept: letters, digits, . % $ and -."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[A-Za-z0-9.%$-]+"), 0)


def is_refusal(text: Column | str) -> Column:
    return F.lower(_col(text)).rlike("|".join(REFUSALS))


def clip(text: Column | str, limit: int) -> Column:
    """White space squeezed; longer texts cut to limit with an ellipsis."""
    flat = F.trim(F.regexp_replace(_col(text), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))).otherwise(flat)


def bounded_top_k(value: Column, default: int, top: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(value.try_cast("int"), F.lit(default)), F.lit(top)))


def stem(word: Column) -> Column:
    """A light stemmer: the first matching ending goes, if more than three letters are left."""
    out = F.when(word.isin(*STEMS), F.element_at(F.create_map(*(F.lit(x) for e in STEMS.items() for x in e)), word))
    for x in ENDINGS:
        out = out.when(word.endswith(x) & (F.length(word) > len(x) + 3), F.left(word, F.length(word) - len(x)))
    return out.otherwise(word)


def content_tokens(text: Column | str) -> Column:
    """Distinct stems of the words of three signs or more that begin with a letter and aren't stop words, sorted."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z][a-z0-9-]{2,}"), 0)
    stems = F.transform(F.filter(words, lambda x: ~x.isin(*STOP_WORDS)), stem)
    return F.array_sort(F.array_distinct(F.filter(stems, lambda x: (F.length(x) >= 3) & ~x.isin(*STOP_WORDS))))


def judge_score(reply: Column | str, two_way: bool = False) -> Column:
    """A judge's score 0 to 4 from its reply: a JSON object's, else "score": n, else the first lone number 0 to 4, else 0.

    With two_way only 4 and 0 are allowed, and whatever isn't 4 is 0.
    """
    reply = _col(reply)
    whole = F.when(F.try_parse_json(reply).isNotNull() & F.ltrim(reply).startswith("{"), F.coalesce(F.get_json_object(reply, "$.score"), F.lit("0"))).try_cast("double")
    part = lambda p: F.nullif(F.regexp_extract(reply, p, 1), F.lit("")).try_cast("double")
    score = F.coalesce(whole, part('"score"\\s*:\\s*([0-4])'), part(r"\b([0-4])\b"), F.lit(0.0))
    score = F.greatest(F.lit(0), F.least(F.lit(4), score.cast("int")))
    return F.when(score == 4, 4).otherwise(0) if two_way else score


def json_object(text: Column | str) -> Column:
    """The JSON object of a text: the text itself, or what stands between its first and last brace; null if that is none."""
    t = _col(text)
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    whole = F.when(F.try_parse_json(t).isNotNull() & F.trim(t).startswith("{"), F.trim(t))
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def truncated(vector: Column, dims: int) -> Column:
    """The first `dims` numbers of a longer vector, then length one; a zero vector stays."""
    v = F.when(F.size(vector) > dims, F.slice(vector, 1, dims)).otherwise(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def leak_terms(terms: Column, exceptions: tuple[str, ...] = ("block",)) -> Column:
    """Literals that must not occur: distinct small letters and digits, three at least, but for some exceptions."""
    keys = F.transform(terms, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", ""))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda x: (F.length(x) >= 3) & ~x.isin(*exceptions))))


def instructions(text: Column | str) -> Column:
    """The parts of a numbered list: 1. ... 2. ..."""
    return F.filter(F.transform(F.split(_col(text), r"(?:^|\n)\s*\d+\.\s+"), F.trim), lambda x: x != "")


RESULT = "ok boolean, query string, scope string, doc_id string, source_name string, title string, error string, results array<struct<score:string,source_name:string,title:string,text:string,ref:struct<doc_id:string,node_id:string>>>"


def compact_result(result: Column | str) -> Column:
    """A tool's result (JSON) in short: named texts clipped to 300, three hits clipped to 500, or a preview if there is neither."""
    raw = _col(result)
    r = F.from_json(raw, RESULT)
    names = ("query", "scope", "doc_id", "source_name", "title", "error")
    hits = F.transform(F.slice(r["results"], 1, 3), lambda x: F.struct(*(clip(x[c], 500).alias(c) for c in ("score", "source_name", "title", "text")), x["ref"].alias("ref")))
    nothing = F.coalesce(*(r[c] for c in names)).isNull() & r["results"].isNull()
    preview = F.when(F.try_parse_json(raw).isNull() | ~F.trim(raw).startswith("{"), clip(raw, 800)).when(nothing, clip(raw, 900))
    return F.struct(r["ok"].alias("ok"), *(clip(r[c], 300).alias(c) for c in names), hits.alias("results"), preview.alias("preview"))


def request_key(tool: Column, args: Column) -> Column:
    """Canonical key of a tool call: arguments but top_k, sorted by name, values squeezed in small letters."""
    kept = F.array_sort(F.map_entries(F.map_filter(args, lambda k, v: k != "top_k")))
    value = lambda v: F.lower(F.trim(F.regexp_replace(v, r"\s+", " ")))
    return F.concat_ws("|", tool, F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), "|"))


def chunk_id(doc: Column, node: Column, hit: Column, first: Column) -> Column:
    p = F.coalesce(hit, first)
    return F.when(doc.isNotNull() & node.isNotNull() & p.isNotNull(), F.concat_ws("/", doc.cast("string"), node.cast("string"), p.cast("string")))


def normalised(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x)) + 1e-12
    return F.transform(vector, lambda x: x.cast("double") / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal_key(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]", "")
