"""Routing of questions to documents by their names, and to sections by their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import periods
from quarry.functions.text import title_parts
from quarry.operators.blocks import best_of_terms, in_order, term_blocks
from quarry.operators.retrieval import top_k
from quarry.sources.tables import scratch_table, small

#: Words of names that say little; short names that stand for others; words of headings that say nothing.
GENERIC = ("annual", "report", "quarter", "quarterly", "fiscal", "year", "the", "what", "which", "how", "was", "were", "is", "are", "10k", "10q", "20f", "8k")
SHORT_NAMES = {"jnj": ["johnson"], "jpm": ["jpmorgan"]}
FACETS = ("by_name", "by_year", "by_quarter", "by_filing", "by_date")
HEADING_GENERIC = ("the", "a", "an", "of", "to", "for", "and", "or", "in", "on", "what", "which", "how", "is", "are", "was", "were", "fy")


def _question_parts(text: Column | str) -> Column:
    parts = title_parts(text)
    more = [F.when(F.array_contains(parts, short), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for short, names in SHORT_NAMES.items()]
    return F.concat(parts, *more)


def route_titles(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ok, doc_id, source_name, score, matched_terms, rank) of queries (query_id, query) over document names.

    A name's components count where the question, written without gaps, holds them: 0.5 if generic, 2 for a year, 10 for
    a word, 8 for letters and digits, else 1; its other parts that are words of the question count 2 or 1; a name that
    stands there as a whole counts 5 more. A question without letters or digits gives one row, not ok. Components are
    found by joining them with the stretches of the question that are as long; names are scored in blocks within a task.
    """
    q = queries.select("query_id", _question_parts("query").alias("parts")).withColumn("compact", F.array_join("parts", ""))
    low = F.lower("source_name")
    comps, parts, full = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0)), F.array_distinct(title_parts(low)), F.array_join(title_parts(low), "")
    # what a name can be found by, its kind in front: c a component, p a part that is none, f the name without gaps
    kinds = F.concat(F.transform(comps, lambda x: F.concat(F.lit("c"), x)), F.transform(F.array_except(parts, comps), lambda x: F.concat(F.lit("p"), x)), F.filter(F.array(F.concat(F.lit("f"), full)), lambda x: x != "f"))
    names = docs.select("doc_id", F.lit(0).alias("p_idx"), "source_name", kinds.alias("t"))
    words = names.select(F.explode("t").alias("term")).distinct()
    sizes = words.where("term not like 'p%'").select((F.length("term") - 1).alias("n")).distinct()  # a few dozen numbers
    spans = q.select("query_id", "compact").join(F.broadcast(sizes), F.col("n") <= F.length("compact"))
    spans = spans.select("query_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("compact") - F.col("n") + 1), lambda i: F.substr("compact", i, F.col("n"))))).alias("w"))
    w = F.col("w")
    year = w.rlike("^[0-9]{4}$")
    weight = F.when(w.isin(*GENERIC), 0.5).when(year, 2.0).when(w.rlike("^[a-z]{3,}$"), 10.0).when(w.rlike("[a-z]"), 8.0).otherwise(1.0)
    whole = spans.select("query_id", F.concat(F.lit("c"), w).alias("term"), weight.alias("weight")).unionByName(spans.select("query_id", F.concat(F.lit("f"), w).alias("term"), F.lit(5.0).alias("weight")))
    weight = F.when(year, 2.0).when(~w.isin(*GENERIC) & (F.length(w) >= 2), 1.0).otherwise(0.0)
    single = q.select("query_id", F.explode(F.array_distinct("parts")).alias("w")).select("query_id", F.concat(F.lit("p"), w).alias("term"), weight.alias("weight"))
    terms = scratch_table(whole.unionByName(single).join(words, "term", "left_semi").select("query_id", "term", "weight"), "terms")
    k = max(1, min(k, 20))
    s = best_of_terms(in_order(names), list(term_blocks(terms)), terms.schema["query_id"].dataType, k, lambda tf, size: 1.0 * (tf > 0), 3, ["source_name", "doc_id"])
    best = scratch_table(top_k(s, k, "source_name", "doc_id").select("query_id", "doc_id", "source_name", "score", "rank"), "best")
    found = names.join(small(best.select("query_id", "doc_id")), "doc_id").select("query_id", "doc_id", F.explode("t").alias("term")).join(terms.where("term not like 'f%'"), ["query_id", "term"])
    found = found.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.substr("term", F.lit(2)))).alias("matched_terms"))
    best = best.join(found, ["query_id", "doc_id"]).select("query_id", "doc_id", "source_name", "score", "matched_terms", "rank")
    return q.select("query_id", (F.col("compact") != "").alias("ok")).join(best, "query_id", "left").where("not ok or rank is not null")


def search_headings(queries: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ok, doc_id, node_id, title, score, matched_terms, rank): queries (query_id, query, doc_id) over the headings
    (doc_id, node_id, title) of their document.

    Parts of a heading that the question has, or holds without gaps if they have four letters, count 1, or 2 from six
    letters on; 4 more if heading or question, without gaps, holds the other. An unknown document, or a question without
    letters or digits, gives one row, not ok.
    """
    q = queries.select("query_id", "doc_id", title_parts("query").alias("q")).withColumn("qc", F.array_join("q", ""))
    h = nodes.select("doc_id", "node_id", "title", F.array_sort(F.array_distinct(title_parts("title"))).alias("t"), F.array_join(title_parts("title"), "").alias("tc"))
    known = q.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id").withColumn("known", F.lit(True))
    s = q.where("qc <> ''").join(h.where("tc <> ''"), "doc_id")
    matched = F.filter("t", lambda x: ~x.isin(*HEADING_GENERIC) & (F.array_contains("q", x) | ((F.length(x) >= 4) & F.col("qc").contains(x))))
    s = s.withColumn("matched_terms", matched)
    score = F.aggregate("matched_terms", F.lit(0.0), lambda a, x: a + F.when(F.length(x) >= 6, 2.0).otherwise(1.0))
    s = s.withColumn("score", score + F.when(F.col("qc").contains(F.col("tc")) | F.col("tc").contains(F.col("qc")), 4.0).otherwise(0.0)).where("score > 0")
    best = top_k(s.select("query_id", "doc_id", "node_id", "title", "score", "matched_terms"), max(1, min(k, 20)), "title", "node_id")
    ok = q.join(known, "query_id", "left").select("query_id", (F.coalesce("known", F.lit(False)) & (F.col("qc") != "")).alias("ok"))
    return ok.join(best, "query_id", "left").where("not ok or rank is not null")


def _squeezed(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def document_facets(docs: DataFrame, dated: bool = True) -> DataFrame:
    """Adds to documents (doc_id, source_name) what their names say: name, aliases, years, quarters, filing, dates."""
    both = F.concat_ws(" ", "doc_id", "source_name")
    own, other = periods.name_tokens("doc_id", dated), periods.name_tokens("source_name", dated)
    tokens = F.when((F.size(own) > 0) & ~periods.is_generic_name("doc_id", dated), own).when(F.size(other) > 0, other).otherwise(own)
    low = F.array_distinct(F.transform(tokens, F.lower))
    kind = periods.filing(both) if dated else periods.filing_undated(both)
    out = docs.select("doc_id", "source_name", low.alias("tokens"), periods.years(both).alias("years"), periods.quarters(both).alias("quarters"), kind.alias("filing"), periods.dates(both).alias("dates"))
    name = _squeezed(F.when(F.size("tokens") > 0, F.array_join("tokens", " ")).otherwise(F.col("doc_id")))
    return out.withColumn("name", name).withColumn("aliases", periods.aliases(F.transform("tokens", _squeezed)))


def question_facets(queries: DataFrame, dated: bool = True) -> DataFrame:
    """Adds to queries (query_id, query) the same of what they ask."""
    q = F.col("query")
    kind = periods.filing(q) if dated else periods.filing_undated(q, question=True)
    return queries.select(
        "query_id", periods.years(q).alias("q_years"), periods.quarters(q, words=True).alias("q_quarters"), kind.alias("q_filing"), periods.dates(q).alias("q_dates"),
        _squeezed(q).alias("q_text"), F.regexp_extract_all(F.lower(q), F.lit("[a-z0-9]+"), 0).alias("q_tokens"), periods.proper_tokens(q).alias("q_proper"),
    )


def _keys(*pairs: tuple[str, Column]) -> Column:
    """All (how, key) of some arrays of keys."""
    pair = lambda how: lambda x: F.struct(F.lit(how).alias("how"), x.cast("string").alias("key"))
    return F.explode(F.concat(*(F.transform(F.array_distinct(keys), pair(how)) for how, keys in pairs)))


def _long(keys: Column, n: int) -> Column:
    return F.filter(keys, lambda x: F.length(x) >= n)


def _prefixes(word: Column, least: int) -> Column:
    return F.when(F.length(word) >= least, F.transform(F.sequence(F.lit(least), F.greatest(F.length(word), F.lit(least))), lambda n: F.left(word, n))).otherwise(F.array().cast("array<string>"))


class FacetRouting:
    """Questions and documents as what their names and texts say, joined by keys and never pair by pair.

    Documents of the same name share a name group, those of the same periods, filing and dates a class. Questions meet
    the groups by stretches of text, words and prefixes, and the classes by the periods, filings and months that they
    share. Within a group and class documents only differ in doc_id, so the first k of each are enough: k of every class
    a question meets, k of every class of a name it meets, and the first k of all.
    """

    def __init__(self, queries: DataFrame, docs: DataFrame, dated: bool = True):
        self.dated = dated
        f = document_facets(docs, dated)
        digest = lambda *c: F.sha1(F.to_json(F.struct(*c)).cast("binary"))
        self.docs = scratch_table(f.withColumn("group", digest("name", "aliases", "tokens")).withColumn("class", digest("years", "quarters", "filing", "dates")), "facets")
        self.questions = scratch_table(question_facets(queries, dated), "questions")
        self.groups = scratch_table(self.docs.groupBy("group").agg(F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("name", "aliases", "tokens"))), "groups")
        self.classes = scratch_table(self.docs.groupBy("class").agg(F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("years", "quarters", "filing", "dates"))), "classes")
        self.both = scratch_table(self.docs.groupBy("group", "class").agg(F.count("*").alias("n")), "both")
        self.named = scratch_table(self._named(), "named")
        self.met = scratch_table(self._met(), "met")

    def _named(self) -> DataFrame:
        """(query_id, group) of the names that questions hold."""
        name, proper = F.col("name"), F.col("q_proper")
        one = F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))
        g = self.groups.where("name <> ''")
        if self.dated:
            keys = (("text", F.concat(_long(one, 3), _long(F.col("aliases"), 2))), ("token", one), ("proper", _long(F.col("aliases"), 2)), ("begins", _prefixes(name, 3)), ("begun", one))
        else:
            keys = (("text", _long(one, 3)), ("token", one))
        own = scratch_table(g.select("group", _keys(*keys).alias("k")).select("group", "k.*"), "names")
        sizes = own.where("how = 'text'").select(F.length("key").alias("n")).distinct()  # a few dozen numbers
        spans = self.questions.select("query_id", "q_text").join(F.broadcast(sizes), F.col("n") <= F.length("q_text"))
        spans = spans.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("q_text") - F.col("n") + 1), lambda i: F.substr("q_text", i, F.col("n")))).alias("key")).distinct()
        asked = [("token", F.col("q_tokens"))]
        if self.dated:
            long = _long(proper, 3)
            asked += [("proper", proper), ("begins", long), ("begun", F.flatten(F.transform(long, lambda p: _prefixes(p, 1))))]
        q = self.questions.select("query_id", _keys(*asked).alias("k")).select("query_id", "k.*").unionByName(spans.select("query_id", F.lit("text").alias("how"), "key"))
        out = q.join(own, ["how", "key"]).select("query_id", "group")
        if not self.dated:  # or all words of the name, in any order
            words = g.select("group", F.size(F.array_distinct(F.transform("tokens", _squeezed))).alias("n"), F.explode(F.array_distinct(F.transform("tokens", _squeezed))).alias("w"))
            said = self.questions.select("query_id", F.explode(F.array_distinct("q_tokens")).alias("w"))
            out = out.unionByName(words.join(said, "w").groupBy("query_id", "group").agg(F.count("*").alias("k"), F.any_value("n").alias("n")).where("k = n").select("query_id", "group"))
        return out.distinct()

    def _met(self) -> DataFrame:
        """(query_id, class, by_year, by_quarter, by_filing, by_date) of the classes that questions share anything with."""
        month = lambda dates: F.transform(dates, lambda x: x["y"] * 100 + x["m"])
        keys = lambda p: _keys(("y", F.col(f"{p}years")), ("q", F.col(f"{p}quarters")), ("f", F.array_compact(F.array(f"{p}filing"))), *([("d", month(F.col(f"{p}dates")))] if self.dated else []))
        own = self.classes.select("class", keys("").alias("k")).select("class", "k.*")
        asked = self.questions.select("query_id", keys("q_").alias("k")).select("query_id", "k.*")
        pairs = asked.join(own, ["how", "key"]).select("query_id", "class").distinct()
        return self._flagged(pairs).select("query_id", "class", "by_year", "by_quarter", "by_filing", "by_date")

    def _flagged(self, pairs: DataFrame) -> DataFrame:
        """Adds to (query_id, class, ...) what both say and which of it they share; null where the question leaves it open."""
        shared = lambda a, b: F.when(F.size(b) > 0, F.arrays_overlap(a, b))
        p = pairs.join(self.classes.drop("n"), "class").join(self.questions.select("query_id", "q_years", "q_quarters", "q_filing", "q_dates"), "query_id")
        date = periods.dates_meet(F.col("q_dates"), F.col("dates")) if self.dated else F.lit(False)
        return p.withColumns({
            "by_year": shared(F.col("years"), F.col("q_years")), "by_quarter": shared(F.col("quarters"), F.col("q_quarters")),
            "by_filing": F.when(F.col("q_filing").isNotNull(), F.coalesce(F.col("filing") == F.col("q_filing"), F.lit(False))), "by_date": date,
        })

    def _first(self, k: int, *by: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))
        return self.docs.select("doc_id", "source_name", "group", "class").withColumn("_n", n).where(F.col("_n") <= k).drop("_n")

    def ranked(self, k: int = 5) -> DataFrame:
        """(query_id, doc_id, source_name, score, match_count, reasons, rank)."""
        own = ["query_id", "doc_id", "source_name", "group", "class"]
        by_class = self.met.select("query_id", "class").join(self._first(k, "class"), "class").select(*own)
        by_name = self.named.join(self._first(k, "group", "class"), "group").select(*own)
        first = self.docs.select("doc_id", "source_name", "group", "class").orderBy("doc_id").limit(k)
        every = self.questions.select("query_id").crossJoin(F.broadcast(first)).select(*own)  # k rows
        found = by_class.unionByName(by_name).unionByName(every).distinct()
        found = found.join(self.named.withColumn("by_name", F.lit(True)), ["query_id", "group"], "left").fillna(False, ["by_name"])
        pairs = self._flagged(found).join(self.groups.select("group", "tokens"), "group")
        half = lambda c, x: F.when(F.col(c).isNull(), x / 2).when(F.col(c), x).otherwise(0.0)
        score = F.when(F.col("by_name"), 3.0).otherwise(0.0) + half("by_year", 1.5) + half("by_quarter", 1.0) + half("by_filing", 1.0) + F.when(F.col("by_date"), 2.0).otherwise(0.0)
        count = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in FACETS), F.lit(0))
        said = lambda c, text: F.when(F.col(c), text)
        least = lambda a, b: F.array_min(F.array_intersect(a, b)).cast("string")
        reasons = F.array_compact(F.array(
            said("by_name", F.concat(F.lit("company="), F.array_join("tokens", " "))), said("by_year", F.concat(F.lit("year="), least("years", "q_years"))), said("by_quarter", F.concat(F.lit("quarter="), least("quarters", "q_quarters"))),
            said("by_filing", F.concat(F.lit("filing_type="), "filing")), said("by_date", F.concat(F.lit("date="), periods.date_text(F.col("dates")[0]))),
        ))
        scored = pairs.withColumn("score", F.round(score, 4)).withColumn("match_count", count)
        order = [F.desc("score"), *([F.desc("match_count")] if self.dated else []), "doc_id"]
        out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
        out = out.withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("no strong match"))))
        return out.select("query_id", "doc_id", "source_name", "score", "match_count", "reasons", "rank")

    def _strong(self) -> DataFrame:
        """(query_id, group, class, strong) of the documents that a question names; strong ones share something else too."""
        any_ = F.greatest(*(F.coalesce(c, F.lit(False)) for c in FACETS[1:]))
        p = self.named.join(self.both, "group").join(self.met.select("query_id", "class", any_.alias("strong")), ["query_id", "class"], "left")
        return p.fillna(False, ["strong"])

    def coverage(self) -> DataFrame:
        """(query_id, n_documents, n_by_name, n_by_year, n_by_quarter, n_by_filing, n_by_date, n_strong), from the sizes of groups and classes."""
        total = self.groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"))
        some = lambda c, name: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(name)
        by_name = self.named.join(self.groups.select("group", "n"), "group").groupBy("query_id").agg(F.sum("n").alias("n_by_name"))
        met = self.met.join(self.classes.select("class", "n"), "class").groupBy("query_id").agg(*(some(c, f"n_{c}") for c in FACETS[1:]))
        strong = self._strong().groupBy("query_id").agg(some("strong", "n_strong"))
        out = self.questions.select("query_id").crossJoin(F.broadcast(total)).join(by_name, "query_id", "left").join(met, "query_id", "left").join(strong, "query_id", "left")
        return out.fillna(0).select("query_id", "n_documents", *(f"n_{c}" for c in FACETS), "n_strong")

    def matches(self) -> DataFrame:
        """(query_id, doc_id, strong): a row for each document that a question names."""
        return self._strong().select("query_id", "group", "class", "strong").join(self.docs.select("doc_id", "group", "class"), ["group", "class"]).select("query_id", "doc_id", "strong")


def route_facets(queries: DataFrame, docs: DataFrame, k: int = 5, dated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Ranked documents of each question, and how many documents each facet matches.

    The first table is (query_id, doc_id, source_name, score, match_count, reasons, rank): 3 for the name, 1.5 for a year, 1
    for a quarter, 1 for the kind of filing, 2 for a date; a facet that the question leaves open counts half (a date
    nothing). Without `dated` dates count for nothing, a name has to be there as a whole or in all its words, and ties go
    by document alone. The second is (query_id, n_documents, counts of matches, n_strong): strong documents match the name
    and something else.
    """
    routing = FacetRouting(queries, docs, dated)
    return routing.ranked(k), routing.coverage()
