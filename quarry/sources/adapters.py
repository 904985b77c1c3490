"""Question data sets as one shape: sample_id, question, golds, evidence, category, and what else a set has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.datasets import non_blank

#: The fields that the data sets' files have.
FINANCE = "financebench_id string, doc_name string, company string, question string, answer string, question_type string, question_reasoning string, justification string, evidence array<struct<evidence_text:string,doc_name:string>>"
PAPER = "struct<title:string,abstract:string,full_text:array<struct<section_name:string,paragraphs:array<string>>>,figures_and_tables:array<struct<caption:string,file:string>>,qas:array<struct<question:string,question_id:string,answers:array<struct<answer:struct<unanswerable:boolean,extractive_spans:array<string>,free_form_answer:string,yes_no:boolean,evidence:array<string>>>>>>>"
MULTI_HOP = "id string, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>"
SYLLABUS = ", ".join(f"{c} string" for c in ("id", "syllabus_name", "question_type", "question", "answer", *(f"answer_span_{i}" for i in range(1, 6)), *(f"reasoning_step_{i}" for i in range(1, 6))))
OPEN_DOMAIN = "id string, input string, passages array<struct<title:string,text:string>>, output array<struct<answer:string,selected_sentences:array<string>>>"
LEGAL = "tests array<struct<query:string,snippets:array<struct<file_path:string,span:array<int>,answer:string>>>>"
#: The answer that stands for none, and what joins several golds.
UNANSWERABLE, JOIN = "Not mentioned", "；"
_TEXTS = "array<string>"


def finance(rows: DataFrame) -> DataFrame:
    """One gold, the texts of the evidence, the kind of question as category."""
    meta = F.map_from_arrays(F.array(*map(F.lit, ("financebench_id", "company", "question_reasoning", "justification"))), F.array("financebench_id", "company", "question_reasoning", "justification"))
    return rows.select(
        F.col("doc_name").alias("sample_id"), "question", F.array("answer").alias("golds"), non_blank(F.transform("evidence", lambda e: e["evidence_text"])).alias("evidence"), F.col("question_type").alias("category"), meta.alias("metadata"),
    )


def papers(keyed: DataFrame) -> DataFrame:
    """Questions on papers (key, value); those that all annotators call unanswerable are left out.

    An annotator's answer is, in this order: unanswerable, the spans joined, free text, yes or no. Golds, evidence and
    kinds of answer are without repetition, in the order of annotators; the question begins with the paper's title.
    """
    q = keyed.select(F.col("key").alias("sample_id"), F.col("value.title").alias("title"), F.posexplode("value.qas").alias("place", "q"))
    answers = F.transform(F.coalesce("q.answers", F.array()), lambda a: a["answer"])
    q = q.withColumn("a", answers).where((F.size("a") > 0) & ~F.forall("a", lambda a: F.coalesce(a["unanswerable"], F.lit(False))))
    filled = lambda a: F.size(non_blank(a["extractive_spans"])) > 0
    kind = lambda a: F.when(F.coalesce(a["unanswerable"], F.lit(False)), "unanswerable").when(filled(a), "extractive").when(F.trim(a["free_form_answer"]) != "", "free_form").when(a["yes_no"].isNotNull(), "yes_no").otherwise("none")
    gold = lambda a: F.when(kind(a) == "unanswerable", UNANSWERABLE).when(kind(a) == "extractive", F.array_join(non_blank(a["extractive_spans"]), "; ")).when(kind(a) == "free_form", F.trim(a["free_form_answer"])).when(kind(a) == "yes_no", F.when(a["yes_no"], "Yes").otherwise("No"))
    return q.select(
        "sample_id", "place", F.col("q.question_id").alias("question_id"), F.concat_ws(": ", "title", "q.question").alias("question"), F.array_distinct(F.array_compact(F.transform("a", gold))).alias("golds"),
        F.array_distinct(F.flatten(F.transform("a", lambda a: non_blank(a["evidence"])))).alias("evidence"), F.array_distinct(F.transform("a", kind)).alias("answer_types"),
    )


def multi_hop(rows: DataFrame) -> DataFrame:
    """Evidence are the sentences at (title, sent_id) of the context; places that don't exist are left out."""
    facts = F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent"))
    at = lambda f: F.array_position(F.col("context.title"), f["title"])
    sentence = lambda f: F.when((at(f) > 0) & (f["sent_id"] >= 0), F.get(F.get(F.col("context.sentences"), at(f).cast("int") - 1), f["sent_id"]))
    facts = F.arrays_zip("supporting_facts.title", "supporting_facts.sent_id")
    return rows.select(F.col("id").alias("sample_id"), "question", F.array("answer").alias("golds"), non_blank(F.transform(facts, sentence)).alias("evidence"), F.col("type").alias("category"), "level")


def multi_hop_joined(rows: DataFrame) -> DataFrame:
    """(sample_id, title, sent_id, sentence): the same evidence by joins, for contexts that are a table of their own."""
    sentences = rows.select("id", F.explode(F.arrays_zip("context.title", "context.sentences")).alias("c")).select("id", F.col("c.title").alias("title"), F.posexplode("c.sentences").alias("sent_id", "sentence"))
    facts = rows.select("id", F.explode(F.arrays_zip("supporting_facts.title", "supporting_facts.sent_id")).alias("f")).select("id", F.col("f.title").alias("title"), F.col("f.sent_id").alias("sent_id"))
    return facts.join(sentences, ["id", "title", "sent_id"]).select(F.col("id").alias("sample_id"), "title", "sent_id", "sentence")


def syllabus(rows: DataFrame) -> DataFrame:
    """Questions of the type "no answer" are left out; evidence are the spans, and the reasoning steps that aren't among them."""
    span, step = (F.filter(F.array(*(F.trim(f"{n}_{i}") for i in range(1, 6))), lambda x: x.isNotNull() & (x != "")) for n in ("answer_span", "reasoning_step"))
    fresh = F.array_except(step, span)
    kind = F.lower(F.trim("question_type"))
    return rows.where(kind != "no answer").select(F.col("id").alias("case_id"), F.col("syllabus_name").alias("sample_id"), "question", F.array("answer").alias("golds"), F.concat(span, fresh).alias("evidence"), F.col("question_type").alias("category"))


def open_domain(rows: DataFrame) -> DataFrame:
    """Golds are the answers that aren't blank, evidence all selected sentences, the title that of the first passage."""
    return rows.select(
        F.col("id").alias("sample_id"), F.col("input").alias("question"), non_blank(F.transform("output", lambda o: o["answer"])).alias("golds"),
        F.flatten(F.transform("output", lambda o: F.coalesce(o["selected_sentences"], F.array().cast(_TEXTS)))).alias("evidence"), F.get("passages", F.lit(0))["title"].alias("title"),
    )


def legal(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Tests of a subset (subset, tests); golds are all snippets' answers, evidence their spans of the texts (path, text), or the
    answer where the text is missing; the sample is the first snippet's file. Tests without snippets are left out."""
    t = files.select("subset", F.posexplode("tests").alias("place", "t")).where(F.size("t.snippets") > 0)
    s = t.select("subset", "place", F.posexplode("t.snippets").alias("k", "s")).join(texts.select(F.col("path").alias("file"), "text"), F.col("s.file_path") == F.col("file"), "left")
    span = F.substr("text", F.col("s.span")[0] + 1, F.greatest(F.col("s.span")[1] - F.col("s.span")[0], F.lit(0)))
    g = s.groupBy("subset", "place").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce(F.nullif(span, F.lit("")), "s.answer").alias("e")))).alias("l"))
    return t.join(g, ["subset", "place"]).select(
        F.element_at("t.snippets", 1)["file_path"].alias("sample_id"), "place", F.col("t.query").alias("question"), F.transform("t.snippets", lambda x: x["answer"]).alias("golds"), F.transform("l", lambda x: x["e"]).alias("evidence"), F.col("subset").alias("category"),
    )


def conversation_qa(qa: DataFrame, turns: DataFrame) -> DataFrame:
    """Questions (sample_id, place, question, answer, evidence array<string>, category) on turns (sample_id, dia_id, speaker, text).

    Category 5 is left out; an answer of any kind is a gold text; evidence ids, several with ; between, become "speaker: text",
    or stay as they are where no turn has them.
    """
    q = qa.where("category <> 5").withColumn("gold", F.col("answer").cast("string"))
    ids = q.select("sample_id", "place", F.posexplode_outer(F.flatten(F.transform("evidence", lambda e: F.split(e, r"\s*;\s*")))).alias("k", "dia_id")).where("trim(dia_id) <> ''")
    found = ids.join(turns.select("sample_id", "dia_id", F.concat_ws(": ", "speaker", "text").alias("said")), ["sample_id", "dia_id"], "left")
    g = found.groupBy("sample_id", "place").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("said", "dia_id").alias("e")))).alias("l"))
    out = q.join(g, ["sample_id", "place"], "left")
    return out.select("sample_id", "place", "question", F.array("gold").alias("golds"), F.coalesce(F.transform("l", lambda x: x["e"]), F.array().cast(_TEXTS)).alias("evidence"), "category")


def canonical_cases(samples: DataFrame, case_id: Column | None = None) -> DataFrame:
    """(case_id, source_id, question, gold, excerpts, category) of adapted samples; the id is the one given, or sample#place.

    Golds are joined, excerpts are the first two pieces of evidence.
    """
    own = case_id if case_id is not None else F.concat_ws("#", "sample_id", F.col("place").cast("string"))
    category = F.col("category").cast("string") if "category" in samples.columns else F.lit(None).cast("string")
    return samples.select(own.alias("case_id"), F.col("sample_id").alias("source_id"), "question", F.array_join("golds", JOIN).alias("gold"), F.slice("evidence", 1, 2).alias("excerpts"), category.alias("category"))


def subset(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """Documents (doc_id, qa array<struct<case_id,...>>) with wanted cases (case_id) alone; those left without any go."""
    q = docs.select("doc_id", F.posexplode("qa").alias("place", "q")).join(cases.select(F.col("case_id").alias("wanted")).distinct(), F.col("q.case_id") == F.col("wanted"), "left_semi")
    return q.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "q"))).alias("l")).select("doc_id", F.transform("l", lambda x: x["q"]).alias("qa"))


def required_documents(questions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (title) that questions (title) need and that are there, and the needed titles that aren't.

    The first table raises an error when it is read if nothing that is needed is there.
    """
    needed = questions.select("title").where("title is not null").distinct()
    there = docs.join(needed, "title", "left_semi")
    some = there.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("none of the needed documents is there"))).alias("n_required"))
    return there.crossJoin(F.broadcast(some)), needed.join(docs.select("title").distinct(), "title", "left_anti")


def article_markdown(articles: DataFrame) -> DataFrame:
    """(title, markdown) of articles (title, text array<array<string>>): paragraphs of sentences, blank ones left out."""
    paragraphs = F.filter(F.transform("text", lambda p: F.trim(F.array_join(p, " "))), lambda x: x != "")
    return articles.select("title", F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.array_join(paragraphs, "\n\n")).alias("markdown"))


def paper_markdown(keyed: DataFrame) -> DataFrame:
    """(sample_id, markdown) of papers: title, id, abstract, sections, and numbered captions of figures and tables."""
    v = F.col("value")
    section = lambda s: F.concat_ws("\n\n", F.concat(F.lit("## "), F.coalesce(s["section_name"], F.lit("Section"))), F.array_join(non_blank(s["paragraphs"]), "\n\n"))
    figure = lambda c: F.coalesce(c["file"].contains("Figure") | F.lower(c["caption"]).contains("figure"), F.lit(False))
    caption = lambda c, i: F.concat(F.when(figure(c), "**Figure ").otherwise("**Table "), (i + 1).cast("string"), F.lit("**: "), F.coalesce(c["caption"], F.lit("")))
    parts = F.array_compact(F.array(
        F.concat(F.lit("# "), v["title"]), F.concat(F.lit("Paper ID: "), "key"), F.when(F.trim(v["abstract"]) != "", F.concat(F.lit("## Abstract\n\n"), v["abstract"])),
        F.nullif(F.array_join(F.transform(F.coalesce(v["full_text"], F.array()), section), "\n\n"), F.lit("")), F.nullif(F.array_join(F.transform(F.coalesce(v["figures_and_tables"], F.array()), caption), "\n\n"), F.lit("")),
    ))
    return keyed.select(F.col("key").alias("sample_id"), F.array_join(parts, "\n\n").alias("markdown"))


def contract_markdown(texts: DataFrame) -> DataFrame:
    """(doc_id, markdown) of contracts (doc_id, title, text): the first rule that fits a line makes it a heading or an item.

    All capitals: second level; Article or Section: third; numbered: third; (a): an item of a list. Blank lines are squeezed.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))  # F.trim itself would take a line's number as what to trim
    capitals = lambda x: (F.length(x) > 3) & x.rlike("[A-Z]") & ~x.rlike("[a-z]")
    made = F.transform(
        lines, lambda x: F.when(x == "", x).when(capitals(x), F.concat(F.lit("## "), x)).when(x.rlike(r"(?i)^(article|section)\s+\S+"), F.concat(F.lit("### "), x)).when(x.rlike(r"^\d+(\.\d+)*\.?\s+\S"), F.concat(F.lit("### "), x)).when(x.rlike(r"^\([a-z0-9]+\)\s"), F.concat(F.lit("- "), x)).otherwise(x)
    )
    body = F.regexp_replace(F.array_join(made, "\n"), r"\n{3,}", "\n\n")
    return texts.select("doc_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.trim(body)).alias("markdown"))


def wiki_markdown(text: Column | str) -> Column:
    """Running text of an encyclopedia as Markdown: white space squeezed, its list of contents a heading, a blank line before headings."""
    t = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " "))
    t = F.regexp_replace(t, r"Contents\s*\(\s*hide\s*\)", "## Contents ( hide )\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*## ", "\n\n## "), r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit("\n"))


def plain_answer(raw: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, r"^\s+|\s+$", ""))
