"""Column functions over periods, dates, kinds of filings and names in questions and document names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import _col

#: Months by their first three letters; numbers of quarters in words; words that belong to no name.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
QUARTERS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4}
NO_NAME = (
    "10", "8", "K", "Q", "10K", "10Q", "8K", "10-K", "10-Q", "8-K", "FY", "Q1", "Q2", "Q3", "Q4", "ANNUAL", "REPORT", "EARNINGS", "RELEASE", "SOURCE", "DOCUMENT", "FILE", "FILING", "PDF",
    "HTML", "TXT", "INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LLC", "PLC", "GROUP", "HOLDINGS", "THE", "AND", "OF", "FOR", "COM", "QUARTER", "QUARTERLY", "RESULTS", "PRESS",
    "STATEMENT",
)
#: More of these, where dates count.
NO_NAME_DATED = (
    "FORM", "ITEM", "PAGE", "CURRENT", "EXHIBIT", "EXHIBITS", "SEC", "COMMISSION", "UNITED", "STATES", "WASHINGTON", "DELAWARE", "JERSEY", "INCORPORATED", "DATED", "FILED",
)
_YEAR, _MONTH, _NTH = "((?:19|20)[0-9]{2})", rf"((?:{'|'.join(MONTHS)})[a-z]*\.?)", "([0-9]{1,2})(?:st|nd|rd|th)?"
#: Ways of writing a date, and which group of each is the year, the month and the day (0: none).
DATES = (
    (f"(?i)(?<![0-9]){_YEAR}[-_/](0?[1-9]|1[0-2])[-_/](0?[1-9]|[12][0-9]|3[01])(?![0-9])", 1, 2, 3), (f"(?i){_MONTH}[ ]+{_NTH},?[ ]+{_YEAR}", 3, 1, 2),
    (f"(?i){_NTH}[ ]+{_MONTH}[ ]+{_YEAR}", 3, 2, 1), (f"(?i){_MONTH}[ ]+{_YEAR}", 2, 1, 0),
)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), group), F.array().cast("array<string>"))


def _numbers(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.concat(*parts), lambda x: x.cast("int"))))


def years(text: Column | str) -> Column:
    """Four-digit years from 1900 on that stand alone, before a quarter, or behind FY or fiscal year; sorted."""
    t = _col(text)
    return _numbers(_all(t, "(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1), _all(t, "(?<![0-9])((?:19|20)[0-9]{2})[Qq][1-4](?![0-9])", 1), _all(t, "(?i)(?:FY|FISCAL(?:[ ]+YEAR)?[ ]+)((?:19|20)[0-9]{2})", 1))


def quarters(text: Column | str, words: bool = False) -> Column:
    """Quarters written as 2024Q2 or Q2, with `words` as second quarter or 2nd quarter too; sorted."""
    t = _col(text)
    out = [_all(t, "(?<![0-9])(?:19|20)[0-9]{2}[Qq]([1-4])(?![0-9])", 1), _all(t, "(?<![A-Za-z0-9])[Qq]([1-4])(?![0-9])", 1)]
    if words:
        said = F.array_compact(F.array(*(F.when(t.rlike(f"(?i){w}[ ]+quarter"), F.lit(str(n))) for w, n in QUARTERS.items())))
        out.append(said)
    return _numbers(*out)


def filing_undated(text: Column | str, question: bool = False) -> Column:
    """The kind of filing by the first metadata ranking: a question may say it in words before it names another form."""
    t = F.upper(_col(text))
    alone = lambda p: t.rlike(f"(?<![A-Za-z0-9]){p}(?![A-Za-z0-9])")
    k, q, e, annual, quarterly = alone("10-?K"), alone("10-?Q"), t.rlike("EARNINGS[ ]+RELEASE"), t.rlike("ANNUAL[ ]+REPORT"), t.rlike("QUARTERLY[ ]+REPORT")
    if question:
        return F.when(k | annual, "10-K").when(q | quarterly | t.rlike("QUARTER[ ]+ENDED"), "10-Q").when(alone("8-?K"), "8-K").when(e, "earnings")
    return F.when(k, "10-K").when(q, "10-Q").when(alone("8-?K"), "8-K").when(e, "earnings").when(annual, "10-K").when(quarterly, "10-Q")


def filing(text: Column | str) -> Column:
    """The kind of filing that a text names first in this order, or null."""
    t = F.upper(_col(text))
    alone = lambda p: t.rlike(f"(?<![A-Za-z0-9]){p}(?![A-Za-z0-9])")
    return (
        F.when(alone("10-?K"), "10-K").when(alone("10-?Q"), "10-Q").when(alone("8-?K"), "8-K").when(alone("EARNINGS"), "earnings")
        .when(alone("ANNUAL[ ]+REPORT"), "10-K").when(alone("QUARTERLY[ ]+REPORT"), "10-Q")
    )


def dates(text: Column | str) -> Column:
    """Sorted distinct (y, m, d) of the dates in a text; d is 0 where no day is named."""
    t = _col(text)

    def found(pattern: str, y: int, m: int, d: int) -> Column:
        months = _all(t, pattern, m)
        number = lambda x: F.coalesce(x.try_cast("int"), F.array_position(F.array(*map(F.lit, MONTHS)), F.left(F.lower(x), F.lit(3))).cast("int"))
        day = lambda i: F.get(_all(t, pattern, d), i).cast("int") if d else F.lit(0)
        return F.transform(_all(t, pattern, y), lambda x, i: F.struct(x.cast("int").alias("y"), number(F.get(months, i)).alias("m"), day(i).alias("d")))

    return F.array_sort(F.array_distinct(F.concat(*(found(*x) for x in DATES))))


def date_text(date: Column) -> Column:
    return F.when(date["d"] > 0, F.format_string("%04d-%02d-%02d", date["y"], date["m"], date["d"])).otherwise(F.format_string("%04d-%02d", date["y"], date["m"]))


def dates_meet(a: Column, b: Column) -> Column:
    """Whether two lists of dates share one; a date without a day meets all days of its month."""
    same = lambda x, y: (x["y"] == y["y"]) & (x["m"] == y["m"]) & ((x["d"] == y["d"]) | (x["d"] == 0) | (y["d"] == 0))
    return F.exists(a, lambda x: F.exists(b, lambda y: same(x, y)))


def without_dates(text: Column | str) -> Column:
    t = _col(text)
    for pattern, *_ in DATES:
        t = F.regexp_replace(t, pattern, " ")
    return F.regexp_replace(t, "(?i)dated", " ")


def name_tokens(text: Column | str, dated: bool = True) -> Column:
    """What is left of a document's name without periods, forms and common words; where dates count, without these and short numbers."""
    parts = F.split(without_dates(text) if dated else _col(text), "[^A-Za-z0-9]+")
    period = "^(?:(?:FY)?(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}Q[1-4]|Q[1-4]|(?:10|8)-?[KQ]" + ("|[0-9]{1,2})$" if dated else ")$")
    return F.filter(parts, lambda x: (x != "") & ~F.upper(x).rlike(period) & ~F.upper(x).isin(*NO_NAME, *(NO_NAME_DATED if dated else ())))


def is_generic_name(text: Column | str, dated: bool = True) -> Column:
    """Whether a document's name says nothing: a number, doc_12, or, where dates count, a few letters and digits."""
    short = "|[a-z]{1,4}[_-]?[0-9]{1,4}" if dated else ""
    return F.lower(F.trim(_col(text))).rlike(f"^(?:[0-9]*|(?:doc|document|file)[_-]?[0-9]*{short})$")


def aliases(tokens: Column) -> Column:
    """Other ways of writing a name of several small-letter tokens: joined, spaced, by initials, first and last."""
    first = F.transform(F.filter(tokens, lambda x: x != ""), lambda x: F.left(x, F.lit(1)))
    initials, last, n = F.array_join(first, ""), F.element_at(tokens, -1), F.size(tokens)
    more = F.array(
        initials, F.array_join(first, "n"), F.array_join(first, "and"), F.concat(tokens[0], F.lit("n"), last), F.concat(F.left(tokens[0], F.lit(1)), F.lit("n"), F.left(last, F.lit(1)))
    )
    out = F.concat(F.array(F.array_join(tokens, ""), F.array_join(tokens, " ")), F.when(F.length(initials) >= 2, more).otherwise(F.array().cast("array<string>")))
    return F.when(n > 0, F.array_distinct(out)).otherwise(F.array().cast("array<string>"))


def proper_tokens(question: Column | str) -> Column:
    """Distinct words of a question that hold a capital letter, in small letters, without periods."""
    words = F.regexp_extract_all(_col(question), F.lit("[A-Za-z0-9]+"), 0)
    fine = lambda x: x.rlike("[A-Z]") & ~x.rlike("(?i)^(?:FY|FISCAL|Q)[0-9]+$")
    return F.array_distinct(F.transform(F.filter(words, fine), F.lower))
