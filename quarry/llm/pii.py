"""PII: format-preserving Feistel pseudonyms, in DataFrame functions alone.

Candidates are found by one pattern and validated (Luhn, mod 97, octets, calendar, number plans). A validated number
or date is a point in a product of two ranges; alternate keyed additions modulo each range permute the product, so the
result keeps the format, stays valid, and equal values get equal pseudonyms in every document. Dates walk on along
the permutation until they keep their kind of writing. Strings (mail names, account letters, secrets) are permuted
character by character within their alphabet, each half shifted by a keyed hash of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import column as own
from quarry.llm.common import read_table, spare

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: The name of a secret with its sign; the name may end a quoted one, as in JSON.
NAMED = r"(?i:api_?key|token|secret|password)[\"']?[ \t]*+[=:][ \t]*+"
#: In quotes of either kind; without any, only what holds letters and digits and is no mail address.
SECRET = NAMED + r"(?:\"[^\"\s]{8,}+\"|'[^'\s]{8,}+'|(?=[^\s\"',;)}\]@]*+(?!@))(?=[^\s\"',;)}\]@]*?[0-9])(?=[^\s\"',;)}\]@]*?[A-Za-z])[^\s\"',;)}\]@]{8,}+)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}(?: ?(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,6}(?: ?(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?<mark>[/.])[0-9]{1,2}\k<mark>[0-9]{4})(?![0-9])"
SSN = r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
PHONE = r"(?:(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4})(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{1,4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
ANY = "|".join((EMAIL, SECRET, IBAN, IP, DATE, SSN, PHONE, CARD))
KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "phone", "card")
_DAYS = (365, 366)  # dates are permuted within spans of their product of days, counted from 1800-01-01
_SPAN = _DAYS[0] * _DAYS[1]


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _feistel(key: str, tag: Column | str, left: Column, right: Column, a: int | Column, b: int | Column, rounds: int = 8) -> Column:
    """Permutes the pairs (left of a, right of b); a struct of l and r."""
    a, b, tag = (x if isinstance(x, Column) else F.lit(x) for x in (a, b, tag))
    a, b = a.cast("long"), b.cast("long")

    def step(s: Column, i: Column) -> Column:
        word = lambda x: F.conv(F.substring(_hash(key, tag, a, b, i, x), 1, 15), 16, 10).cast("long")
        return F.when(i % 2 == 1, F.struct(F.pmod(s["l"] + word(s["r"]), a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), F.pmod(s["r"] + word(s["l"]), b).alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _shift(s: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """Moves each character within its alphabet by the numbers of a hex digest."""

    def one(i: Column) -> Column:
        c = F.substr(s, i, F.lit(1))
        k = F.conv(F.substr(by, F.pmod(i - 1, F.lit(31)) * 2 + 1, F.lit(4)), 16, 10).cast("int")
        out = c
        for x in alphabets:
            at = F.instr(F.lit(x), c)
            out = F.when(at > 0, F.substr(F.lit(x), F.pmod(at - 1 + k, F.lit(len(x))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(s) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), one), ""))


_LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _string(key: str, tag: str, s: Column, alphabets: tuple[str, ...] = _LETTERS) -> Column:
    """Permutes the strings of one format; letters keep their case, which makes no difference to the result.

    A long string is permuted 128 characters at a time, each stretch by its place, so that the work stays in proportion.
    """

    def stretch(c: Column, place: Column) -> Column:
        half = F.floor(F.length(c) / 2).cast("int")
        start = F.struct(F.substr(c, F.lit(1), half).alias("l"), F.substr(c, half + 1, F.lit(128)).alias("r"))

        def step(x: Column, i: Column) -> Column:
            digest = lambda y: _hash(key, F.lit(tag), place, F.length(c), i, F.lower(y))
            return F.when(i % 2 == 1, F.struct(_shift(x["l"], digest(x["r"]), alphabets).alias("l"), x["r"].alias("r"))).otherwise(
                F.struct(x["l"].alias("l"), _shift(x["r"], digest(x["l"]), alphabets).alias("r"))
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda x: F.concat(x["l"], x["r"]))

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s).{1,128}"), 0), stretch), "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _number(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(0))


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _written(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    at = lambda i: F.length(_digits(F.substr(m, F.lit(1), i)))
    one = lambda i: F.when(F.substr(m, i, F.lit(1)).between("0", "9"), F.substr(digits, at(i), F.lit(1))).otherwise(F.substr(m, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


def _luhn(d: Column) -> Column:
    """The Luhn sum of a digit string modulo 10."""
    n = F.length(d)

    def add(s: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        return s + F.when(F.pmod(n - i, F.lit(2)) == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def _mod97(s: Column) -> Column:
    """A string of digits and capital letters (A is 10) modulo 97."""

    def add(r: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substr(s, i, F.lit(1))) - 1
        return F.pmod(F.when(v > 9, r * 100 + v).otherwise(r * 10 + v), F.lit(97))

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _halves(key: str, tag: Column | str, d: Column) -> Column:
    """Permutes the digit strings of one length (18 at most)."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    p = _feistel(key, tag, _number(F.substr(d, F.lit(1), u)), _number(F.substr(d, u + 1, F.lit(18))), F.pow(F.lit(10), u), F.pow(F.lit(10), n - u))
    return F.concat(F.when(u > 0, _pad(p["l"], u)).otherwise(F.lit("")), _pad(p["r"], n - u))


def _card(key: str, m: Column) -> Column:
    """Keeps the length, the first digit and the Luhn check."""
    d = _digits(m)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _halves(key, F.concat(F.lit("card"), F.substr(d, F.lit(1), F.lit(1))), F.substr(d, F.lit(2), F.length(d) - 2)))
    return F.transform(F.array(body), lambda b: _written(m, F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))[0]


def _phone(key: str, m: Column) -> Column:
    """North American numbers keep the country code and a valid area code; others keep their first two digits."""
    d = _digits(m)
    american = (F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))
    ten = F.right(d, F.lit(10))
    fine = american & (F.substr(ten, F.lit(1), F.lit(1)) >= "2")
    p = _feistel(key, "phone", _number(F.left(ten, F.lit(3))) - 200, _number(F.right(ten, F.lit(7))), 800, 10_000_000)
    new = F.when(fine, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), (p["l"] + 200).cast("string"), _pad(p["r"], 7)))
    return _written(m, new.otherwise(F.concat(F.left(d, F.lit(2)), _halves(key, "phones", F.substr(d, F.lit(3), F.lit(18))))))


def _ip(key: str, m: Column) -> Column:
    o = F.split(m, r"\.")
    p = _feistel(key, "ip", o[0].cast("int") * 256 + o[1].cast("int"), o[2].cast("int") * 256 + o[3].cast("int"), 65536, 65536)
    parts = lambda x: (F.floor(x / 256), F.pmod(x, F.lit(256)))
    return F.concat_ws(".", *(x.cast("string") for x in (*parts(p["l"]), *parts(p["r"]))))


def _ssn(key: str, m: Column) -> Column:
    area, rest = F.substr(m, F.lit(1), F.lit(3)).cast("int"), (F.substr(m, F.lit(5), F.lit(2)).cast("int") - 1) * 9999 + F.substr(m, F.lit(8), F.lit(4)).cast("int") - 1
    p = _feistel(key, "ssn", F.when(area > 666, area - 2).otherwise(area - 1), rest, 898, 99 * 9999)
    return F.concat_ws("-", _pad(F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1), 3), _pad(F.floor(p["r"] / 9999) + 1, 2), _pad(F.pmod(p["r"], F.lit(9999)) + 1, 4))


def _day(m: Column) -> Column:
    """The date that m writes, or null: year-month-day, else day and month, else month and day."""
    x = F.split(m, "[/.-]")
    make = lambda y, mo, d: F.try_make_timestamp(y.cast("int"), mo.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).cast("date")
    date = F.when(m.rlike("^[0-9]{4}-"), make(x[0], x[1], x[2])).otherwise(F.coalesce(make(x[2], x[1], x[0]), make(x[2], x[0], x[1])))
    return F.when(date.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")), date)


def _date(key: str, m: Column) -> Column:
    """Keeps the way of writing; day and month keep being told apart, or not, by a day over 12.

    A date moves within its span of some 366 years, so that it stays likely; in the first and the last one it walks on
    until the year has four digits.
    """
    iso, x, first = m.rlike("^[0-9]{4}-"), F.split(m, "[/.-]"), F.lit("1800-01-01").cast("date")
    span = F.floor(F.datediff(_day(m), first) / _SPAN)
    date = lambda n: F.date_add(first, (n + span * _SPAN).cast("int"))
    kind = lambda n: iso | (F.dayofmonth(date(n)) > 12)

    def walk(s: Column, _: Column) -> Column:
        p = _feistel(key, F.concat(F.lit("date"), span), F.floor(s["n"] / _DAYS[1]), F.pmod(s["n"], F.lit(_DAYS[1])), *_DAYS)
        n = p["l"] * _DAYS[1] + p["r"]
        moved = F.transform(F.array(n), lambda v: F.struct(v.cast("long").alias("n"), ((kind(v) == s["k"]) & F.year(date(v)).between(1, 9999)).alias("ok"), s["k"].alias("k")))[0]
        return F.when(s["ok"], s).otherwise(moved)

    start = F.transform(F.array(F.pmod(F.datediff(_day(m), first), F.lit(_SPAN)).cast("long")), lambda n: F.struct(n.alias("n"), F.lit(False).alias("ok"), kind(n).alias("k")))[0]
    day = F.aggregate(F.sequence(F.lit(1), F.lit(128)), start, walk, lambda s: date(s["n"]))
    width = lambda i, v: F.when(F.length(x[i]) == 2, _pad(v, 2)).otherwise(v.cast("string"))
    american = (x[1].cast("int") > 12) & ~iso
    mark = F.substr(F.regexp_replace(m, "[0-9]", ""), F.lit(1), F.lit(1))

    def written(v: Column) -> Column:
        d, mo, y = F.dayofmonth(v), F.month(v), _pad(F.year(v), 4)
        return F.when(iso, F.date_format(v, "yyyy-MM-dd")).when(american, F.concat(width(0, mo), mark, width(1, d), mark, y)).otherwise(F.concat(width(0, d), mark, width(1, mo), mark, y))

    return F.transform(F.array(day), written)[0]


def _iban(key: str, m: Column) -> Column:
    """Keeps country, length, spaces and the check; letters stay letters."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    body = _string(key, "iban", F.substr(s, F.lit(5), F.lit(40)))

    def whole(b: Column) -> Column:
        check = _pad(98 - _mod97(F.concat(b, F.left(s, F.lit(2)), F.lit("00"))), 2)
        t = F.concat(F.left(s, F.lit(2)), check, b)
        at = lambda i: F.length(F.replace(F.substr(m, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substr(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substr(t, at(i), F.lit(1)))), "")

    return F.transform(F.array(body), whole)[0]


def _secret(key: str, m: Column) -> Column:
    head = F.regexp_extract(m, f"^{NAMED}[\"']?", 0)
    quoted = F.right(head, F.lit(1)).isin('"', "'")
    inner = F.substr(m, F.length(head) + 1, F.length(m) - F.length(head) - quoted.cast("int"))
    new = F.when(inner.rlike("^[0-9a-f]+$"), _string(key, "hex", inner, ("0123456789abcdef",))).otherwise(_string(key, "secret", inner))
    return F.concat(head, new, F.when(quoted, F.right(head, F.lit(1))).otherwise(F.lit("")))


def _kind(m: Column) -> Column:
    """The kind of a candidate, or null if it isn't valid."""
    d, whole = _digits(m), lambda p: m.rlike(f"^(?:{p})$")
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    area = F.left(m, F.lit(3)).cast("int")
    iban = F.replace(m, F.lit(" "), F.lit(""))
    return (
        F.when(m.rlike(f"^{NAMED}"), "secret")
        .when(m.contains("@"), F.when(F.substring_index(m, "@", -1).rlike(r"\.[A-Za-z]{2,}(?:\.|$)"), "email"))
        .when(m.rlike("^[A-Z]"), F.when(F.length(iban).between(15, 34) & (_mod97(F.concat(F.substr(iban, F.lit(5), F.lit(40)), F.left(iban, F.lit(4)))) == 1), "iban"))
        .when(whole(IP), F.when(octets, "ip"))
        .when(whole(DATE), F.when(_day(m).isNotNull(), "date"))
        .when(whole(SSN), F.when((area > 0) & (area < 900) & (area != 666) & (F.substr(m, F.lit(5), F.lit(2)) != "00") & (F.right(m, F.lit(4)) != "0000"), "ssn"))
        .when(whole(PHONE), F.when(F.length(d).between(7, 15), "phone"))
        .when(whole(CARD), F.when(_luhn(d) == 0, "card"))
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Replaces personal data in a text column, and adds pii_kinds, the kinds replaced, in order of place.

    Null stays null, and has no kinds, like an empty text. Texts, secrets and mail names of any length are searched and
    replaced whole. Candidates that fail validation stay as they are. Each row is worked on by itself, so repeated rows
    come back as often and alike, and no rows give no rows. A column pii_kinds is replaced; all others stay, whatever
    their names. The key decides the permutation; keep it secret.
    """
    m, k = spare(docs, "_m"), spare(docs, "_k")
    found = docs.withColumn(m, F.coalesce(F.regexp_extract_all(own(column), F.lit(ANY), 0), F.array().cast("array<string>")))
    found, kinds = found.withColumn(k, F.transform(m, _kind)), F.col(k)

    def new(m: Column, i: Column) -> Column:
        k, at = kinds[i], F.instr(m, "@")
        return (
            F.when(k.isNull(), m).when(k == "card", _card(key, m)).when(k == "phone", _phone(key, m)).when(k == "ip", _ip(key, m)).when(k == "date", _date(key, m))
            .when(k == "email", F.concat(_string(key, "mail", F.substr(m, F.lit(1), at - 1)), F.substr(m, at, F.length(m))))
            .when(k == "secret", _secret(key, m)).when(k == "ssn", _ssn(key, m)).when(k == "iban", _iban(key, m)).otherwise(m)
        )

    text = F.array_join(F.zip_with(F.split(own(column), ANY, -1), F.transform(m, new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size(m) > 0, text).otherwise(own(column))
    return found.withColumn(column, text).withColumn("pii_kinds", F.filter(k, lambda x: x.isNotNull())).drop(m, k)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many values of each kind were replaced, of every document."""
    out = pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key="quarry")
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long")
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), *(count(k).alias(f"n_{k}") for k in KINDS))
