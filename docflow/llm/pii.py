"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by one pattern, checked (Luhn, octets, calendar, number plan), and
replaced by keyed permutations within their own format: a Feistel network in which
one half of the value, hashed with the key, is added to the other half, in turns. Equal
values get equal pseudonyms in all documents, different values different ones, and
whoever has the key can run the rounds backwards.

| kind   | valid                                           | permuted                                              |
|-|-|-|
| email  | local part up to 64, a top-level domain         | letters and digits before the top-level domain        |
| ip     | four octets                                     | the 32 bits                                           |
| card   | 13 to 19 digits, Luhn                           | all but the first digit; the check digit is set anew  |
| phone  | North American: area and exchange from 200      | area and exchange, line                               |
| ssn    | area not 000, 666, 9xx; group and serial not 0  | area and group, serial                                |
| date   | a day of 1800-01-01 to 2199-09-23, three formats | the day                                               |
| secret | access keys; password=, token=                  | letters and digits of the value                       |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[3-6](?:[0-9]{12,18}|[0-9]{3}(?:[ -][0-9]{4}){3}|[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?:[Pp]assword|[Tt]oken|[Ss]ecret) ?[=:] ?\"?[0-9A-Za-z]{8,128})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
#: No text without one of these holds a value.
HINT = r"[0-9]{2}|[0-9]\.[0-9]\.[0-9]\.[0-9]|@|[=:] ?\"?[0-9A-Za-z]{8}|AKIA"
KINDS = list(PATTERNS)
FIRST_DAY, YEARS, DAYS = "1800-01-01", 400, 365
DATES = ["yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy"]


def _prf(key: str, tag: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), half.cast("string")), 256)


def _rounds() -> Column:
    return F.array(*map(F.lit, range(ROUNDS)))


def permuted(key: str, tag: str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """struct<l, r>: left below a and right below b, permuted within these bounds."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (a, b))
    number = lambda i, half: F.conv(F.substring(_prf(key, tag, i, half), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        odd = F.struct(F.pmod(s["l"] + number(i, s["r"]), a).alias("l"), s["r"].alias("r"))
        even = F.struct(s["l"].alias("l"), F.pmod(s["r"] + number(i, s["l"]), b).alias("r"))
        return F.when(i % 2 == 0, odd).otherwise(even)

    return F.aggregate(_rounds(), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _shifted(half: Column, stream: Column) -> Column:
    """Each letter and digit moved within its class by two hexadecimal digits of the stream."""

    def move(c: Column, k: Column) -> Column:
        by = F.conv(F.substring(stream, (k % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        within = lambda first, n: F.char(F.lit(first) + (F.ascii(c) - first + by) % n)
        return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), move), "")


def permuted_text(key: str, tag: str, value: Column) -> Column:
    """A text's ASCII letters and digits permuted, each within its class."""
    h = F.floor(F.length(value) / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        odd = F.struct(_shifted(s["l"], _prf(key, tag, i, s["r"])).alias("l"), s["r"].alias("r"))
        even = F.struct(s["l"].alias("l"), _shifted(s["r"], _prf(key, tag, i, s["l"])).alias("r"))
        return F.when(i % 2 == 0, odd).otherwise(even)

    start = F.struct(F.substring(value, F.lit(1), h).alias("l"), F.substring(value, h + 1, F.length(value)).alias("r"))
    done = F.aggregate(_rounds(), start, step)
    return F.concat(done["l"], done["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits, the last of them counted once."""

    def add(total: Column, s: Column) -> Column:
        twice = s["d"] * 2
        return total + F.when(s["k"] % 2 == 0, s["d"]).when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.struct(c.try_cast("int").alias("d"), k.alias("k")))
    return F.aggregate(each, F.lit(0), add)


def _refilled(value: Column, digits: Column) -> Column:
    """value with its digits replaced in order."""

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["o"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("o"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), step)["o"]


def _padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _day(value: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))


def kind_of(value: Column) -> Column:
    """The kind of a value that ANY has found, or null if it isn't valid."""
    whole = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    days = F.coalesce(*(_day(value, f) for f in DATES))
    ssn = ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(whole("ip"), F.lit("ip"))
        .when(whole("date"), F.when(days.between(0, YEARS * DAYS - 1), F.lit("date")))
        .when(whole("ssn"), F.when(ssn, F.lit("ssn")))
        .when(whole("phone"), F.lit("phone"))
        .when(whole("card"), F.when(_luhn(_digits(value)) % 10 == 0, F.lit("card")))
        .when(whole("secret"), F.lit("secret"))
    )


def pseudonym(key: str, kind: Column, value: Column) -> Column:
    """What stands in for a valid value of that kind."""
    digits = _digits(value)
    at = lambda first, n: F.substring(digits, first, n).cast("long")
    # email: all before the last dot
    email = F.concat(permuted_text(key, "email", F.regexp_extract(value, r"^(.*)\.", 1)), F.regexp_extract(value, r"(\.[^.]*)$", 1))
    octet = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("long")
    ip = permuted(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536)
    ip = F.transform(F.array(ip), lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))[0]
    # card: the first digit, what lies between in two halves, the check digit
    n = F.length(digits) - 2
    h = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10), k).cast("long")
    inner = permuted(key, "card", F.substring(digits, F.lit(2), h).cast("long"), F.substring(digits, h + 2, n - h).cast("long"), power(h), power(n - h))
    payload = F.transform(F.array(inner), lambda s: F.concat(F.substring(digits, 1, 1), _padded(s["l"], h), _padded(s["r"], n - h)))
    card = F.transform(payload, lambda p: _refilled(value, F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))))[0]
    # phone: the last ten digits
    area, line = F.right(digits, F.lit(10)), F.right(digits, F.lit(4)).cast("long")
    phone = permuted(key, "phone", (F.substring(area, 1, 3).cast("long") - 200) * 800 + F.substring(area, 4, 3).cast("long") - 200, line, 640_000, 10_000)
    phone = F.transform(
        F.array(phone),
        lambda s: _refilled(value, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), F.floor(s["l"] / 800) + 200, s["l"] % 800 + 200, _padded(s["r"], 4))),
    )[0]
    ssn = permuted(key, "ssn", (at(1, 3) - F.when(at(1, 3) > 666, 2).otherwise(1)) * 99 + at(4, 2) - 1, at(6, 4) - 1, 898 * 99, 9999)
    ssn = F.transform(F.array(ssn), lambda s: F.concat_ws("-", _padded(F.floor(s["l"] / 99) + F.when(s["l"] >= 665 * 99, 2).otherwise(1), 3), _padded(s["l"] % 99 + 1, 2), _padded(s["r"] + 1, 4)))[0]

    def date(form: str) -> Column:
        day = _day(value, form)
        new = permuted(key, "date", F.floor(day / DAYS), day % DAYS, YEARS, DAYS)
        return F.transform(F.array(new), lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS + s["r"]).cast("int")), form))[0]

    secret = F.concat(F.regexp_extract(value, r'^(AKIA|.*[=:"] ?"?)', 1), permuted_text(key, "secret", F.regexp_extract(value, "^(?:AKIA)?.*?([0-9A-Za-z]+)$", 1)))
    secret = F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), permuted_text(key, "secret", F.substring(value, F.lit(5), F.length(value))))).otherwise(secret)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "date", F.when(value.contains("-"), date(DATES[0])).when(value.contains("."), date(DATES[1])).otherwise(date(DATES[2])))
        .when(kind == "ssn", ssn)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "secret", secret)
        .otherwise(value)
    )


def mask(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the valid values in text replaced, and _kinds, an array of the kind of each in order.

    Null text stays null with no kinds. Values that look alike but aren't valid stay.
    Other columns and repeated rows pass through; an empty table gives an empty result.
    The pattern runs in time linear in a text's length: all repeats that could be
    tried from many places are bounded.
    """
    body = F.col(text)
    hinted = body.rlike(HINT)
    values = F.when(hinted, F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    found = docs.withColumn("_values", values).withColumn("_found", F.transform("_values", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind"))))
    found = found.withColumn("_found", F.when(F.exists("_found", lambda f: f["kind"].isNotNull()), F.col("_found")))
    new = F.concat(F.transform("_found", lambda f: pseudonym(key, f["kind"], f["value"])), F.array(F.lit("")))
    masked = F.array_join(F.zip_with(F.split(body, ANY, -1), new, lambda between, value: F.concat(between, value)), "")
    kinds = F.coalesce(F.filter(F.col("_found.kind"), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return found.withColumn("_kinds", kinds).withColumn(text, F.when(F.col("_found").isNotNull(), masked).otherwise(body)).drop("_values", "_found")
