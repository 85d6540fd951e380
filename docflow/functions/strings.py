"""Column functions with the text rules that office documents need: Unicode trimming, strict numbers, cuts with a fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"[\s\p{Z}\x1c-\x1f]"


def ktrim(x: Column) -> Column:
    """x without white space of any kind at its ends."""
    return F.regexp_replace(x, f"^{SPACES}+|{SPACES}+$", "")


def is_blank(x: Column) -> Column:
    """True for white space only and for empty text; null for null."""
    return ktrim(x) == ""


def non_blank(x: Column) -> Column:
    """x, or null where it is blank."""
    return F.when(~is_blank(x), x)


def to_int(x: Column) -> Column:
    """A whole number with an optional sign and nothing else, or null."""
    return F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("int"))


def to_float(x: Column, suffix: str = "pt") -> Column:
    """A number after the suffix is taken off, or null."""
    return F.regexp_replace(x, f"{suffix}$", "").try_cast("float")


def after_last(x: Column, cut: str, fallback: Column | None = None) -> Column:
    return F.when(x.contains(cut), F.substring_index(x, cut, -1)).otherwise(x if fallback is None else fallback)


def before_first(x: Column, cut: str, fallback: Column | None = None) -> Column:
    return F.when(x.contains(cut), F.substring_index(x, cut, 1)).otherwise(x if fallback is None else fallback)


def after_first(x: Column, cut: str, fallback: Column | None = None) -> Column:
    rest = F.substring(x, F.locate(cut, x) + len(cut), F.length(x))
    return F.when(x.contains(cut), rest).otherwise(x if fallback is None else fallback)


def upper_first(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))


def lower_first(x: Column) -> Column:
    return F.concat(F.lower(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))


def contains_ignoring_case(x: Column, part: str) -> Column:
    return F.lower(x).contains(part.lower())


def starts_ignoring_case(x: Column, part: str) -> Column:
    return F.lower(x).startswith(part.lower())


def joined(sep: str, *parts: Column, fallback: Column | None = None) -> Column:
    """The parts that aren't null, joined; the fallback, or null, where that is blank."""
    text = non_blank(F.concat_ws(sep, *parts))
    return text if fallback is None else F.coalesce(text, fallback)


def non_blank_values(m: Column) -> Column:
    """A map without its null and blank values."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & ~is_blank(v))


def words(x: Column) -> Column:
    """White-space separated words of the trimmed text."""
    return F.split(ktrim(x), f"{SPACES}+")


def nth_word(x: Column, n: int) -> Column:
    return F.get(words(x), F.lit(n))


def drop_words(x: Column, n: int) -> Column:
    w = words(x)
    return F.array_join(F.slice(w, F.lit(n + 1), F.greatest(F.size(w) - n, F.lit(0))), " ")


def unquoted(x: Column) -> Column:
    return F.regexp_replace(x, '^"+|"+$', "")


def repeated(x: Column, n: Column | int) -> Column:
    """The text n times; "" for n of 0 or less."""
    return F.repeat(x, F.lit(n) if isinstance(n, int) else n)


def prefix(x: Column, n: int) -> Column:
    """The first n characters (code points) of a text."""
    return F.left(x, F.lit(n))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


RECENT = T.ArrayType(
    T.StructType([T.StructField("uri", T.StringType()), T.StructField("fileName", T.StringType()), T.StructField("mimeType", T.StringType()), T.StructField("fileSize", T.LongType()), T.StructField("lastAccessed", T.LongType())])
)


def escaped(x: Column) -> Column:
    """Text as XML character data."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x
