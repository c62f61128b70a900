"""Column functions over text: matches with their places, context windows, normal forms. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, regex: str, hint: str | None = None) -> Column:
    """array<struct<value, start>> of all matches, start counted in characters from 0.

    The pieces between the matches give the places: a match begins where the pieces and matches before it end. Null texts give an
    empty array; hint is a cheaper regex that a text with a match must satisfy.
    """
    kind = "array<struct<value: string, start: int>>"
    # each regex is evaluated once: lambdas see the accumulator and the element only
    found, between = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["between"])
        here = F.struct(pair["found"].alias("value"), start.alias("start"))
        out = F.when(pair["found"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(here)))
        return F.struct((start + F.coalesce(F.length(pair["found"]), F.lit(0))).alias("at"), out.alias("out"))

    pairs = F.arrays_zip(found.alias("found"), between.alias("between"))
    placed = F.aggregate(pairs.cast("array<struct<found: string, between: string>>"), begin, step, lambda acc: acc["out"])
    may = text.rlike(hint) if hint else text.isNotNull()
    return F.when(may, placed).otherwise(F.array().cast(kind))


def let(value: Column, body) -> Column:
    """body of value, evaluated once even where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def context(text: Column, start: Column, length: Column, window: int = 100) -> Column:
    """The text around a match: so many characters on each side, blanks collapsed, `...` where the text goes on."""
    first = F.greatest(F.lit(0), start - window)
    last = F.least(F.length(text), start + length + window)
    inner = collapse(F.substring(text, first + 1, last - first))
    return F.concat(F.when(first > 0, "...").otherwise(""), inner, F.when(last < F.length(text), "...").otherwise(""))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    blanks = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    return F.btrim(F.regexp_replace(text, blanks, " "))


def decoded(url: Column) -> Column:
    """Percent escapes undone; bad ones and plus signs stay as they are."""
    safe = F.regexp_replace(F.regexp_replace(url, r"%(?![0-9a-fA-F]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), url)


def normal_url(url: Column) -> Column:
    return F.regexp_replace(decoded(F.lower(url)), "/$", "")


def authority(url: Column) -> Column:
    """What stands between `//` and the next `/`, `?` or `#`, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def sanitized(text: Column) -> Column:
    """Without control characters other than tabs and line ends, and without white space at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\x00", ""), r"^\s+|\s+$", ""), r"[\x01-\x08\x0B-\x1F]", "")


def html_escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def octets(ip: Column) -> Column:
    """An IPv4 address as one number; null if it isn't one (leading zeros are not allowed)."""
    part = r"(?:0|[1-9][0-9]{0,2})"
    valid = ip.rlike(rf"^{part}(?:\.{part}){{3}}$")
    pieces = F.transform(F.split(ip, r"\."), lambda p: p.cast("long"))
    whole = F.forall(pieces, lambda p: p <= 255)
    return F.when(valid & whole, F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def public_ip(ip: Column) -> Column:
    """Whether an IPv4 address is valid and in no private or reserved range."""
    from inkspan.functions.patterns import RESERVED_IPV4

    def number(address: str) -> int:
        value = 0
        for part in address.split("."):
            value = value * 256 + int(part)
        return value

    value = octets(ip)
    reserved = F.lit(False)
    for low, high in RESERVED_IPV4:
        reserved |= value.between(number(low), number(high))
    return value.isNotNull() & ~reserved
