"""Indicator extraction: one array expression per type over the text, deduplicated within it and exploded once; nothing is shuffled.

Defined results of odd input: null and empty texts have no indicators; long texts are read whole; repeated rows are extracted each; an indicator
found several times in a text counts once, with its surest and then first match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.functions.patterns import CALLING_CODES, CRYPTO, HASHES, LOOSE, PATTERNS, SOCIAL, SUFFIXES, TRACKING, WHITELIST, Pattern

#: Types added by register_pattern: pattern and normal form.
_EXTRA: dict[str, tuple[Pattern, object]] = {}


def register_pattern(kind: str, regex: str, normalise=None, confidence: float = 1.0, hint: str | None = None) -> None:
    """Adds an indicator type; normalise maps the matched column to its normal form (lower case unless given)."""
    _EXTRA[kind] = (Pattern(regex, hint or regex, confidence), normalise or F.lower)


def _found(text: Column, kind: str, text_pattern: Pattern | None = None) -> Column:
    pattern = text_pattern or PATTERNS[kind]
    return T.matches(text, ("(?i)" if pattern.ignore_case else "") + pattern.regex, pattern.hint)


def _as_indicators(found: Column, kind: str, normal, keep=None, confidence=None, meta=None) -> Column:
    """array of the common struct from (value, start) matches."""
    none = F.create_map().cast("map<string,string>")
    rows = F.transform(
        found,
        lambda m: F.struct(
            F.lit(kind).alias("type"), m["value"].alias("value"), normal(m["value"]).alias("normalized_value"), m["start"].alias("start"),
            (confidence(m["value"]) if confidence else F.lit(PATTERNS[kind].confidence if kind in PATTERNS else _EXTRA[kind][0].confidence)).cast("double").alias("confidence"),
            (meta(m["value"]) if meta else none).alias("metadata"),
        ),
    )
    return F.filter(rows, lambda r: keep(r)) if keep else rows


def urls(text: Column) -> Column:
    return _as_indicators(_found(text, "url"), "url", T.normal_url, lambda r: T.authority(r["value"]) != "")


def domains(text: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Domains but those of the text's URLs, of the whitelist or without a public suffix."""
    ends = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True))

    def keep(r: Column) -> Column:
        name = r["normalized_value"]
        return ~name.isin(*WHITELIST) & (F.length(name) <= 253) & (F.regexp_count(name, F.lit(r"\.")) <= 10) & name.rlike(rf"\.(?:{ends})$")

    named = _as_indicators(_found(text, "domain"), "domain", F.lower, keep)
    within = F.transform(_found(text, "url"), lambda m: T.authority(m["value"]))
    return T.let(F.struct(named.alias("named"), within.alias("within")), lambda s: F.filter(s["named"], lambda r: ~F.array_contains(s["within"], r["normalized_value"])))


def ip_candidates(text: Column) -> Column:
    """array of (value, start, public) of everything that looks like an IPv4 address, with the verdict on it."""
    return F.transform(_found(text, "ip_address"), lambda m: F.struct(m["value"].alias("value"), m["start"].alias("start"), T.public_ip(m["value"]).alias("public")))


def ips(text: Column) -> Column:
    version = F.create_map(F.lit("ip_version"), F.lit("4"))
    return _as_indicators(_found(text, "ip_address"), "ip_address", lambda v: v, lambda r: T.public_ip(r["value"]), meta=lambda _: version)


def valid_email(value: Column) -> Column:
    """Local part of 1 to 64 characters without dots at its ends or doubled, and a host of valid labels."""
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    fine = (F.length(local).between(1, 64)) & ~local.rlike(r"^\.|\.$|\.\.")
    return fine & host.rlike(r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$") & (F.length(value) <= 254)


def emails(text: Column) -> Column:
    host = lambda v: F.create_map(F.lit("domain"), F.lower(F.substring_index(v, "@", -1)))
    return _as_indicators(_found(text, "email"), "email", F.lower, lambda r: valid_email(r["value"]), meta=host)


def phones(text: Column) -> Column:
    """Numbers in international form with a calling code and 8 to 15 digits as E.164; others of 7 digits or more as their digits, less sure."""
    digits = lambda v: F.regexp_replace(v, r"\D", "")
    abroad = lambda v: v.startswith("+")
    codes = "|".join(sorted(CALLING_CODES, key=len, reverse=True))
    normal = lambda v: F.when(abroad(v), F.concat(F.lit("+"), digits(v))).otherwise(digits(v))
    keep = lambda r: F.when(abroad(r["value"]), digits(r["value"]).rlike(rf"^(?:{codes})\d+$") & F.length(digits(r["value"])).between(8, 15)).otherwise(F.length(digits(r["value"])) >= 7)
    return _as_indicators(_found(text, "phone"), "phone", normal, keep, lambda v: F.when(abroad(v), 1.0).otherwise(0.7))


def hashes(text: Column, kind: str) -> Column:
    """Hex strings of a length, in lower case, but those of one repeated character."""
    return _as_indicators(_found(text, kind), kind, F.lower, lambda r: ~r["normalized_value"].rlike(r"^(.)\1*$"))


def social(text: Column, kind: str, telegram_invites: bool = False) -> Column:
    """Account links in lower case; of Telegram links the name alone (all invites fall together unless telegram_invites)."""

    def normal(v: Column) -> Column:
        low = F.lower(v)
        if kind != "telegram":
            return low
        name = F.split_part(F.substring_index(low, "t.me/", -1), F.lit("/"), F.lit(1))
        return F.when(low.contains("joinchat/") & F.lit(telegram_invites), F.substring_index(low, "t.me/", -1)).otherwise(name)

    return _as_indicators(_found(text, kind), kind, normal)


def verbatim(text: Column, kind: str) -> Column:
    meta = (lambda _: F.create_map(F.lit("cryptocurrency"), F.lit(CRYPTO[kind]))) if kind in CRYPTO else None
    return _as_indicators(_found(text, kind), kind, lambda v: v, meta=meta)


def all_indicators(text: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The indicators of every type in one array, in the order of the types."""
    parts = [urls(text), domains(text, suffixes), ips(text), emails(text), phones(text)]
    parts += [hashes(text, k) for k in HASHES] + [social(text, k) for k in SOCIAL] + [verbatim(text, k) for k in (*TRACKING, *CRYPTO)]
    parts += [_as_indicators(_found(text, k, p), k, normal) for k, (p, normal) in _EXTRA.items()]
    return F.concat(*parts)


def surest(found: Column) -> Column:
    """Of an array of indicators, for each (type, normalized_value) the surest, then the first match."""

    def pick(all_: Column) -> Column:
        keyed = F.transform(all_, lambda x, i: F.struct(x["type"].alias("type"), x["normalized_value"].alias("name"), (-x["confidence"]).alias("unsure"), x["start"].alias("start"), i.alias("i")))
        return T.let(F.array_sort(keyed), lambda order: F.transform(F.filter(order, lambda x, k: _new(order, x, k)), lambda x: F.get(all_, x["i"])))

    return T.let(found, pick)


def _new(order: Column, x: Column, k: Column) -> Column:
    before = F.get(order, k - 1)
    return (k == 0) | (before["type"] != x["type"]) | ~before["name"].eqNullSafe(x["name"])


def extract(rows: DataFrame, key: str, text: str, found: Column | None = None, window: int = 100, dedup: bool = True, source: str | None = None) -> DataFrame:
    """(key, type, value, normalized_value, start, confidence, metadata, context) of the indicators in a text column.

    dedup keeps of each row one per (type, normalized_value): the surest, then the first. source names a column whose value is added
    to the metadata as source_document.
    """
    array = all_indicators(F.col(text)) if found is None else found
    extra = [F.col(source).cast("string").alias("_source")] if source else []
    flat = rows.select(F.col(key), F.col(text).alias("_text"), *extra, F.explode(surest(array) if dedup else array).alias("x")).select(F.col(key), "_text", *(["_source"] if source else []), "x.*")
    metadata = F.map_concat("metadata", F.create_map(F.lit("source_document"), F.col("_source"))) if source else F.col("metadata")
    return flat.select(key, "type", "value", "normalized_value", "start", "confidence", metadata.alias("metadata"), T.context(F.col("_text"), F.col("start"), F.length("value"), window).alias("context"))


def with_ids(found: DataFrame) -> DataFrame:
    """Adds indicator_id: the md5 of `type:normalized_value`."""
    return found.withColumn("indicator_id", F.md5(F.concat_ws(":", "type", "normalized_value")))


def statistics(found: DataFrame) -> DataFrame:
    """(type, total, high, medium, low): indicators per type by confidence (from 0.9, from 0.7, below)."""
    level = F.col("confidence")
    return found.groupBy("type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(level >= 0.9).alias("high"), F.count_if((level >= 0.7) & (level < 0.9)).alias("medium"), F.count_if(level < 0.7).alias("low")
    )


def loose_count(text: Column) -> Column:
    """How many matches of the loose patterns a text has, all together."""
    total = F.lit(0)
    for regex in LOOSE:
        total = total + F.coalesce(F.regexp_count(text, F.lit(f"(?i){regex}")), F.lit(0))
    return total
