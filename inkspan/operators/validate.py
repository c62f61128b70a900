"""Validation and sanitising of columns: each rule is an expression; `checked` results are struct<valid, value>.

Null input is never valid and has a null value.
"""

from __future__ import annotations

import re
from json import dumps, loads

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.functions.patterns import SUFFIXES
from inkspan.operators.extract import valid_email

#: What a query may not contain (letter case aside).
SQL_INJECTION = (
    r";\s*(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE)\s+", r"--\s*", r"\/\*.*\*\/", r"(UNION|SELECT).*(FROM|WHERE)", r"OR\s+\d+=\d+", r"OR\s+'[^']*'\s*=\s*'[^']*'",
)
NOSQL_INJECTION = (r"\$where", r"\$ne", r"\$gt", r"\$regex", r"function\s*\(", r"this\.", r"db\.", r"sleep\s*\(")
#: Forms of ids and names.
FORMS = {
    "md5": r"^[a-fA-F0-9]{32}$", "sha1": r"^[a-fA-F0-9]{40}$", "sha256": r"^[a-fA-F0-9]{64}$", "indicator_id": r"^[a-fA-F0-9]{32}$",
    "document_id": r"^[a-zA-Z0-9_-]{1,255}$", "campaign_name": r"^[a-zA-Z0-9\s_-]{1,100}$", "language_code": r"^[a-z]{2}$",
    "bitcoin": r"^(?:[13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-z0-9]{39,})", "ethereum": r"^0x[a-fA-F0-9]{40}",
}
#: Keys whose values are secrets.
SECRETS = ("password", "secret", "token", "api_key", "private_key", "ssn", "credit_card")
#: Requests per client and seconds, by kind of request.
RATES = {"search": (100, 60), "process": (10, 60), "bulk": (5, 60)}
MAX_QUERY, MAX_INDICATOR, MAX_METADATA, MAX_DAYS = 1000, 500, 10_000, 3650


def checked(valid: Column, value: Column) -> Column:
    fine = F.coalesce(valid, F.lit(False))
    return F.struct(fine.alias("valid"), F.when(fine, value).alias("value"))


def has_injection(text: Column) -> Column:
    found = F.lit(False)
    for regex in (*SQL_INJECTION, *NOSQL_INJECTION):
        found |= text.rlike(f"(?i){regex}")
    return found


def query(text: Column) -> Column:
    clean = T.sanitized(text)
    return checked((F.length(text) > 0) & (F.length(text) <= MAX_QUERY) & ~has_injection(clean), clean)


def form(kind: str, value: Column) -> Column:
    """A value of one of the fixed forms; hashes and Ethereum addresses in lower case."""
    return checked(value.rlike(FORMS[kind]), F.lower(value) if kind in ("md5", "sha1", "sha256", "ethereum") else value)


def domain(value: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    plain = F.lower(F.trim(value))
    name = F.when(plain.rlike("^https?://"), T.authority(plain)).otherwise(plain)
    ends = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True))
    return checked(name.rlike(rf"^[a-z0-9.-]+\.(?:{ends})$") & (F.length(name) <= 253), name)


def url(value: Column) -> Column:
    plain = F.trim(value)
    return checked(plain.rlike(r"^(?i)(?:https?|ftp)://[^\s/?#]+(?:[/?#]\S*)?$") & F.coalesce(F.try_parse_url(plain, F.lit("HOST")), F.lit("")).contains("."), plain)


def ip(value: Column) -> Column:
    plain = F.trim(value)
    return checked(T.octets(plain).isNotNull(), plain)


def email(value: Column) -> Column:
    plain = F.lower(F.trim(value))
    return checked(plain.rlike(r"^[^@\s]+@[^@\s]+$") & valid_email(plain), plain)


def phone(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return checked(F.length(digits).between(7, 15), F.when(F.trim(value).startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits))


def indicator(kind: Column, value: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The rule of the row's type on its value of 1 to 500 characters; unknown types are not valid."""
    rules = {"domain": domain(value, suffixes), "url": url(value), "ip_address": ip(value), "email": email(value), "phone": phone(value)}
    rules |= {k: form(k, value) for k in ("md5", "sha1", "sha256", "bitcoin", "ethereum")}
    result = checked(F.lit(False), value)
    for name, rule in rules.items():
        result = F.when(kind == name, rule).otherwise(result)
    return F.when(F.length(value).between(1, MAX_INDICATOR), result).otherwise(checked(F.lit(False), value))


def confidence(value: Column) -> Column:
    return F.coalesce(value.between(0.0, 1.0), F.lit(False))


def metadata(json: Column) -> Column:
    """JSON objects of at most 10,000 characters."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return checked((F.length(json) <= MAX_METADATA) & kind.startswith("OBJECT"), json)


def date_range(first: Column, last: Column, days: int = MAX_DAYS) -> Column:
    return F.coalesce((first <= last) & (F.datediff(last, first) <= days), F.lit(False))


def redact(values: Column) -> Column:
    """A map with the values of secret keys masked: the first and last two characters of longer ones stay."""

    def masked(key: Column, value: Column) -> Column:
        secret = F.lower(key).rlike("|".join(SECRETS))
        long = F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), F.length(value) - 4), F.right(value, F.lit(2)))
        return F.when(secret, F.when(F.length(value) > 4, long).otherwise("****")).otherwise(value)

    return F.transform_values(values, masked)


def redacted_json(json: Column) -> Column:
    """JSON with the values of secret keys masked at every level as in redact(), whatever kind they are; texts that are no JSON give null."""
    return _nested(json, True)


def sanitized_json(json: Column) -> Column:
    """JSON objects of at most 10,000 characters with every text in them, keys too, freed of control characters and of blanks around it; others give null."""
    return F.when(metadata(json)["valid"], _nested(json, False))


def _nested(json: Column, hide: bool) -> Column:
    """Objects nest to any depth, which no expression walks: Arrow batches through the json module."""
    secret = re.compile("|".join(SECRETS))
    control = re.compile(r"[\x00-\x08\x0b-\x1f]")

    def mask(value) -> str:
        text = value if isinstance(value, str) else dumps(value)
        return text[:2] + "*" * (len(text) - 4) + text[-2:] if len(text) > 4 else "****"

    def walk(value):
        if isinstance(value, dict):
            return {clean(k): mask(v) if hide and v is not None and secret.search(k.lower()) else walk(v) for k, v in value.items()}
        if isinstance(value, list):
            return [walk(v) for v in value]
        return clean(value)

    def clean(value):
        return value if hide or not isinstance(value, str) else control.sub("", value.strip())

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else dumps(walk(loads(text)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run(json)


def rate_window(events: DataFrame, client: str, at: str, kind: str = "search") -> DataFrame:
    """events with `recent`, the client's requests in the window up to and with each one, and `over`, whether they pass the limit."""
    limit, seconds = RATES[kind]
    span = Window.partitionBy(client).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(span)).withColumn("over", F.col("recent") > limit)


def rate_admitted(events: DataFrame, client: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """(order, client, admitted): exact admission; rejected requests don't count against later ones.

    A fold over each client's requests in time: its state is the times of the admitted requests in the window, at most `limit`.
    The requests of a client are read batch by batch, so a client with a third of all rows is never held whole.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(batches):
        from collections import deque

        now, recent = None, deque()
        for batch in batches:
            if len(batch) == 0:
                continue
            out = []
            for who, t in zip(batch["client"], batch["micros"]):
                if who != now:
                    now, recent = who, deque()
                while recent and recent[0] <= t - seconds * 1_000_000:
                    recent.popleft()
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(t)
            yield pd.DataFrame({order: batch["order"], client: batch["client"], "admitted": out})

    rows = events.select(F.col(order).alias("order"), F.col(client).alias("client"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros")).dropna()
    sorted_rows = rows.repartition("client").sortWithinPartitions("client", "micros", "order")
    return sorted_rows.mapInPandas(run, f"{order} {kinds[order]}, {client} {kinds[client]}, admitted boolean")
