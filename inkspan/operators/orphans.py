"""References to records that do not exist (numbered problem 6).

Mentions refer to indicators and documents by key. A key is compared without blanks around it and in lower
case. A reference is `deleted` (no such row, but the deletion log has the key for that table), `missing`
(no such row and no log entry) or `late` (the earliest created_at of the row is after that of the mention).

Defined results of odd input: null and blank keys are no references; a null created_at on either side is never
late; repeated mention rows give one row each per reference (distinct); repeated target rows count as one with
their earliest known created_at; empty tables make every reference missing (or deleted); extra columns are
ignored, whatever their names, as every input is projected first.

Plan: references are counted per key and month before anything is shuffled (map-side combine), so a key with a third of
all rows arrives as one row per task and month. The status of each distinct key comes from joins between one-row-per-key
tables. The counts per month are sums of these; only references to records of the very month in which they were created are looked at
row by row, to tell late ones. For single references, back at the rows, hot keys (at most 1 / HOT_SHARE of them) meet a broadcast table, all others a shuffle
join; both parts are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.skew import cut, key_of, split_join

#: Reference column of the mentions -> referenced table and its key column.
TARGETS = {"indicator_id": ("indicators", "indicator_id"), "document_id": ("pdf_documents", "doc_id")}


def references(mentions: DataFrame) -> DataFrame:
    """(mention_id, created_at, ref_column, key): one row for every non-blank reference."""
    refs = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_column"), key_of(c).alias("key")) for c in TARGETS]))
    return mentions.select("mention_id", "created_at", refs.alias("ref")).select("mention_id", "created_at", "ref.ref_column", "ref.key").filter(F.col("key").isNotNull())


def target_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(ref_column, key, first_created): every existing target key once."""
    parts = [
        tables[name].select(F.lit(column).alias("ref_column"), key_of(key).alias("key"), F.col("created_at").alias("first_created"))
        for column, (name, key) in TARGETS.items()
    ]
    both = parts[0].unionByName(parts[1]).filter(F.col("key").isNotNull())
    return both.groupBy("ref_column", "key").agg(F.min("first_created").alias("first_created"), F.lit(True).alias("there"))


def logged_keys(deleted: DataFrame) -> DataFrame:
    """(ref_column, key, logged): every key in the deletion log of a referenced table once."""
    name = F.lower(F.trim("table_name"))
    column = F.coalesce(*[F.when(name == table, F.lit(c)) for c, (table, _) in TARGETS.items()])
    return deleted.select(column.alias("ref_column"), key_of("record_key").alias("key")).dropna().distinct().withColumn("logged", F.lit(True))


def monthly_references(refs: DataFrame) -> DataFrame:
    """(ref_column, key, month, refs, earliest): references counted per key and month of the mention (null where it has no time)."""
    return refs.groupBy("ref_column", "key", month_of("created_at").alias("month")).agg(F.count(F.lit(1)).alias("refs"), F.min("created_at").alias("earliest"))


def month_of(column: str) -> Column:
    return F.date_format(column, "yyyy-MM")


def suspect_keys(monthly: DataFrame, indicators: DataFrame, documents: DataFrame, deleted: DataFrame) -> DataFrame:
    """(ref_column, key, refs, first_created, state) of every key with a reference that is deleted, missing or late; monthly as of monthly_references()."""
    per_key = monthly.groupBy("ref_column", "key").agg(F.sum("refs").alias("refs"), F.min("earliest").alias("earliest"))
    state = (
        F.when(F.col("there").isNotNull(), F.when(F.col("first_created") > F.col("earliest"), "late"))
        .when(F.col("logged").isNotNull(), "deleted")
        .otherwise("missing")
    )
    targets = target_keys({"indicators": indicators, "pdf_documents": documents})
    return cut(
        per_key.join(targets, ["ref_column", "key"], "left")
        .join(logged_keys(deleted), ["ref_column", "key"], "left")
        .select("ref_column", "key", "refs", "first_created", state.alias("state"))
        .filter(F.col("state").isNotNull())
    )


def orphan_references(mentions: DataFrame, indicators: DataFrame, documents: DataFrame, deleted: DataFrame) -> DataFrame:
    """(mention_id, ref_column, state, created_at) of every reference that is deleted, missing or late."""
    refs = references(mentions)
    suspects = suspect_keys(monthly_references(refs), indicators, documents, deleted)
    total = suspects.agg(F.sum("refs")).first()[0] or 0
    found = split_join(refs, suspects, ["ref_column", "key"], "refs", total)
    return found.filter((F.col("state") != "late") | (F.col("first_created") > F.col("created_at"))).select("mention_id", "ref_column", "state", "created_at")


def orphans_by_month(mentions: DataFrame, indicators: DataFrame, documents: DataFrame, deleted: DataFrame) -> DataFrame:
    """(ref_table, month, state, n_refs): orphan references counted per referenced table and month; repeated mention rows count each."""
    refs = references(mentions)
    monthly = cut(monthly_references(refs))
    suspects = suspect_keys(monthly, indicators, documents, deleted)
    born = month_of("first_created")
    whole = monthly.join(suspects.drop("refs"), ["ref_column", "key"])
    whole = whole.filter((F.col("state") != "late") | (F.col("month") < born)).select("ref_column", "month", "state", "refs")
    # references from the month of creation are before or after it: these alone are looked at one by one
    late = suspects.filter("state = 'late'").withColumn("month", born).drop("refs")
    mixed = cut(late.join(monthly.select("ref_column", "key", "month", "refs"), ["ref_column", "key", "month"]).select("ref_column", "key", "month", "first_created", "refs"))
    total = mixed.agg(F.sum("refs")).first()[0] or 0
    rows = split_join(refs.withColumn("month", month_of("created_at")), mixed, ["ref_column", "key", "month"], "refs", total)
    border = rows.filter(F.col("first_created") > F.col("created_at")).select("ref_column", "month", F.lit("late").alias("state"), F.lit(1).cast("long").alias("refs"))
    table = F.coalesce(*[F.when(F.col("ref_column") == c, F.lit(t)) for c, (t, _) in TARGETS.items()])
    return whole.unionByName(border).groupBy(table.alias("ref_table"), "month", "state").agg(F.sum("refs").alias("n_refs"))
