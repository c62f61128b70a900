"""Merging new rows into stored ones: one row per key under a policy per column, deletions and updates.

Every function is one pass with map-side combine (`latest`, `merge_counts`) or one join; nothing is kept outside the tables.
Null keys are distinct, as in a UNIQUE constraint: such rows are never merged. Ties of the order are broken by the
remaining columns but for maps, so results don't depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str], keep_first: list[str] = (), loose: list[str] | None = None, total: bool = False) -> DataFrame:
    """One row per key: the last in the order, with the columns of keep_first from the first one (created_at and the like).

    loose names the keys that may be null (all unless given): only for these the rows with a null are looked for, in a scan of their own. total says that the order
    leaves no ties; else the other columns break them, but for maps, which have no order (rows that differ in these alone are one of them, any).
    Columns that nobody reads are best dropped before: what is left goes through the shuffle.
    """
    columns = rows.columns
    others = [c for c in columns if c not in keys]
    ties = [] if total else [c for c in others if c not in order and not dict(rows.dtypes)[c].startswith("map")]
    rank = F.struct(*[F.col(c) for c in (*order, *ties)])
    loose = keys if loose is None else loose
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in loose], F.lit(True))
    kept = rows.filter(whole) if loose else rows
    if not others:
        merged = kept.distinct()
    else:
        picked = kept.groupBy(*keys).agg(
            F.max_by(F.struct(*others), rank).alias("last"),
            *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"first_{c}") for c in keep_first],
        )
        merged = picked.select(*[F.col(c) if c in keys else F.coalesce(f"first_{c}", f"last.{c}").alias(c) if c in keep_first else F.col(f"last.{c}").alias(c) for c in columns])
    return merged.unionByName(rows.filter(~whole)) if loose else merged


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """stored with the rows of fresh: a key that is there gets fresh's columns but for those in keep; new keys are added.

    fresh has one row per key (see latest); columns that only stored has stay as they are.
    """
    theirs = fresh.select(*keys, *[F.col(c).alias(f"new_{c}") for c in fresh.columns if c not in keys], F.lit(True).alias("is_new"))
    joined = stored.withColumn("is_old", F.lit(True)).join(theirs, keys, "full")
    given = set(fresh.columns) - set(keys)
    pick = lambda c: F.col(c) if c not in given else F.when(F.col("is_new") & (F.col("is_old").isNull() | F.lit(c not in keep)), F.col(f"new_{c}")).otherwise(F.col(c))
    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in stored.columns])


def merge_counts(events: DataFrame, key: str, at: str, first: list[str] = (), count: str = "occurrence_count") -> DataFrame:
    """(key, first columns, first_seen, last_seen, count) of repeated sightings; the columns in first come from the first one."""
    seen = F.struct(F.col(at), *[F.col(c) for c in first])
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.min_by(F.col(c), seen).alias(c) for c in first], F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias(count)
    )


def linked(edges: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """The edges of which both ends exist: what a MATCH of both ends lets through."""
    first, second = sources.select(F.col(source_key).alias("source")).distinct(), targets.select(F.col(target_key).alias("target")).distinct()
    return edges.join(first, "source", "left_semi").join(second, "target", "left_semi").select(*edges.columns)


def delete_where(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows without those whose key is in the one-column table gone."""
    return rows.join(gone.select(F.col(gone.columns[0]).alias(key)).dropna(), key, "left_anti").select(*rows.columns)


def update_where(rows: DataFrame, condition, **new) -> DataFrame:
    """rows with the given columns set where the condition holds."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in new.items()})


def merge_named(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Campaigns or actors (name, properties, updated_at): one row per name; a name met again gets the new properties, the last ones of fresh."""
    named = fresh.filter(F.btrim("name") != "").withColumn("name", F.btrim("name"))
    return upsert(stored, latest(named, ["name"], ["updated_at"], loose=[]), ["name"])


def cleared(rows: DataFrame) -> DataFrame:
    """The empty table that is left of a store once it is cleared: to be written over it."""
    return rows.limit(0)
