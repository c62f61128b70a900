"""Building blocks that keep hot keys from ending in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.session import ensure_checkpoint_dir

#: A key is hot from this share of all rows on, so that there are at most 1 / HOT_SHARE hot keys to broadcast.
HOT_SHARE = 1 / 1000


#: Setting by which Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """df as a table written to the shared checkpoint folder: its lineage ends here, executors may be lost.

    A written table, unlike a checkpoint, brings its real size and no inherited constraints to the next plan, so loops
    don't grow. The folder is deleted with the application; forget() deletes it as soon as it isn't needed.
    release: the shuffle files that writing it took are deleted once it is written.
    """
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/inkspan-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    at = f"{root}/{uuid.uuid4().hex}"
    was = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true" if release else was)
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(RELEASE, was)
    table = spark.read.schema(df.schema).parquet(at)
    table._written_at = at
    return table


def forget(df: DataFrame) -> None:
    """Deletes what cut() wrote for df."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot(keys: DataFrame, count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """The rows of keys (one per key, with its row count) that hold at least that share of total.

    At most 1 / share rows can pass, which bounds what a broadcast of them sends.
    """
    return keys.filter(F.col(count) >= F.lit(max(1.0, total * share)))


def split_join(left: DataFrame, keys: DataFrame, on: list[str], count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of left with keys, a table with one row per key and the number of left rows of each.

    Rows of hot keys meet a broadcast table of at most 1 / share rows and stay where they are; only the
    others are shuffled, and none of their keys holds more than that share of the rows.
    """
    many = F.col(count) >= F.lit(max(1.0, total * share))
    heavy = left.join(F.broadcast(keys.filter(many)), on)
    light = left.join(F.broadcast(keys.filter(many).select(*on)), on, "left_anti").join(keys.filter(~many), on)
    return heavy.unionByName(light)


def spread(scan: DataFrame) -> DataFrame:
    """A scan for heavy work per row: over all cores where its files give fewer partitions than there are cores, else as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: Rows of one basket in one block.
BLOCK = 512


def meet(left: DataFrame, right: DataFrame, basket: str) -> DataFrame:
    """Inner join of two tables on a basket in which a huge basket is cut into blocks: every pair of blocks has a key of its own.

    The tables share no other column. A row of a basket of n blocks is sent n times, so a block pair never holds more than about BLOCK rows of a side.
    """
    sizes = left.groupBy(basket).agg(F.count(F.lit(1)).alias("n_left")).join(right.groupBy(basket).agg(F.count(F.lit(1)).alias("n_right")), basket)
    parts = [F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_left", "n_right")]
    # only baskets of more than one block; a table with its real size
    many = cut(sizes.filter(F.greatest("n_left", "n_right") > BLOCK).select(basket, parts[0].alias("parts_left"), parts[1].alias("parts_right")))
    if many.isEmpty():
        return left.join(right, basket)
    ones = F.coalesce("parts_left", F.lit(1)), F.coalesce("parts_right", F.lit(1))

    def placed(rows: DataFrame, own: Column, other: Column, own_name: str, other_name: str) -> DataFrame:
        drawn = F.pmod(F.xxhash64(*[c for c in rows.columns if c != basket]), own.cast("long")).cast("int")
        return rows.join(many, basket, "left").select(*rows.columns, drawn.alias(own_name), F.explode(F.sequence(F.lit(0), other - 1)).alias(other_name))

    a = placed(left, ones[0], ones[1], "block_left", "block_right")
    b = placed(right, ones[1], ones[0], "block_right", "block_left")
    return a.join(b, [basket, "block_left", "block_right"]).drop("block_left", "block_right")


#: Characters that are cut from both ends of keys.
BLANKS = " \t\n\r\f\v\u00a0"


def key_of(column: Column | str) -> Column:
    """A reference key without blanks around it, in lower case; null where nothing is left."""
    trimmed = F.lower(F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS)))
    return F.when(trimmed != "", trimmed)
