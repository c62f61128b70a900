"""Items that appear together (numbered problem 5).

Input is (basket, item) rows; the result is every pair of items that share at least min_together baskets and meet
at least min_lift times as often as by chance, with its counts, lift and pointwise mutual information.

Defined results of odd input: null and blank items are left out, as are null and blank baskets; repeated items of a
basket count once; baskets of one item give no pair but count in n; empty input gives an empty result; other
columns are never read.

Plan: keys become numbers by joins with their dictionaries, so that strings are shuffled once. Two exact prunings follow
from the thresholds before any pair is made: n_ab >= t needs n_a >= t and n_b >= t, and n_ab * n >= f * n_a * n_b with
n_ab <= min(n_a, n_b) needs n_a <= n / f; the second removes every item that lies in a large share of all baskets. Items
are numbered by rising frequency, and a pair belongs to its rarer item: an item held by many baskets then owns few pairs.
A pair needs t baskets, so the t - 1 largest ones alone never suffice: where they would make most of the pairs, pairs are made in the
other baskets only, and the largest add to the counts of these by a bit per basket and item. A third exact saving, whatever one basket
holds. A basket's items are put into blocks of about BLOCK, so a huge basket is many rows, and every pair of blocks a key of its own. The ordered pairs of the
FREQUENT most frequent items, at most FREQUENT**2 / 2 different ones, are combined on the map side. All other pairs hardly repeat within a task: they are
emitted as one row per basket block and item with the list of its partners (4 bytes a pair), and counted behind one shuffle by the rarer item.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.skew import cut, key_of

#: Items of one basket in one block; most frequent items whose pairs are counted on the map side.
BLOCK, FREQUENT = 512, 1000


def basket_items(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, item): normalised keys of the rows in which neither is blank."""
    return rows.select(key_of(basket).alias("basket"), key_of(item).alias("item")).dropna()


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with no, counting from 0 in the given order; only one count per partition reaches the driver."""
    placed = cut(rows.sort(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("part").count().sort("part").collect()
    begins = accumulate([0, *[s[1] for s in sizes]])
    offsets = rows.sparkSession.createDataFrame([(s[0], b) for s, b in zip(sizes, begins)], "part int, begin long")
    no = F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(offsets), "part").withColumn("no", no).drop("part", "at", "begin")


def frequent_pairs(items: DataFrame, min_together: int = 4, min_lift: float = 5.0, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi) with item_a < item_b, of (basket, item) rows."""
    baskets = cut(items.select("basket").distinct().withColumn("b", F.monotonically_increasing_id()))
    dictionary = cut(items.select("item").distinct().withColumn("i", F.monotonically_increasing_id()))
    rows = cut(items.join(baskets, "basket").select("b", "item").join(dictionary, "item").select("b", "i").distinct())
    n = baskets.count()
    often = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n_item"))
    often = often.filter((F.col("n_item") >= min_together) & (F.col("n_item") * F.lit(min_lift) <= F.lit(n)))
    items_no = cut(numbered(often, "n_item", "i").join(dictionary, "i"))
    n_kept = items_no.count()
    kind = "int" if n_kept < 1 << 31 else "long"

    kept = rows.join(items_no.select("i", F.col("no").cast(kind).alias("no")), "i").select("b", "no")
    sizes = cut(kept.groupBy("b").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    square = F.col("size").cast("double") * F.col("size")
    largest = sizes.orderBy(F.desc("size"), "b").limit(min_together - 1).select("b", square.alias("pairs")).collect()
    whole = sizes.agg(F.sum(square)).first()[0] or 0.0
    huge = [r["b"] for r in largest] if sum(r["pairs"] for r in largest) > 0.5 * whole else []
    bit = F.coalesce(*[F.when(F.col("b") == b, F.lit(1 << k)) for k, b in enumerate(huge)], F.lit(0))
    in_huge = kept.filter(F.col("b").isin(huge)).groupBy("no").agg(F.bit_or(bit).alias("bits")) if huge else None
    if huge:
        sizes = sizes.filter(~F.col("b").isin(huge))
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = kept.join(sizes, "b").select("b", "no", blocks.alias("blocks"), F.pmod(F.xxhash64("no"), blocks.cast("long")).cast("int").alias("own"))
    grouped = cut(placed.groupBy("b", "own", "blocks").agg(F.sort_array(F.collect_list("no")).alias("nos")))
    inside = grouped.select(F.posexplode("nos").alias("at", "x"), "nos").select("x", F.expr("slice(nos, at + 2, size(nos))").alias("ys"))
    # every pair of blocks of a basket has a key of its own, so a huge basket spreads over all tasks
    many = grouped.filter("blocks > 1")
    lower = many.filter("own < blocks - 1").select("b", "own", F.explode(F.sequence(F.col("own") + 1, F.col("blocks") - 1)).alias("other"), F.col("nos").alias("here"))
    upper = many.filter("own > 0").select("b", F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("own"), F.col("nos").alias("there"))
    sides = F.explode(F.array(F.struct(F.col("here").alias("xs"), F.col("there").alias("ys")), F.struct(F.col("there").alias("xs"), F.col("here").alias("ys"))))
    across = lower.join(upper, ["b", "own", "other"]).select(sides.alias("s")).select(F.explode("s.xs").alias("x"), F.col("s.ys").alias("ys")).select("x", F.expr("filter(ys, y -> y > x)").alias("ys"))
    stripes = inside.unionByName(across).filter(F.size("ys") > 0)
    # the most frequent items lie in many baskets but have few partners of a higher number: their pairs are counted on the map side, all others as
    # lists behind a shuffle by their rarer item, which lies in less than 1 / FREQUENT of all rows
    frequent = F.col("x") >= n_kept - FREQUENT
    pairs = lambda rows: rows.select("x", F.explode("ys").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_ab"))
    counts = pairs(stripes.filter(~frequent).repartition("x")).unionByName(pairs(stripes.filter(frequent)))
    counts = counts.filter(F.col("n_ab") >= min_together - len(huge))
    if in_huge is not None:
        both = counts.join(in_huge.select(F.col("no").alias("x"), F.col("bits").alias("bits_x")), "x", "left").join(in_huge.select(F.col("no").alias("y"), F.col("bits").alias("bits_y")), "y", "left")
        more = F.coalesce(F.bit_count(F.col("bits_x").bitwiseAND(F.col("bits_y"))), F.lit(0))
        counts = both.select("x", "y", (F.col("n_ab") + more).alias("n_ab")).filter(F.col("n_ab") >= min_together)
    counts = cut(counts)
    first = items_no.select(F.col("no").cast(kind).alias("x"), F.col("item").alias("item_x"), F.col("n_item").alias("n_x"))
    second = items_no.select(F.col("no").cast(kind).alias("y"), F.col("item").alias("item_y"), F.col("n_item").alias("n_y"))
    lift = F.col("n_ab") * F.lit(n) / (F.col("n_x") * F.col("n_y"))
    ordered = F.col("item_x") < F.col("item_y")
    pick = lambda yes, no: F.when(ordered, F.col(yes)).otherwise(F.col(no))
    return (
        counts.join(first, "x")
        .join(second, "y")
        .filter(F.col("n_ab") * F.lit(n) >= F.col("n_x") * F.col("n_y") * F.lit(min_lift))
        .select(
            pick("item_x", "item_y").alias("item_a"), pick("item_y", "item_x").alias("item_b"), "n_ab", pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"),
            F.lit(n).alias("n"), lift.alias("lift"), F.log2(lift).alias("pmi"),
        )
    )
