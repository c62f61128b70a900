"""Consolidating pairwise matches into groups (numbered problem 2).

Input is rows of two record ids that match; the result gives every id that occurs one group id, the smallest id of
all records it is linked to directly or through others.

Defined results of odd input: links with a null or blank end are no links; ids are trimmed and in lower case; repeated,
reversed and self links change nothing, an id linked only to itself is its own group; empty input gives an empty
result; only the named columns are read.

Method: deterministic Boruvka hooking. Components are ordered by their label and component edges by (smaller label,
larger label), so the smallest outgoing edge of a component is the one to its smallest neighbour. Each component hooks to
that neighbour; of two that hook to each other the smaller stays a root. The trees collapse by pointer doubling, edges are
relabelled with the roots and deduplicated, and the next round begins, until no edge is left: at most log2(n) rounds, as
every component with an edge merges. Each round's table is cut by a checkpoint in the shared folder; only counts reach
the driver. A hub component is one row of the label table after a map-side combined minimum. Its edges, and the many components that hook to it or
have it as their root, meet its row by a broadcast of hub components only (at most 2 / HOT_SHARE of them) and are not shuffled by it. Tables of past rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.skew import HOT_SHARE, cut, forget, key_of, split_join

#: Fewest rows of a hot parent.
HOT_LEAST = 10_000


def related_links(relationships: DataFrame, kind: str = "related to") -> DataFrame:
    """(u, v): normalised ends of the links of a type; letter case and the separator of the type don't matter."""
    written = F.regexp_replace(F.lower(F.regexp_replace("relationship_type", r"^\s+|\s+$", "")), r"[_\-\s]", " ")
    return relationships.filter(written == kind).select(key_of("source_id").alias("u"), key_of("target_id").alias("v")).dropna()


def _hot_parents(forest: DataFrame, total: int) -> tuple[bool, DataFrame | None]:
    """(whether a pointer moved, the parents of at least HOT_SHARE of total and HOT_LEAST rows): one small row reaches the driver."""
    per_parent = forest.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.max("moved").alias("moved"))
    many = F.when(F.col("n") >= max(HOT_LEAST, total * HOT_SHARE), F.col("parent"))
    moved, hot = per_parent.agg(F.max("moved"), F.collect_list(many)).first()
    return bool(moved), forest.sparkSession.createDataFrame([(x,) for x in hot], "parent string") if hot else None


def _up(rows: DataFrame, above: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with what `above` (one row per parent) says of their parent; rows of hot parents meet a broadcast table and stay where they are."""
    if hot is None:
        return rows.join(above, "parent")
    heavy = rows.join(F.broadcast(above.join(F.broadcast(hot), "parent")), "parent")
    light = rows.join(F.broadcast(hot), "parent", "left_anti").join(above, "parent")
    return heavy.unionByName(light)


def _collapse(forest: DataFrame, total: int, hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """((id, parent, degree) with the root as parent, hot roots) of a forest (id, parent, degree) whose roots are their own parents, given its hot parents."""
    moved = True
    while moved:
        second = forest.select(F.col("id").alias("parent"), F.col("parent").alias("second"))
        up = _up(forest.select("id", "parent", "degree"), second, hot)
        if hot is None:
            # two doublings a job: three steps up
            third = forest.select(F.col("id").alias("second"), F.col("parent").alias("third"))
            last = forest.select(F.col("id").alias("third"), F.col("parent").alias("root"))
            up = up.join(third, "second").join(last, "third").withColumn("moved", F.col("root") != F.col("second"))
        else:
            up = up.withColumn("root", F.col("second")).withColumn("moved", F.col("root") != F.col("parent"))
        higher = cut(up.select("id", F.col("root").alias("parent"), "degree", "moved"))
        forget(forest)
        forest = higher
        moved, hot = _hot_parents(forest, total)
    return forest, hot


def _relabel(edges: DataFrame, side: str, roots: DataFrame, total: int) -> DataFrame:
    labels = roots.select(F.col("id").alias(side), F.col("parent").alias("label"), "degree")
    return split_join(edges, labels, [side], "degree", total).drop(side, "degree").withColumnRenamed("label", side)


def connected_groups(links: DataFrame) -> DataFrame:
    """(record_id, group_id) of every id among the (u, v) links."""
    ordered = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    links = cut(ordered.distinct())
    edges = cut(links.filter("u != v"))
    maps: list[tuple[DataFrame, DataFrame | None]] = []
    while total := edges.count():
        ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("to")), F.struct(F.col("v").alias("id"), F.col("u").alias("to"))))
        hooks = edges.select(ends.alias("e")).select("e.*").groupBy("id").agg(F.min("to").alias("parent"), F.count(F.lit(1)).alias("degree"))
        hooks = cut(hooks.withColumn("moved", F.lit(True)))
        _, hot = _hot_parents(hooks, total)
        mutual = (F.col("back") == F.col("id")) & (F.col("id") < F.col("parent"))
        back = hooks.select(F.col("id").alias("parent"), F.col("parent").alias("back"))
        forest = _up(hooks, back, hot).select("id", F.when(mutual, F.col("id")).otherwise(F.col("parent")).alias("parent"), "degree")
        roots, hot = _collapse(cut(forest), total, hot)
        forget(hooks)
        maps.append((roots, hot))
        relabelled = _relabel(_relabel(edges, "u", roots, total), "v", roots, total).filter("u != v")
        relabelled = cut(relabelled.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        forget(edges)
        edges = relabelled
    # the rounds' label tables shrink at least by half, so they are chained from the last one back
    label: DataFrame | None = None
    for roots, hot in reversed(maps):
        step = roots.select("id", "parent")
        if label is not None:
            # components that had no edge left keep their label
            gone = label.select(F.col("id").alias("parent"), F.col("parent").alias("top"))
            stay = roots.select("parent").distinct().join(label.select(F.col("id").alias("parent")), "parent", "left_anti").withColumn("top", F.col("parent"))
            step = _up(step, gone.unionByName(stay), hot).select("id", F.col("top").alias("parent"))
        label = step
    loops = links.filter("u = v").select(F.col("u").alias("id"), F.col("u").alias("parent"))
    if label is None:
        return loops.select(F.col("id").alias("record_id"), F.col("parent").alias("group_id"))
    label = cut(label)
    for roots, _ in maps:
        forget(roots)
    least = label.groupBy("parent").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("members"))
    grouped = split_join(label, least, ["parent"], "members", label.count()).select(F.col("id").alias("record_id"), "group_id")
    alone = loops.join(label.select("id"), "id", "left_anti")
    return grouped.unionByName(alone.select(F.col("id").alias("record_id"), F.col("parent").alias("group_id")))
