"""Page layout from characters and cells: lines of text, layout types, tables, images, exports.

Characters come as rows (page key, char, x0, x1, top); tables as array<array<array<string>>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_text(chars: DataFrame, page: str = "page_id", gap: float = 0.3) -> DataFrame:
    """(page, text): characters in lines by their rounded top, from left to right, a blank where the gap passes a share of the last character's width."""
    rows = chars.withColumn("line", F.round("top").cast("long")).groupBy(page, "line").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "char"))).alias("c"))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"), F.lit(0.0).alias("width"))

    def add(acc: Column, c: Column) -> Column:
        space = F.when(c["x0"] - acc["end"] > gap * acc["width"], " ").otherwise("")
        return F.struct(F.concat(acc["text"], F.coalesce(space, F.lit("")), c["char"]).alias("text"), c["x1"].cast("double").alias("end"), (c["x1"] - c["x0"]).cast("double").alias("width"))

    lines = rows.select(page, "line", F.aggregate("c", start, add, lambda a: a["text"]).alias("text"))
    return lines.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l")).select(page, F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def layout_type(chars: DataFrame, width: float, page: str = "page_id") -> DataFrame:
    """(page, layout_type): multi_column if over 30 % of the characters begin in the left and in the right third, single_column if over 60 % in the middle, else mixed."""
    third = width / 3
    n = F.count("x0")
    left, right = F.count_if(F.col("x0") < third), F.count_if(F.col("x0") > 2 * third)
    middle = n - left - right
    kind = F.when(n == 0, "single_column").when((left > 0.3 * n) & (right > 0.3 * n), "multi_column").when(middle > 0.6 * n, "single_column").otherwise("mixed")
    return chars.groupBy(page).agg(kind.alias("layout_type"))


def clean_tables(tables: Column) -> Column:
    """Cells trimmed, null as '', rows without text and tables without rows left out."""
    trimmed = F.transform(tables, lambda t: F.transform(t, lambda r: F.transform(r, lambda c: F.coalesce(F.trim(c), F.lit("")))))
    rows = F.transform(trimmed, lambda t: F.filter(t, lambda r: F.exists(r, lambda c: c != "")))
    return F.filter(rows, lambda t: F.size(t) > 0)


def image_boxes(images: Column) -> Column:
    """Boxes of images with missing numbers as 0."""
    number = lambda i, f: F.coalesce(i[f].cast("double"), F.lit(0.0)).alias(f)
    return F.transform(images, lambda i: F.struct(i["page"].alias("page"), number(i, "x0"), number(i, "y0"), number(i, "width"), number(i, "height"), F.lit("image").alias("object_type")))


def export(texts: Column, tables: Column) -> Column:
    """Page texts joined by blank lines, then each table as a [Table] block with cells by tabs."""
    blocks = F.transform(tables, lambda t: F.concat(F.lit("[Table]\n"), F.array_join(F.transform(t, lambda r: F.array_join(r, "\t")), "\n")))
    return F.array_join(F.concat(texts, F.coalesce(blocks, F.array().cast("array<string>"))), "\n\n")
