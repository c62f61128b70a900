"""Text chunking: sliding windows, sentences, semantic packing, pages and chunk statistics.

Windows, sentence splits and page offsets are column expressions and window functions. Semantic packing is a fold over one text's sentences, and
runs in a map over Arrow batches: narrow, one text at a time.

Defined results of odd input: null and blank texts give no chunks; NUL characters are dropped; texts shorter than a window give one chunk; long
texts are read whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.text import collapse, let
from inkspan.operators.vectors import hashed_vector

SIZE, OVERLAP, SMALLEST, LARGEST = 512, 128, 100, 1000


def clean(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def words(text: Column) -> Column:
    """The text's words between blanks."""
    return F.filter(F.split(clean(text), r"\s+"), lambda w: w != "")


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<index, content, start_word, end_word>>: windows of so many words, each overlapping the last; the last one ends with the text."""
    step = size - overlap
    n = F.size(words(text))
    count = F.when(n <= size, F.least(n, F.lit(1))).otherwise(F.ceil((n - overlap) / step))
    return let(
        F.struct(words(text).alias("w"), count.cast("int").alias("k")),
        lambda s: F.when(s["k"] > 0, F.transform(F.sequence(F.lit(0), s["k"] - 1), lambda i: F.struct(
            i.alias("index"), F.array_join(F.slice(s["w"], i * step + 1, F.lit(size)), " ").alias("content"),
            (i * step).alias("start_word"), F.least(i * step + size, F.size(s["w"])).alias("end_word"),
        ))),
    )


def sliding_chunks(rows: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, content, start_word, end_word)."""
    flat = rows.select(key, F.explode(windows(F.col(text), size, overlap)).alias("c"))
    return flat.select(key, F.col("c.index").alias("chunk_index"), "c.content", "c.start_word", "c.end_word")


def sentences(text: Column) -> Column:
    """A text's sentences: cut after `.`, `!` or `?` and white space."""
    marked = F.regexp_replace(F.btrim(clean(text)), r"([.!?])\s+", "$1\x01")
    return F.filter(F.split(marked, "\x01"), lambda s: s != "")


def chunk_id(document: Column, index: Column, content: Column) -> Column:
    return F.md5(F.concat_ws("_", document, index.cast("string"), F.substring(content, 1, 50)))


def fit(rows: DataFrame, content: str = "content", smallest: int = SMALLEST) -> DataFrame:
    """Chunks of at least so many characters, with white space collapsed."""
    return rows.filter(F.length(F.trim(content)) >= smallest).withColumn(content, collapse(F.col(content)))


def page_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, chunk_index, page_number, content, offset): windows of each page, numbered per document, with the characters before the page.

    Running sums are per document; a document's pages are rows of one window partition, which is what a document bounds.
    """
    order = Window.partitionBy("document_id").orderBy("page_number", "page_id")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pages.select("document_id", "page_number", "page_id", "text", before.alias("offset"))
    flat = placed.select("document_id", "page_number", "page_id", "offset", F.explode(windows(F.col("text"), size, overlap)).alias("c"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "page_id", "c.index")) - 1
    return flat.select("document_id", number.alias("chunk_index"), "page_number", "page_id", F.col("c.content").alias("content"), "offset")


def merge_pages(chunks: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(document_id, chunk_index, pages, content): consecutive chunks of consecutive pages joined in pairs, from left to right, while they fit.

    chunks: (document_id, chunk_index, page_number, content). Which chunks are joined depends on the pairs before, but only within a
    run of joinable neighbours: runs are found by window functions, and in a run every second chunk takes its successor. A pair too large
    ends its run, so parity within the run is exact.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    following, next_page = F.lead("content").over(order), F.lead("page_number").over(order)
    joinable = (next_page == F.col("page_number") + 1) & (F.length("content") + F.length(following) <= largest)
    marked = chunks.withColumn("joins", F.coalesce(joinable, F.lit(False))).withColumn("next_content", following).withColumn("next_page", next_page)
    broken = F.when(F.lag("joins", 1, False).over(order), 0).otherwise(1)
    runs = marked.withColumn("run", F.sum(broken).over(order))
    place = F.row_number().over(Window.partitionBy("document_id", "run").orderBy("chunk_index")) - 1
    takes = runs.withColumn("place", place).withColumn("takes", (F.col("place") % 2 == 0) & F.col("joins"))
    taken = (F.col("place") % 2 == 1) & F.lag("takes", 1, False).over(order)
    kept = takes.withColumn("taken", taken).filter(~F.col("taken"))
    number = F.row_number().over(order) - 1
    content = F.when(F.col("takes"), F.concat_ws(" ", "content", "next_content")).otherwise(F.col("content"))
    pages = F.when(F.col("takes"), F.array("page_number", "next_page")).otherwise(F.array("page_number"))
    return kept.select("document_id", number.alias("chunk_index"), pages.alias("pages"), content.alias("content"))


def statistics(chunks: DataFrame) -> DataFrame:
    """(language, chunks, mean_size, least, most, deviation, indicators) by language, and over all in the row with language '*'."""
    size = F.length("content")
    sums = chunks.withColumn("language", F.explode(F.array(F.coalesce("language", F.lit("")), F.lit("*")))).groupBy("language")
    return sums.agg(
        F.count(F.lit(1)).alias("chunks"), F.avg(size).alias("mean_size"), F.min(size).alias("least"), F.max(size).alias("most"), F.stddev_pop(size).alias("deviation"), F.sum("indicators_count").alias("indicators")
    )


def boundaries(vectors: np.ndarray) -> set[int]:
    """Places i + 1 such that sentences i and i + 1 are less similar than the mean by more than a (population) deviation."""
    if len(vectors) < 2:
        return set()
    similar = np.einsum("ij,ij->i", vectors[:-1], vectors[1:])
    return set((np.flatnonzero(similar < similar.mean() - similar.std()) + 1).tolist())


def pack(parts: list[str], cuts: set[int], largest: int = LARGEST, smallest: int = SMALLEST, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(content, start) of chunks of sentences, start being the place of the first one among the sentences joined by blanks.

    With running sums of the sentences' words, every end follows by bisection: a chunk ends with the first cut sentence by which it has `smallest` words, or else
    before it would pass `largest`, in which case the next chunk goes back by the sentences that fit into `overlap` words. A chunk has a new sentence at least.
    """
    words = [0, *accumulate(len(s.split()) for s in parts)]
    places = [0, *accumulate(len(s) + 1 for s in parts)]
    at_cuts = sorted(cuts)
    chunks: list[tuple[str, int]] = []
    first = new = 0
    while new < len(parts):
        full = max(new + 1, bisect_right(words, words[first] + largest) - 1)
        enough = bisect_left(words, words[first] + smallest) - 1
        later = bisect_left(at_cuts, max(new, enough))
        cut = at_cuts[later] + 1 if later < len(at_cuts) else len(parts)
        end = min(cut, full)
        chunks.append((" ".join(parts[first:end]), places[first]))
        first, new = max(first, bisect_left(words, words[end] - overlap)) if full < cut else end, end
    return chunks


def semantic_chunks(rows: DataFrame, key: str, text: str, largest: int = LARGEST, smallest: int = SMALLEST, overlap: int = OVERLAP, dimension: int = 384, embed=None) -> DataFrame:
    """(key, chunk_index, content, start): packed by sentence similarity; embed maps a list of sentences to unit vectors (hashed words unless given)."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, parts in zip(batch["key"], batch["parts"]):
                parts = list(parts)
                vectors = embed(parts) if embed else np.array([hashed_vector(s, dimension) for s in parts])
                out += [(k, i, content, start) for i, (content, start) in enumerate(pack(parts, boundaries(vectors), largest, smallest, overlap))]
            yield pd.DataFrame(out, columns=["key", "chunk_index", "content", "start"])

    parts = rows.select(F.col(key).alias("key"), sentences(F.col(text)).alias("parts")).filter(F.size("parts") > 0)
    return parts.mapInPandas(run, f"key {kind}, chunk_index int, content string, start int").withColumnRenamed("key", key)
