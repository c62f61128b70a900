"""Mixing sources to target weights (numbered problem 8).

Orders the texts of several sources so that every stretch of the mixture holds each source in its target share of all tokens; small
sources are repeated, no text more often than its source allows, and the shares reached are reported.

Defined results of odd input: texts without a source, of a source without a target, or blank, are not used; source names are compared in
lower case with `_` for blanks and hyphens; a text stored several times is one text and belongs to the source of its smallest doc_id;
targets that are null or not positive are dropped, repeated ones count once (the largest), missing max_repeats is 1; a target without texts
keeps share 0 and the others share its part in proportion; with no texts or no targets the mixture is empty.

Method: Pfair scheduling. A source's tokens, in a random but fixed order of its texts, are cut into blocks of BLOCK tokens. Of a mixture of B blocks, n of them
from a source, its block i is released at slot floor(i B / n) and due at slot ceil((i + 1) B / n); earliest deadline first fills each slot with
one block, so no source is ever a whole block off its weight. Weights are these whole numbers of blocks: no share is rounded away, however small.
There are at most MOST_BLOCKS blocks, longer mixtures having longer ones, so one task schedules them all. A text's place comes from
running sums of tokens in two levels, by bucket and within it, so that no source is summed in one task; a text that goes on over the end of its block is cut there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.skew import cut, spread

#: Least tokens of a block, and most blocks of a mixture: one of more than 4 thousand million tokens has longer blocks.
BLOCK, MOST_BLOCKS = 4096, 1 << 20
#: Texts in a bucket aimed at.
BUCKET_TEXTS = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def source_name(column: str):
    name = F.regexp_replace(F.lower(F.btrim(column)), r"[\s\-]+", "_")
    return F.when(name != "", name)


def counted_texts(documents: DataFrame, tokenizer_file: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, key, tokens): every different text once, with its size in tokens of the public tokenizer."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer_file, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        tokenizer = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            if len(batch) == 0:
                continue
            sizes = [len(tokenizer.encode_ordinary(text)) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "key": batch["key"], "tokens": sizes})

    rows = documents.select("doc_id", source_name("source").alias("source"), F.md5("text").alias("key"), "text")
    rows = rows.filter((F.length(F.trim("text")) > 0) & F.col("source").isNotNull() & F.col("doc_id").isNotNull())
    kind = documents.schema["doc_id"].dataType.simpleString()
    sizes = spread(rows).mapInPandas(count, f"doc_id {kind}, source string, key string, tokens long")
    return sizes.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"), F.max("tokens").alias("tokens"))


def pfair(blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, number of the block, slot) of every slot, each source having that many blocks: earliest deadline first among those released."""
    total = sum(blocks.values())
    waiting = [(0, s, 0) for s, n in sorted(blocks.items()) if n]
    ready: list[tuple[int, str, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // blocks[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s, i, slot
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * total // blocks[s], s, i + 1))


def slots_of(spark: SparkSession, blocks: dict[str, int]) -> DataFrame:
    """(source, number, slot) of every block."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = pfair(blocks)
        while part := list(islice(slots, 100_000)):
            yield pd.DataFrame(part, columns=["source", "number", "slot"])

    return spark.range(1).coalesce(1).mapInPandas(place, "source string, number long, slot long")


def plan(texts: DataFrame, targets: DataFrame) -> list[dict]:
    """One entry per target source: its share, weight, available and wanted tokens (targets are a small fixed table)."""
    wanted = targets.select(source_name("source").alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    wanted = wanted.filter("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share) AND max_repeats > 0")
    wanted = wanted.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    have = {r["source"]: (r["tokens"], r["texts"]) for r in texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")).join(F.broadcast(wanted), "source", "left_semi").collect()}
    entries = [r.asDict() | {"tokens": have.get(r["source"], (0, 0))[0], "texts": have.get(r["source"], (0, 0))[1]} for r in wanted.orderBy("source").collect()]
    present = [e for e in entries if e["tokens"]]
    covered = sum(e["share"] for e in present)
    # the largest mixture for which every source has tokens enough
    size = min((e["tokens"] * e["max_repeats"] * covered / e["share"] for e in present), default=0)
    for e in entries:
        e["weight"] = e["share"] / covered if e["tokens"] else 0.0
        e["quota"] = int(size * e["weight"])
    return entries


def mixture(documents: DataFrame, targets: DataFrame, tokenizer_file: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """(slot, source, start, doc_id, copy, skipped, tokens): the mixture's texts, each within one block; sorted by slot and start it is the order to read them
    in. A text that goes on over the end of its block is several rows, with the tokens skipped before each."""
    spark = documents.sparkSession
    texts = cut(counted_texts(documents, tokenizer_file))
    entries = [e for e in plan(texts, targets) if e["quota"]]
    if not entries:
        kind = documents.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"slot long, source string, start long, doc_id {kind}, copy int, skipped long, tokens long")
    sources = spark.createDataFrame([(e["source"], e["tokens"], e["quota"]) for e in entries], "source string, available long, quota long")
    block = max(block, -(-sum(e["quota"] for e in entries) // MOST_BLOCKS))
    slots = slots_of(spark, {e["source"]: -(-e["quota"] // block) for e in entries})
    bits = max(1, (sum(e["texts"] for e in entries) // BUCKET_TEXTS).bit_length())

    placed = texts.join(F.broadcast(sources.select("source")), "source").withColumn("order", F.xxhash64("key")).withColumn("bucket", F.shiftrightunsigned("order", 64 - bits))
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    # one row per bucket
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.join(F.broadcast(sources), "source").select("source", "bucket", before.alias("before"), "available", "quota")
    within = Window.partitionBy("source", "bucket").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.join(sums, ["source", "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("quota") - 1 - F.col("at")) / F.col("available"))).cast("int"))
    copies = at.filter((F.col("at") < F.col("quota")) & (F.col("tokens") > 0)).withColumn("pass", F.explode(passes))
    copies = copies.withColumn("begin", F.col("at") + F.col("pass") * F.col("available")).filter(F.col("begin") < F.col("quota"))
    end = F.least(F.col("begin") + F.col("tokens"), F.col("quota"))
    copies = copies.withColumn("end", end).withColumn("number", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))))
    start = F.greatest(F.col("begin"), F.col("number") * block)
    pieces = copies.withColumn("start", start).withColumn("size", F.least(F.col("end"), (F.col("number") + 1) * block) - F.col("start"))
    return pieces.join(slots, ["source", "number"]).select("slot", "source", "start", "doc_id", (F.col("pass") + 1).alias("copy"), (F.col("start") - F.col("begin")).alias("skipped"), F.col("size").alias("tokens"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, texts, most_copies) of every target source."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("texts"), F.max("copy").alias("most_copies"))
    wanted = targets.select(source_name("source").alias("source"), "target_share").filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"))
    joined = wanted.join(got, "source", "left").fillna(0, ["tokens", "texts", "most_copies"])
    total = joined.agg(F.sum("tokens").alias("all"))
    return joined.crossJoin(F.broadcast(total)).select("source", "target_share", F.coalesce(F.col("tokens") / F.nullif("all", F.lit(0)), F.lit(0.0)).alias("actual_share"), "tokens", "texts", "most_copies")
