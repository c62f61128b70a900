"""Embeddings and exact vector search as column expressions; approximate search over everything is in the llm package."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, of length zero or of another dimension."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), dot(a, b) / lengths)


def top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = 10, threshold: float | None = None, strict: bool = False) -> DataFrame:
    """(key, similarity) of the k vectors most similar to the query, by cosine from the threshold on (above it if strict); ties by key."""
    similarity = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    rows = vectors.select(key, similarity.alias("similarity")).filter("similarity IS NOT NULL")
    if threshold is not None:
        rows = rows.filter(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)
    return rows.orderBy(F.desc("similarity"), key).limit(k)


def top_k_inner(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """(key, score) of the k largest inner products."""
    rows = vectors.filter(F.size(vector) == len(query)).select(key, dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return rows.orderBy(F.desc("score"), key).limit(k)


@lru_cache(maxsize=500_000)
def word_place(word: str) -> int:
    """The first 8 bytes of a word's md5 as a number: its place is the remainder by the dimension, its sign the lowest bit of the upper half."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")


def hashed_vector(text: str, dimension: int = 384) -> np.ndarray:
    """A unit bag-of-words vector of a text; zero for texts without words."""
    hashes = np.array([word_place(w) for w in _WORD.findall(text.lower())], np.uint64)
    vector = np.bincount((hashes % np.uint64(dimension)).astype(np.int64), np.where((hashes >> np.uint64(32)) & np.uint64(1), 1.0, -1.0), dimension)
    length = np.linalg.norm(vector)
    return vector / length if length else vector


def hashed_embedding(text: Column, dimension: int = 384) -> Column:
    """hashed_vector() of a text column in Arrow batches; null for null."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashed_vector(t, dimension))

    return run(text)


def cache_misses(texts: DataFrame, text: str, cached: DataFrame) -> DataFrame:
    """(text_key, text) of distinct texts whose md5 isn't in cached(text_key): what still has to be embedded."""
    wanted = texts.filter(F.col(text).isNotNull()).select(F.md5(text).alias("text_key"), F.col(text).alias("text")).groupBy("text_key").agg(F.min("text").alias("text"))
    return wanted.join(cached.select("text_key").distinct(), "text_key", "left_anti")


def embed_missing(texts: DataFrame, text: str, cached: DataFrame, embedding) -> DataFrame:
    """cached with the embeddings of the misses added; embedding maps a text column to a vector column."""
    fresh = cache_misses(texts, text, cached).select("text_key", embedding(F.col("text")).alias("embedding"))
    return cached.select("text_key", "embedding").unionByName(fresh)


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct documents, chunks with an embedding."""
    docs = chunks.select("document_id").distinct().agg(F.count("document_id").alias("documents"))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded")).crossJoin(docs)
