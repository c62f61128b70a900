import numpy as np
from pyspark.sql import functions as F

from inkspan.operators import chunking as K


def python_merge(rows, largest):
    merged, i = [], 0
    while i < len(rows):
        if i + 1 < len(rows) and rows[i + 1][0] == rows[i][0] + 1 and len(rows[i][1]) + len(rows[i + 1][1]) <= largest:
            merged.append(([rows[i][0], rows[i + 1][0]], rows[i][1] + " " + rows[i + 1][1]))
            i += 2
        else:
            merged.append(([rows[i][0]], rows[i][1]))
            i += 1
    return merged


def test_windows(spark):
    words = [f"w{i}" for i in range(10)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, "a\x00b  c")], "id long, text string")
    got = {}
    for r in K.sliding_chunks(rows, "id", "text", 4, 1).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["content"], r["start_word"], r["end_word"]))
    assert got[1] == [("w0 w1 w2 w3", 0, 4), ("w3 w4 w5 w6", 3, 7), ("w6 w7 w8 w9", 6, 10)]
    assert set(got) == {1, 4} and got[4][0][0] == "ab c"


def test_merge_pages_equals_a_fold(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for doc in range(30):
        pages = np.cumsum(rng.integers(1, 3, 12))
        own = [(int(p), "x" * int(rng.integers(1, 60))) for p in pages]
        expected[doc] = python_merge(own, 70)
        rows += [(doc, i, p, c) for i, (p, c) in enumerate(own)]
    frame = spark.createDataFrame(rows, "document_id long, chunk_index int, page_number int, content string")
    got = {}
    for r in K.merge_pages(frame, 70).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append((r["pages"], r["content"]))
    assert got == expected


def test_pack_overlaps_and_cuts():
    parts = ["a b c", "d e f", "g h", "i j k l"]
    assert K.pack(parts, set(), largest=6, smallest=2, overlap=3) == [("a b c d e f", 0), ("d e f g h", 6), ("g h i j k l", 12)]
    assert K.pack(parts, {1}, largest=100, smallest=4, overlap=3) == [("a b c d e f", 0), ("g h i j k l", 12)]
    assert K.pack([], set()) == []


def test_boundaries_use_the_population_deviation():
    v = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1], [0, 1]])
    assert K.boundaries(v) == {2}


def test_semantic_chunks_cover_all_sentences(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    parts = {r["doc_id"]: r["s"] for r in docs.select("doc_id", K.sentences(F.col("text")).alias("s")).collect()}
    text = {}
    for r in K.semantic_chunks(docs, "doc_id", "text", 60, 20, 0).orderBy("doc_id", "chunk_index").collect():
        text.setdefault(r["doc_id"], []).append(r["content"])
    for doc, chunks in text.items():
        assert " ".join(chunks) == " ".join(parts[doc])


def test_fit_and_ids(spark):
    row = spark.createDataFrame([("d", 0, "a  b\n" * 30), ("d", 1, "short")], "document_id string, chunk_index int, content string")
    kept = K.fit(row).collect()
    assert len(kept) == 1 and kept[0]["content"] == " ".join(["a b"] * 30)
    import hashlib

    first = row.select(K.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("content")).alias("i")).first()["i"]
    assert first == hashlib.md5(("d_0_" + ("a  b\n" * 30)[:50]).encode()).hexdigest()
