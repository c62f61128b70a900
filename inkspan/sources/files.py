"""Reading document files and writing documents and embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of files that may be read, and most bytes of one.
ENDINGS, LARGEST = ("pdf", "txt", "json", "csv"), 100 * 1024 * 1024


def files(spark: SparkSession, folder: str, largest: int = LARGEST) -> DataFrame:
    """(path, file_hash, size, is_pdf, content) of the readable files below a folder: known endings, no `..` in the path, not too large."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(folder)
    kept = rows.filter((F.col("length") <= largest) & ~F.col("path").contains(".."))
    return kept.select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"), "content")


def parsed(rows: DataFrame, parser: Callable[[bytes], list[str]] | None = None, most_pages: int = 1000) -> DataFrame:
    """(path, file_hash, page_number, text, layout_type): pages of files; a file the parser fails on is read as plain text, layout 'unknown'.

    parser maps a file's bytes to its pages' texts; without one PDF files have no pages. Documents of more than most_pages pages are left out.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, digest, is_pdf, content in zip(batch["path"], batch["file_hash"], batch["is_pdf"], batch["content"]):
                pages, layout = None, "single_column"
                if parser is not None and is_pdf:
                    try:
                        pages = parser(bytes(content))
                    except Exception:  # whatever a parser meets in a broken file
                        pages = None
                if pages is None:
                    layout = "unknown"
                    pages = [] if is_pdf else bytes(content).decode("utf-8", "replace").split("\f")
                if len(pages) <= most_pages:
                    out += [(path, digest, n, text, layout) for n, text in enumerate(pages, 1)]
            yield pd.DataFrame(out, columns=["path", "file_hash", "page_number", "text", "layout_type"])

    return rows.select("path", "file_hash", "is_pdf", "content").mapInPandas(run, "path string, file_hash string, page_number int, text string, layout_type string")


def write_documents(documents: DataFrame, pages: DataFrame, path: str) -> None:
    """Documents with their pages nested, one JSON object a line."""
    nested = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "text", "layout_type", "language"))).alias("pages"))
    documents.join(nested.withColumnRenamed("document_id", "doc_id"), "doc_id", "left").write.mode("overwrite").json(path)


def write_embeddings(vectors: DataFrame, path: str, model: str, dimension: int) -> None:
    """(id, embedding) rows with the model they come from, as JSON lines."""
    vectors.select(F.lit(model).alias("model_name"), F.lit(dimension).alias("dimension"), "id", "embedding").write.mode("overwrite").json(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model_name string, dimension int, id string, embedding array<double>").json(path)


def page_metadata(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with `details`, the struct (title, author, subject, creator, producer, created, modified, pages) that the head of an HTML text or a parser's JSON in `metadata` names; null where it names none."""

    def named(name: str, *meta: str):
        tags = [F.nullif(F.regexp_extract(text, rf"(?is)<meta\s+name=[\"']{m}[\"']\s+content=[\"']([^\"']*)[\"']", 1), F.lit("")) for m in meta]
        given = [F.get_json_object("metadata", f"$.{k}") for k in (name, *meta)] if "metadata" in rows.columns else []
        return F.coalesce(*given, *tags, F.lit(None).cast("string"))

    title = F.coalesce(named("title", "title"), F.nullif(F.btrim(F.regexp_replace(F.regexp_extract(text, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit("")))
    fields = [title.alias("title"), *(named(n, *m).alias(n) for n, m in (("author", ("author",)), ("subject", ("subject", "description")), ("creator", ("creator",)), ("producer", ("producer", "generator")), ("created", ("creationDate", "created")), ("modified", ("modDate", "modified"))))]
    return rows.withColumn("details", F.struct(*fields, named("pages", "pages").try_cast("int").alias("pages")))
