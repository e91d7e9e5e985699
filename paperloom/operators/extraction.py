"""From pages to chunks with labels, ids and vectors: the extraction as one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.models import embed, hashed_embedder
from paperloom.operators import chunking
from paperloom.sources import files as S


def structured_pages(pages: DataFrame, key: str = "file") -> DataFrame:
    """(key, page, idx, id, article, text): the chunks of each file's pages.

    ``pages`` holds key, page, idx, text. Pages are cleaned, blank ones dropped, the others joined over their boundaries, cut by structure, labelled; noise
    is dropped, and what is left numbered through the file. The page of a chunk is that on which its joined text began.
    """
    clean = pages.where("page IS NOT NULL").select(key, "page", "idx", T.clean_page(F.col("text")).alias("text"))
    whole = chunking.merge_pages(clean, key)
    parts = chunking.structured_chunks(whole.select(F.struct(key, "island", "page").alias("k"), "text"), "k")
    parts = parts.select("k.*", F.col("idx").alias("part"), F.col("chunk").alias("text")).where(~T.is_noise(F.col("text")))
    n = F.row_number().over(Window.partitionBy(key).orderBy("island", "part")) - 1
    return parts.withColumn("idx", n).select(key, "page", "idx", T.chunk_id(F.col(key), F.col("page"), F.col("idx")).alias("id"), T.article(F.col("text")).alias("article"), "text")


def parse_and_embed(files: DataFrame, parsers: list[S.Parser], make: Callable = hashed_embedder) -> DataFrame:
    """(path, page, idx, id, article, text, embedding, error): chunks with their vectors of (path, content), or one row with an error for a file that
    no parser reads; ``make`` gives the embedder once per task."""
    pages = S.extract_pages(files, parsers)
    good = structured_pages(pages.where("error IS NULL").select("path", "page", F.lit(0).alias("idx"), "text"), "path")
    good = good.withColumn("embedding", embed(F.col("text"), make)).withColumn("error", F.lit(None).cast("string"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema.fields if f.name not in ("path", "error")]
    return good.unionByName(pages.where("error IS NOT NULL").select("path", *none, "error"))
