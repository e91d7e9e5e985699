"""Files as sources and sinks: discovery, hashing, page extraction, chunk and failure tables, versioned manifests."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from paperloom import config as C
from paperloom.functions.text import folder_collection

MANIFEST = "path string, category string, collection string, sha256 string, size long, mtime double, chunk_ids array<string>, chunk_count int, indexed_at string"
CHUNK = "id string, text string, metadata struct<source: string, page: int, article: string, category: string, collection: string>"
#: A page parser takes a file's bytes and gives the texts of its pages; it may raise.
Parser = Callable[[bytes], list[str]]


def discover(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """(path, category, collection, size, mtime) of the files below the first-level folders of ``root``, by file status alone.

    Folders whose names start with '.' or '__' are left out; files that lie in ``root`` itself have no category.
    """
    root = root.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.element_at(F.split(F.col("path"), F.lit(root.split("://")[-1] + "/"), 2), -1)
    category = F.when(F.instr(rel, "/") > 0, F.substring_index(rel, "/", 1))
    f = f.select("path", category.alias("category"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("us"))
    f = f.where(F.col("category").isNotNull() & ~F.col("category").startswith(".") & ~F.col("category").startswith("__"))
    return f.select("path", "category", folder_collection(F.col("category")).alias("collection"), "size", (F.col("us") / 1e6).alias("mtime"))


def contents(spark: SparkSession, paths: DataFrame, root: str, glob: str = "*.pdf", most: int = C.MAX_FILE_BYTES) -> DataFrame:
    """(path, sha256, size, content) of the files named in ``paths``; files over ``most`` bytes are left out before they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).where(F.col("length") <= most)
    return f.join(paths.select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def plain_text_parser(data: bytes) -> list[str]:
    """Pages of a text file, parted by form feeds."""
    return data.decode("utf-8").split("\f")


def pdf_parser(data: bytes) -> list[str]:
    """Pages of a PDF by whichever library there is."""
    try:
        import pymupdf

        with pymupdf.open(stream=data, filetype="pdf") as doc:
            return [page.get_text() for page in doc]
    except ImportError:
        import io

        import pypdf

        return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages]


def extract_pages(files: DataFrame, parsers: list[Parser], few: int = 50) -> DataFrame:
    """(path, page, text, error): the pages of each file, or one row with an error.

    Parsers are tried in turn until one gives ``few`` characters a page; the best result counts if none does. A file that no
    parser reads gives a row without page. Nothing raises, so that one bad file doesn't end a job.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, data in zip(b["path"], b["content"]):
                best, errors = None, []
                for parse in parsers:
                    try:
                        pages = parse(bytes(data))
                    except Exception as e:  # noqa: BLE001 - a parser may raise anything
                        errors.append(f"{type(e).__name__}: {e}")
                        continue
                    if best is None or sum(map(len, pages)) > sum(map(len, best)):
                        best = pages
                    if sum(map(len, pages)) >= few * max(1, len(pages)):
                        break
                rows += [(path, i, t, None) for i, t in enumerate(best, 1)] if best else [(path, None, None, "; ".join(errors) or "no pages")]
            out = pd.DataFrame(rows, columns=["path", "page", "text", "error"])
            yield out.astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def read_manifest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A manifest file of entries; lines that are no JSON or lack a path are left out, a missing file is an empty manifest. With ``strict`` such lines fail the read."""
    try:
        df = spark.read.schema(MANIFEST + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    if strict and df.select("path", "_bad").where("_bad IS NOT NULL OR path IS NULL").limit(1).count():
        raise ValueError(f"{path} has lines that are no entries")
    return df.where("_bad IS NULL AND path IS NOT NULL").drop("_bad")


def save_manifest(df: DataFrame, path: str, version: int) -> str:
    """Write a new version beside the earlier ones; readers go by the newest finished one (:func:`newest_manifest`)."""
    target = f"{path}/version={version}"
    df.write.mode("overwrite").json(target)
    return target


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The number of the newest finished version at ``path``."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=None)


def newest_manifest(spark: SparkSession, path: str) -> DataFrame:
    n = newest_version(spark, path)
    return read_manifest(spark, f"{path}/version={n}") if n is not None else spark.createDataFrame([], MANIFEST)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk JSONL as flat columns; blank lines and lines without id are left out, repeated ids kept."""
    df = spark.read.schema(CHUNK).json(path).where("id IS NOT NULL")
    return df.select("id", "text", "metadata.*")


def write_chunks(pages_or_chunks: DataFrame, path: str) -> dict[str, int]:
    """Rows with an error go to ``path``/failed as TSV, the others to ``path``/chunks as JSONL; the counts come back, and are kept in ``path``/stats.

    What an earlier run wrote is kept under the same names with ``.bak``.
    """
    spark = pages_or_chunks.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for part in ("chunks", "failed", "stats"):
        at, old = (jvm.org.apache.hadoop.fs.Path(f"{path}/{part}{end}") for end in ("", ".bak"))
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            fs.delete(old, True)
            fs.rename(at, old)
    ok = pages_or_chunks.where("error IS NULL").drop("error")
    bad = pages_or_chunks.where("error IS NOT NULL").select("path", "error").distinct()
    ok.write.mode("overwrite").json(f"{path}/chunks")
    bad.write.mode("overwrite").option("sep", "\t").csv(f"{path}/failed")
    out = {"chunks": spark.read.schema(ok.schema).json(f"{path}/chunks").count(), "failed": spark.read.schema("path string, error string").option("sep", "\t").csv(f"{path}/failed").count()}
    spark.createDataFrame([tuple(out.values())], "chunks long, failed long").coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return out


class DocumentCounts:
    """Documents per collection of the newest manifest at ``path``, counted once per version; while that can't be read the last counts stay."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.version, self.counts = spark, path, None, {}

    def __call__(self) -> dict[str, int]:
        from paperloom.operators.ingest import documents_per_collection

        try:
            version = newest_version(self.spark, self.path)
            if version is not None and version != self.version:
                rows = documents_per_collection(read_manifest(self.spark, f"{self.path}/version={version}", strict=True)).collect()  # a row per collection
                self.counts, self.version = {r[0]: r[1] for r in rows}, version
        except Exception as e:  # noqa: BLE001 - whatever is wrong with the file, the last counts are better than none
            self.error = e
        return dict(self.counts)


class UsageReport(DataSource):
    """A paginated report as a table of its ``data`` entries: option ``url``, ``pages`` (at most 20), ``header.<name>`` for headers.

    Pages follow each other by the ``next_page`` of the one before, so that one task reads them all. ``file:`` urls name a folder with
    ``page-<cursor>.json``, first ``page-.json``.
    """

    @classmethod
    def name(cls) -> str:
        return "usage_report"

    def schema(self) -> str:
        return "starting_at string, results string"

    def reader(self, schema) -> DataSourceReader:
        return _UsageReader(dict(self.options))


class _UsageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.parse import quote
        from urllib.request import Request, urlopen

        url, cursor = self.options["url"], ""
        headers = {k.split(".", 1)[1]: v for k, v in self.options.items() if k.startswith("header.")}
        for _ in range(min(int(self.options.get("pages", 20)), 20)):
            at = f"{url}/page-{quote(cursor)}.json" if url.startswith("file:") else f"{url}{'&' if '?' in url else '?'}page={quote(cursor)}" if cursor else url
            with urlopen(Request(at, headers=headers), timeout=30) as got:  # noqa: S310
                page = json.load(got)
            for row in page.get("data", []):
                yield row.get("starting_at"), json.dumps(row.get("results", []))
            cursor = page.get("next_page") or ""
            if not page.get("has_more") or not cursor:
                return
